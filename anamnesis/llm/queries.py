"""The operators as queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from anamnesis.llm import oracles
from anamnesis.llm.chat import op3_chat
from anamnesis.llm.html_text import op7_html
from anamnesis.llm.license_scan import op8_license_scan
from anamnesis.llm.mixing import op10_mixing
from anamnesis.llm.pieces import op6_sentencepiece
from anamnesis.llm.pii import op1_pii
from anamnesis.llm.png_media import op5_media
from anamnesis.llm.quality import op4_quality
from anamnesis.llm.secret_scan import op9_secret_scan
from anamnesis.llm.simhash import op2_simhash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pii, op2_simhash, op3_chat, op4_quality, op5_media, op6_sentencepiece, op7_html, op8_license_scan, op9_secret_scan, op10_mixing)
}
ORACLE_SQL: dict[str, str] = {"op4_quality": oracles.QUALITY, "op8_license_scan": oracles.LICENSES}
