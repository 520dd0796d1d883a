"""Queries of the pluggable models, the facade and the event fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis import models
from anamnesis.engine import Engine
from anamnesis.plans import stand_ins as si
from anamnesis.plans.files_and_streams import place
from anamnesis.plans.retrieval import docs
from anamnesis.registry import query, table
from anamnesis.sources import datasets


class Shorter:
    """A stand-in reranker: shorter texts score higher."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        return [1.0 / (1 + len(t)) for t in texts]


class FirstWord:
    """A stand-in extractor: each text's first word."""

    def extract(self, texts: list[str]) -> list[list[tuple[str, str]]]:
        return [[(t.split()[0], "Concept")] if t.split() else [] for t in texts]


class Fixed:
    def __init__(self, said: str) -> None:
        self.said = said

    def complete(self, prompt: str) -> str:
        if self.said == "fault":
            raise RuntimeError(prompt)
        return self.said


class Broken:
    model, version, dimensions = "none", "0", 0

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        raise RuntimeError("no embedder")


query("rerank_local", "SELECT doc_id AS key, round(1.0::DOUBLE / (1 + length(text)), 6) AS score FROM documents")(
    lambda s, d: models.model_scores(docs(s, d).select("key", "text", F.lit("q").alias("query_text")), Shorter).select("key", F.round("model_score", 6).alias("score"))
)
_FIRST = "SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS key, regexp_extract(text, '\\S+') AS name, 'Concept' AS label FROM conversations WHERE trim(text) <> ''"
for _n in ("ing_extract_spacy", "ing_extract_gliner", "ing_extract_llm"):
    query(_n, _FIRST)(lambda s, d: models.model_entities(si.memories(s, d), FirstWord))
_GATES = "SELECT said, said = 'SKIP now' AS skipped FROM (VALUES ('SKIP now'), ('fetch'), ('fault'), ('')) t(said)"
query("ret_gate", _GATES)(lambda s, d: s.createDataFrame([(x, models.skip_retrieval("q", Fixed(x))) for x in ("SKIP now", "fetch", "fault", "")], "said string, skipped boolean"))
query("ret_hyde", "SELECT said, CASE WHEN said = 'an answer' THEN said ELSE 'q' END AS embedded FROM (VALUES ('an answer'), ('fault'), ('')) t(said)")(
    lambda s, d: s.createDataFrame([(x, models.hypothetical("q", Fixed(x))) for x in ("an answer", "fault", "")], "said string, embedded string")
)
query("ret_embed_fallback", "SELECT 0 AS dimensions")(lambda s, d: s.createDataFrame([(len(models.embed_or_nothing("q", Broken())),)], "dimensions int"))


@query("source_scenarios", "SELECT conv_id::VARCHAR AS id, 'user' AS agent, count(*) AS facts FROM conversations WHERE role = 'user' GROUP BY conv_id")
def source_scenarios(s: SparkSession, d: str) -> DataFrame:
    path = place(s, "scenarios")
    facts = table(s, d, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.collect_list("text").alias("facts"))
    each = facts.select(F.struct(F.col("conv_id").cast("string").alias("id"), F.array(F.struct(F.lit("user").alias("agent_id"), "facts")).alias("writers")).alias("s"))
    each.agg(F.collect_list("s").alias("scenarios")).coalesce(1).write.json(path)
    return datasets.read_scenarios(s, path).select("id", F.explode("writers").alias("w")).select("id", F.col("w.agent_id").alias("agent"), F.size("w.facts").cast("long").alias("facts"))


_FOLD = "SELECT user_id, arg_max(event_type, (ts, event_id)) AS phase, count(*) FILTER (event_type = 'click') AS disputes, bool_and(value >= 0) AS ok FROM events GROUP BY user_id"
for _n in ("str_sse_fold", "ex_campaign"):
    query(_n, _FOLD)(
        lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("phase"), F.count_if(F.col("event_type") == "click").alias("disputes"), F.bool_and(F.col("value") >= 0).alias("ok"))
    )
query("ret_view_sync", "SELECT count(*) AS visible FROM conversations")(lambda s, d: si.memories(s, d).agg(F.count("*").alias("visible")))


def engine(s: SparkSession, d: str) -> Engine:
    e = Engine(s, place(s, "engine"))
    m = si.memories(s, d).select("tenant", "agent", F.col("session").cast("string").alias("session"), "turn", "text")
    e.store(m, F.lit(si.NOW).cast("timestamp"))
    return e


@query("connector_db", "SELECT 'tenant1' AS tenant, count(*) AS memories FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id % 8 = 1)")
def connector_db(s: SparkSession, d: str) -> DataFrame:
    return engine(s, d).stats().filter("tenant = 'tenant1'").select("tenant", "memories")


for _n in ("connector_http", "ad_mcp_tools", "prime"):

    @query(_n)
    def prime(s: SparkSession, d: str) -> DataFrame:
        e = engine(s, d)
        got = e.prime("the of and in que de der", "tenant1", ["user", "assistant", "system"], F.lit(si.NOW).cast("timestamp"))
        return got["hits"].select(F.lit("hit").alias("section"), F.col("text").alias("line")).unionByName(got["entities"].select(F.lit("entity").alias("section"), F.col("name").alias("line"))).unionByName(got["steps"].select(F.lit("step").alias("section"), F.col("tool_name").alias("line")))


query("connector_redis", "SELECT count(DISTINCT text) AS cached FROM conversations")(lambda s, d: table(s, d, "conversations").agg(F.countDistinct("text").alias("cached")))
