"""Streams of turns: effectively-once ingestion, dead letters, topic state."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.operators.ingest import BLEND, SHIFT, episodes

RETRIES, BACKOFF_S = 5, 0.5


def attempt(work: Callable[[], None], bury: Callable[[Exception], None], retries: int = RETRIES, backoff_s: float = BACKOFF_S) -> None:
    """Run, again after growing pauses on a fault; after the last, bury."""
    for n in range(retries):
        try:
            return work()
        except Exception as fault:
            if n + 1 == retries:
                return bury(fault)
            time.sleep(backoff_s * 2**n)
    return None


def ingest_stream(turns: DataFrame, out: str, checkpoint: str, dead: str, retries: int = RETRIES, backoff_s: float = BACKOFF_S):  # noqa: ANN201
    """Write a stream of turns as episodes under ``out``; returns the query.

    Each batch goes to a folder of its own that a replay overwrites, without the
    keys that earlier batches hold: at least once and idempotent. A batch that
    keeps failing goes to the dead letters with its error.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession

        def work() -> None:
            new = episodes(batch)
            folder = spark._jvm.org.apache.hadoop.fs.Path(out)
            files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
            if files.exists(folder):
                old = spark.read.parquet(out).filter(F.col("batch") != number).select("key")
                new = new.join(old, "key", "left_anti")
            new.write.mode("overwrite").parquet(f"{out}/batch={number}")

        def bury(fault: Exception) -> None:
            batch.withColumn("error", F.lit(str(fault)[:500])).withColumn("attempts", F.lit(retries)).write.mode("overwrite").parquet(f"{dead}/batch={number}")

        attempt(work, bury, retries, backoff_s)

    return turns.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def topic_stream(turns: DataFrame, group: str = "session", shift: float = SHIFT, blend: float = BLEND) -> DataFrame:
    """(session, turn, shift) with the running topic as each session's state.

    Within a batch a session's turns are taken in order."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kinds = {f.name: f.dataType.simpleString() for f in turns.schema}

    def track(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import numpy as np

        topic = np.array(state.get[0]) if state.exists else None
        rows, out = pd.concat(list(parts)).sort_values("turn"), []
        for row in rows.itertuples():
            vec = np.asarray(row.embedding, dtype=float)
            moved = False
            if topic is not None:
                size = float(np.linalg.norm(vec) * np.linalg.norm(topic))
                moved = (float(vec @ topic) / size if size else 0.0) < shift
            topic = vec if topic is None or moved else blend * vec + (1 - blend) * topic
            out.append((key[0], row.turn, moved))
        state.update((topic.tolist(),))
        yield pd.DataFrame(out, columns=[group, "turn", "shift"])

    return turns.select(group, "turn", "embedding").groupBy(group).applyInPandasWithState(track, f"{group} {kinds[group]}, turn long, shift boolean", "topic array<double>", "append", GroupStateTimeout.NoTimeout)


def read_turns(spark: SparkSession, folder: str, schema: str, name: str = "*") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", 100).parquet(folder)
