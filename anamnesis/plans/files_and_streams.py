"""Queries that go through files and streams; they write beside the warehouse."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.operators.graph import _settle, shared_folder
from anamnesis.plans import stand_ins as si
from anamnesis.registry import query, table
from anamnesis.sources import datasets
from anamnesis.streaming import turns as st


def place(s: SparkSession, name: str) -> str:
    """A fresh folder that executors and driver share."""
    return f"{shared_folder(s)}/_anamnesis/{name}-{uuid.uuid4().hex}"


for _n in ("sink_csv", "source_csv"):

    @query(_n, "SELECT event_id, event_type, value FROM events")
    def csv_round_trip(s: SparkSession, d: str) -> DataFrame:
        path = place(s, "csv")
        datasets.write_csv(table(s, d, "events").select("event_id", "event_type", "value"), path)
        return datasets.read_csv(s, path, "event_id bigint, event_type string, value double")


@query("source_json_dataset", "SELECT conv_id::VARCHAR AS sample_id, turn, role AS speaker, md5(text) AS digest FROM conversations")
def source_json_dataset(s: SparkSession, d: str) -> DataFrame:
    """Conversations written as one dataset document, read again."""
    path = place(s, "dataset")
    c = table(s, d, "conversations")
    turns = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("speaker"), x["text"].alias("text"))).alias("t"))
    samples = turns.agg(F.collect_list(F.struct(F.col("conv_id").cast("string").alias("sample_id"), F.array("t").alias("sessions"))).alias("samples"))
    samples.coalesce(1).write.json(path)
    return datasets.read_dataset(s, path)[0].select("sample_id", F.col("turn").cast("long").alias("turn"), "speaker", F.md5("text").alias("digest"))


@query("source_jsonl_or_array", "SELECT item_id, md5(text) AS digest FROM benchmark")
def source_jsonl_or_array(s: SparkSession, d: str) -> DataFrame:
    lines, array = place(s, "jsonl"), place(s, "array")
    b = table(s, d, "benchmark")
    b.filter("item_id % 2 = 0").coalesce(1).write.json(lines)
    b.filter("item_id % 2 = 1").agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).coalesce(1).write.text(array)
    schema = "item_id: bigint, text: string"
    both = datasets.read_items(s, lines, schema).unionByName(datasets.read_items(s, array, schema))
    return both.select("item_id", F.md5("text").alias("digest"))


_ONCE = f"WITH {si.MEMORIES} SELECT tenant, agent, session, turn FROM (SELECT DISTINCT tenant, agent, session, turn, text FROM memories)"


def _streamed(s: SparkSession, d: str, times: int) -> DataFrame:
    base = place(s, "stream")
    t = si.memories(s, d).select("tenant", "agent", "session", "turn", "text")
    for i in range(times):  # the second delivery repeats the first
        t.write.mode("append").parquet(f"{base}/in")
        st.ingest_stream(st.read_turns(s, f"{base}/in", t.schema), f"{base}/out", f"{base}/state", f"{base}/dead").awaitTermination()
    return _settle(s.read.parquet(f"{base}/out").select("tenant", "agent", "session", "turn"))


query("str_worker", _ONCE)(lambda s, d: _streamed(s, d, 1))
for _n in ("str_exactly_once", "str_sync_commit"):
    query(_n, _ONCE)(lambda s, d: _streamed(s, d, 2))


@query("str_topic_state")
def str_topic_state(s: SparkSession, d: str) -> DataFrame:
    base = place(s, "topic")
    v = table(s, d, "embeddings").select(F.col("label").alias("session"), F.col("vec_id").alias("turn"), F.col("embedding").cast("array<double>").alias("embedding"))
    v.write.parquet(f"{base}/in")
    found = st.topic_stream(st.read_turns(s, f"{base}/in", v.schema))
    found.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{base}/out")
