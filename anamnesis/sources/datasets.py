"""Readers and writers of the engine's file formats: JSON, JSON lines, CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURN = "struct<speaker:string,text:string,event_time:string>"
QA = "struct<question:string,answer:string,gold_fact:string,gold_facts:array<string>,category:string,abstention:boolean>"
DATASET = f"samples array<struct<sample_id:string,sessions:array<array<{TURN}>>,qa:array<{QA}>>>"
SCENARIOS = (
    "scenarios array<struct<id:string,tenant_id:string,writers:array<struct<agent_id:string,facts:array<string>,steps:array<struct<tool_name:string,outcome:string>>>>,"
    "reader:struct<agent_id:string,task:string,read_agent_ids:array<string>,via:string,max_memory_tokens:int>,gold_facts:array<string>,gold_tools:array<string>>>"
)


def read_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(turns, questions) of a {samples: [...]} file."""
    samples = spark.read.schema(DATASET).json(path, multiLine=True).select(F.explode("samples").alias("s"))
    sessions = samples.select("s.sample_id", F.posexplode("s.sessions").alias("session", "turns"))
    turns = sessions.select("sample_id", "session", F.posexplode("turns").alias("turn", "t")).select("sample_id", "session", "turn", "t.*")
    questions = samples.select("s.sample_id", F.posexplode("s.qa").alias("nth", "q")).select("sample_id", "nth", "q.*")
    return turns, questions


def read_items(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Items of a file that is either JSON lines or one JSON array."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    is_array = F.col("v").startswith("[")
    items = text.select(F.when(is_array, F.from_json("v", f"array<struct<{schema}>>")).otherwise(F.transform(F.filter(F.split("v", "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, f"struct<{schema}>"))).alias("items"))
    return items.select(F.explode("items").alias("i")).select("i.*")


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCENARIOS).json(path, multiLine=True).select(F.explode("scenarios").alias("s")).select("s.*")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)
