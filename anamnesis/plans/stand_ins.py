"""The memory engine's tables made of the driver's tables, in Spark and in SQL.

Conversations are memory turns, suppliers are entities that orders relate,
events are tool steps and accesses; the SQL beside each is its oracle's CTE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.registry import table

NOW = "2024-03-01 00:00:00"
#: Searches take every row whose id is divisible by this as a query, against all rows.
EVERY = 20
NOW_SQL = f"TIMESTAMP '{NOW}'"

MEMORIES = """memories AS (
  SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS key, 'tenant' || (conv_id % 8)::VARCHAR AS tenant,
         role AS agent, conv_id AS session, turn, text,
         make_timestamp((1704067200 + 3600 * conv_id + 60 * turn) * 1000000) AS created_at,
         CASE WHEN (conv_id + turn) % 3 = 0 THEN 'working' ELSE 'episodic' END AS type
  FROM conversations)"""

ENTITIES = """entities AS (
  SELECT s_suppkey AS key, s_name AS name, 'label' || (s_nationkey % 5)::VARCHAR AS label,
         'tenant' || (s_nationkey % 4)::VARCHAR AS tenant, coalesce(m.mention_count, 0)::BIGINT AS mention_count,
         coalesce(1 - pow(0.5, m.reliability_sum), 0) AS belief, (s_suppkey % 7 = 0) AS needs_review
  FROM supplier LEFT JOIN (
    SELECT l_suppkey, count(DISTINCT l_orderkey) AS mention_count, 0.05 * count(DISTINCT l_orderkey) AS reliability_sum
    FROM lineitem GROUP BY l_suppkey) m ON s_suppkey = m.l_suppkey)"""

RELATES = """mentions AS (SELECT DISTINCT l_orderkey AS memory, l_suppkey AS entity FROM lineitem),
relates AS (
  SELECT a.entity AS lo, b.entity AS hi, count(*) AS corroboration, 0.1 * count(*) AS reliability_sum,
         1 - pow(0.5, 0.1 * count(*)) AS belief
  FROM mentions a JOIN mentions b ON a.memory = b.memory AND a.entity < b.entity GROUP BY a.entity, b.entity)"""

DOC_MEMORIES = """docmem AS (
  SELECT doc_id AS key, text, 1.0::DOUBLE AS strength, TIMESTAMP '2024-01-01' + to_minutes(n_chars) AS accessed_at,
         CASE WHEN doc_id % 3 = 0 THEN 'working' ELSE 'episodic' END AS type FROM documents)"""

STEPS = """steps AS (
  SELECT sha256('t' || chr(31) || (user_id % 50)::VARCHAR || chr(31) || event_type || chr(31) || CASE WHEN value > 50 THEN 'success' ELSE 'failure' END) AS key,
         (user_id % 50)::VARCHAR AS agent, event_type AS tool_name, CASE WHEN value > 50 THEN 'success' ELSE 'failure' END AS outcome,
         count(*) AS use_count, max(ts) AS last_used_at, arg_max(props, (ts, event_id)) AS arguments
  FROM events GROUP BY ALL)"""


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"),
        F.concat(F.lit("tenant"), (F.col("conv_id") % 8).cast("string")).alias("tenant"),
        F.col("role").alias("agent"), F.col("conv_id").alias("session"), "turn", "text",
        F.timestamp_seconds(1704067200 + 3600 * F.col("conv_id") + 60 * F.col("turn")).cast("timestamp_ntz").alias("created_at"),
        F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, "working").otherwise("episodic").alias("type"),
    )


def doc_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories, last used as many minutes into 2024 as they have characters."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("key"), "text", F.lit(1.0).alias("strength"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("n_chars").cast("int"))).alias("accessed_at"),
        F.when(F.col("doc_id") % 3 == 0, "working").otherwise("episodic").alias("type"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentioned = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey").distinct().groupBy("l_suppkey").agg(F.count("*").alias("mention_count"))
    s = table(spark, sf_dir, "supplier").join(mentioned, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return s.select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"),
        F.concat(F.lit("label"), (F.col("s_nationkey") % 5).cast("string")).alias("label"),
        F.concat(F.lit("tenant"), (F.col("s_nationkey") % 4).cast("string")).alias("tenant"),
        F.coalesce("mention_count", F.lit(0)).alias("mention_count"),
        F.coalesce(1 - F.pow(F.lit(0.5), 0.05 * F.col("mention_count")), F.lit(0.0)).alias("belief"),
        (F.col("s_suppkey") % 7 == 0).alias("needs_review"),
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for memories, their suppliers for the entities named there."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("memory"), F.col("l_suppkey").alias("entity")).distinct()


def relates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of entities in one memory: an order has seven lines at most, so the
    pairs are made of one small array a memory, not of a self-join."""
    per = mentions(spark, sf_dir).groupBy("memory").agg(F.array_sort(F.collect_list("entity")).alias("e"))
    pairs = F.flatten(F.transform("e", lambda a: F.transform(F.filter("e", lambda b: b > a), lambda b: F.struct(a.alias("lo"), b.alias("hi")))))
    return per.select(F.explode(pairs).alias("p")).groupBy("p.lo", "p.hi").agg(F.count("*").alias("corroboration")).withColumns({
        "reliability_sum": 0.1 * F.col("corroboration"), "belief": 1 - F.pow(F.lit(0.5), 0.1 * F.col("corroboration"))})


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anamnesis.functions.text import step_key

    e = table(spark, sf_dir, "events").select("event_id", "ts", "props", (F.col("user_id") % 50).cast("string").alias("agent"), F.col("event_type").alias("tool_name"), F.when(F.col("value") > 50, "success").otherwise("failure").alias("outcome"))
    grouped = e.groupBy("agent", "tool_name", "outcome").agg(F.count("*").alias("use_count"), F.max("ts").alias("last_used_at"), F.max_by("props", F.struct("ts", "event_id")).alias("arguments"))
    return grouped.select(step_key(F.lit("t"), F.col("agent"), F.col("tool_name"), F.col("outcome")).alias("key"), "*")
