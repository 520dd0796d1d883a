"""Ingestion as table transitions: key-idempotent inserts, accumulation, resolution."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.functions import text as tx
from anamnesis.operators.retrieve import nearest

BASE = 0.5
MERGE, FLAG = 0.9, 0.6
CAPACITY, TTL = 7, 3600
SHIFT, BLEND = 0.7, 0.5
MAX_PAIRS = 32


def insert_ignore(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Old rows, and the new ones whose key is not there yet, each key once."""
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def replace(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new.dropDuplicates([key]), allowMissingColumns=True)


def belief(reliability_sum: Column, confidence: Column | None = None, base: float = BASE) -> Column:
    value = 1 - F.pow(F.lit(1 - base), reliability_sum)
    return value if confidence is None else confidence * value


def episodes(turns: DataFrame) -> DataFrame:
    """turns: tenant, agent, session, turn, text. Redacted, keyed, each key once."""
    clean = turns.withColumn("content", tx.redacted(F.col("text")))
    return clean.withColumn("key", tx.idempotency_key(F.col("tenant"), F.col("agent"), F.col("session"), F.col("turn"), F.col("content"))).dropDuplicates(["key"])


def over_capacity(memories: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Working memories beyond the newest of their session become episodic and lose their expiry."""
    own = Window.partitionBy("tenant", "agent", "session", "type").orderBy(F.desc("created_at"), F.desc("key"))
    out = memories.withColumn("_n", F.row_number().over(own))
    moved = (F.col("type") == "working") & (F.col("_n") > capacity)
    out = out.withColumn("type", F.when(moved, "episodic").otherwise(F.col("type")))
    if "expires_at" in memories.columns:
        out = out.withColumn("expires_at", F.when(~moved, F.col("expires_at")))
    return out.drop("_n")


def mentions_of(memories: DataFrame) -> DataFrame:
    """(tenant, key, name): capitalised spans of each memory, once a memory."""
    return memories.select("tenant", "key", F.explode(tx.caps_spans(F.col("text"))).alias("name"))


def accumulate_entities(found: DataFrame, reliability: Column) -> DataFrame:
    """(tenant, name, mention_count, reliability_sum, belief): sums only, so batches add up."""
    return found.dropDuplicates(["tenant", "key", "name"]).groupBy("tenant", "name").agg(F.count("*").alias("mention_count"), F.sum(reliability).alias("reliability_sum")).withColumn("belief", belief(F.col("reliability_sum")))


def pairs_in_order(names: Column, most: int = MAX_PAIRS) -> Column:
    """The first unordered pairs of an array, by first then second place."""
    n = F.size(names)
    rows = F.transform(names, lambda a, i: F.when(i + 1 < n, F.transform(F.slice(names, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda b: F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")))).otherwise(F.filter(F.transform(names, lambda b: F.struct(a.alias("lo"), b.alias("hi"))), lambda _: F.lit(False))))
    return F.slice(F.flatten(rows), 1, most)


def upsert_entities(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Counts and sums added on (tenant, name); belief anew."""
    both = old.select("tenant", "name", "mention_count", "reliability_sum").unionByName(batch.select("tenant", "name", "mention_count", "reliability_sum"))
    return both.groupBy("tenant", "name").agg(F.sum("mention_count").alias("mention_count"), F.sum("reliability_sum").alias("reliability_sum")).withColumn("belief", belief(F.col("reliability_sum")))


def resolve(rows: DataFrame, pool: DataFrame) -> DataFrame:
    """(key, match, similarity, verdict): best other row by cosine; merge, flag or create.

    Each task gives a row's best of its part of the pool; a row without any has -1.
    """
    near = nearest(pool, rows.select(F.col("key").alias("query"), "embedding"), 1, others=True)
    minus = (-F.col("key")).alias("minus")
    found = near.select(F.col("query").alias("key"), F.struct(F.coalesce("score", F.lit(-1.0)).alias("similarity"), minus).alias("b"))
    kind = found.schema["b"].dataType["minus"].dataType
    none = rows.select("key", F.struct(F.lit(-1.0).alias("similarity"), F.lit(None).cast(kind).alias("minus")).alias("b"))
    best = found.unionByName(none).groupBy("key").agg(F.max("b").alias("b"))
    sim = F.col("b")["similarity"]
    verdict = F.when(sim >= MERGE, "merge").when(sim >= FLAG, "flag").otherwise("create")
    return best.select("key", (-F.col("b")["minus"]).alias("match"), sim.alias("similarity"), verdict.alias("verdict"))


def topic_shifts(turns: DataFrame, group: str = "session", shift: float = SHIFT, blend: float = BLEND) -> DataFrame:
    """(session, turn, similarity, shift): each turn against the running topic.

    The topic depends on every turn before, so a session is one group; on a
    shift it starts anew, else it blends. Turns come one at a time into two
    vectors, whatever the session's length.
    """
    kinds = {f.name: f.dataType.simpleString() for f in turns.schema}

    def track(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        out, topic = [], None
        for row in pdf.sort_values("turn").itertuples():
            vec = np.asarray(row.embedding, dtype=float)
            sim, moved = None, False
            if topic is not None:
                size = float(np.linalg.norm(vec) * np.linalg.norm(topic))
                sim = float(vec @ topic) / size if size else 0.0
                moved = sim < shift
            topic = vec if topic is None or moved else blend * vec + (1 - blend) * topic
            out.append((getattr(row, group), row.turn, None if sim is None else round(sim, 6), moved))
        return pd.DataFrame(out, columns=[group, "turn", "similarity", "shift"]).astype({"similarity": "float64"})

    return turns.select(group, "turn", "embedding").groupBy(group).applyInPandas(track, f"{group} {kinds[group]}, turn long, similarity double, shift boolean")


def edge_weights(events: DataFrame, now: Column, alpha: float = 0.5, rate: float = 0.02) -> DataFrame:
    """(lo, hi, weight): a recurrence over an edge's times; idle time fades it first.

    weight = alpha + (1 - alpha) * weight * exp(-rate * days since the last)."""
    times = events.groupBy("lo", "hi").agg(F.array_sort(F.collect_list(F.unix_micros(F.col("ts").cast("timestamp")))).alias("ts"))
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("long").alias("last"))
    step = lambda acc, t: F.struct((alpha + (1 - alpha) * acc["w"] * F.coalesce(F.exp(-rate * (t - acc["last"]) / 86_400e6), F.lit(0.0))).alias("w"), t.alias("last"))
    return times.select("lo", "hi", F.aggregate("ts", zero, step, lambda acc: acc["w"]).alias("weight"))
