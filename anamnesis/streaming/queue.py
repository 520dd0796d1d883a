"""A durable write queue as table transitions.

Items: id, tenant, payload, enqueued_at, leased_until, attempts, error. Every verb
takes the table and gives its next version, so whoever stores it decides how; a
claim that is never acknowledged comes back when its lease ends, and an item that
fails too often becomes a dead letter that can be replayed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEASE_S, ATTEMPTS = 60, 3
ITEM = "id string, tenant string, payload string, enqueued_at timestamp, leased_until timestamp, attempts int, error string"


def enqueue(items: DataFrame, new: DataFrame) -> DataFrame:
    """new: id, tenant, payload, enqueued_at. An id that is queued changes nothing."""
    fresh = new.dropDuplicates(["id"]).join(items.select("id"), "id", "left_anti")
    full = fresh.withColumns({"leased_until": F.lit(None).cast("timestamp"), "attempts": F.lit(0), "error": F.lit(None).cast("string")})
    return items.unionByName(full.select(*items.columns))


def free(now: Column) -> Column:
    """Not leased, or leased and expired."""
    return F.col("leased_until").isNull() | (F.col("leased_until") < now)


def claim(items: DataFrame, now: Column, most: int | None = None, lease_s: int = LEASE_S) -> DataFrame:
    """The items with the oldest free ones leased: at most ``most`` of each tenant, or all."""
    until = now + F.expr(f"INTERVAL '{lease_s}' SECOND")
    if most is None:
        return items.withColumn("leased_until", F.when(free(now), until).otherwise(F.col("leased_until")))
    nth = F.row_number().over(Window.partitionBy("tenant", free(now)).orderBy("enqueued_at", "id"))
    ranked = items.withColumn("_n", nth)
    return ranked.withColumn("leased_until", F.when(free(now) & (F.col("_n") <= most), until).otherwise(F.col("leased_until"))).drop("_n")


def held(items: DataFrame, now: Column) -> DataFrame:
    return items.filter(~free(now))


def ack(items: DataFrame, done: DataFrame) -> DataFrame:
    """Items without those done (id)."""
    return items.join(done.select("id"), "id", "left_anti").select(*items.columns)


def nack(items: DataFrame, failed: DataFrame, attempts: int = ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """(items, dead): failed (id, error) give up their lease; those that failed
    ``attempts`` times leave the queue as dead letters."""
    j = items.drop("error").join(failed.select("id", F.col("error").alias("new_error")).dropDuplicates(["id"]), "id", "left").join(items.select("id", "error"), "id")
    hit = F.col("new_error").isNotNull()
    tried = j.withColumns({
        "attempts": F.when(hit, F.col("attempts") + 1).otherwise(F.col("attempts")),
        "leased_until": F.when(~hit, F.col("leased_until")),
        "error": F.coalesce("new_error", "error"),
    }).select(*items.columns)
    return tried.filter(F.col("attempts") < attempts), tried.filter(F.col("attempts") >= attempts)


def replay(items: DataFrame, dead: DataFrame) -> DataFrame:
    """Dead letters queued anew, with no attempts."""
    return enqueue(items, dead.select("id", "tenant", "payload", "enqueued_at"))


def pending(items: DataFrame, now: Column) -> DataFrame:
    """(tenant, pending, leased)."""
    return items.groupBy("tenant").agg(F.count("*").alias("pending"), F.count_if(~free(now)).alias("leased"))
