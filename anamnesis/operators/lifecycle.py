"""Upkeep as table transitions: decay, consolidation, ontology, deletion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.operators.retrieve import DECAY, effective_strength

FLOOR, BREAKER, MENTIONS, SUPPORT = 0.1, 0.5, 5, 3


def decay_sweep(memories: DataFrame, now: Column, rate: float = DECAY, floor: float = FLOOR) -> DataFrame:
    """Live episodic memories fainter than the floor are marked invalid."""
    faint = (F.col("type") == "episodic") & F.col("invalid_at").isNull() & (effective_strength(F.col("strength"), F.col("accessed_at"), now, rate) < floor)
    return memories.withColumn("invalid_at", F.when(faint, now).otherwise(F.col("invalid_at")))


def supersede(entities: DataFrame, pairs: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(entities, edges): the old of each (new, old) is invalid, an edge says why."""
    edges = pairs.select("new", "old").distinct()
    gone = edges.select(F.col("old").alias("key")).distinct().withColumn("gone", F.lit(True))
    marked = entities.join(gone, "key", "left").withColumn("invalid_at", F.when(F.col("gone") & F.col("invalid_at").isNull(), now).otherwise(F.col("invalid_at"))).drop("gone")
    return marked, edges


def dream_decisions(entities: DataFrame, verdicts: DataFrame, breaker: float = BREAKER, mentions: int = MENTIONS) -> DataFrame:
    """(key, action, winner, loser): what a consolidation pass does.

    entities: key, mention_count, belief, needs_review, conflict_with, community,
    live. verdicts: key, contradicts. Reviewed ones whose rival is gone are
    cleared, those of another community are skipped, contradictions go by belief
    then mentions, a tie keeping the entity. If more than ``breaker`` of the
    candidates would be superseded, nothing is.
    """
    rival = entities.select(F.col("key").alias("r_key"), F.col("belief").alias("r_belief"), F.col("mention_count").alias("r_count"), F.col("community").alias("r_community"), F.col("live").alias("r_live"))
    picked = entities.filter(F.col("live") & (F.col("needs_review") | (F.col("mention_count") >= mentions)))
    j = picked.join(rival, F.col("conflict_with") == F.col("r_key"), "left").join(verdicts, "key", "left")
    gone = F.col("r_key").isNull() | ~F.coalesce("r_live", F.lit(False))
    apart = F.col("community").isNotNull() & F.col("r_community").isNotNull() & (F.col("community") != F.col("r_community"))
    loses = F.struct(F.coalesce("belief", F.lit(0.0)), "mention_count") < F.struct(F.coalesce("r_belief", F.lit(0.0)).alias("belief"), F.col("r_count").alias("mention_count"))
    action = F.when(~F.col("needs_review"), "distil").when(gone, "clear").when(apart, "skip").when(F.coalesce("contradicts", F.lit(False)), "supersede").otherwise("clear")
    out = j.select("key", action.alias("action"), F.when(loses, F.col("r_key")).otherwise(F.col("key")).alias("winner"), F.when(loses, F.col("key")).otherwise(F.col("r_key")).alias("loser"))
    share = out.agg((F.count(F.when(F.col("action") == "supersede", 1)) > breaker * F.count("*")).alias("tripped"))
    # share is one row.
    return out.join(F.broadcast(share), F.lit(True), "left").select("key", F.when(F.col("tripped"), "none").otherwise(F.col("action")).alias("action"), *[F.when(~F.col("tripped") & (F.col("action") == "supersede"), F.col(c)).alias(c) for c in ("winner", "loser")])


def ontology_clusters(entities: DataFrame, edges: DataFrame, least: int = SUPPORT, examples: int = 8) -> DataFrame:
    """(tenant, label_a, label_b, support, examples) of pairs of labels often related."""
    a = entities.select(F.col("key").alias("lo"), F.col("label").alias("la"), F.col("name").alias("na"), "tenant")
    b = entities.select(F.col("key").alias("hi"), F.col("label").alias("lb"), F.col("name").alias("nb"))
    j = edges.join(a, "lo").join(b, "hi").withColumns({"label_a": F.least("la", "lb"), "label_b": F.greatest("la", "lb")})
    nth = Window.partitionBy("tenant", "label_a", "label_b", F.pmod("lo", F.lit(64))).orderBy("lo", "hi")
    few = F.when(F.col("_n") <= examples, F.struct("lo", "hi", F.concat_ws("-", "na", "nb").alias("pair")))
    grouped = j.withColumn("_n", F.row_number().over(nth)).groupBy("tenant", "label_a", "label_b").agg(F.count("*").alias("support"), F.slice(F.array_sort(F.collect_list(few)), 1, examples).alias("e"))
    return grouped.filter(F.col("support") >= least).select("tenant", "label_a", "label_b", "support", F.transform("e", lambda x: x["pair"]).alias("examples"))


def upsert_proposals(old: DataFrame, found: DataFrame) -> DataFrame:
    """Support and label renewed, the status of known proposals kept."""
    n = found.select("tenant", "label_a", "label_b", F.col("support").alias("n_support"), F.col("proposed_relationship").alias("n_rel"))
    j = old.join(n, ["tenant", "label_a", "label_b"], "full")
    return j.select("tenant", "label_a", "label_b", F.coalesce("n_support", "support").alias("support"), F.coalesce("n_rel", "proposed_relationship").alias("proposed_relationship"), F.coalesce("status", F.lit("pending")).alias("status"))


def forget(rows: DataFrame, tenant: str, now: Column, agent: str | None = None) -> DataFrame:
    """Soft deletion of a tenant's, or one agent's, live rows."""
    hit = (F.col("tenant") == tenant) & F.col("invalid_at").isNull()
    if agent is not None:
        hit &= F.col("agent") == agent
    return rows.withColumn("invalid_at", F.when(hit, now).otherwise(F.col("invalid_at")))


def purge(nodes: DataFrame, edges: DataFrame, tenant: str, agent: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Hard deletion of nodes and of every edge that touches one."""
    hit = F.col("tenant") == tenant
    if agent is not None:
        hit &= F.col("agent") == agent
    gone = nodes.filter(hit).select("key")
    left = nodes.join(gone, "key", "left_anti")
    for side in ("lo", "hi"):
        edges = edges.join(gone.withColumnRenamed("key", side), side, "left_anti")
    return left, edges


def write_once(rows: DataFrame, path: str) -> None:
    """Episodes are provenance: they are written to a new place, or not at all."""
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at.suffix("/_SUCCESS")):
        raise PermissionError(f"{path} is written once")
    # What a failed job left there is no version yet.
    rows.write.mode("overwrite").parquet(path)


def reembed(vectors: DataFrame, memories: DataFrame, embed: Callable[[DataFrame], DataFrame], version: str) -> DataFrame:
    """(key, embedding, version): vectors of another version, and memories without one,
    are made anew; the others stay."""
    current = vectors.filter(F.col("version") == version).select("key", "embedding", "version")
    stale = memories.select("key", "text").join(current.select("key"), "key", "left_anti")
    return current.unionByName(embed(stale).select("key", "embedding").withColumn("version", F.lit(version)))


def relabel(edges: DataFrame, entities: DataFrame, proposals: DataFrame) -> DataFrame:
    """Edges between labels of an approved proposal take its relationship."""
    a = entities.select(F.col("key").alias("lo"), F.col("label").alias("la"))
    b = entities.select(F.col("key").alias("hi"), F.col("label").alias("lb"))
    p = proposals.filter("status = 'approved'").select("tenant", "label_a", "label_b", "proposed_relationship")
    j = edges.join(a, "lo", "left").join(b, "hi", "left").withColumns({"label_a": F.least("la", "lb"), "label_b": F.greatest("la", "lb")})
    named = j.join(p, ["tenant", "label_a", "label_b"], "left")
    return named.withColumn("relationship", F.coalesce("proposed_relationship", "relationship")).select(*edges.columns)


def rate_limited(hits: DataFrame, limit: int, window_s: int) -> DataFrame:
    """(user, ts, event, limited): fixed windows that begin with a key's first hit.

    A window's beginning depends on the one before, so a key's times are folded
    in order: window start and count travel through the fold.
    """
    times = hits.groupBy("user").agg(F.array_sort(F.collect_list(F.struct("ts", "event"))).alias("h"))
    zero = F.struct(F.lit(None).cast("timestamp_ntz").alias("start"), F.lit(0).alias("n"), F.filter(F.transform("h", lambda x: F.struct(x["ts"].alias("ts"), x["event"].alias("event"), F.lit(False).alias("limited"))), lambda _: F.lit(False)).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = acc["start"].isNull() | (x["ts"] >= acc["start"] + F.expr(f"INTERVAL '{window_s}' SECOND"))
        n = F.when(new, 1).otherwise(acc["n"] + 1)
        return F.struct(F.when(new, x["ts"]).otherwise(acc["start"]).alias("start"), n.alias("n"), F.concat(acc["out"], F.array(F.struct(x["ts"].alias("ts"), x["event"].alias("event"), (n > limit).alias("limited")))).alias("out"))

    return times.select("user", F.explode(F.aggregate("h", zero, step, lambda acc: acc["out"])).alias("o")).select("user", "o.*")
