"""Graph analytics: PageRank and community labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session may name none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"


def _settle(df: DataFrame) -> DataFrame:
    """Computed once and checkpointed in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 40, tolerance: float = 1e-6) -> DataFrame:
    """(node, rank): undirected PageRank scaled to a largest of one.

    Self-loops and edges to foreign nodes go; parallel edges count; dangling mass
    is spread evenly. The loop ends when the ranks' summed change is within the
    tolerance. A round is one join and one aggregation; only sums reach the driver.
    """
    nodes = nodes.select("node").distinct()
    own = edges.filter("lo <> hi").join(nodes.withColumnRenamed("node", "lo"), "lo", "left_semi").join(nodes.withColumnRenamed("node", "hi"), "hi", "left_semi")
    both = own.select(F.col("lo").alias("a"), F.col("hi").alias("b")).unionByName(own.select(F.col("hi").alias("a"), F.col("lo").alias("b")))
    weighted = both.groupBy("a", "b").agg(F.count("*").alias("n"))
    degree = weighted.groupBy("a").agg(F.sum("n").alias("degree"))
    links = _settle(weighted.join(degree, "a").select("a", "b", (F.col("n") / F.col("degree")).alias("share")))
    count = nodes.count()
    if not count:
        return nodes.withColumn("rank", F.lit(0.0))
    ranks = _settle(nodes.join(degree, F.col("node") == F.col("a"), "left").select("node", F.col("degree").isNull().alias("dangling"), F.lit(1.0 / count).alias("rank")))
    for i in range(rounds):
        loose = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("s")).first().s
        flow = links.join(ranks, F.col("a") == F.col("node")).groupBy("b").agg(F.sum(F.col("share") * F.col("rank")).alias("flow"))
        moved = ranks.join(flow, F.col("node") == F.col("b"), "left").select("node", "dangling", F.col("rank").alias("before"), ((1 - damping) / count + damping * (F.coalesce("flow", F.lit(0.0)) + loose / count)).alias("rank"))
        moved = _settle(moved) if i % 5 == 4 or i == rounds - 1 else moved.cache()
        change = moved.agg(F.sum(F.abs(F.col("rank") - F.col("before"))).alias("d")).first().d
        ranks = moved.select("node", "dangling", "rank")
        if change < tolerance:
            break
    most = ranks.agg(F.max("rank").alias("m")).first().m
    return ranks.select("node", (F.col("rank") / (most or 1.0)).alias("rank"))


def label_propagation(nodes: DataFrame, edges: DataFrame, group: str = "tenant", rounds: int = 20) -> DataFrame:
    """(tenant, node, community): majority labels taken in key order, in place.

    Each step sees the labels of the steps before it, so a tenant's graph is one
    group; ties take the smallest label; communities are numbered by size, then
    by label. Edges across tenants do not count.
    """
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    sides = edges.join(nodes.select(F.col("node").alias("lo"), F.col(group).alias("g")), "lo").join(nodes.select(F.col("node").alias("hi"), F.col(group).alias("h")), "hi").filter("g = h AND lo <> hi")
    rows = nodes.select(group, F.col("node").alias("a"), F.lit(None).cast(kinds["node"]).alias("b")).unionByName(sides.select(F.col("g").alias(group), F.col("lo").alias("a"), F.col("hi").alias("b")))

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pdf.a[pdf.b.isna()].unique())
        near: dict = {n: [] for n in names}
        for a, b in pdf[pdf.b.notna()][["a", "b"]].itertuples(index=False):
            b = type(names[0])(b)
            near[a].append(b)
            near[b].append(a)
        labels = {n: n for n in names}
        for _ in range(rounds):
            changed = False
            for n in names:
                if near[n]:
                    seen: dict = {}
                    for m in near[n]:
                        seen[labels[m]] = seen.get(labels[m], 0) + 1
                    best = min(seen, key=lambda x: (-seen[x], x))
                    changed |= best != labels[n]
                    labels[n] = best
            if not changed:
                break
        size: dict = {}
        for x in labels.values():
            size[x] = size.get(x, 0) + 1
        number = {x: i for i, x in enumerate(sorted(size, key=lambda x: (-size[x], x)))}
        return pd.DataFrame({group: pdf[group].iloc[0], "node": names, "community": [number[labels[n]] for n in names]})

    return rows.groupBy(group).applyInPandas(label, f"{group} {kinds[group]}, node {kinds['node']}, community long")
