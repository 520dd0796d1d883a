"""Evaluation measures over hits and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.functions.text import normalized, tokens


def token_f1(predicted: Column, gold: Column) -> Column:
    """Overlap of token bags; zero where either is empty."""
    p, g = tokens(predicted), tokens(gold)
    count = lambda a, t: F.size(F.filter(a, lambda x: x == t))
    common = F.aggregate(F.transform(F.array_intersect(p, g), lambda t: F.least(count(p, t), count(g, t))), F.lit(0), lambda a, x: a + x)
    return F.when((F.size(p) == 0) | (F.size(g) == 0) | (common == 0), 0.0).otherwise(2.0 * common / (F.size(p) + F.size(g)))


def recall_hit(texts: Column, fact: Column) -> Column:
    """Whether a text's joined tokens hold the fact's as a substring."""
    return F.exists(texts, lambda t: normalized(t).contains(normalized(fact)))


def recall_fraction(texts: Column, support: Column) -> Column:
    found = F.size(F.filter(support, lambda f: recall_hit(texts, f)))
    return F.when(F.size(support) == 0, 0.0).otherwise(found / F.size(support))


def classify(top: Column, pool: Column, support: Column) -> Column:
    """hit: all support on top; ranking: all of it in the pool; recall: not."""
    return F.when(recall_fraction(top, support) == 1, "hit").when(recall_fraction(pool, support) == 1, "ranking").otherwise("recall")


def judged_correct(label: Column) -> Column:
    words = F.split(F.upper(label), r"[^A-Z]+")
    return F.array_contains(words, "CORRECT") & ~F.array_contains(words, "INCORRECT")


def by_category(rows: DataFrame, category: str, **measures: Column) -> DataFrame:
    """Means a category, and overall where the category is null."""
    return rows.rollup(category).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(name) for name, c in measures.items()])


def nearest_rank(rows: DataFrame, group: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """The ceil(q n)-th smallest of each group."""
    n = Window.partitionBy(group)
    ranked = rows.select(group, value, F.row_number().over(n.orderBy(value)).alias("i"), F.count("*").over(n).alias("n"))
    return ranked.groupBy(group).agg(*[F.min(F.when(F.col("i") == F.greatest(F.ceil(q * F.col("n")), F.lit(1)), F.col(value))).alias(name) for name, q in quantiles.items()])


def floor_rank(rows: DataFrame, group: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """The value at place min(n - 1, floor(q n)), counted from zero."""
    n = Window.partitionBy(group)
    ranked = rows.select(group, value, F.row_number().over(n.orderBy(value)).alias("i"), F.count("*").over(n).alias("n"))
    return ranked.groupBy(group).agg(*[F.min(F.when(F.col("i") == F.least(F.col("n"), F.floor(q * F.col("n")) + 1), F.col(value))).alias(name) for name, q in quantiles.items()])


def latest(rows: DataFrame, group: str, order: list[str], most: int = 1024) -> DataFrame:
    """The last rows of each group."""
    w = Window.partitionBy(group).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def round_robin(rows: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """One row of each group in turn, up to ``most``; groups by their first key."""
    w = Window.partitionBy(group)
    placed = rows.withColumns({"_n": F.row_number().over(w.orderBy(key)), "_first": F.min(key).over(w)})
    return placed.orderBy("_n", "_first").limit(most).drop("_n", "_first")
