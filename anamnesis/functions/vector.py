"""Vector scalars, and the hashing embedding used without a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.functions.text import tokens

DIMENSIONS = 256


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; zero for empty or zero vectors."""
    length = norm(a) * norm(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (length == 0), 0.0).otherwise(dot(a, b) / length)


def hashed_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, value): signed counts of hashed tokens, summed before the shuffle."""
    tok = docs.select(key, F.explode(tokens(F.col(text))).alias("tok")).withColumn("h", F.sha1("tok"))
    idx = (F.conv(F.substr("h", F.lit(1), F.lit(8)), 16, 10).cast("long") % DIMENSIONS).cast("int")
    sign = F.when(F.conv(F.substr("h", F.lit(9), F.lit(2)), 16, 10).cast("int") % 2 == 1, 1).otherwise(-1)
    return tok.groupBy(key, idx.alias("idx")).agg(F.sum(sign).alias("value"))


def embed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, embedding): unit vectors; a text without tokens has the zero vector."""
    sparse = hashed_counts(docs, key, text).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("idx", F.col("value").cast("double")))).alias("m"))
    length = F.sqrt(_sum(F.transform(F.map_values("m"), lambda v: v * v)))
    dense = F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    unit = F.when(length > 0, F.transform(dense, lambda v: v / length)).otherwise(F.transform(dense, lambda v: F.lit(0.0)))
    made = sparse.select(key, unit.alias("embedding"))
    zero = F.array_repeat(F.lit(0.0), DIMENSIONS)
    return docs.select(key).join(made, key, "left").select(key, F.coalesce("embedding", zero).alias("embedding"))
