"""Quality rules with thresholds from mergeable quantile sketches.

Every document's measures and sizes fall into buckets whose bounds grow by a fixed
factor; the buckets' counts are a quantile sketch with bounded relative error, the
same whatever the order of merging. Counts are merged per language and source, per
language, and over all; a group of under ``LEAST_GROUP`` documents takes the
next wider group's thresholds. A measure's limit is the group's upper quantile
``TAIL`` and ``SPREADS`` times the tail's width: the distance from the median to that
quantile, or where most documents have none of what is counted, so that both are
zero, one event in a text of the group's median size. A document's rates count
against its own size or the group's median size, whichever is more, as one event
in a short text says little. No limit is a number fixed beforehand. The verdicts
come from a join of the documents' measures with the groups' limits, in which no
source with a third of all rows meets in one task.

Only DataFrame functions run; the text itself is never shuffled.

Defined cases: null or empty text has no words and fails the base rules; null
language or source counts as its own group; a value that equals its limit passes;
texts of any length are read whole; repeated rows each give their row; an empty
table gives none; other columns pass through ``kept_documents`` whatever their
names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anamnesis.llm.common import settle, table

WINDOW = 8
GROWTH = 1.02
SPREADS = 6.0
LEAST_GROUP = 50
TAIL = 0.9
SALTS = 16
MOST_BROADCAST = 20_000
SIZES = ("chars", "words", "lines")
#: Rates, the size that each counts against, and how much one event counts: a
#: window that is found again covers its words twice.
RATES = {"symbols": ("chars", 1), "marks": ("chars", 1), "dup_lines": ("lines", 1), "repeats": ("words", 2 * WINDOW)}
MEASURES = (*RATES, "word_size")
_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"


def _count_chars(text: Column, chars: str) -> Column:
    """How many of some ASCII characters a text holds; plain replacement is a byte search."""
    return F.length(text) - F.length(reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), chars, text))


def _paired(a: Column, step: int) -> Column:
    """Hashes of elements and those ``step`` places on."""
    n = F.greatest(F.size(a) - step, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + step), n), lambda x, y: F.xxhash64(x, y))


def _covered(windows: Column) -> Column:
    """Words inside windows that occur twice or more: sort by hash, mark equal
    neighbours, then add the gaps between marked places, each up to the window."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    n = F.size(windows) - 1
    marked = F.sort_array(F.array_distinct(F.flatten(F.zip_with(
        F.slice(placed, F.lit(1), n), F.slice(placed, F.lit(2), n),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    ))))
    m = F.greatest(F.size(marked) - 1, F.lit(0))
    gaps = F.zip_with(F.slice(marked, F.lit(1), m), F.slice(marked, F.lit(2), m), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    return F.aggregate(gaps, F.lit(WINDOW).cast("long"), lambda acc, g: acc + g)


def measure(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, group columns, the base counts and the measures, and columns to carry."""
    text = F.coalesce("text", F.lit(""))
    one = docs.select(*carry, "doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), text.alias("text"))
    cut = one.select(
        *carry, "doc_id", "lang", "source",
        F.array_remove(F.split("text", _SPACE), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        _count_chars(F.col("text"), _SYMBOLS).cast("long").alias("n_symbols"),
        _count_chars(F.col("text"), "!").cast("long").alias("n_marks"),
    )
    hashed = cut.select(
        *carry, "doc_id", "lang", "source", "n_symbols", "n_marks",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h1"),
    )
    same = [c for c in hashed.columns if c != "h1"]
    two = hashed.select(*same, _paired(F.col("h1"), 1).alias("h2"))
    four = two.select(*same, _paired(F.col("h2"), 2).alias("h4"))
    eight = four.select(*same, _paired(F.col("h4"), 4).alias("h8"))
    repeated = F.when(F.size("h8") == F.size(F.array_distinct("h8")), F.lit(0).cast("long")).otherwise(_covered(F.col("h8")))
    counted = eight.select(*same, repeated.alias("n_repeat_words"))
    chars, words = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    return counted.select(
        *carry, "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        F.struct(
            (F.col("n_symbols") / chars).alias("symbols"),
            (F.col("n_marks") / chars).alias("marks"),
            (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_lines"),
            (F.col("n_repeat_words") / words).alias("repeats"),
            (F.col("word_chars") / words).alias("word_size"),
            *[c.cast("double").alias(n) for n, c in zip(SIZES, (chars, words, F.greatest("n_lines", F.lit(1))), strict=True)],
        ).alias("measures"),
    )


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n) of the documents that pass the base rules;
    null source: the language, both null: all.

    Counts are summed before the shuffle, so a row per group, measure and bucket
    moves from each task.
    """
    bucket = lambda m: F.when(F.col("measures")[m] > 1e-6, F.ceil(F.log(F.col("measures")[m]) / F.log(F.lit(GROWTH))).cast("int")).otherwise(-10_000)
    long = measured.filter(~F.col("base_failed")).select("lang", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(m).alias("bucket")) for m in (*MEASURES, *SIZES)])).alias("x"))
    finest = long.groupBy("lang", "source", "x.measure", "x.bucket").agg(F.count("*").alias("n"))
    wider = finest.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    widest = wider.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    return finest.unionByName(wider.withColumn("source", F.lit(None).cast("string"))).unionByName(widest.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")}))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, size, limits): for every group a limit a measure and the median sizes."""
    group = ["lang", "source", "measure"]
    upto = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sketch.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(Window.partitionBy(*group))})
    value = F.when(F.col("bucket") == -10_000, 0.0).otherwise(F.pow(F.lit(GROWTH), F.col("bucket") - 0.5))
    at = lambda m, q: F.min(F.when((F.col("measure") == m) & (F.col("upto") >= q * F.col("total")), value))
    quantiles = ranked.groupBy("lang", "source").agg(
        F.max("total").alias("size"),
        *[at(m, 0.5).alias(f"mid_{m}") for m in (*MEASURES, *SIZES)],
        *[at(m, TAIL).alias(f"high_{m}") for m in MEASURES],
    )
    # Word size is never zero; its least width is the sketch's own error.
    event = {m: F.lit(float(n)) / F.col(f"mid_{size}") for m, (size, n) in RATES.items()} | {"word_size": F.col("mid_word_size") * (GROWTH - 1)}
    limit = lambda m: F.col(f"high_{m}") + SPREADS * F.greatest(F.col(f"high_{m}") - F.col(f"mid_{m}"), event[m])
    return quantiles.select("lang", "source", "size", F.struct(*[limit(m).alias(m) for m in MEASURES], *[F.col(f"mid_{m}").alias(m) for m in SIZES]).alias("limits"))


def group_limits(measured: DataFrame) -> DataFrame:
    """(lang, source, limits) of every group, settled; small groups take a wider one's."""
    found = settle(thresholds(sketches(measured)))
    enough = F.when(F.col("size") >= LEAST_GROUP, F.col("limits"))
    fine = found.filter("source IS NOT NULL").select("lang", "source", enough.alias("fine"))
    wide = found.filter("source IS NULL AND lang IS NOT NULL").select("lang", enough.alias("wide"))
    widest = found.filter("lang IS NULL").select(F.col("limits").alias("widest"))
    # widest is one row: all documents are one group.
    return settle(fine.join(wide, "lang", "left").join(F.broadcast(widest), F.lit(True), "left").select("lang", "source", F.coalesce("fine", "wide", "widest").alias("limits")))


def judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """The measured rows with ``kept``.

    Up to MOST_BROADCAST groups are broadcast, so that no document moves; beyond,
    the documents are salted and every group's limits repeated for each salt.
    """
    if limits.count() <= MOST_BROADCAST:
        joined = measured.join(F.broadcast(limits), ["lang", "source"], "left")
    else:
        salted = limits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = measured.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "source", "salt"], "left")
    mine, most = F.col("measures"), F.col("limits")
    room = lambda m: F.greatest(F.lit(1.0), most[RATES[m][0]] / mine[RATES[m][0]]) if m in RATES else F.lit(1.0)
    within = reduce(lambda a, b: a & b, [mine[m] <= most[m] * room(m) for m in MEASURES])
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(True)))


def verdicts(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    measured = settle(measure(docs))
    return judged(measured, group_limits(measured)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents whose verdict is kept, with all their columns.

    The measures are taken once: the rows are stored with them while the groups'
    limits are found. No filter stands before that, as it would be pushed below the
    measures and take them again for each of its conditions.
    """
    whole = docs.select("doc_id", "text", "lang", "source", F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    measured = settle(measure(whole, ("row",)))
    return judged(measured, group_limits(measured.drop("row"))).filter("kept").select("row.*")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"))
