"""Retrieval: search arms over many queries at once, fusion, ranking and packing.

Every operator takes and returns DataFrames with a ``query`` column, so that any
number of queries run in one plan; every ranking ends in the key.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.functions.text import token_cost, tokens
from anamnesis.functions.vector import cosine

K1, B = 1.2, 0.75
RRF, ARM_WEIGHTS = 60, {"bm25": 1.0, "vector": 1.0, "graph": 0.1}
DECAY, POOL, SEEDS = 0.02, 100, 10
TIERS = {"working": 0.267, "episodic": 0.467, "semantic": 0.2, "reasoning": 0.067}


def age_days(ts: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.coalesce(ts, now).cast("timestamp"))) / 86_400e6


def decay_multiplier(strength: Column, accessed: Column, now: Column, rate: float = DECAY) -> Column:
    """Not clamped: a future access raises it."""
    return F.coalesce(strength, F.lit(1.0)) * F.exp(-rate * age_days(accessed, now))


def effective_strength(strength: Column, accessed: Column, now: Column, rate: float = DECAY) -> Column:
    """Clamped: a future access counts as now."""
    return F.coalesce(strength, F.lit(1.0)) * F.exp(-rate * F.greatest(age_days(accessed, now), F.lit(0.0)))


def bm25(docs: DataFrame, queries: DataFrame, key: str = "key", text: str = "text", weight: Column | None = None, pool: int | None = POOL) -> DataFrame:
    """(query, key, score, rank): Robertson BM25 over all docs.

    Lengths come from the token arrays; only query terms are exploded past the
    semi-join, and counts are summed before the shuffle.
    """
    wanted = queries.select("query", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    cut = docs.select(F.col(key).alias("key"), tokens(F.col(text)).alias("t"), (weight if weight is not None else F.lit(1.0)).alias("weight"))
    # Counted without arrays; the same runs of letters and digits as those of tokens().
    length = F.regexp_count(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"))
    totals = docs.agg(F.count("*").alias("n_docs"), F.avg(length).alias("avg_len"))
    terms = wanted.select("term").distinct()
    tf = cut.select("key", "weight", F.size("t").alias("len"), F.explode("t").alias("term")).join(terms, "term", "left_semi").groupBy("key", "weight", "len", "term").agg(F.count("*").alias("tf"))
    # The sum reads tf, so that both uses of the postings have one plan and one shuffle.
    df = tf.groupBy("term").agg(F.sum(F.when(F.col("tf") > 0, 1)).alias("df"))
    # totals is one row.
    scored = tf.join(df, "term").join(F.broadcast(totals), F.lit(True), "left").join(wanted, "term")
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    summed = scored.groupBy("query", "key", "weight").agg(F.round(F.sum(part), 6).alias("score"))
    order = F.col("score") if weight is None else F.round(F.col("score") * F.col("weight"), 9)
    return top(summed.withColumn("order", order), pool).select("query", "key", "score", "rank")


def top(rows: DataFrame, most: int | None, by: str = "order") -> DataFrame:
    """Rows ranked within their query, at most ``most`` of each."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(by), "key")))
    return ranked.filter(F.col("rank") <= most) if most else ranked


def _whole(df: DataFrame) -> Column:
    """Vectors whose elements are all there and in a common range; without lambdas, which Spark interprets."""
    kind = df.schema["embedding"].dataType.elementType
    # Null, not false, if an element is missing.
    there = ~F.array_contains("embedding", F.lit(float("inf")).cast(kind))
    return F.coalesce(there & (F.array_max("embedding") < 1e150) & (F.array_min("embedding") > -1e150), F.lit(False))


def _numbers(df: DataFrame, name: str) -> DataFrame:
    """(name, embedding): floats stay what they are, which halves what is sent; others are doubles."""
    kept = df.schema["embedding"].dataType.simpleString() in ("array<float>", "array<double>")
    return df.select(name, F.col("embedding") if kept else F.col("embedding").cast("array<double>").alias("embedding"))


def _grid(rows: int, pairs: int, held: int, cores: int) -> tuple[int, int]:
    """Parts of the rows, and lots of the queries that each part meets in tasks of their own.

    Few parts leave few hits to merge; lots keep all cores busy beside few parts.
    """
    parts = -(-rows // held) or 1
    if pairs >= 1 << 24:
        parts = max(parts, 2)
        parts = parts if 2 * parts <= cores else -(-parts // cores) * cores
    return parts, max(1, cores // parts) if pairs >= 1 << 24 else 1


def nearest(rows: DataFrame, queries: DataFrame, most: int, others: bool = False, at_once: int = 10_000, held: int = 65_536) -> DataFrame:
    """(query, key, score): exact cosine of every row with every query, of which each
    task gives a query's first ``most`` by rounded score, then key.

    Queries go out in blocks of at most ``at_once``, a task holds about ``held`` rows (fewer
    if they are long), and their products are taken 32 queries at a time, so neither set is
    bounded and no pair becomes a row. Products of single precision leave out what is surely
    behind a query's first; the rest is computed in double precision.
    With ``others`` a row is no hit of a query of its own key.
    Vectors of another size than most queries, or with elements missing, are joined.
    """
    rows, queries = _numbers(rows, "key"), _numbers(queries, "query")
    apart = F.col("query") != F.col("key") if others else F.lit(True)
    if others:
        rows, queries = rows.filter("key IS NOT NULL"), queries.filter("query IS NOT NULL")
    kinds = [df.select(F.lit(side).alias("side"), F.size("embedding").alias("size"), _whole(df).alias("whole")) for side, df in (("row", rows), ("query", queries))]
    counts = kinds[0].unionByName(kinds[1]).groupBy("side", "size", "whole").agg(F.count("*").alias("n")).collect()
    sizes = Counter()
    for c in counts:
        if c.side == "query" and (c["size"] or 0) > 0:
            sizes[c["size"]] += c.n
    size = min(sizes, key=lambda x: (-sizes[x], x), default=1)
    fit, odd = Counter(), Counter()
    for c in counts:
        (fit if c["size"] == size and c.whole else odd)[c.side] += c.n
    fits = F.coalesce(F.size("embedding") == size, F.lit(False))
    sound, clear = fits & _whole(rows), fits & _whole(queries)
    schema = f"query {queries.schema['query'].dataType.simpleString()}, key {rows.schema['key'].dataType.simpleString()}, score double"
    count = fit["query"] + odd["query"]
    blocks = count // at_once + 1
    parts, lots = _grid(fit["row"], fit["row"] * min(count, at_once), min(held, (1 << 22) // size + 1), rows.sparkSession.sparkContext.defaultParallelism)
    lot = F.explode(F.sequence(F.lit(0), F.lit(lots - 1))) if lots > 1 else F.lit(0)
    dealt = (rows.filter(sound) if odd["row"] else rows).select("key", "embedding", lot.alias("lot"))
    # By id, so that each task meets one lot; the hash has the vector, as keys may be missing.
    even = dealt.repartitionById(parts * lots, (F.pmod(F.xxhash64("key", "embedding"), F.lit(parts)) * lots + F.col("lot")).cast("int"))

    def unit(vec: np.ndarray) -> np.ndarray:
        vec = vec.reshape(-1, size).astype(float)
        length = np.linalg.norm(vec, axis=1, keepdims=True)
        return vec / np.where(length == 0, 1.0, length)

    found = None
    for i in range(blocks):
        some = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i)
        near = []
        if odd["row"]:
            near.append(rows.filter(~sound).join(F.broadcast(some.select("query", F.col("embedding").alias("q"))), apart))
        if odd["query"] and (blocks == 1 or some.filter(~clear).head(1)):
            near.append(rows.filter(sound).join(F.broadcast(some.filter(~clear).select("query", F.col("embedding").alias("q"))), apart))
        for pairs in near:
            joined = pairs.select("query", "key", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
            found = joined if found is None else found.unionByName(joined)
        asked = (some.filter(clear) if odd["query"] else some).toArrow().combine_chunks()
        if not asked.num_rows or not fit["row"]:
            continue
        names = asked.column("query").combine_chunks()
        vectors = pc.list_flatten(asked.column("embedding")).to_numpy()
        sent = rows.sparkSession.sparkContext.broadcast((names, unit(vectors)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            full = [b for b in batches if b.num_rows]
            if not full:
                return
            lot, (names, asked) = full[0].column(2)[0].as_py(), sent.value
            mine = slice(lot * len(names) // lots, (lot + 1) * len(names) // lots)
            names, asked = names[mine], asked[mine]
            keys = pa.chunked_array([b.column(0) for b in full]).combine_chunks()
            order = pc.sort_indices(keys, sort_keys=[("", "ascending")], null_placement="at_start")
            keys = keys.take(order)
            vec = unit(np.concatenate([b.column(1).flatten().to_numpy(zero_copy_only=False) for b in full]).reshape(-1, size)[order.to_numpy()])
            brief, n = vec.astype(np.float32), len(keys)
            # Each query's hits are at least those of its best group; what a sum of single
            # precision and the rounding of scores may be off is twice taken off.
            wide = max(1, min(32, n // (4 * most)))
            groups, slack = n // wide, 4 * (size + 4) * 2.0**-24 + 2e-6
            own: dict = {}
            for at, key in enumerate(keys.to_pylist() if others else []):
                own.setdefault(key, []).append(at)
            for i in range(0, len(names), 32):
                sims = asked[i : i + 32].astype(np.float32) @ brief.T
                for at, name in enumerate(names[i : i + 32].to_pylist() if others else []):
                    sims[at, own.get(name, [])] = -2.0
                least = np.full((len(sims), 1), -1.5, dtype=np.float32)
                if groups > most:
                    peaks = sims[:, : groups * wide].reshape(len(sims), wide, groups).max(axis=1)
                    least = np.maximum(least, np.partition(peaks, groups - most, axis=1)[:, groups - most, None] - np.float32(slack))
                ask, hit = np.nonzero(sims >= least)
                score = np.concatenate([np.einsum("ij,ij->i", asked[i + ask[j : j + 65_536]], vec[hit[j : j + 65_536]]) for j in range(0, len(ask), 65_536)] or [np.zeros(0)])
                # Score and place in one number: the greatest are the first by score, then key.
                mark = (np.copysign(np.floor(np.abs(score) * 1e6 + 0.5), score).astype(np.int64) << 32) + (n - 1 - hit)
                order = np.lexsort((-mark, ask))
                ask, mark = ask[order], mark[order]
                first = np.arange(len(ask)) - np.searchsorted(ask, ask) < most
                ask, mark = ask[first], mark[first]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(i + ask)), keys.take(pa.array(n - 1 - (mark & 0xFFFFFFFF))), pa.array((mark >> 32) / 1e6)], names=["query", "key", "score"])

        hits = even.mapInArrow(run, schema)
        found = hits if found is None else found.unionByName(hits)
    return rows.sparkSession.createDataFrame([], schema) if found is None else found


def vector_top(rows: DataFrame, queries: DataFrame, pool: int = POOL, most_queries: int = 10_000) -> DataFrame:
    """(query, key, score, rank): exact cosine of every row with every query, in blocks."""
    near = nearest(rows, queries, pool, at_once=most_queries)
    return top(near.withColumn("order", F.col("score")), pool).select("query", "key", "score", "rank")


def seeds(arms: Sequence[DataFrame], most: int = SEEDS) -> DataFrame:
    """(query, key, nth): the arms' first rows, each key at its first place."""
    every = None
    for i, arm in enumerate(arms):
        part = arm.filter(F.col("rank") <= most).select("query", "key", F.lit(i).alias("arm"), "rank")
        every = part if every is None else every.unionByName(part)
    first = every.groupBy("query", "key").agg(F.min(F.struct("arm", "rank")).alias("at"))
    return first.select("query", "key", F.row_number().over(Window.partitionBy("query").orderBy("at")).cast("long").alias("nth"))


def fuse(arms: dict[str, DataFrame], weights: dict[str, float] = ARM_WEIGHTS) -> DataFrame:
    """(query, key, fused, signals): weighted reciprocal ranks; first arm first on ties."""
    every = None
    for i, (name, arm) in enumerate(arms.items()):
        part = arm.select("query", "key", F.lit(name).alias("arm"), F.struct(F.lit(i), "rank").alias("seen"), (F.lit(weights.get(name, 1.0)) / (RRF + F.col("rank"))).alias("share"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("query", "key").agg(F.round(F.sum("share"), 9).alias("fused"), F.array_join(F.array_sort(F.collect_set("arm")), "+").alias("signals"), F.min("seen").alias("seen"))


def _near_ids(df: DataFrame, name: str) -> Column:
    """A group of 512 ids that follow each other; of other keys one of 256 by hash."""
    whole = df.schema[name].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    return F.shiftright(F.col(name).cast("long"), 9) if whole else F.pmod(F.xxhash64(name), F.lit(256).cast("long"))


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places of the ranges that begin at ``starts``, one range after the other."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def _by_first(table: pa.Table, first: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct values of a column, where each one's rows begin (and the last end), and their order."""
    coded = table.column(first).combine_chunks().dictionary_encode()
    codes = coded.indices.to_numpy()
    return coded.dictionary, np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))]), np.argsort(codes, kind="stable")


def _reach(frontier: pa.Table, edges: pa.Table, at_once: int = 1 << 20) -> pa.Table:
    """(query, node, sum_w) over one group's edges: paths meet in an array, ``at_once`` at a time."""
    values, begin, order = _by_first(edges, "a")
    ends = edges.column("b").combine_chunks().dictionary_encode()
    to, weight, width = ends.indices.to_numpy()[order], edges.column("weight").to_numpy()[order], len(ends.dictionary)
    asked, first, rows = _by_first(frontier, "query")
    node = pc.index_in(frontier.column("node").combine_chunks(), value_set=values).to_numpy()[rows]
    so_far = frontier.column("sum_w").to_numpy()[rows]
    counts = begin[node + 1] - begin[node]
    query = np.repeat(np.arange(len(asked)), np.diff(first))
    step, found = max(1, at_once // width), []
    for q in range(0, len(asked), step):
        some = min(step, len(asked) - q)
        most, hit = np.full(some * width, np.nan), np.zeros(some * width, bool)
        low, high = first[q], first[q + some]
        cuts = low + np.flatnonzero(np.diff(np.cumsum(counts[low:high]) // at_once, prepend=0))
        for x, y in pairwise([low, *cuts[cuts > low], high]):
            n, edge = counts[x:y], _spread(begin[node[x:y]], counts[x:y])
            place = np.repeat((query[x:y] - q) * width, n) + to[edge]
            np.fmax.at(most, place, np.repeat(so_far[x:y], n) + weight[edge])
            hit[place] = True
        place = np.flatnonzero(hit)
        sums = most[place]
        found.append(pa.table({"query": asked.take(pa.array(q + place // width)), "node": ends.dictionary.take(pa.array(place % width)), "sum_w": pa.array(sums, mask=np.isnan(sums))}))
    return pa.concat_tables(found)


def khop(seeds_: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """(query, node, hop, sum_w): nodes within reach over undirected edges, each at its
    least hop, with the heaviest sum of weights among the shortest paths.

    Edges are dealt by the group of ids they lead to, and a query's frontier goes to
    the groups that it has edges into; there paths meet in arrays, so that no path
    becomes a row. What a longer way gives to a node loses to its least hop.
    """
    ways = F.array(F.struct(F.col("lo").alias("a"), F.col("hi").alias("b"), "weight"), F.struct(F.col("hi").alias("a"), F.col("lo").alias("b"), "weight"))
    both = edges.select(F.inline(ways)).filter("a IS NOT NULL AND b IS NOT NULL").withColumn("weight", F.col("weight").cast("double"))
    both = both.withColumn("part", _near_ids(both, "b"))
    into = both.select("a", "part").distinct()
    kind = {"query": seeds_.schema["query"].dataType.simpleString(), "node": both.schema["b"].dataType.simpleString()}
    frontier = seeds_.select("query", F.col("node").cast(kind["node"])).distinct().withColumn("sum_w", F.lit(0.0))
    seen = frontier.withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        sent = frontier.join(into, F.col("node") == F.col("a")).select(F.col("part").alias("for"), "query", "node", "sum_w")
        frontier = sent.groupBy("for").cogroup(both.groupBy("part")).applyInArrow(_reached, f"query {kind['query']}, node {kind['node']}, sum_w double")
        seen = seen.unionByName(frontier.withColumn("hop", F.lit(hop)))
    sums = [F.max(F.when(F.col("hop") == h, F.col("sum_w"))).alias(f"_{h}") for h in range(hops + 1)]
    least = seen.groupBy("query", "node").agg(F.min("hop").alias("hop"), *sums)
    return least.select("query", "node", "hop", F.element_at(F.array(*[f"_{h}" for h in range(hops + 1)]), F.col("hop") + 1).alias("sum_w"))


def _reached(frontier: pa.Table, edges: pa.Table) -> pa.Table:
    if not frontier.num_rows or not edges.num_rows:
        return pa.table({"query": frontier.column("query")[:0], "node": edges.column("b")[:0], "sum_w": pa.array([], pa.float64())})
    return _reach(frontier, edges)


def first_memories(near: DataFrame, mentions: DataFrame, most: int = 50, pool: int = POOL, weight: DataFrame | None = None, but: DataFrame | None = None, strays: bool = False) -> DataFrame:
    """(query, key, score): the first ``pool`` memories of each query's entities (near: query,
    node, hop, trust), of which each gives its first ``most``: 1 / (1 + least hop) *
    (0.5 + 0.5 * greatest trust) * its weight (key, weight), rounded, then by key.

    Memories without a weight are no hits, or with ``strays`` weigh one; those in ``but``
    (query, key) are no hits of that query. An entity's memories are cut before the
    join, and go once to each group of queries; there they meet in arrays.
    """
    kinds = {f.name: f.dataType.simpleString() for f in [*near.schema, *mentions.schema]}
    own = F.row_number().over(Window.partitionBy("entity").orderBy("memory"))
    first = mentions.select("entity", "memory").withColumn("_n", own).filter(F.col("_n") <= most).drop("_n")
    if weight is None:
        first = first.withColumn("weight", F.lit(1.0))
    else:
        weighed = weight.select("key", F.col("weight").cast("double"))
        first = first.filter("memory IS NOT NULL").join(weighed, F.col("memory") == F.col("key"), "left" if strays else "inner").select("entity", "memory", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    near = near.select("query", "node", "hop", "trust", F.lit(None).cast(kinds["memory"]).alias("but"))
    # The filter reads trust and lets all through, so that both uses of the nodes in reach have one plan and one shuffle.
    asked = near.groupBy(_near_ids(near, "query").alias("part"), "node").agg(F.max("trust").alias("_t")).filter(F.coalesce("_t", F.lit(0.0)) >= float("-inf"))
    sent = asked.join(first, F.col("node") == F.col("entity")).select(F.col("part").alias("for"), "entity", "memory", "weight")
    if but is not None:
        near = near.unionByName(but.filter("key IS NOT NULL").select("query", F.col("key").cast(kinds["memory"]).alias("but")), allowMissingColumns=True)
    near = near.withColumn("part", _near_ids(near, "query"))

    def best(near: pa.Table, held: pa.Table) -> pa.Table:
        empty = pa.table({"query": near.column("query")[:0], "key": held.column("memory")[:0], "score": pa.array([], pa.float64())})
        if not near.num_rows or not held.num_rows:
            return empty
        values, begin, order = _by_first(held, "entity")
        coded = held.column("memory").combine_chunks().dictionary_encode()
        sort = pc.sort_indices(coded.dictionary).to_numpy()
        keys, place, n = coded.dictionary.take(pa.array(sort)), np.argsort(sort), len(sort)
        memory = place[coded.indices.to_numpy()][order]
        weight = np.ones(n)
        weight[memory] = held.column("weight").to_numpy()[order]
        asked, start, rows = _by_first(near, "query")
        at = pc.index_in(near.column("node").combine_chunks(), value_set=values).fill_null(-1).to_numpy()[rows]
        apart = pc.index_in(near.column("but").combine_chunks(), value_set=keys, skip_nulls=True).fill_null(-1).to_numpy()[rows]
        hop, trust, found = near.column("hop").to_numpy()[rows], near.column("trust").to_numpy()[rows], [empty]
        for q in range(len(asked)):
            every = np.arange(start[q], start[q + 1])
            some = every[at[every] >= 0]
            counts = begin[at[some] + 1] - begin[at[some]]
            to = memory[_spread(begin[at[some]], counts)]
            least, greatest = np.full(n, np.inf), np.full(n, np.nan)
            np.minimum.at(least, to, np.repeat(hop[some].astype(float), counts))
            np.fmax.at(greatest, to, np.repeat(trust[some], counts))
            least[apart[every[apart[every] >= 0]]] = np.inf
            hit = np.flatnonzero(np.isfinite(least))
            mark = (np.floor(1.0 / (1 + least[hit]) * (0.5 + 0.5 * greatest[hit]) * weight[hit] * 1e6 + 0.5).astype(np.int64) << 32) + (n - 1 - hit)
            mark = np.partition(mark, max(0, len(mark) - pool))[-pool:] if len(mark) else mark
            found.append(pa.table({"query": asked.take(pa.array(np.full(len(mark), q))), "key": keys.take(pa.array(n - 1 - (mark & 0xFFFFFFFF))), "score": (mark >> 32) / 1e6}))
        return pa.concat_tables(found)

    return near.groupBy("part").cogroup(sent.groupBy("for")).applyInArrow(best, f"query {kinds['query']}, key {kinds['memory']}, score double")


def rerank_coverage(query: Column, text: Column) -> Column:
    """Share of the query's tokens that the text has."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, tokens(text))) / F.size(q))


def rerank(rows: DataFrame, score: Column, top_n: int = 50) -> DataFrame:
    """The first ``top_n`` rows with a new score and rank; the tail is dropped."""
    return top(rows.filter(F.col("rank") <= top_n).withColumn("order", F.round(score, 6)), None)


def minmax(value: str) -> Column:
    """Value scaled to its range within the query; a range of zero counts as one."""
    w = Window.partitionBy("query")
    low, high = F.min(value).over(w), F.max(value).over(w)
    return (F.col(value) - low) / F.when(high == low, 1.0).otherwise(high - low)


def _picks(fused: np.ndarray, vec: list[np.ndarray], k: int, lambda_: float) -> list[int]:
    """Places of one query's picks; its rows come by descending relevance, then key."""
    known = fused[~np.isnan(fused)]
    low, high = (known.min(), known.max()) if len(known) else (0.0, 0.0)
    rel = np.where(np.isnan(fused), 0.0, (fused - low) / ((high - low) or 1.0))
    size = max(len(v) for v in vec)
    unit = np.array([v if len(v) == size else np.zeros(size) for v in vec], dtype=float).reshape(len(vec), size)
    unit[~np.isfinite(unit).all(axis=1)] = 0.0
    length = np.linalg.norm(unit, axis=1, keepdims=True)
    unit /= np.where(length == 0, 1, length)
    chosen, near = [], np.full(len(vec), -np.inf)
    for _ in range(min(k, len(vec))):
        value = lambda_ * rel - (1 - lambda_) * np.where(np.isneginf(near), 0.0, near)
        value[chosen] = -np.inf
        best = int(np.argmax(value))
        chosen.append(best)
        near = np.maximum(near, unit @ unit[best])
    return chosen


def mmr(rows: DataFrame, k: int, lambda_: float) -> DataFrame:
    """(query, key, pick): greedy relevance against closeness to what is picked.

    rows: query, key, fused, embedding; a query has at most its pool of rows, so
    a group is bounded. Rows come sorted, in batches of many queries; one that goes
    on in the next batch waits. A vector that is missing, of another size than the
    longest or without some element is a zero vector; a missing relevance is the least.
    """

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches, [None]):
            if batch is not None:
                held = pa.concat_tables([*([held] if held else []), pa.Table.from_batches([batch])]).combine_chunks()
            if not held:
                continue
            table, names = held, held.column("query").combine_chunks()
            codes = names.dictionary_encode(null_encoding="encode").indices.to_numpy()
            ends = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            if batch is not None:
                # The last query may go on in the next batch.
                held, ends = table.slice(ends[-2]), ends[:-1]
            fused, lists = table.column("fused").to_numpy().astype(float), table.column("embedding").combine_chunks()
            begin, values, there = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False), lists.is_valid().to_numpy(zero_copy_only=False)
            at, nth = [], []
            for first, last in pairwise(ends):
                chosen = _picks(fused[first:last], [values[begin[i] : begin[i + 1]] if there[i] else values[:0] for i in range(first, last)], k, lambda_)
                at += [first + i for i in chosen]
                nth += range(1, len(chosen) + 1)
            if at:
                yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), table.column("key").combine_chunks().take(pa.array(at)), pa.array(nth, pa.int64())], names=["query", "key", "pick"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    sorted_ = rows.select("query", "key", "fused", "embedding").repartition("query").sortWithinPartitions("query", F.desc("fused"), "key")
    return sorted_.mapInArrow(pick, f"query {kinds['query']}, key {kinds['key']}, pick long")


def line(event_time: Column, text: Column) -> Column:
    return F.when(F.coalesce(event_time, F.lit("")) != "", F.concat(F.lit("- ["), event_time, F.lit("] "), text)).otherwise(F.concat(F.lit("- "), text))


def pack_prefix(rows: DataFrame, budget: int, order: Sequence[Column]) -> DataFrame:
    """Rows kept while the running cost stays within the budget; the first that does not ends it."""
    running = F.sum(token_cost(F.col("text"))).over(Window.partitionBy("query").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running", running).filter(F.col("running") <= budget)


def pack_tiers(rows: DataFrame, budget: int) -> DataFrame:
    """(query, key): two greedy passes that skip what does not fit: by tier within the
    tier's share, then by score within the whole.

    rows: query, key, tier, score, text; a query has at most k rows.
    """
    order = list(TIERS)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(at=pdf.tier.map(lambda t: order.index(t) if t in order else len(order))).sort_values(["at", "score", "key"], ascending=[True, False, True])
        spent, used, kept = 0, dict.fromkeys(order, 0), []
        for r in pdf.itertuples():
            cap = int(budget * TIERS.get(r.tier, 0.0))
            if used.get(r.tier, 0) + r.cost <= cap and spent + r.cost <= budget:
                kept.append(r.key)
                spent += r.cost
                used[r.tier] = used.get(r.tier, 0) + r.cost
        for r in pdf.sort_values(["score", "key"], ascending=[False, True]).itertuples():
            if r.key not in kept and spent + r.cost <= budget:
                kept.append(r.key)
                spent += r.cost
        return pdf[pdf.key.isin(kept)][["query", "key"]]

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    slim = rows.select("query", "key", "tier", "score", token_cost(F.col("text")).alias("cost"))
    return slim.groupBy("query").applyInPandas(pack, f"query {kinds['query']}, key {kinds['key']}")


def touch(memories: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """Hit memories with their access counted and dated; a copy of the table."""
    hit = hits.select("key").distinct().withColumn("hit", F.lit(True))
    count = F.when(F.coalesce("access_count", F.lit(0)) == 0, 1).otherwise(F.col("access_count")) + 1
    return memories.join(hit, "key", "left").withColumns({"access_count": F.when(F.col("hit"), count).otherwise(F.col("access_count")), "accessed_at": F.when(F.col("hit"), now).otherwise(F.col("accessed_at"))}).drop("hit")


def vector_blocks(rows: DataFrame, pool: DataFrame, most: int = 16_384) -> DataFrame:
    """(key, best, score): each row's best of a pool (key, embedding), in numpy blocks.

    The pool goes to the tasks in blocks of at most ``most`` vectors; the blocks'
    bests meet in one aggregation.
    """
    parts = pool.count() // most + 1
    spark = rows.sparkSession
    kind = rows.schema["key"].dataType.simpleString()
    found = None
    for i in range(parts):
        some = (pool if parts == 1 else pool.filter(F.pmod(F.xxhash64("key"), F.lit(parts)) == i)).orderBy("key").collect()
        if not some:
            continue
        unit = np.array([r.embedding for r in some], dtype=float)
        unit = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
        held, names = spark.sparkContext.broadcast(unit), [r.key for r in some]

        def run(batches: Iterator[pa.RecordBatch], held=held, names=names) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for b in batches:
                vec = np.array(b.column(1).to_pylist(), dtype=float)
                if not len(vec):
                    continue
                sims = (vec / np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-300)) @ held.value.T
                best = sims.argmax(1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([names[x] for x in best], b.schema.field(0).type), pa.array(np.round(sims[np.arange(len(best)), best], 6))], names=["key", "best", "score"])

        near = rows.select("key", "embedding").mapInArrow(run, f"key {kind}, best {kind}, score double")
        found = near if found is None else found.unionByName(near)
    if found is None or parts == 1:
        return found if found is not None else rows.select("key", F.lit(None).cast(kind).alias("best"), F.lit(None).cast("double").alias("score"))
    order = F.struct("score", (-F.col("best")).alias("minus")) if kind in ("int", "bigint") else F.struct("score", "best")
    return found.groupBy("key").agg(F.max_by("best", order).alias("best"), F.max("score").alias("score"))


MOST_MEMORIES = 50
LITE, FULL, MULTIHOP = "lite", "full", "multihop"


def graph_arm(seeds_: DataFrame, mentions: DataFrame, entities: DataFrame, edges: DataFrame, weight: DataFrame, hops: int = 2, pool: int = POOL, most: int = MOST_MEMORIES, strays: bool = False) -> DataFrame:
    """(query, key, score, rank): memories of the entities near those that the seeds mention.

    seeds: query, key; mentions: memory, entity; entities: key, belief, centrality;
    edges: lo, hi, weight; weight: key, weight. An entity's trust is the greatest of its
    belief, its centrality and the mean weight of the best path there; a memory's
    score is 1 / (1 + least hop) * (0.5 + 0.5 * greatest trust) * its weight; without one it
    is no hit, or with ``strays`` weighs one. Seeds are no hits; an entity gives its first
    ``most`` memories.
    """
    start = seeds_.join(mentions, F.col("key") == F.col("memory")).select("query", F.col("entity").alias("node")).distinct()
    reach = khop(start, edges, hops)
    known = entities.select(F.col("key").alias("node"), "belief", "centrality")
    path = F.when(F.col("hop") > 0, F.col("sum_w") / F.col("hop"))
    near = reach.join(known, "node").withColumn("trust", F.coalesce(F.greatest("belief", "centrality", path), F.lit(0.0)))
    scored = first_memories(near, mentions, most, pool, weight, seeds_, strays)
    return top(scored.withColumn("order", F.col("score")), pool).select("query", "key", "score", "rank")


def gather(memories: DataFrame, queries: DataFrame, now: Column, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, graph: tuple[DataFrame, DataFrame, DataFrame] | None = None, pool: int = POOL, hops: int = 2, strays: bool = False) -> DataFrame:
    """(query, key, fused, signals): the arms' lists fused and faded by age.

    memories: key, text, strength, accessed_at. Without vectors the vector arm is
    left out, without a graph (mentions, entities, edges) the graph arm. With ``strays``
    vectors and mentions of no memory in the table are hits too, undated and so of no age.
    """
    strong = memories.withColumn("strength", F.when(F.coalesce("strength", F.lit(0.0)) == 0, 1.0).otherwise(F.col("strength")))
    fade = decay_multiplier(F.col("strength"), F.col("accessed_at"), now)
    arms = {"bm25": bm25(strong, queries, weight=fade, pool=pool)}
    if vectors is not None and query_vectors is not None:
        live = vectors if strays else vectors.join(memories.select("key"), "key", "left_semi")
        arms["vector"] = vector_top(live, query_vectors, pool)
    if graph is not None and hops > 0:
        first = seeds(list(arms.values())).select("query", "key")
        arms["graph"] = graph_arm(first, *graph, strong.select("key", fade.alias("weight")), hops, pool, strays=strays)
    found = fuse(arms)
    aged = found.join(strong.select("key", effective_strength(F.col("strength"), F.col("accessed_at"), now).alias("alive")), "key", "left" if strays else "inner")
    return aged.select("query", "key", F.round(F.col("fused") * F.coalesce("alive", F.lit(1.0)), 9).alias("fused"), "signals")


def best_hits(found: DataFrame, memories: DataFrame, k: int, budget: int, vectors: DataFrame | None = None, lambda_: float = 1.0, scorer: Column | None = None, texts: DataFrame | None = None, top_n: int = 50) -> DataFrame:
    """(query, key, text, score, rank, signals): reranked, diversified, packed by tiers.

    ``scorer`` rescores the first ``top_n`` with ``query_text`` (from texts: query, text)
    and ``text`` at hand and drops the rest. A lambda of one takes the best k as they are.
    """
    ranked = top(found, None, "fused")
    if scorer is not None:
        rows = ranked.filter(F.col("rank") <= top_n).join(memories.select("key", "text"), "key").join(texts.select("query", F.col("text").alias("query_text")), "query")
        ranked = top(rows.withColumn("fused", F.round(scorer, 6)).select("query", "key", "fused", "signals"), None, "fused")
    if lambda_ >= 1.0 or vectors is None:
        chosen = ranked.filter(F.col("rank") <= k)
    else:
        empty = F.array().cast("array<double>")
        rows = ranked.filter(F.col("rank") <= max(top_n, k)).join(vectors.select("key", "embedding"), "key", "left").withColumn("embedding", F.coalesce("embedding", empty))
        chosen = ranked.join(mmr(rows, k, lambda_).select("query", "key"), ["query", "key"])
    full = chosen.drop("rank").join(memories.select("key", "text", F.col("type").alias("tier")), "key").withColumnRenamed("fused", "score")
    kept = pack_tiers(full, budget)
    packed = full.join(kept, ["query", "key"])
    return top(packed, None, "score").select("query", "key", "text", F.round("score", 6).alias("score"), "rank", "signals")
