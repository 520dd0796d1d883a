"""Operators that work in blocks against plain ones, with ties, copies and odd rows."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from anamnesis import catalog
from anamnesis.functions.text import tokens
from anamnesis.operators import ingest, retrieve

VECTORS = [(i, [float(i % 7) - 3, float(i % 5) - 2, float(i % 3)]) for i in range(120)] + [(200, None), (201, []), (202, [1.0]), (203, [0.0, 0.0, 0.0]), (204, [1.0, None, 2.0])]


def frame(spark, rows, name="key"):
    return spark.createDataFrame(rows, f"{name} long, embedding array<double>")


def plain_cosine(a, b):
    if a == [] or b == []:
        return 0.0
    if a is None or b is None or None in a or None in b:
        return None
    length = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    if length and len(a) != len(b):
        return None
    return round(sum(x * y for x, y in zip(a, b, strict=False)) / length, 6) + 0.0 if length else 0.0


def test_resolve_makes_no_row_of_each_pair(spark):
    v = frame(spark, VECTORS)
    got = {r.key: r for r in ingest.resolve(v.filter("key % 3 = 0"), v).collect()}
    for key, e in VECTORS:
        if key % 3 == 0:
            score, other = max((-1.0 if (c := plain_cosine(e, f)) is None else c, -k) for k, f in VECTORS if k != key)
            assert (got[key].similarity, got[key].match) == (score, -other), key
    plan = ingest.resolve(v.filter("key % 3 = 0 AND key < 200"), v)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
    near = retrieve.nearest(v.filter("key < 120"), v.filter("key < 50").withColumnRenamed("key", "query"), 1, others=True, held=60)
    assert near.count() <= 50 * 3


def test_vector_arm_in_blocks_is_exact(spark):
    v = frame(spark, VECTORS)
    asked = v.filter("key % 4 = 0 OR key > 199").withColumnRenamed("key", "query")
    got = {}
    for r in retrieve.vector_top(v, asked, 9, most_queries=10).collect():
        got.setdefault(r.query, []).append((r["rank"], r.key, r.score))
    for query, q in VECTORS:
        if query % 4 == 0 or query > 199:
            scored = [(plain_cosine(e, q), k) for k, e in VECTORS]
            want = sorted(scored, key=lambda x: (x[0] is None, -(x[0] or 0.0), x[1]))[:9]
            assert sorted(got[query]) == [(i, k, c) for i, (c, k) in enumerate(want, 1)], query
    assert "MapInArrow" in retrieve.vector_top(v, asked, 9)._jdf.queryExecution().optimizedPlan().toString()


def test_vector_arm_leaves_few_hits_to_merge(spark):
    rng = np.random.default_rng(5)
    drawn = rng.normal(size=(40_000, 16)).astype(np.float32)
    # Copies of one vector, so that equal scores are more than the hits asked for.
    drawn[:900], drawn[900] = drawn[0], 0
    v = spark.createDataFrame(pa.table({"key": np.arange(40_000), "embedding": list(drawn)}))
    asked = v.filter("key % 80 = 0").withColumnRenamed("key", "query")
    near = retrieve.nearest(v, asked, 20)
    # Two parts of the rows give hits; lots of the queries keep the cores busy.
    assert near.count() == 2 * 20 * 500
    exact = drawn.astype(float)
    length = np.linalg.norm(exact, axis=1, keepdims=True)
    exact /= np.where(length == 0, 1.0, length)
    got = {}
    for r in retrieve.vector_top(v, asked, 20).collect():
        got.setdefault(r.query, []).append((r["rank"], r.key, r.score))
    assert len(got) == 500
    for query in (0, 80, 880, 960, 4000, 39_920):
        scores = np.round(exact @ exact[query], 6) + 0.0
        first = np.lexsort((np.arange(len(scores)), -scores))[:20]
        assert sorted(got[query]) == [(i, k, scores[k]) for i, k in enumerate(first.tolist(), 1)], query


def plain_picks(rows, k, lambda_):
    rows = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0.0), r[0]))
    known = [f for _, f, _ in rows if f is not None]
    low, high = min(known, default=0.0), max(known, default=0.0)
    rel = {key: 0.0 if f is None else (f - low) / ((high - low) or 1.0) for key, f, _ in rows}
    vec, picked = {key: e for key, _, e in rows}, []
    while len(picked) < min(k, len(rows)):
        left = [key for key, _, _ in rows if key not in picked]
        near = lambda key: max((plain_cosine(vec[key], vec[p]) or 0.0 for p in picked), default=0.0)
        picked.append(max(left, key=lambda key: round(lambda_ * rel[key] - (1 - lambda_) * near(key), 9)))
    return picked


def test_mmr_takes_batches_of_many_queries(spark):
    rng = np.random.default_rng(3)
    queries = {q: [(key, round(float(rng.random()), 3), [round(float(x), 2) for x in rng.normal(size=4)]) for key in range(1 + q % 13)] for q in range(40)}
    queries[50] = [(1, 0.9, [1.0, 0.0]), (2, 0.8, None), (3, None, [0.0, 1.0]), (4, 0.1, [1.0, None]), (5, 0.4, [1.0]), (6, None, None)]
    queries[51] = [(1, None, None), (2, None, [])]
    rows = spark.createDataFrame([(q, *r) for q, some in queries.items() for r in some], "query long, key long, fused double, embedding array<float>")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for most in ("5", size):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            picks = retrieve.mmr(rows, 5, 0.6)
            got = {}
            for r in picks.orderBy("query", "pick").collect():
                got.setdefault(r.query, []).append((r["pick"], r.key))
            for q, some in queries.items():
                assert got[q] == list(enumerate(plain_picks(some, 5, 0.6), 1)), q
            assert len(got) == len(queries)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert "MapInArrow" in picks._jdf.queryExecution().optimizedPlan().toString()


def test_khop_makes_no_row_of_each_path(spark):
    pairs = [(i, j, ((i * 7 + j * 3) % 11) / 16) for i in range(0, 1400, 20) for j in range(i + 20, min(i + 700, 1400), 60)] + [(3, 3, 0.5), (20, 20, 1.0)]
    edges = spark.createDataFrame(pairs, "lo long, hi long, weight double")
    starts = [(9, 0), (9, 700), (8, 40), (7, 3), (6, 77777)]
    both = [x for a, b, w in pairs for x in ((a, b, w), (b, a, w))]
    want = {}
    for query in {q for q, _ in starts}:
        seen = {n: (0, 0.0) for q, n in starts if q == query}
        front = {n: 0.0 for n in seen}
        for hop in (1, 2):
            now = {}
            for a, b, w in both:
                if a in front and b not in seen:
                    now[b] = max(now.get(b, 0.0), front[a] + w)
            seen |= {n: (hop, s) for n, s in now.items()}
            front = now
        want |= {(query, n): x for n, x in seen.items()}
    for name in ("long", "string"):
        typed = edges.select(F.col("lo").cast(name).alias("lo"), F.col("hi").cast(name).alias("hi"), "weight")
        start = spark.createDataFrame(starts, "query long, node long").select("query", F.col("node").cast(name).alias("node"))
        reach = retrieve.khop(start, typed)
        assert {(r["query"], int(r.node)): (r.hop, r.sum_w) for r in reach.collect()} == want
    assert "FlatMapCoGroupsInArrow" in reach._jdf.queryExecution().optimizedPlan().toString()


def test_reach_in_pieces_is_the_same():
    front = pa.table({"query": [1, 1, 2, 2], "node": [5, 6, 6, 5], "sum_w": [0.5, 0.0, 1.0, 0.0]})
    edges = pa.table({"a": [5, 5, 6, 6, 6], "b": [1, 2, 2, 3, 1], "weight": [0.25, 0.5, 1.0, 0.5, None]})
    whole = sorted(retrieve._reach(front, edges).to_pylist(), key=str)
    assert whole == sorted(retrieve._reach(front, edges, 1).to_pylist(), key=str) == sorted(retrieve._reach(front, edges, 4).to_pylist(), key=str)
    assert {(r["query"], r["node"]): r["sum_w"] for r in whole} == {(1, 1): 0.75, (1, 2): 1.0, (1, 3): 0.5, (2, 1): 0.25, (2, 2): 2.0, (2, 3): 1.5}


def test_first_memories_meet_before_they_are_rows(spark):
    near = [(q, n, (q + n) % 3, (n % 9) / 9) for q in (1, 2, 600) for n in range(q % 5, 60)]
    mentions = [(m, n) for n in range(70) for m in range(n % 4, 90, 3)]
    want = {}
    for q, n, hop, trust in near:
        for m in sorted(m for m, e in mentions if e == n)[:20]:
            h, t = want.get((q, m), (9, 0.0))
            want[q, m] = min(h, hop), max(t, trust)
    want = {k: round(1 / (1 + h) * (0.5 + 0.5 * t), 6) for k, (h, t) in want.items()}
    first = {(q, m) for q in (1, 2, 600) for _, m in sorted((-s, m) for (p, m), s in want.items() if p == q)[:15]}
    got = retrieve.first_memories(spark.createDataFrame(near, "query long, node long, hop int, trust double"), spark.createDataFrame(mentions, "memory long, entity long"), 20, 15)
    assert {(r["query"], r.key): r.score for r in got.collect()} == {k: want[k] for k in first}


def test_first_memories_weigh_and_leave_out_seeds(spark):
    near = [(q, n, (q + n) % 3, (n % 9) / 9) for q in (1, 2, 600) for n in range(q % 5, 30)]
    mentions = [(m, n) for n in range(40) for m in range(n % 4, 90, 3)] + [(None, 3)]
    weight = {m: (m % 7) / 7 for m in range(60)}
    but = [(1, 0), (1, 3), (2, 6), (2, 1000), (600, None), (9, 1)]
    frames = [
        spark.createDataFrame(near, "query long, node long, hop int, trust double"), spark.createDataFrame(mentions, "memory long, entity long"), 20, 15,
        spark.createDataFrame(list(weight.items()), "key long, weight double"), spark.createDataFrame(but, "query long, key long"),
    ]
    for strays in (False, True):
        want = {}
        for q, n, hop, trust in near:
            # A missing memory comes first in its entity's order.
            for m in sorted((m for m, e in mentions if e == n), key=lambda m: (m is not None, m or 0))[:20]:
                if m is not None and (q, m) not in but and (strays or m in weight):
                    h, t = want.get((q, m), (9, 0.0))
                    want[q, m] = min(h, hop), max(t, trust)
        want = {(q, m): round(1 / (1 + h) * (0.5 + 0.5 * t) * weight.get(m, 1.0), 6) for (q, m), (h, t) in want.items()}
        first = {(q, m) for q in (1, 2, 600) for _, m in sorted((-s, m) for (p, m), s in want.items() if p == q)[:15]}
        got = retrieve.first_memories(*frames, strays=strays)
        assert {(r["query"], r.key): r.score for r in got.collect()} == {k: want[k] for k in first}


def test_word_arm_counts_lengths_without_arrays(spark):
    texts = ["İstanbul a1 b", "x²y½ ②z", "\U0001d49c\U0001d49e d'e", "  ", None, "ﬀ—é ß_q 漢字٣"]
    docs = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    asked = spark.createDataFrame([(1, "a1 z d ß 漢字")], "query long, text string")
    got = retrieve.bm25(docs, asked)
    assert "regexp_count" in got._jdf.queryExecution().analyzed().toString()
    lengths = {r.key: r.n for r in docs.select("key", F.size(tokens(F.col("text"))).alias("n")).collect()}
    cut = docs.select("key", F.explode(tokens(F.col("text"))).alias("t")).collect()
    mean, words, want = sum(lengths.values()) / len(texts), {"a1", "z", "d", "ß", "漢字"}, {}
    for key in range(len(texts)):
        for w in words:
            tf, df = sum(r.key == key and r.t == w for r in cut), len({r.key for r in cut if r.t == w})
            if tf:
                part = math.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[key] / mean))
                want[key] = want.get(key, 0.0) + part
    assert {r.key: r.score for r in got.collect()} == {k: round(x, 6) for k, x in want.items()} != {}


def test_topk_mmr_sends_vectors_as_stored(spark, small):
    picks = catalog.queries()["topk_mmr"](spark, small)
    assert "as array<double>" not in picks._jdf.queryExecution().optimizedPlan().toString()
    ranked, got = {}, {}
    vec = {r.vec_id: [float(x) for x in r.embedding] for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()}
    for r in catalog.queries()["ret_vector"](spark, small).collect():
        ranked.setdefault(r["query"], []).append((r.key, r.score, vec[r.key]))
    for r in picks.orderBy("query", "pick").collect():
        got.setdefault(r["query"], []).append(r.key)
    assert sorted(got) == sorted(ranked) == sorted(key for key in vec if key % 20 == 0)
    for query in sorted(ranked)[:4]:
        assert got[query] == plain_picks(ranked[query], 5, 0.7), query
