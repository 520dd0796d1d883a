"""Hand-computed values of single operators."""

import datetime as dt
import math

from pyspark.sql import functions as F

from anamnesis.functions import text as tx
from anamnesis.functions.vector import cosine, embed
from anamnesis.operators import evaluate, graph, ingest, lifecycle, retrieve
from anamnesis.sources import datasets
from anamnesis.streaming import turns as st


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_belief_of_three_mentions(spark):
    assert one(spark, ingest.belief(F.lit(3.0))) == 0.875


def test_edge_weight_of_two_confirmations(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, 2, t), (1, 2, t)], "lo int, hi int, ts timestamp")
    assert ingest.edge_weights(df, F.current_timestamp()).first().weight == 0.75


def test_decay_of_a_hundred_days(spark):
    now, then = F.lit("2024-04-10").cast("timestamp"), F.lit("2024-01-01").cast("timestamp")
    assert abs(one(spark, retrieve.effective_strength(F.lit(1.0), then, now)) - math.exp(-2)) < 1e-12
    assert one(spark, retrieve.effective_strength(F.lit(1.0), now, then)) == 1.0
    assert one(spark, retrieve.decay_multiplier(F.lit(1.0), now, then)) > 1.0


def mmr(spark, k, lambda_):
    rows = spark.createDataFrame([(1, "A", 1.0, [1.0, 0.0]), (1, "B", 0.4, [0.98, 0.02]), (1, "C", 0.6, [0.0, 1.0])], "query int, key string, fused double, embedding array<double>")
    return [r.key for r in retrieve.mmr(rows, k, lambda_).orderBy("pick").collect()]


def test_mmr(spark):
    assert mmr(spark, 3, 1.0) == ["A", "C", "B"]
    assert mmr(spark, 2, 0.0) == ["A", "C"]


def test_rrf_weighs_arms(spark):
    arm = lambda k: spark.createDataFrame([(1, k, 1)], "query int, key string, rank int")
    rows = {r.key: r for r in retrieve.fuse({"bm25": arm("x"), "graph": arm("y")}).collect()}
    assert rows["x"].fused > rows["y"].fused and rows["x"].signals == "bm25"


def test_label_propagation(spark):
    nodes = [("t", n) for n in ("a1", "a2", "a3", "b1", "b2", "b3", "b4")]
    edges = [("a1", "a2"), ("a2", "a3"), ("a1", "a3"), ("b1", "b2"), ("b2", "b3"), ("b1", "b3"), ("b3", "b4")]
    got = {r.node: r.community for r in graph.label_propagation(spark.createDataFrame(nodes, "tenant string, node string"), spark.createDataFrame(edges, "lo string, hi string")).collect()}
    assert {got[n] for n in ("b1", "b2", "b3", "b4")} == {0} and {got[n] for n in ("a1", "a2", "a3")} == {1}


def test_pagerank_of_a_star(spark):
    nodes = spark.createDataFrame([("hub",), ("a",), ("b",), ("c",)], "node string")
    edges = spark.createDataFrame([("hub", "a"), ("hub", "b"), ("hub", "c"), ("a", "a"), ("hub", "foreign")], "lo string, hi string")
    got = {r.node: r.rank for r in graph.pagerank(nodes, edges).collect()}
    assert got["hub"] == 1.0 and all(got[n] < 1 for n in "abc")


def test_topic_shift(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0, 0.0]), (1, 1, [0.8, 0.6, 0.0]), (1, 2, [0.0, 1.0, 0.0])], "session int, turn long, embedding array<double>")
    assert [r["shift"] for r in ingest.topic_shifts(df).orderBy("turn").collect()] == [False, False, True]


def test_capacity_keeps_seven(spark):
    rows = [("t", "a", 1, str(i), "working", dt.datetime(2024, 1, 1, i)) for i in range(9)]
    got = ingest.over_capacity(spark.createDataFrame(rows, "tenant string, agent string, session int, key string, type string, created_at timestamp")).collect()
    assert sorted(r.key for r in got if r.type == "episodic") == ["0", "1"]


def test_dream_prefers_the_stronger_belief(spark):
    rows = [("weak", 1, 0.3, True, "strong", None, True), ("strong", 9, 0.95, False, None, None, True)]
    e = spark.createDataFrame(rows, "key string, mention_count int, belief double, needs_review boolean, conflict_with string, community int, live boolean")
    v = spark.createDataFrame([("weak", True)], "key string, contradicts boolean")
    got = {r.key: r for r in lifecycle.dream_decisions(e, v, breaker=0.6).collect()}
    assert (got["weak"].action, got["weak"].winner, got["weak"].loser) == ("supersede", "strong", "weak") and got["strong"].action == "distil"
    assert {r.action for r in lifecycle.dream_decisions(e, v, breaker=0.4).collect()} == {"none"}


def test_best_match(spark):
    v = lambda rows: spark.createDataFrame(rows, "key int, embedding array<double>")
    got = {r.key: r for r in ingest.resolve(v([(1, [1.0, 0.0]), (9, [0.0, 0.0])]), v([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])])).collect()}
    assert got[1].match == 2 and got[1].verdict == "merge" and got[9].similarity == 0.0
    assert ingest.resolve(v([(1, [1.0])]), v([(1, [1.0])])).first().similarity == -1.0


def test_redaction(spark):
    text = "write a.b@c.org, 123-45-6789, sk-abcdefghijklmnop1, Bearer abcdefghijkl.mn"
    assert one(spark, tx.redacted(F.lit(text))) == "write [REDACTED_EMAIL], [REDACTED_SSN], [REDACTED_KEY], [REDACTED_TOKEN]"
    assert one(spark, tx.redacted(F.lit("Plain prose of 2024."))) == "Plain prose of 2024."


def test_dates(spark):
    day = lambda t: one(spark, tx.valid_time(F.lit(t)))
    assert day("on 2023-02-30 or May 2020") is None
    assert day("Sept. 3rd, 2021").date() == dt.date(2021, 9, 3) and day("in may 2020").date() == dt.date(2020, 5, 1) and day("since 1999").date() == dt.date(1999, 1, 1)


def test_caps_and_pairs(spark):
    names = one(spark, tx.caps_spans(F.lit("Alice met Bob Stone at Acme. Alice left A.")))
    assert names == ["Alice", "Bob Stone", "Acme"]
    pairs = one(spark, ingest.pairs_in_order(F.array(*map(F.lit, names))))
    assert [tuple(p) for p in pairs] == [("Alice", "Bob Stone"), ("Acme", "Alice"), ("Acme", "Bob Stone")]
    assert one(spark, ingest.pairs_in_order(F.array(F.lit("x")))) == []


def test_ontology_needs_three(spark):
    e = spark.createDataFrame([(i, f"n{i}", "Person" if i < 3 else "Company", "t") for i in range(6)], "key int, name string, label string, tenant string")
    edges = spark.createDataFrame([(0, 3), (1, 4), (2, 5)], "lo int, hi int")
    row = lifecycle.ontology_clusters(e, edges).first()
    assert (row.label_a, row.label_b, row.support, len(row.examples)) == ("Company", "Person", 3, 3)


def test_fixed_rate_windows(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    df = spark.createDataFrame([("u", at(s), i) for i, s in enumerate((0, 10, 20, 61, 62))], "user string, ts timestamp_ntz, event int")
    assert [r.limited for r in lifecycle.rate_limited(df, 2, 60).orderBy("event").collect()] == [False, False, True, False, False]


def test_percentiles(spark):
    df = spark.range(1, 101).select(F.lit("g").alias("g"), F.col("id").alias("v"))
    assert evaluate.nearest_rank(df, "g", "v", {"p95": 0.95}).first().p95 == 95
    assert evaluate.floor_rank(df, "g", "v", {"p95": 0.95}).first().p95 == 96


def test_f1_and_recall(spark):
    assert one(spark, evaluate.token_f1(F.lit("the cat sat"), F.lit("The cat! the"))) == 2 * 2 / 6
    assert one(spark, evaluate.token_f1(F.lit(""), F.lit("a"))) == 0.0
    assert one(spark, evaluate.recall_hit(F.array(F.lit("He said: Blue, car.")), F.lit("blue car")))
    assert one(spark, evaluate.classify(F.array(F.lit("a b")), F.array(F.lit("a b"), F.lit("c")), F.array(F.lit("c")))) == "ranking"


def test_prefix_stops_and_tiers_skip(spark):
    rows = spark.createDataFrame([(1, "a", "episodic", 3.0, "x " * 4), (1, "b", "episodic", 2.0, "x " * 9), (1, "c", "semantic", 1.0, "x " * 2)], "query int, key string, tier string, score double, text string")
    assert [r.key for r in retrieve.pack_prefix(rows, 8, [F.desc("score")]).collect()] == ["a"]
    assert sorted(r.key for r in retrieve.pack_tiers(rows, 8).collect()) == ["a", "c"]


def test_cosine_of_nothing(spark):
    assert one(spark, cosine(F.array().cast("array<double>"), F.array(F.lit(1.0)))) == 0.0
    e = {r.key: r.embedding for r in embed(spark.createDataFrame([(1, "a b a"), (2, "")], "key int, text string"), "key", "text").collect()}
    assert abs(sum(x * x for x in e[1]) - 1) < 1e-9 and not any(e[2])


def test_khop_is_minimal_and_unique(spark):
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.5), (1, 3, 0.1), (3, 4, 1.0), (4, 5, 1.0)], "lo int, hi int, weight double")
    got = {r.node: r.hop for r in retrieve.khop(spark.createDataFrame([(7, 1)], "query int, node int"), edges).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2}


def test_upsert_equals_one_pass_and_replay_adds_nothing(spark):
    found = spark.createDataFrame([("t", i % 7, f"n{i % 3}") for i in range(40)], "tenant string, key int, name string")
    whole = ingest.accumulate_entities(found, F.lit(0.5)).orderBy("name").collect()
    parts = ingest.upsert_entities(ingest.accumulate_entities(found.filter("key < 3"), F.lit(0.5)), ingest.accumulate_entities(found.filter("key >= 3"), F.lit(0.5))).orderBy("name").collect()
    assert [r.asDict() for r in whole] == [r.asDict() for r in parts]
    new = spark.createDataFrame([("k1",), ("k1",), ("k2",)], "key string")
    once = ingest.insert_ignore(new.limit(0), new)
    assert ingest.insert_ignore(once, new).count() == 2


def test_dataset_file(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"samples": [{"sample_id": "s", "sessions": [[{"speaker": "A", "text": "hi", "event_time": null}], [{"speaker": "B", "text": "yo"}]], "qa": [{"question": "q", "answer": "a", "abstention": true}]}]}')
    turns, questions = datasets.read_dataset(spark, str(tmp_path / "d.json"))
    assert [(r.session, r.turn, r.speaker) for r in turns.orderBy("session").collect()] == [(0, 0, "A"), (1, 0, "B")] and questions.first().abstention


def test_failing_batches_reach_the_dead_letters(spark, tmp_path):
    rows = spark.createDataFrame([("t", "a", 1, 0, "x"), ("t", "a", 1, 0, "x")], "tenant string, agent string, session int, turn int, text string")
    rows.write.parquet(str(tmp_path / "in"))
    (tmp_path / "blocked").write_text("a file where a folder should be")
    stream = st.read_turns(spark, str(tmp_path / "in"), rows.schema)
    st.ingest_stream(stream, str(tmp_path / "blocked"), str(tmp_path / "c1"), str(tmp_path / "dead"), 2, 0.01).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "dead")).first().attempts == 2
    st.ingest_stream(stream, str(tmp_path / "out"), str(tmp_path / "c2"), str(tmp_path / "dead2"), 2, 0.01).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_plans_push_down_and_stay_native(spark, small):
    plan = retrieve.bm25(spark.read.parquet(f"{small}/documents.parquet").withColumnRenamed("doc_id", "key"), spark.createDataFrame([(1, "the of")], "query int, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan and "lang" not in plan.split("ReadSchema")[1]
