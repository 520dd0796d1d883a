"""The engine's verbs, end to end on a small store."""

import datetime as dt
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from anamnesis.engine import Engine
from anamnesis.operators import lifecycle, retrieve
from anamnesis.streaming import queue

NOW = "2024-03-01"
# Workers cannot import this module: the models of the tests travel with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("engine")))
    rows = [("t1", "a", "s", 0, "Alice met Bob at Acme."), ("t1", "a", "s", 1, "Carol joined Acme."), ("t1", "b", "s", 2, "Dave left, mail d@x.org."), ("t2", "a", "s", 0, "Alice elsewhere.")]
    turns = spark.createDataFrame(rows, "tenant string, agent string, session string, turn long, text string")
    for _ in range(2):  # a replay changes nothing
        e.store(turns, F.lit(NOW).cast("timestamp"))
    return e


def test_store_is_idempotent(engine):
    assert engine.read("memories").count() == 4
    counts = {(r.tenant, r.name): r.mention_count for r in engine.read("entities").collect()}
    assert counts[("t1", "Acme")] == 2 and counts[("t2", "Alice")] == 1
    assert "[REDACTED_EMAIL]" in engine.read("memories").filter("turn = 2").first().text
    assert engine.read("relates").count() == 4


class Says:
    def __init__(self, said):
        self.said = said

    def complete(self, prompt):
        if self.said == "fault":
            raise RuntimeError(prompt)
        return self.said


class Longest:
    def score(self, query, texts):
        return [float(len(t)) for t in texts]


def broken():
    raise RuntimeError("no model")


def test_retrieve_fuses_three_arms_in_scope(engine):
    now = F.lit(NOW).cast("timestamp")
    hits = engine.retrieve("carol acme", "t1", ["a"], now).orderBy("rank").collect()
    assert hits[0].text == "Carol joined Acme." and "bm25" in hits[0].signals and "vector" in hits[0].signals
    assert {r.text for r in hits} <= {"Alice met Bob at Acme.", "Carol joined Acme."}
    assert [r.text for r in engine.retrieve("alice", "t2", ["a"], now).collect()] == ["Alice elsewhere."]
    # The word arm alone finds one memory and gives one seed; its entities lead to the other.
    live = engine._live("t1", ["a"], now)
    texts = engine.spark.createDataFrame([(0, "Carol")], "query int, text string")
    graph = engine.read("mentions"), engine.read("entities"), engine.read("relates").select("lo", "hi", F.lit(0.5).alias("weight"))
    found = {r.signals: r.key for r in retrieve.gather(live, texts, now, graph=graph).collect()}
    assert set(found) == {"bm25", "graph"}


def test_hits_count_as_accesses(engine):
    now = F.lit("2024-03-05").cast("timestamp")
    before = engine.read("accesses").count()
    key = engine.retrieve("alice elsewhere", "t2", ["a"], now).first().key
    assert engine.read("accesses").count() == before + 1
    row = engine._live("t2", ["a"], now).filter(F.col("key") == key).first()
    assert row.access_count >= 2 and str(row.accessed_at)[:10] == "2024-03-05"


def test_modes_and_faults(spark, engine, tmp_path):
    now = F.lit(NOW).cast("timestamp")
    talk = Engine(spark, engine.path, Says("SKIP"))
    assert talk.retrieve("carol", "t1", ["a"], now, mode="full").count() == 0
    for said, mode in (("fault", "full"), ("fault", "multihop"), ("Where is Bob?\nWho joined Acme?", "multihop")):
        talk.generator = Says(said)
        assert talk.retrieve("carol acme", "t1", ["a"], now, mode=mode).count() == 2
    talk.reranker = Longest
    assert talk.retrieve("carol acme", "t1", ["a"], now, rerank=True).orderBy("rank").first().text == "Alice met Bob at Acme."
    talk.reranker = broken
    assert talk.retrieve("carol acme", "t1", ["a"], now, rerank=True).orderBy("rank").first().text == "Carol joined Acme."
    talk.embedder = broken
    got = talk.retrieve("carol", "t1", ["a"], now).collect()
    assert got and all("vector" not in r.signals for r in got)
    assert engine.retrieve("carol acme", "t1", ["a"], now, budget=3).count() == 1
    assert engine.retrieve("carol acme", "t1", ["a"], now, lambda_=0.5, k=1).count() == 1
    assert Engine(spark, str(tmp_path / "none")).retrieve("x", "t", ["a"], now).count() == 0


def test_prime_splits_the_budget(engine):
    got = engine.prime("acme", "t1", ["a"], F.lit(NOW).cast("timestamp"))
    assert "Acme" in {r.name for r in got["entities"].collect()} and got["hits"].count() == 2
    small = engine.prime("acme", "t1", ["a"], F.lit(NOW).cast("timestamp"), budget=12)
    assert small["entities"].agg(F.max("running")).first()[0] <= 3


def test_vectors_of_another_version_are_made_anew(spark, engine):
    newer = Engine(spark, engine.path, version="hashed-2")
    newer.reembed()
    assert {r.version for r in newer.read("vectors").collect()} == {"hashed-2"} and newer.read("vectors").count() == 4
    Engine(spark, engine.path).reembed()


def test_history_is_in_order(engine):
    assert [r.turn for r in engine.history("t1", "s").collect()] == [0, 1, 2]


def test_a_version_is_written_once(spark, tmp_path):
    rows = spark.range(3)
    lifecycle.write_once(rows, str(tmp_path / "v1"))
    with pytest.raises(PermissionError):
        lifecycle.write_once(rows, str(tmp_path / "v1"))


def test_queue_leases_buries_and_replays(spark):
    at = lambda s: F.lit(f"2024-01-01 00:00:{s:02}").cast("timestamp")
    new = spark.createDataFrame([(str(i), f"t{i % 2}", "p", dt.datetime(2024, 1, 1)) for i in range(6)], "id string, tenant string, payload string, enqueued_at timestamp")
    items = queue.enqueue(queue.enqueue(spark.createDataFrame([], queue.ITEM), new), new)
    assert items.count() == 6
    first = queue.claim(items, at(0), 1, 30)
    assert {r.id for r in queue.held(first, at(10)).collect()} == {"0", "1"}
    second = queue.claim(first, at(10), 1, 30)
    assert {r.id for r in queue.held(second, at(20)).collect()} == {"0", "1", "2", "3"}
    assert {r.id for r in queue.held(second, at(35)).collect()} == {"2", "3"}
    left = queue.ack(second, spark.createDataFrame([("2",)], "id string"))
    assert left.count() == 5
    bad, dead = spark.createDataFrame([("3", "boom")], "id string, error string"), None
    for _ in range(queue.ATTEMPTS):
        left, dead = queue.nack(queue.claim(left, at(40)), bad)
    assert [(r.id, r.attempts, r.error) for r in dead.collect()] == [("3", 3, "boom")] and left.count() == 4
    assert queue.replay(left, dead).filter("id = '3' AND attempts = 0 AND leased_until IS NULL").count() == 1


def test_steps_and_passes(engine, spark):
    calls = spark.createDataFrame([("t1", "a", "search", "success", "{}", dt.datetime(2024, 1, i)) for i in (1, 2)], "tenant string, agent string, tool_name string, outcome string, arguments string, at timestamp")
    engine.step(calls)
    assert engine.steps("t1", ["a"]).first().use_count == 2
    engine.seed("t1", [("Acme", "Org"), ("Zeta", "Org")])
    assert engine.read("entities").filter("tenant = 't1' AND name = 'Acme'").first().mention_count == 2
    engine.salience()
    engine.community()
    top = engine.read("entities").orderBy(F.desc("centrality")).first()
    assert top.name == "Acme" and top.centrality == 1.0
    engine.ontology_scan(least=2)
    engine.ontology_decide("Concept", "Concept", "approved")
    assert "concept_to_concept" in {r.relationship for r in engine.read("relates").collect()}
    more = spark.createDataFrame([("t1", "a", "s", 9, "Alice saw Bob at Acme again.")], "tenant string, agent string, session string, turn long, text string")
    engine.store(more, F.lit(NOW).cast("timestamp"))
    assert engine.read("relates").filter("corroboration > 1 AND relationship = 'concept_to_concept'").count() > 0
    engine.ontology_scan(least=2)
    assert engine.read("proposals").first().status == "approved"


def test_forget_and_purge(engine):
    engine.forget("t1", F.lit(NOW).cast("timestamp"), "b")
    assert engine.read("memories").filter("invalid_at IS NOT NULL").count() == 1
    engine.purge("t2")
    assert engine.read("memories").filter("tenant = 't2'").count() == 0 and engine.read("vectors").filter("tenant = 't2'").count() == 0
