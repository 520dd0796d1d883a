"""The engine's verbs over tables kept as Parquet under one path.

Every verb reads the current tables and, where it writes, replaces a table by a
new version of it: written beside the old, then named current, so a lost
executor or a failed job leaves the old version in place.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.functions import text as tx
from anamnesis.functions.vector import embed
from anamnesis.models import Embedder, Generator, Reranker, decompose, hypothetical, model_scores, model_vectors, skip_retrieval
from anamnesis.operators import graph, ingest, lifecycle, retrieve

log = logging.getLogger(__name__)

# Columns that later passes add are there, and null, from the start.
TABLES = {
    "memories": "key string, tenant string, agent string, session string, turn long, text string, type string, strength double, access_count int, created_at timestamp, accessed_at timestamp, invalid_at timestamp, expires_at timestamp",
    "entities": "key string, tenant string, name string, label string, mention_count long, reliability_sum double, belief double, centrality double, community long, needs_review boolean, conflict_with string, invalid_at timestamp",
    "mentions": "memory string, entity string",
    "relates": "tenant string, lo string, hi string, corroboration long, relationship string",
    "steps": "key string, tenant string, agent string, tool_name string, outcome string, use_count long, arguments string",
    "vectors": "key string, tenant string, embedding array<double>, version string",
    "accesses": "key string, at timestamp",
    "proposals": "tenant string, label_a string, label_b string, support long, proposed_relationship string, status string",
}


#: What an edge is called until an approved proposal names it.
PLAIN = "associated_with"


class Engine:
    """``embedder`` and ``reranker`` are loaders that each task calls once; without an
    embedder texts have hashed vectors. ``version`` names the embedder's state."""

    def __init__(self, spark: SparkSession, path: str, generator: Generator | None = None, embedder: Callable[[], Embedder] | None = None, reranker: Callable[[], Reranker] | None = None, version: str = "hashed-1") -> None:
        self.spark, self.path, self.generator = spark, path.rstrip("/"), generator
        self.embedder, self.reranker, self.version = embedder, reranker, version
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._at = hadoop.Path

    def _versions(self, name: str) -> list[int]:
        folder = self._at(f"{self.path}/{name}")
        if not self._fs.exists(folder):
            return []
        found = [s.getPath() for s in self._fs.listStatus(folder)]
        return sorted(int(p.getName()[1:]) for p in found if self._fs.exists(self._at(f"{p}/_SUCCESS")))

    def read(self, name: str) -> DataFrame:
        versions = self._versions(name)
        if not versions:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}/v{versions[-1]}")

    def write(self, name: str, rows: DataFrame) -> None:
        columns = [f.name for f in self.spark.createDataFrame([], TABLES[name]).schema]
        full = rows.withColumns({c: F.lit(None) for c in columns if c not in rows.columns})
        kinds = self.spark.createDataFrame([], TABLES[name]).schema
        at = (self._versions(name) or [0])[-1] + 1
        lifecycle.write_once(full.select(*[F.col(c).cast(kinds[c].dataType).alias(c) for c in columns]), f"{self.path}/{name}/v{at}")
        for old in self._versions(name)[:-2]:
            self._fs.delete(self._at(f"{self.path}/{name}/v{old}"), True)

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows to a table that is only added to: it has one version."""
        rows.write.mode("append").parquet(f"{self.path}/{name}/v1")

    def _embed(self, rows: DataFrame) -> DataFrame:
        """(key, embedding) of rows with key and text."""
        return model_vectors(rows, self.embedder) if self.embedder else embed(rows, "key", "text")

    def store(self, turns: DataFrame, now: Column, type_: str = "episodic", reliability: float = 0.5) -> None:
        """turns: tenant, agent, session, turn, text. A turn stored before changes nothing."""
        old = self.read("memories")
        new = ingest.episodes(turns).join(old.select("key"), "key", "left_anti").withColumns({"text": F.col("content"), "type": F.lit(type_), "strength": F.lit(1.0), "access_count": F.lit(0), "created_at": now, "accessed_at": now}).drop("content")
        new = new.withColumn("expires_at", now + F.expr(f"INTERVAL '{ingest.TTL}' SECOND") if type_ == "working" else F.lit(None).cast("timestamp"))
        new = graph._settle(new)
        self.write("memories", ingest.over_capacity(old.unionByName(new, allowMissingColumns=True)))
        made = self._embed(new).join(new.select("key", "tenant"), "key").withColumn("version", F.lit(self.version))
        self.write("vectors", self.read("vectors").unionByName(made.select("key", "tenant", "embedding", "version")))
        if type_ == "working":
            return
        found = graph._settle(ingest.mentions_of(new))
        batch = ingest.accumulate_entities(found, F.lit(reliability))
        known = self.read("entities")
        merged = ingest.upsert_entities(known, batch).withColumn("key", F.sha2(F.concat_ws(tx.UNIT, "tenant", "name"), 256))
        late = known.select("key", "centrality", "community", "needs_review", "conflict_with", "invalid_at", "label")
        self.write("entities", merged.join(late, "key", "left").withColumn("label", F.coalesce("label", F.lit("Concept"))))
        keyed = found.select("tenant", F.col("key").alias("memory"), F.sha2(F.concat_ws(tx.UNIT, "tenant", "name"), 256).alias("entity"))
        self.write("mentions", self.read("mentions").unionByName(keyed.select("memory", "entity")).distinct())
        pairs = keyed.groupBy("tenant", "memory").agg(F.array_sort(F.collect_set("entity")).alias("e")).select("tenant", F.explode(ingest.pairs_in_order(F.col("e"))).alias("p")).select("tenant", "p.*")
        count = pairs.groupBy("tenant", "lo", "hi").agg(F.count("*").alias("corroboration")).withColumn("relationship", F.lit(PLAIN))
        both = self.read("relates").unionByName(count)
        self.write("relates", both.groupBy("tenant", "lo", "hi").agg(F.sum("corroboration").alias("corroboration"), F.coalesce(F.max(F.when(F.col("relationship") != PLAIN, F.col("relationship"))), F.lit(PLAIN)).alias("relationship")))

    def _live(self, tenant: str, agents: list[str], now: Column) -> DataFrame:
        """A tenant's and agents' valid memories, with the accesses since they were stored."""
        m = self.read("memories").filter((F.col("tenant") == tenant) & F.col("agent").isin(*agents) & F.col("invalid_at").isNull())
        m = m.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))
        used = self.read("accesses").groupBy("key").agg(F.count("*").alias("_n"), F.max("at").alias("_at"))
        j = m.join(used, "key", "left")
        count = F.when(F.col("_n") > 0, F.greatest("access_count", F.lit(1)) + F.col("_n")).otherwise(F.col("access_count")).cast("int")
        return j.withColumns({"access_count": count, "accessed_at": F.greatest("accessed_at", "_at")}).drop("_n", "_at")

    def retrieve(
        self, query: str, tenant: str, agents: list[str], now: Column, k: int = 10, budget: int = 1500, mode: str = retrieve.LITE,
        pool: int = retrieve.POOL, hops: int = 2, lambda_: float = 1.0, rerank: bool = False,
    ) -> DataFrame:
        """(key, text, score, rank, signals): word, vector and graph arms fused by reciprocal
        ranks, faded by age, reranked if asked, diversified and packed by tiers.

        ``lite`` embeds the query; ``full`` asks the generator whether to search and for a
        made-up answer to embed; ``multihop`` fuses the lists of its sub-queries again. Hits
        count as accesses. A fault gives no hits: it never fails the caller's turn.
        """
        none = self.spark.createDataFrame([], "key string, text string, score double, rank int, signals string")
        if mode == retrieve.FULL and skip_retrieval(query, self.generator):
            return none
        try:
            hits = graph._settle(self._search(query, tenant, agents, now, k, budget, mode, pool, hops, lambda_, rerank))
            self.append("accesses", hits.select("key", now.cast("timestamp").alias("at")))
            return hits
        except Exception as fault:
            log.warning("retrieval failed: %s", fault)
            return none

    def _search(self, query: str, tenant: str, agents: list[str], now: Column, k: int, budget: int, mode: str, pool: int, hops: int, lambda_: float, rerank: bool) -> DataFrame:
        live = self._live(tenant, agents, now)
        asked = decompose(query, self.generator) if mode == retrieve.MULTIHOP else [query]
        texts = self.spark.createDataFrame(list(enumerate(asked)), "query int, text string")
        meant = [hypothetical(query, self.generator)] if mode == retrieve.FULL else asked
        spoken = self.spark.createDataFrame(list(enumerate(meant)), "key int, text string")
        known = self.read("entities").filter((F.col("tenant") == tenant) & F.col("invalid_at").isNull())
        edges = self.read("relates").filter(F.col("tenant") == tenant).select("lo", "hi", ingest.belief(F.col("corroboration") * ingest.BASE).alias("weight"))
        mentions = self.read("mentions").join(live.select(F.col("key").alias("memory")), "memory", "left_semi")
        vectors = self.read("vectors").filter((F.col("tenant") == tenant) & (F.col("version") == self.version)).select("key", "embedding")
        try:
            near = graph._settle(self._embed(spoken)).select(F.col("key").alias("query"), "embedding")
        except Exception as fault:
            log.warning("no vector arm: %s", fault)
            near = None
        found = retrieve.gather(live, texts, now, vectors, near, (mentions, known, edges), pool, hops)
        if len(asked) > 1:
            lists = retrieve.top(found, pool, "fused")
            found = lists.groupBy("key").agg(F.round(F.sum(1.0 / (retrieve.RRF + F.col("rank"))), 9).alias("fused"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("signals", r"\+"))))), "+").alias("signals")).withColumn("query", F.lit(0))
        if rerank:
            found = self._reranked(found, live, query)
        hits = retrieve.best_hits(found, live, k, budget, vectors, lambda_)
        return hits.select("key", "text", "score", "rank", "signals")

    def _reranked(self, found: DataFrame, live: DataFrame, query: str, top_n: int = 50) -> DataFrame:
        """The first rows with the reranker's score; on a fault all rows as they were."""
        first = retrieve.top(found, top_n, "fused").join(live.select("key", "text"), "key").withColumn("query_text", F.lit(query))
        try:
            score = retrieve.rerank_coverage(F.col("query_text"), F.col("text"))
            rows = model_scores(first, self.reranker) if self.reranker else first.withColumn("model_score", score)
            return graph._settle(rows.select("query", "key", F.round("model_score", 6).alias("fused"), "signals"))
        except Exception as fault:
            log.warning("not reranked: %s", fault)
            return found

    def prime(self, task: str, tenant: str, agents: list[str], now: Column, budget: int = 1500) -> dict[str, DataFrame]:
        """Hits in half of the budget, their entities and the agents' steps in a quarter each."""
        hits = self.retrieve(task, tenant, agents, now, budget=budget // 2)
        ents = hits.join(self.read("mentions"), F.col("key") == F.col("memory")).select(F.col("entity").alias("key")).distinct().join(self.read("entities"), "key")
        trust = F.greatest(F.coalesce("belief", F.lit(0.0)), F.coalesce("centrality", F.lit(0.0)))
        best = ents.withColumns({"query": F.lit(0), "trust": trust}).orderBy(F.desc("trust"), F.desc("mention_count"), "key").limit(20).withColumn("text", F.concat(F.lit("- "), "name", F.lit(" ("), "label", F.lit(")")))
        used = self.steps(tenant, agents).withColumns({"query": F.lit(0), "text": F.concat(F.lit("- "), "tool_name", F.lit(" ("), "outcome", F.lit(", used "), F.col("use_count").cast("string"), F.lit("x)"))})
        return {
            "hits": hits,
            "entities": retrieve.pack_prefix(best, budget // 4, [F.desc("trust"), F.desc("mention_count"), F.col("key")]),
            "steps": retrieve.pack_prefix(used, budget // 4, [F.desc("use_count"), F.col("key")]),
        }

    def history(self, tenant: str, session: str) -> DataFrame:
        """A session's valid turns in order."""
        m = self.read("memories").filter((F.col("tenant") == tenant) & (F.col("session") == session) & F.col("invalid_at").isNull())
        return m.select("turn", "agent", "text").orderBy("turn", "agent")

    def reembed(self) -> None:
        """Vectors of another version of the embedder are made anew."""
        m = self.read("memories").select("key", "tenant", "text")
        made = lifecycle.reembed(self.read("vectors"), m, self._embed, self.version)
        self.write("vectors", made.join(m.select("key", "tenant"), "key"))

    def dream(self, verdicts: DataFrame, now: Column) -> DataFrame:
        """Consolidation by verdicts (key, contradicts): losers are superseded, the others
        cleared; beyond the breaker nothing changes. Returns the decisions."""
        e = self.read("entities").withColumns({"live": F.col("invalid_at").isNull(), "needs_review": F.coalesce("needs_review", F.lit(False))})
        done = graph._settle(lifecycle.dream_decisions(e, verdicts))
        lost = done.filter("loser IS NOT NULL").select(F.col("winner").alias("new"), F.col("loser").alias("old"))
        marked, _ = lifecycle.supersede(self.read("entities"), lost, now)
        cleared = done.filter("action IN ('clear', 'supersede')").select("key").distinct().withColumn("_done", F.lit(True))
        j = marked.join(cleared, "key", "left")
        self.write("entities", j.withColumn("needs_review", F.when(F.col("_done"), False).otherwise(F.col("needs_review"))).drop("_done"))
        return done

    def step(self, calls: DataFrame) -> None:
        """calls: tenant, agent, tool_name, outcome, arguments, at."""
        new = calls.groupBy("tenant", "agent", "tool_name", "outcome").agg(F.count("*").alias("use_count"), F.max_by("arguments", "at").alias("arguments")).withColumn("key", tx.step_key(F.col("tenant"), F.col("agent"), F.col("tool_name"), F.col("outcome")))
        both = self.read("steps").withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
        self.write("steps", both.groupBy("key", "tenant", "agent", "tool_name", "outcome").agg(F.sum("use_count").alias("use_count"), F.max_by("arguments", "age").alias("arguments")))

    def steps(self, tenant: str, agents: list[str], most: int = 10) -> DataFrame:
        return self.read("steps").filter((F.col("tenant") == tenant) & F.col("agent").isin(*agents)).orderBy(F.desc("use_count"), "key").limit(most)

    def forget(self, tenant: str, now: Column, agent: str | None = None) -> None:
        self.write("memories", lifecycle.forget(self.read("memories"), tenant, now, agent))

    def purge(self, tenant: str) -> None:
        gone = self.read("memories").filter(F.col("tenant") == tenant).select(F.col("key").alias("memory"))
        self.write("mentions", self.read("mentions").join(gone, "memory", "left_anti"))
        for name in ("memories", "vectors", "entities", "relates", "steps"):
            self.write(name, self.read(name).filter(F.col("tenant") != tenant))

    def stats(self) -> DataFrame:
        parts = [self.read(n).groupBy("tenant").agg(F.count("*").alias("n")).withColumn("table", F.lit(n)) for n in ("memories", "entities", "steps")]
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("tenant").pivot("table", ["memories", "entities", "steps"]).agg(F.first("n"))

    def entity(self, key: str) -> DataFrame:
        r = self.read("relates")
        near = r.filter(F.col("lo") == key).select(F.col("hi").alias("key")).union(r.filter(F.col("hi") == key).select("lo")).distinct()
        return self.read("entities").join(near, "key", "left_semi")

    def entities(self, tenant: str, label: str | None = None, most: int = 50) -> DataFrame:
        e = self.read("entities").filter(F.col("tenant") == tenant)
        return (e if label is None else e.filter(F.col("label") == label)).orderBy(F.desc("mention_count"), "key").limit(most)

    def seed(self, tenant: str, names: list[tuple[str, str]]) -> None:
        new = self.spark.createDataFrame([(tenant, n.strip(), label) for n, label in names if n.strip()], "tenant string, name string, label string")
        new = new.withColumns({"key": F.sha2(F.concat_ws(tx.UNIT, "tenant", "name"), 256), "mention_count": F.lit(0).cast("long"), "reliability_sum": F.lit(0.0)})
        self.write("entities", ingest.insert_ignore(self.read("entities"), new))

    def supersede(self, pairs: DataFrame, now: Column) -> None:
        self.write("entities", lifecycle.supersede(self.read("entities"), pairs, now)[0])

    def decay(self, now: Column) -> None:
        self.write("memories", lifecycle.decay_sweep(self.read("memories"), now))

    def salience(self) -> None:
        e = self.read("entities")
        rank = graph.pagerank(e.select(F.col("key").alias("node")), self.read("relates").select("lo", "hi"))
        self.write("entities", e.drop("centrality").join(rank, F.col("key") == F.col("node"), "left").withColumn("centrality", F.coalesce("rank", F.lit(0.0))))

    def community(self) -> None:
        e = self.read("entities")
        found = graph.label_propagation(e.select(F.col("key").alias("node"), "tenant"), self.read("relates").select("lo", "hi")).select("node", F.col("community").alias("c"))
        self.write("entities", e.join(found, F.col("key") == F.col("node"), "left").withColumn("community", F.coalesce("c", F.lit(-1))))

    def ontology_scan(self, least: int = lifecycle.SUPPORT) -> None:
        found = lifecycle.ontology_clusters(self.read("entities"), self.read("relates").select("lo", "hi"), least)
        named = found.withColumn("proposed_relationship", tx.snake_case(F.concat("label_a", F.lit(" to "), "label_b")))
        self.write("proposals", lifecycle.upsert_proposals(self.read("proposals"), named))

    def ontology_decide(self, label_a: str, label_b: str, status: str) -> None:
        hit = (F.col("label_a") == label_a) & (F.col("label_b") == label_b)
        self.write("proposals", self.read("proposals").withColumn("status", F.when(hit, status).otherwise(F.col("status"))))
        if status == "approved":
            self.write("relates", lifecycle.relabel(self.read("relates"), self.read("entities"), self.read("proposals").filter(hit)))
