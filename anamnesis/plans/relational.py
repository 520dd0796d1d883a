"""Queries of scans, filters, joins, aggregations, windows, evaluation and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anamnesis.functions import text as tx
from anamnesis.functions.vector import cosine, embed
from anamnesis.operators import evaluate as ev
from anamnesis.plans import stand_ins as si
from anamnesis.plans.retrieval import _TOK, BM25_CTE, bench_queries, bm25_arm, docs
from anamnesis.registry import query, table
from anamnesis.streaming import queue as wq

# Scans, projections, filters.
query("scan_collection", "SELECT doc_id, lang FROM documents WHERE source = 'src1'")(lambda s, d: table(s, d, "documents").filter("source = 'src1'").select("doc_id", "lang"))
query("scan_by_key", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (1, 5, 9)")(lambda s, d: table(s, d, "documents").filter("doc_id IN (1, 5, 9)").select("doc_id", "n_chars"))
query("scan_dynamic", "SELECT 'documents' AS coll, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'events', count(*) FROM events")(
    lambda s, d: table(s, d, "documents").agg(F.count("*").alias("n")).select(F.lit("documents").alias("coll"), "n")
    .unionByName(table(s, d, "pages").agg(F.count("*").alias("n")).select(F.lit("pages").alias("coll"), "n"))
    .unionByName(table(s, d, "events").agg(F.count("*").alias("n")).select(F.lit("events").alias("coll"), "n"))
)


@query("scan_index_audit", "SELECT 'documents' AS scan, true AS filters_pushed, true AS columns_pruned")
def scan_index_audit(s: SparkSession, d: str) -> DataFrame:
    """Whether a hot scan's plan pushes its filter down and reads two columns only."""
    plan = table(s, d, "documents").filter("source = 'src1'").select("doc_id", "source")._jdf.queryExecution().executedPlan().toString()
    pushed, pruned = "EqualTo(source,src1)" in plan, "ReadSchema: struct<doc_id:bigint,source:string>" in plan
    return s.range(1).select(F.lit("documents").alias("scan"), F.lit(pushed).alias("filters_pushed"), F.lit(pruned).alias("columns_pruned"))


query("project_public_entity", f"WITH {si.ENTITIES} SELECT key, name, label, tenant, mention_count FROM entities")(lambda s, d: si.entities(s, d).select("key", "name", "label", "tenant", "mention_count"))
query("project_graph_node", f"WITH {si.ENTITIES} SELECT key, name, 'entity' AS kind FROM entities")(lambda s, d: si.entities(s, d).select("key", "name", F.lit("entity").alias("kind")))
query("project_drop", "SELECT * EXCLUDE (text, n_chars) FROM documents")(lambda s, d: table(s, d, "documents").drop("text", "n_chars"))
query("filter_scope", f"WITH {si.MEMORIES} SELECT key FROM memories WHERE tenant = 'tenant2' AND agent IN ('user', 'assistant')")(lambda s, d: si.memories(s, d).filter((F.col("tenant") == "tenant2") & F.col("agent").isin("user", "assistant")).select("key"))
_NOT = f"WITH {si.ENTITIES} SELECT key FROM entities WHERE key NOT IN (SELECT key FROM entities WHERE needs_review)"
for _n in ("filter_not_in", "set_except_seeds"):
    query(_n, _NOT)(lambda s, d: si.entities(s, d).select("key").join(si.entities(s, d).filter("needs_review").select("key"), "key", "left_anti"))
query("filter_disjunction", f"WITH {si.ENTITIES} SELECT key FROM entities WHERE needs_review OR mention_count >= 600")(lambda s, d: si.entities(s, d).filter("needs_review OR mention_count >= 600").select("key"))
_QUEUE = "(SELECT event_id, ts, user_id, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 60 SECOND END AS leased_until FROM events)"
_AT = "TIMESTAMP '2024-01-15 00:00:00'"


def leases(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", "ts", "user_id", F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.expr("INTERVAL '60' SECOND")).alias("leased_until"))


query("filter_lease_free", f"SELECT event_id FROM {_QUEUE} WHERE leased_until IS NULL OR leased_until < {_AT}")(
    lambda s, d: leases(s, d).filter(F.col("leased_until").isNull() | (F.col("leased_until") < F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'"))).select("event_id")
)
for _n in ("limit_fifo_claim",):
    query(_n, f"SELECT event_id FROM {_QUEUE} WHERE leased_until IS NULL OR leased_until < {_AT} ORDER BY ts, event_id LIMIT 1")(
        lambda s, d: leases(s, d).filter(F.col("leased_until").isNull() | (F.col("leased_until") < F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'"))).orderBy("ts", "event_id").limit(1).select("event_id")
    )
query("str_claim", "SELECT event_id::VARCHAR AS id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR) <= 2")(
    lambda s, d: wq.held(wq.claim(queued(s, d), F.lit("2024-01-15").cast("timestamp"), 2), F.lit("2024-01-15 00:00:30").cast("timestamp")).select("id")
)
query("str_queue", "SELECT user_id::VARCHAR AS tenant, count(*) AS pending, least(count(*), 2)::BIGINT AS leased FROM events GROUP BY user_id")(
    lambda s, d: wq.pending(wq.claim(queued(s, d), F.lit("2024-01-15").cast("timestamp"), 2), F.lit("2024-01-15 00:00:30").cast("timestamp"))
)
query("sanitize_field_null", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")(lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality")))
_VIEW = f"WITH {si.RELATES}, {si.ENTITIES} SELECT lo, hi FROM relates WHERE corroboration > 1 AND lo IN (SELECT key FROM entities WHERE NOT needs_review) AND hi IN (SELECT key FROM entities WHERE NOT needs_review)"


@query("filter_graph_view", _VIEW)
def filter_graph_view(s: SparkSession, d: str) -> DataFrame:
    keep = si.entities(s, d).filter("NOT needs_review").select("key")
    return si.relates(s, d).filter("corroboration > 1").join(keep.withColumnRenamed("key", "lo"), "lo", "left_semi").join(keep.withColumnRenamed("key", "hi"), "hi", "left_semi").select("lo", "hi")


query("search_nodes", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'e')")(lambda s, d: table(s, d, "part").filter(F.lower("p_name").contains("e")).select("p_partkey", "p_name"))
query("graph_view_topn", f"WITH {si.RELATES}, {si.ENTITIES}, t AS (SELECT key FROM entities WHERE NOT needs_review ORDER BY belief DESC, mention_count DESC, key LIMIT 20) SELECT lo, hi, round(least(greatest(belief, 0), 1), 6) AS weight FROM relates WHERE lo IN (FROM t) AND hi IN (FROM t)")(
    lambda s, d: (lambda t: si.relates(s, d).join(t.withColumnRenamed("key", "lo"), "lo", "left_semi").join(t.withColumnRenamed("key", "hi"), "hi", "left_semi").select("lo", "hi", F.round(F.least(F.greatest("belief", F.lit(0.0)), F.lit(1.0)), 6).alias("weight")))(
        si.entities(s, d).filter("NOT needs_review").orderBy(F.desc("belief"), F.desc("mention_count"), "key").limit(20).select("key")
    )
)
# Joins.
query("join_traverse_out", "SELECT DISTINCT l_orderkey AS memory, s_name AS name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey")(
    lambda s, d: si.mentions(s, d).join(table(s, d, "supplier"), F.col("entity") == F.col("s_suppkey")).select("memory", F.col("s_name").alias("name"))
)
query("join_traverse_in", "SELECT l_suppkey AS entity, count(DISTINCT l_orderkey) AS memories, sum(DISTINCT l_orderkey)::BIGINT AS total FROM lineitem GROUP BY l_suppkey")(
    lambda s, d: si.mentions(s, d).groupBy("entity").agg(F.count("*").alias("memories"), F.sum("memory").alias("total"))
)
query("join_token_match", f"WITH {BM25_CTE.split(',' + chr(10) + 'terms')[0]} SELECT DISTINCT query, doc_id FROM q, documents d WHERE list_has_any(list_filter({_TOK.format('q.text')}, lambda x: length(x) > 6), {_TOK.format('d.text')})")(
    lambda s, d: bench_queries(s, d).select("query", F.explode(F.filter(tx.tokens(F.col("text")), lambda x: F.length(x) > 6)).alias("t")).join(docs(s, d).select("key", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("t")), "t").select("query", F.col("key").alias("doc_id")).distinct()
)
_FIRST = "SELECT n_nationkey, s_suppkey FROM nation LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier WHERE s_acctbal > 0 GROUP BY s_nationkey) ON s_nationkey = n_nationkey"
for _n in ("join_first_match", "ev_coverage"):
    query(_n, _FIRST)(lambda s, d: table(s, d, "nation").join(table(s, d, "supplier").filter("s_acctbal > 0").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("s_suppkey")), F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_nationkey", "s_suppkey"))
query("join_tool_call_result", "SELECT c.event_id AS call, coalesce(r.event_id, -1) AS result, coalesce(r.event_type, 'unknown') AS tool FROM events c LEFT JOIN events r ON r.event_id = c.event_id + 1 AND r.user_id = c.user_id")(
    lambda s, d: table(s, d, "events").select(F.col("event_id").alias("call"), (F.col("event_id") + 1).alias("next"), F.col("user_id").alias("u")).join(table(s, d, "events").select(F.col("event_id").alias("result"), F.col("event_type").alias("tool"), "user_id"), (F.col("next") == F.col("result")) & (F.col("u") == F.col("user_id")), "left").select("call", F.coalesce("result", F.lit(-1)).alias("result"), F.coalesce("tool", F.lit("unknown")).alias("tool"))
)
# Aggregations.
query("agg_group_rep", "SELECT DISTINCT l_suppkey AS entity FROM lineitem")(lambda s, d: si.mentions(s, d).dropDuplicates(["entity"]).select("entity"))


def scores(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")


_SCORES = "(SELECT quality, toxic, lang, n_chars FROM labels JOIN documents USING (doc_id))"
_MEANS = f"SELECT lang, count(*) AS n, round(avg(quality), 6) AS recall, round(avg(n_chars), 6) AS tokens FROM {_SCORES} GROUP BY ROLLUP (lang)"
for _n in ("agg_mean_metrics", "ev_run"):
    query(_n, _MEANS)(lambda s, d: ev.by_category(scores(s, d), "lang", recall=F.col("quality"), tokens=F.col("n_chars")))
query("agg_accuracy_type", f"SELECT lang, round(avg(quality), 6) AS accuracy, round(avg(quality) FILTER (toxic = 1), 6) AS abstention FROM {_SCORES} GROUP BY lang")(
    lambda s, d: scores(s, d).groupBy("lang").agg(F.round(F.avg("quality"), 6).alias("accuracy"), F.round(F.avg(F.when(F.col("toxic") == 1, F.col("quality"))), 6).alias("abstention"))
)
query("agg_rates", f"SELECT round(avg(toxic), 6) AS hallucination, round(1 - avg(quality), 6) AS noise FROM {_SCORES}")(lambda s, d: scores(s, d).agg(F.round(F.avg("toxic"), 6).alias("hallucination"), F.round(1 - F.avg("quality"), 6).alias("noise")))
query("agg_miss_breakdown", f"SELECT lang, count(*) FILTER (quality = 1) AS hit, count(*) FILTER (quality = 0 AND toxic = 1) AS ranking, count(*) FILTER (quality = 0 AND toxic = 0) AS recall FROM {_SCORES} GROUP BY ROLLUP (lang)")(
    lambda s, d: scores(s, d).rollup("lang").agg(F.count_if(F.col("quality") == 1).alias("hit"), F.count_if(F.expr("quality = 0 AND toxic = 1")).alias("ranking"), F.count_if(F.expr("quality = 0 AND toxic = 0")).alias("recall"))
)
_Q = "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type"
query("agg_percentile", _Q)(lambda s, d: ev.nearest_rank(table(s, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95}))
query("agg_percentile_floor", "SELECT event_type, list_sort(list(value))[least(count(*), floor(0.5::DOUBLE * count(*))::BIGINT + 1)] AS p50, list_sort(list(value))[least(count(*), floor(0.95::DOUBLE * count(*))::BIGINT + 1)] AS p95 FROM events GROUP BY event_type")(
    lambda s, d: ev.floor_rank(table(s, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})
)
query("agg_dispute_tally", "SELECT user_id, event_type, count(*) AS claims FROM events GROUP BY ALL")(lambda s, d: table(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("claims")))
_LIES = "SELECT c_custkey, count(o_orderkey) AS lies, least(greatest(80 - 40 * count(o_orderkey), 5), 100)::BIGINT AS trust FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey"
for _n in ("agg_caught_lies", "ex_ledger"):
    query(_n, _LIES)(lambda s, d: table(s, d, "customer").join(table(s, d, "orders").filter("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("lies")).withColumn("trust", F.least(F.greatest(80 - 40 * F.col("lies"), F.lit(5)), F.lit(100)).cast("long")))
query("ex_accuse", "SELECT c_custkey, count(o_orderkey) >= 4 AND c_custkey % 2 = 0 AS won FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")(
    lambda s, d: table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n")).select("c_custkey", ((F.col("n") >= 4) & (F.col("c_custkey") % 2 == 0)).alias("won"))
)
query("agg_counter_events", "SELECT event_type, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY event_type")(lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total")))
# Windows.
_RING = "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 1024"
for _n in ("win_last_1024", "str_latency_ring"):
    query(_n, _RING)(lambda s, d: ev.latest(table(s, d, "events").select("event_id", "event_type", "ts"), "event_type", ["ts", "event_id"]).select("event_id"))
query("win_round_robin", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n, min(doc_id) OVER (PARTITION BY lang) AS f FROM documents) ORDER BY n, f LIMIT 50")(
    lambda s, d: ev.round_robin(table(s, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 50)
)
_CHK = "SELECT unnest(list_distinct(list_concat(range(0, count(*)::BIGINT, 64), [count(*)::BIGINT]))) AS checkpoint FROM documents"
for _n in ("win_checkpoints", "ev_curve"):
    query(_n, _CHK)(lambda s, d: table(s, d, "documents").agg(F.count("*").alias("n")).select(F.explode(F.array_distinct(F.concat(F.filter(F.sequence(F.lit(0).cast("long"), F.col("n"), F.lit(64).cast("long")), lambda x: x < F.col("n")), F.array("n")))).alias("checkpoint")))
query("win_next_pending", "SELECT user_id, min(event_id) AS next FROM events WHERE value < 50 GROUP BY user_id")(lambda s, d: table(s, d, "events").filter("value < 50").groupBy("user_id").agg(F.min("event_id").alias("next")))
query("sort_tier", f"WITH {si.MEMORIES} SELECT key, row_number() OVER (PARTITION BY session ORDER BY CASE type WHEN 'working' THEN 1 ELSE 2 END, turn DESC, key)::INTEGER AS nth FROM memories")(
    lambda s, d: si.memories(s, d).select("key", F.row_number().over(Window.partitionBy("session").orderBy(F.array_position(F.array(F.lit("working"), F.lit("episodic")), F.col("type")), F.desc("turn"), "key")).alias("nth"))
)
query("set_absorb", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS rooms FROM events GROUP BY user_id")(lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.array_union(F.collect_set("event_type"), F.array().cast("array<string>"))), ",").alias("rooms")))


def queued(s: SparkSession, d: str) -> DataFrame:
    """Every event enqueued as an item of its user."""
    e = table(s, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("tenant"), F.col("props").alias("payload"), F.col("ts").cast("timestamp").alias("enqueued_at"))
    return wq.enqueue(s.createDataFrame([], wq.ITEM), e)


def buried(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Items that fail are those of a value under one: claimed and refused three times."""
    items, now = queued(s, d), F.lit("2024-01-15").cast("timestamp")
    bad = table(s, d, "events").filter("value < 1").select(F.col("event_id").cast("string").alias("id"), F.lit("too small").alias("error"))
    dead = None
    for _ in range(wq.ATTEMPTS):
        items, dead = wq.nack(wq.claim(items, now), bad)
    return items, dead


query("str_dead_letter", "SELECT event_id::VARCHAR AS id, 3 AS attempts, 'too small' AS error FROM events WHERE value < 1")(lambda s, d: buried(s, d)[1].select("id", "attempts", "error"))
query("str_replay", "SELECT event_id::VARCHAR AS id, 0 AS attempts, value >= 1 AS leased FROM events")(lambda s, d: wq.replay(*buried(s, d)).select("id", "attempts", F.col("leased_until").isNotNull().alias("leased")))
query("str_flush_barrier", "SELECT 0::BIGINT AS still_queued, count(*) AS acknowledged FROM events")(
    lambda s, d: (lambda q: wq.ack(wq.claim(q, F.lit("2024-01-15").cast("timestamp")), q).agg(F.count("*").alias("still_queued")).join(F.broadcast(q.agg(F.count("*").alias("acknowledged"))), F.lit(True)))(queued(s, d))
)


@query("str_embed_cache", "SELECT role, count(*) AS asked, count(DISTINCT text) AS texts, count(*) AS answered FROM conversations GROUP BY role")
def str_embed_cache(s: SparkSession, d: str) -> DataFrame:
    """Each different text is embedded once and joined back to all that ask for it."""
    asked = table(s, d, "conversations").select("role", F.md5("text").alias("key"), "text")
    made = embed(asked.select("key", "text").dropDuplicates(["key"]), "key", "text")
    return asked.join(made, "key").groupBy("role").agg(F.count("*").alias("asked"), F.countDistinct("key").alias("texts"), F.count("embedding").alias("answered"))


@query("ret_query_cache", "SELECT role, round(avg((n > 1)::INT), 6) AS hit_rate FROM (SELECT role, row_number() OVER (PARTITION BY role, text ORDER BY conv_id, turn) AS n FROM conversations) GROUP BY role")
def ret_query_cache(s: SparkSession, d: str) -> DataFrame:
    """A query hits if its text was asked before in the same scope."""
    nth = F.row_number().over(Window.partitionBy("role", "text").orderBy("conv_id", "turn"))
    return table(s, d, "conversations").withColumn("n", nth).groupBy("role").agg(F.round(F.avg((F.col("n") > 1).cast("int")), 6).alias("hit_rate"))


# Evaluation.
query("ev_normalize", f"SELECT item_id, array_to_string({_TOK.format('text')}, ' ') AS norm FROM benchmark")(lambda s, d: table(s, d, "benchmark").select("item_id", tx.normalized(F.col("text")).alias("norm")))
_F1 = f"""WITH p AS (SELECT a.item_id, {_TOK.format('a.text')} AS x, {_TOK.format('b.text')} AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
c AS (SELECT item_id, len(x) + len(y) AS n, list_sum(list_transform(list_distinct(list_intersect(x, y)), lambda t: least(len(list_filter(x, lambda u: u = t)), len(list_filter(y, lambda u: u = t))))) AS k FROM p)
SELECT item_id, round(CASE WHEN coalesce(k, 0) = 0 THEN 0 ELSE 2.0::DOUBLE * k / n END, 6) AS f1 FROM c"""
query("ev_token_f1", _F1)(
    lambda s, d: table(s, d, "benchmark").join(table(s, d, "benchmark").select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("gold")), "item_id").select("item_id", F.round(ev.token_f1(F.col("text"), F.col("gold")), 6).alias("f1"))
)
_HIT = f"SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(array_to_string({_TOK.format('d.text')}, ' '), array_to_string({_TOK.format('b.text')}, ' '))"


@query("ev_recall_hit", _HIT)
def ev_recall_hit(s: SparkSession, d: str) -> DataFrame:
    """Passages found in documents, met on the passage's rarest-length word first."""
    longest = lambda t: F.element_at(F.array_sort(F.transform(tx.tokens(t), lambda x: F.struct(F.length(x).alias("n"), x.alias("t")))), -1)["t"]
    b = table(s, d, "benchmark").select("item_id", F.col("text").alias("fact"), longest(F.col("text")).alias("t"))
    words = table(s, d, "documents").select("doc_id", "text", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("t"))
    return words.join(b, "t").filter(tx.normalized(F.col("text")).contains(tx.normalized(F.col("fact")))).select("doc_id", "item_id")


query("ev_recall_fraction", "SELECT conv_id, round(avg((length(text) > 300)::INT), 6) AS fraction FROM conversations GROUP BY conv_id")(lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.round(F.avg((F.length("text") > 300).cast("int")), 6).alias("fraction")))
query("ev_all_hops", "SELECT conv_id, bool_and(length(text) > 100) AS all_hops FROM conversations GROUP BY conv_id")(lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.bool_and(F.length("text") > 100).alias("all_hops")))
query("ev_classify", f"WITH {BM25_CTE} SELECT item_id AS query, CASE WHEN bool_or(rank <= 10 AND h) THEN 'hit' WHEN bool_or(coalesce(h, false)) THEN 'ranking' ELSE 'recall' END AS label FROM (SELECT q.query AS item_id, rank, contains(array_to_string({_TOK.format('d.text')}, ' '), array_to_string({_TOK.format('b.text')}, ' ')) AS h FROM q JOIN benchmark b ON b.item_id = q.query LEFT JOIN bm25 ON bm25.query = q.query LEFT JOIN documents d ON d.doc_id = bm25.key) GROUP BY item_id")(
    lambda s, d: bench_queries(s, d).select("query").join(bm25_arm(s, d), "query", "left").join(docs(s, d).select("key", "text"), "key", "left").join(table(s, d, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("fact")), "query")
    .withColumn("h", F.coalesce(tx.normalized(F.col("text")).contains(tx.normalized(F.col("fact"))), F.lit(False))).groupBy("query").agg(F.when(F.bool_or((F.col("rank") <= 10) & F.col("h")), "hit").when(F.bool_or("h"), "ranking").otherwise("recall").alias("label"))
)
query("ev_profile", "SELECT i, 'Ent' || i::VARCHAR || ' collaborated with Ent' || (i + 1)::VARCHAR || ' and Hub' || (i % 50)::VARCHAR || ' on Topic' || (i % 200)::VARCHAR AS text FROM range(1000) t(i)")(
    lambda s, d: s.range(1000).select(F.col("id").alias("i"), F.concat(F.lit("Ent"), F.col("id").cast("string"), F.lit(" collaborated with Ent"), (F.col("id") + 1).cast("string"), F.lit(" and Hub"), (F.col("id") % 50).cast("string"), F.lit(" on Topic"), (F.col("id") % 200).cast("string")).alias("text"))
)
query("ev_judge", "SELECT label, label IN ('Correct.', 'yes: correct') AS ok FROM (VALUES ('Correct.'), ('INCORRECT'), ('yes: correct'), ('incorrect, not correct')) t(label)")(
    lambda s, d: s.createDataFrame([("Correct.",), ("INCORRECT",), ("yes: correct",), ("incorrect, not correct",)], "label string").withColumn("ok", ev.judged_correct(F.col("label")))
)
query("ev_handoff", f"SELECT round(avg(coalesce(quality, 1)), 6) AS context, round(coalesce(avg(CASE WHEN toxic = 1 THEN quality END), 1), 6) AS procedural FROM {_SCORES}")(
    lambda s, d: scores(s, d).agg(F.round(F.avg(F.coalesce("quality", F.lit(1))), 6).alias("context"), F.round(F.coalesce(F.avg(F.when(F.col("toxic") == 1, F.col("quality"))), F.lit(1.0)), 6).alias("procedural"))
)
query("ev_convert_locomo", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS nth, role || ': ' || text AS line FROM conversations WHERE trim(text) <> ''")(
    lambda s, d: table(s, d, "conversations").filter(F.trim("text") != "").select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("long").alias("nth"), F.concat("role", F.lit(": "), "text").alias("line"))
)
query("ev_convert_lme", "SELECT conv_id, ends_with(CASE WHEN conv_id % 4 = 0 THEN conv_id::VARCHAR || '_abs' ELSE conv_id::VARCHAR END, '_abs') AS abstention FROM conversations GROUP BY conv_id")(
    lambda s, d: table(s, d, "conversations").select("conv_id").distinct().select("conv_id", F.when(F.col("conv_id") % 4 == 0, F.concat(F.col("conv_id").cast("string"), F.lit("_abs"))).otherwise(F.col("conv_id").cast("string")).endswith("_abs").alias("abstention"))
)
query("ev_convert_musique", "SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text")(lambda s, d: table(s, d, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.md5("text").alias("digest")))
query("ev_sim", f"WITH {si.STEPS} SELECT tool_name, outcome, sum(use_count)::BIGINT AS uses FROM steps GROUP BY ALL")(lambda s, d: si.steps(s, d).groupBy("tool_name", "outcome").agg(F.sum("use_count").alias("uses")))
# Adapters and views.
query("ad_last_user_text", "SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id")(lambda s, d: table(s, d, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text")))
query("ad_inject", "SELECT conv_id, turn, '[MEMORY CONTEXT]' || chr(10) || text AS prompt FROM conversations WHERE role = 'system'")(lambda s, d: table(s, d, "conversations").filter("role = 'system'").select("conv_id", "turn", F.concat(F.lit("[MEMORY CONTEXT]\n"), "text").alias("prompt")))
query("ad_response_trim", "SELECT doc_id, md5('[assistant] ' || substr(text, 1, 4096)) AS digest FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", F.md5(F.concat(F.lit("[assistant] "), F.substring("text", 1, 4096))).alias("digest")))
query("ad_docs", f"WITH {BM25_CTE} SELECT query, key, score, lang, source FROM bm25 JOIN documents ON doc_id = key WHERE rank <= 5")(lambda s, d: bm25_arm(s, d).filter("rank <= 5").join(docs(s, d), "key").select("query", "key", "score", "lang", "source"))
query("ad_history_roles", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' ELSE 'system' END AS type FROM conversations")(lambda s, d: table(s, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "ai").otherwise("system").alias("type")))
query("ad_crew_tiers", f"WITH {si.MEMORIES} SELECT DISTINCT agent, unnest([agent, agent || '::query', agent || '::insight']) AS tier FROM memories")(lambda s, d: si.memories(s, d).select("agent").distinct().select("agent", F.explode(F.array("agent", F.concat("agent", F.lit("::query")), F.concat("agent", F.lit("::insight")))).alias("tier")))
query("ad_crew_threshold", f"WITH {BM25_CTE} SELECT query, key FROM bm25 WHERE score >= 5 AND rank <= 10")(lambda s, d: bm25_arm(s, d).filter("score >= 5 AND rank <= 10").select("query", "key"))
query("ex_claim_text", "SELECT o_orderkey, c_name || ' placed ' || o_orderpriority || '.' AS claim FROM orders JOIN customer ON c_custkey = o_custkey")(lambda s, d: table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.concat("c_name", F.lit(" placed "), "o_orderpriority", F.lit(".")).alias("claim")))
query("ex_reliability", "SELECT doc_id, coalesce(CASE source WHEN 'src0' THEN 0.9 WHEN 'src1' THEN 0.7 END, 0.5)::DOUBLE AS prior FROM documents")(
    lambda s, d: table(s, d, "documents").join(F.broadcast(s.createDataFrame([("src0", 0.9), ("src1", 0.7)], "source string, prior double")), "source", "left").select("doc_id", F.coalesce("prior", F.lit(0.5)).alias("prior"))
)
query("ex_terms", f"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter({_TOK.format('text')}, lambda x: length(x) > 3 AND x NOT IN ('that', 'with', 'this')))), ',') AS terms FROM benchmark")(
    lambda s, d: table(s, d, "benchmark").select("item_id", F.array_join(F.array_sort(F.array_distinct(F.filter(tx.tokens(F.col("text")), lambda x: (F.length(x) > 3) & ~x.isin("that", "with", "this")))), ",").alias("terms"))
)
query("ex_view_scale", f"WITH {si.ENTITIES} SELECT key, (1 + 4 * round(belief, 6))::DOUBLE AS width, (key % 8)::BIGINT AS palette FROM entities")(lambda s, d: si.entities(s, d).select("key", (1 + 4 * F.round("belief", 6)).alias("width"), F.pmod("key", F.lit(8)).cast("long").alias("palette")))
query("ex_memo_md", "SELECT n_regionkey, '# ' || r_name || chr(10) || string_agg('- ' || n_name, chr(10) ORDER BY n_name) AS memo FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY n_regionkey, r_name")(
    lambda s, d: table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("n_regionkey", "r_name").agg(F.array_sort(F.collect_list(F.concat(F.lit("- "), "n_name"))).alias("l")).select("n_regionkey", F.concat(F.lit("# "), "r_name", F.lit("\n"), F.array_join("l", "\n")).alias("memo"))
)
query("ex_critical_path", "SELECT o_custkey, (count(*) + count(DISTINCT o_orderpriority))::BIGINT AS steps FROM orders GROUP BY o_custkey")(lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg((F.count("*") + F.countDistinct("o_orderpriority")).alias("steps")))
query("ex_briefing", "SELECT source, sum(ceil(length(text)::DOUBLE / 4))::BIGINT AS tokens FROM documents GROUP BY source")(lambda s, d: table(s, d, "documents").groupBy("source").agg(F.sum(F.ceil(F.length("text") / 4)).cast("long").alias("tokens")))
query("ex_guild", "SELECT user_id, least(100, round(100.0 * count(*) / 40))::BIGINT AS pct FROM events GROUP BY user_id")(lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.least(F.lit(100.0), F.round(100.0 * F.count("*") / 40)).cast("long").alias("pct")))
query("ex_community_hue", "SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE round((s_suppkey * 137.508::DOUBLE) % 360, 3) END AS hue FROM supplier")(
    lambda s, d: table(s, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 9 != 0, F.round(F.pmod(F.col("s_suppkey") * F.lit(137.508), F.lit(360.0)), 3)).alias("hue"))
)
query("ex_specialist", "SELECT conv_id, count(*) AS claims, min(turn) AS first, max(turn) AS last FROM conversations GROUP BY conv_id")(lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("claims"), F.min("turn").alias("first"), F.max("turn").alias("last")))
query("ex_gather_claims", f"WITH {BM25_CTE} SELECT query, key, source AS agent FROM bm25 JOIN documents ON doc_id = key WHERE rank <= 24")(lambda s, d: bm25_arm(s, d).filter("rank <= 24").join(docs(s, d), "key").select("query", "key", F.col("source").alias("agent")))
query("ex_dispute_text", f"WITH {si.ENTITIES} SELECT key, CASE WHEN needs_review THEN 'Trust ' || name || ' over ' || label ELSE name END AS said FROM entities")(lambda s, d: si.entities(s, d).select("key", F.when(F.col("needs_review"), F.concat(F.lit("Trust "), "name", F.lit(" over "), "label")).otherwise(F.col("name")).alias("said")))
query("ex_golden_events", "SELECT 'step' AS kind, o_orderkey AS id FROM orders UNION ALL SELECT 'dispute', l_orderkey FROM lineitem UNION ALL SELECT 'done', 0")(
    lambda s, d: table(s, d, "orders").select(F.lit("step").alias("kind"), F.col("o_orderkey").alias("id")).unionByName(table(s, d, "lineitem").select(F.lit("dispute").alias("kind"), F.col("l_orderkey").alias("id"))).unionByName(s.range(1).select(F.lit("done").alias("kind"), "id"))
)
query("ex_narrate", "SELECT event_id, CASE WHEN value > 90 THEN 'great' WHEN value > 50 THEN 'good' ELSE 'slow' END AS said FROM events")(lambda s, d: table(s, d, "events").select("event_id", F.when(F.col("value") > 90, "great").when(F.col("value") > 50, "good").otherwise("slow").alias("said")))
query("ex_persona", "SELECT n_nationkey, n_nationkey % 6 AS archetype, floor(n_nationkey / 6)::BIGINT AS cycle FROM nation")(lambda s, d: table(s, d, "nation").select("n_nationkey", F.pmod("n_nationkey", F.lit(6)).alias("archetype"), F.floor(F.col("n_nationkey") / 6).alias("cycle")))
query("ex_share_slug", "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", F.regexp_replace(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-"), "^-+|-+$", "").alias("slug")))
query("ex_surfaced", "SELECT conv_id, min(turn) AS first FROM conversations WHERE contains(lower(text), 'the ') GROUP BY conv_id")(lambda s, d: table(s, d, "conversations").filter(F.lower("text").contains("the ")).groupBy("conv_id").agg(F.min("turn").alias("first")))
query("ex_find_claim", f"SELECT b.item_id, arg_max(q.item_id, (len(list_intersect(list_distinct({_TOK.format('b.text')}), {_TOK.format('q.text')})), -q.item_id)) AS best FROM benchmark b JOIN benchmark q ON q.item_id <> b.item_id GROUP BY b.item_id")(
    lambda s, d: table(s, d, "benchmark").select("item_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("t")).alias("b").join(table(s, d, "benchmark").select(F.col("item_id").alias("o"), F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("t")), "t").filter("item_id <> o").groupBy("item_id", "o").agg(F.count("*").alias("n")).groupBy("item_id").agg(F.max_by("o", F.struct("n", -F.col("o"))).alias("best"))
)
query("events_windowed", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")(
    lambda s, d: table(s, d, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("start"), "event_type").agg(F.count("*").alias("n"))
)
query("row_cosine_pairs", "SELECT label, round(avg(list_cosine_similarity(embedding::DOUBLE[], [1.0] || list_transform(embedding[2:]::DOUBLE[], lambda x: 0.0))), 6) AS mean FROM embeddings GROUP BY label")(
    lambda s, d: table(s, d, "embeddings").groupBy("label").agg(F.round(F.avg(cosine(F.col("embedding"), F.transform("embedding", lambda x, i: F.when(i == 0, 1.0).otherwise(0.0)))), 6).alias("mean"))
)
