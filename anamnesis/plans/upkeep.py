"""Queries of lifecycle, graph analytics, security and administration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anamnesis.functions import text as tx
from anamnesis.operators import graph, lifecycle as lc
from anamnesis.plans import stand_ins as si
from anamnesis.functions.vector import embed, norm
from anamnesis.plans.files_and_streams import place
from anamnesis.registry import query, table

_M = f"""WITH {si.MEMORIES}, m AS (SELECT *, CASE WHEN turn % 2 = 0 THEN created_at - INTERVAL 100 DAY ELSE created_at END AS accessed_at FROM memories)"""


def now():  # noqa: ANN201
    return F.lit(si.NOW).cast("timestamp_ntz")


def mem(s: SparkSession, d: str) -> DataFrame:
    m = si.memories(s, d).withColumn("accessed_at", F.when(F.col("turn") % 2 == 0, F.col("created_at") - F.expr("INTERVAL '100' DAY")).otherwise(F.col("created_at")))
    return m.withColumns({"strength": F.lit(1.0), "invalid_at": F.lit(None).cast("timestamp_ntz")})


_FAINT = f"type = 'episodic' AND exp(-0.02 * greatest((epoch_us({si.NOW_SQL}) - epoch_us(accessed_at)) / 86400e6, 0)) < 0.1"
query("life_sweep", f"{_M} SELECT key, CASE WHEN {_FAINT} THEN {si.NOW_SQL} END AS invalid_at FROM m")(lambda s, d: lc.decay_sweep(mem(s, d), now()).select("key", "invalid_at"))


def ent(s: SparkSession, d: str) -> DataFrame:
    return si.entities(s, d).withColumn("invalid_at", F.lit(None).cast("timestamp_ntz"))


def old_new(s: SparkSession, d: str) -> DataFrame:
    return si.entities(s, d).filter("key % 10 = 0").select((F.col("key") + 1).alias("new"), F.col("key").alias("old"))


_SUP = f"WITH {si.ENTITIES} SELECT key, CASE WHEN key % 10 = 0 THEN {si.NOW_SQL} END AS invalid_at FROM entities"
for _n in ("life_supersede", "ex_confront"):
    query(_n, _SUP)(lambda s, d: lc.supersede(ent(s, d), old_new(s, d), now())[0].select("key", "invalid_at"))
_DREAM = f"""WITH {si.ENTITIES},
x AS (SELECT e.*, key + 1 AS conflict_with, key % 3 AS community, key % 11 <> 0 AS live FROM entities e),
j AS (SELECT a.key, a.needs_review, a.mention_count, a.belief, b.key AS r_key, b.belief AS r_belief, b.mention_count AS r_count, coalesce(b.live, false) AS r_live, a.community <> b.community AS apart, a.key % 2 = 0 AS contradicts
  FROM x a LEFT JOIN x b ON a.conflict_with = b.key WHERE a.live AND (a.needs_review OR a.mention_count >= 5)),
k AS (SELECT *, CASE WHEN NOT needs_review THEN 'distil' WHEN r_key IS NULL OR NOT r_live THEN 'clear' WHEN apart THEN 'skip' WHEN contradicts THEN 'supersede' ELSE 'clear' END AS action FROM j)
SELECT key, action FROM k"""


def dreams(s: SparkSession, d: str) -> DataFrame:
    e = si.entities(s, d).withColumns({"conflict_with": F.col("key") + 1, "community": F.col("key") % 3, "live": F.col("key") % 11 != 0})
    v = e.select("key", (F.col("key") % 2 == 0).alias("contradicts"))
    return lc.dream_decisions(e, v)


query("life_dream", _DREAM)(lambda s, d: dreams(s, d).select("key", "action"))
query("life_different_community", f"WITH {si.ENTITIES} SELECT a.key, a.key % 3 <> b.key % 3 AS differs FROM entities a JOIN entities b ON b.key = a.key + 3 OR b.key = a.key + 1 AND a.key % 2 = 0")(
    lambda s, d: si.entities(s, d).select("key").alias("a").join(
        si.entities(s, d).select(F.explode(F.array(F.struct((F.col("key") - 3).alias("k"), F.lit(True).alias("any")), F.struct((F.col("key") - 1).alias("k"), ((F.col("key") - 1) % 2 == 0).alias("any")))).alias("x"), F.col("key").alias("b")).filter("x.any"), F.col("key") == F.col("x.k")
    ).select("key", (F.col("key") % 3 != F.col("b") % 3).alias("differs"))
)
_GATHER = "SELECT entity, count(*) AS texts, max(o_totalprice) AS most FROM (SELECT DISTINCT l_orderkey, l_suppkey AS entity FROM lineitem) JOIN orders ON o_orderkey = l_orderkey GROUP BY entity"


@query("life_distill_gather", _GATHER)
def life_distill_gather(s: SparkSession, d: str) -> DataFrame:
    return si.mentions(s, d).join(table(s, d, "orders"), F.col("memory") == F.col("o_orderkey")).groupBy("entity").agg(F.count("*").alias("texts"), F.max("o_totalprice").alias("most"))


_PR_ROUNDS = 12
_PR = f"WITH {si.RELATES}, sides AS MATERIALIZED (SELECT lo AS a, hi AS b FROM relates UNION ALL SELECT hi, lo FROM relates), deg AS MATERIALIZED (SELECT a, count(*) AS n FROM sides GROUP BY a), nodes AS MATERIALIZED (SELECT s_suppkey AS node, deg.n FROM supplier LEFT JOIN deg ON a = s_suppkey), r0 AS (SELECT node, n, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes)" + "".join(
    f", r{i} AS MATERIALIZED (SELECT node, n, 0.15 / (SELECT count(*) FROM nodes) + 0.85 * (coalesce(flow, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i - 1} WHERE n IS NULL) / (SELECT count(*) FROM nodes)) AS rank FROM nodes LEFT JOIN (SELECT b, sum(rank / n) AS flow FROM sides JOIN r{i - 1} ON a = node GROUP BY b) ON b = node)"
    for i in range(1, _PR_ROUNDS + 1)
) + f" SELECT node, round(rank / (SELECT max(rank) FROM r{_PR_ROUNDS}), 4) AS rank FROM r{_PR_ROUNDS}"


def ranked(s: SparkSession, d: str) -> DataFrame:
    nodes = table(s, d, "supplier").select(F.col("s_suppkey").alias("node"))
    return graph.pagerank(nodes, si.relates(s, d).select("lo", "hi"), rounds=_PR_ROUNDS, tolerance=0.0)


for _n in ("life_pagerank", "life_centrality"):
    query(_n, _PR)(lambda s, d: ranked(s, d).withColumn("rank", F.round("rank", 4)))


def communities(s: SparkSession, d: str) -> DataFrame:
    nodes = si.entities(s, d).select(F.col("key").alias("node"), "tenant")
    return graph.label_propagation(nodes, si.relates(s, d).filter("corroboration > 1").select("lo", "hi"))


for _n in ("life_lpa", "life_communities"):
    query(_n)(communities)
query("agg_count_distinct", "SELECT s_nationkey AS nation, count(DISTINCT s_suppkey % 3) AS communities FROM supplier GROUP BY s_nationkey")(
    lambda s, d: table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.countDistinct(F.col("s_suppkey") % 3).alias("communities"))
)
_ONT = f"""WITH {si.RELATES}, {si.ENTITIES}, j AS (SELECT a.tenant, least(a.label, b.label) AS label_a, greatest(a.label, b.label) AS label_b FROM relates JOIN entities a ON a.key = lo JOIN entities b ON b.key = hi),
c AS (SELECT tenant, label_a, label_b, count(*) AS support FROM j GROUP BY ALL HAVING count(*) >= 3)"""


def clusters(s: SparkSession, d: str) -> DataFrame:
    return lc.ontology_clusters(si.entities(s, d), si.relates(s, d).select("lo", "hi"))


for _n in ("life_ontology_clusters", "agg_group_into", "join_lookup_endpoints"):
    query(_n, f"{_ONT} SELECT * FROM c")(lambda s, d: clusters(s, d).select("tenant", "label_a", "label_b", "support"))
query("life_ontology_propose", f"{_ONT} SELECT tenant, label_a, label_b, support, label_a || '_to_' || label_b AS proposed_relationship, CASE WHEN label_a = 'label0' THEN 'approved' ELSE 'pending' END AS status FROM c")(
    lambda s, d: lc.upsert_proposals(
        clusters(s, d).filter("label_a = 'label0'").select("tenant", "label_a", "label_b", F.lit(0).cast("long").alias("support"), F.lit("old").alias("proposed_relationship"), F.lit("approved").alias("status")),
        clusters(s, d).withColumn("proposed_relationship", tx.snake_case(F.concat("label_a", F.lit(" TO "), "label_b"))),
    )
)
query("life_ontology_normalize", "SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '_', 'g'), '_') END AS slug FROM nation")(
    lambda s, d: table(s, d, "nation").select("n_nationkey", tx.snake_case(F.when(F.col("n_nationkey") % 4 == 0, "NONE").otherwise(F.concat("n_name", F.lit("\nmore")))).alias("slug"))
)
query("life_ontology_list", f"{_ONT} SELECT label_a, label_b, support FROM c WHERE label_a <> 'label1' ORDER BY support DESC, tenant, label_a, label_b LIMIT 20")(
    lambda s, d: clusters(s, d).filter("label_a <> 'label1'").orderBy(F.desc("support"), "tenant", "label_a", "label_b").limit(20).select("label_a", "label_b", "support")
)
query("life_ontology_approve", f"{_ONT} SELECT lo, hi, CASE WHEN least(a.label, b.label) = 'label1' THEN 'works_with' ELSE 'associated_with' END AS relationship FROM relates JOIN entities a ON a.key = lo JOIN entities b ON b.key = hi")(
    lambda s, d: si.relates(s, d).join(si.entities(s, d).select(F.col("key").alias("lo"), F.col("label").alias("la")), "lo").join(si.entities(s, d).select(F.col("key").alias("hi"), F.col("label").alias("lb")), "hi").select("lo", "hi", F.when(F.least("la", "lb") == "label1", "works_with").otherwise("associated_with").alias("relationship"))
)
query("life_ontology_reject", f"{_ONT} SELECT tenant, label_a, label_b, CASE WHEN support < 10 THEN 'rejected' ELSE 'pending' END AS status FROM c")(
    lambda s, d: clusters(s, d).select("tenant", "label_a", "label_b", F.when(F.col("support") < 10, "rejected").otherwise("pending").alias("status"))
)


@query("life_reembed", f"""WITH {si.MEMORIES} SELECT key, 'v2' AS version, CASE WHEN turn % 2 = 0 OR regexp_matches(lower(text), '[\\p{{L}}\\p{{N}}]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm
FROM (SELECT key, any_value(turn) AS turn, any_value(text) AS text FROM memories GROUP BY key)""")
def life_reembed(s: SparkSession, d: str) -> DataFrame:
    """Odd turns have vectors of an old version, even ones current unit vectors."""
    m = si.memories(s, d).dropDuplicates(["key"])
    old = m.select("key", F.when(F.col("turn") % 2 == 0, F.array(F.lit(0.6), F.lit(0.8))).otherwise(F.array(F.lit(0.5))).alias("embedding"), F.when(F.col("turn") % 2 == 0, "v2").otherwise("v1").alias("version"))
    made = lc.reembed(old, m, lambda rows: embed(rows, "key", "text"), "v2")
    return made.select("key", "version", F.round(norm(F.col("embedding")), 6).alias("norm"))


query("life_rebuild_index", "SELECT label, count(*) >= 40 AS rebuilt FROM embeddings GROUP BY label")(lambda s, d: table(s, d, "embeddings").groupBy("label").agg((F.count("*") >= 40).alias("rebuilt")))

query("sec_forget", f"{_M} SELECT key, CASE WHEN tenant = 'tenant3' AND agent = 'user' THEN {si.NOW_SQL} END AS invalid_at FROM m")(lambda s, d: lc.forget(mem(s, d), "tenant3", now(), "user").select("key", "invalid_at"))


def purged(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return lc.purge(si.entities(s, d), si.relates(s, d), "tenant1")


query("sec_purge", f"WITH {si.ENTITIES} SELECT key FROM entities WHERE tenant <> 'tenant1'")(lambda s, d: purged(s, d)[0].select("key"))
_DEL = f"WITH {si.RELATES}, {si.ENTITIES} SELECT lo, hi FROM relates WHERE lo NOT IN (SELECT key FROM entities WHERE tenant = 'tenant1') AND hi NOT IN (SELECT key FROM entities WHERE tenant = 'tenant1')"
query("join_delete_edges", _DEL)(lambda s, d: purged(s, d)[1].select("lo", "hi"))


@query("sec_worm", "SELECT count(*) AS written, true AS refused FROM conversations")
def sec_worm(s: SparkSession, d: str) -> DataFrame:
    """Episodes written twice to one place: the second time is refused."""
    path, rows, refused = place(s, "worm"), table(s, d, "conversations"), False
    lc.write_once(rows, path)
    try:
        lc.write_once(rows.limit(1), path)
    except PermissionError:
        refused = True
    return s.read.parquet(path).agg(F.count("*").alias("written")).withColumn("refused", F.lit(refused))


query("sec_size_cap", "SELECT doc_id, strlen(text)::BIGINT AS bytes FROM documents WHERE strlen(text) > 4096")(lambda s, d: table(s, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes")).filter("bytes > 4096"))
query("sec_rate_limit")(lambda s, d: lc.rate_limited(table(s, d, "events").select(F.col("user_id").alias("user"), "ts", F.col("event_id").alias("event")), 3, 3600))
query("sec_scope_claim", "SELECT claim, best FROM (VALUES ('read write', 'write'), ('read', 'read'), ('consolidate read', 'consolidate'), ('other', NULL)) t(claim, best)")(
    lambda s, d: s.createDataFrame([("read write",), ("read",), ("consolidate read",), ("other",)], "claim string").select("claim", F.expr("CASE WHEN array_contains(split(claim, ' '), 'consolidate') THEN 'consolidate' WHEN array_contains(split(claim, ' '), 'write') THEN 'write' WHEN array_contains(split(claim, ' '), 'read') THEN 'read' END").alias("best"))
)
query("predicate_agent_glob", "SELECT DISTINCT agent, agent = 'user' OR agent LIKE 'as%' AS allowed FROM (SELECT role AS agent FROM conversations)")(
    lambda s, d: si.memories(s, d).select("agent").distinct().withColumn("allowed", tx.agent_allowed(F.col("agent"), F.array(F.lit("user"), F.lit("as*"))))
)
_SC = "(VALUES ('read'), ('write'), ('consolidate')) {}"
query("predicate_scope_rank", f"SELECT a.s AS have, b.s AS need, (CASE a.s WHEN 'read' THEN 0 WHEN 'write' THEN 1 ELSE 2 END) >= (CASE b.s WHEN 'read' THEN 0 WHEN 'write' THEN 1 ELSE 2 END) AS allowed FROM {_SC.format('a(s)')}, {_SC.format('b(s)')}")(
    lambda s, d: s.range(1).select(F.explode(F.array(*map(F.lit, ("read", "write", "consolidate")))).alias("have")).select("have", F.explode(F.array(*map(F.lit, ("read", "write", "consolidate")))).alias("need")).withColumn("allowed", tx.scope_rank(F.col("have")) >= tx.scope_rank(F.col("need")))
)
query("predicate_insight_tier", f"WITH {si.MEMORIES} SELECT DISTINCT agent || '::insight' AS a, true AS insight FROM memories UNION SELECT DISTINCT agent, false FROM memories")(
    lambda s, d: si.memories(s, d).select(F.explode(F.array(F.concat("agent", F.lit("::insight")), "agent")).alias("a")).distinct().withColumn("insight", F.col("a").endswith("::insight"))
)
query("authorize", f"WITH {si.MEMORIES} SELECT key, CASE WHEN tenant <> 'tenant2' THEN '403 tenant' WHEN agent = 'system' THEN '403 agent' ELSE 'ok' END AS decision FROM memories")(
    lambda s, d: si.memories(s, d).select("key", F.when(F.col("tenant") != "tenant2", "403 tenant").when(~tx.agent_allowed(F.col("agent"), F.array(F.lit("user"), F.lit("assist*"))), "403 agent").otherwise("ok").alias("decision"))
)
query("adm_stats", f"WITH {si.MEMORIES}, {si.ENTITIES} SELECT t.tenant, (SELECT count(*) FROM memories m WHERE m.tenant = t.tenant) AS memories, (SELECT count(*) FROM entities e WHERE e.tenant = t.tenant) AS entities FROM (SELECT DISTINCT tenant FROM memories) t")(
    lambda s, d: si.memories(s, d).groupBy("tenant").agg(F.count("*").alias("memories")).join(si.entities(s, d).groupBy("tenant").agg(F.count("*").alias("entities")), "tenant", "left").select("tenant", "memories", F.coalesce("entities", F.lit(0)).alias("entities"))
)
query("agg_count", f"WITH {si.MEMORIES} SELECT session, count(*) AS n FROM memories GROUP BY session")(lambda s, d: si.memories(s, d).groupBy("session").agg(F.count("*").alias("n")))
_GRAPHQ = f"WITH {si.RELATES}, {si.ENTITIES} SELECT lo, hi, 'relates_to' AS kind FROM relates WHERE lo IN (SELECT key FROM entities WHERE tenant = 'tenant2') AND hi IN (SELECT key FROM entities WHERE tenant = 'tenant2')"


def tenant_edges(s: SparkSession, d: str) -> DataFrame:
    keys = si.entities(s, d).filter("tenant = 'tenant2'").select("key")
    return si.relates(s, d).join(keys.withColumnRenamed("key", "lo"), "lo", "left_semi").join(keys.withColumnRenamed("key", "hi"), "hi", "left_semi").select("lo", "hi", F.lit("relates_to").alias("kind"))


for _n in ("adm_graph", "join_semi_keys", "project_graph_edge"):
    query(_n, _GRAPHQ)(tenant_edges)
query("set_union_all", f"{_GRAPHQ} UNION ALL SELECT key + 1, key, 'supersedes' FROM entities WHERE key % 10 = 0")(lambda s, d: tenant_edges(s, d).unionByName(old_new(s, d).select(F.col("new").alias("lo"), F.col("old").alias("hi"), F.lit("supersedes").alias("kind"))))
_REL = f"WITH {si.RELATES} SELECT DISTINCT CASE WHEN lo = 7 THEN hi ELSE lo END AS neighbour FROM relates WHERE lo = 7 OR hi = 7"
for _n in ("adm_get_entity", "join_traverse_any", "set_union_distinct"):
    query(_n, _REL)(lambda s, d: si.relates(s, d).filter("lo = 7").select(F.col("hi").alias("neighbour")).union(si.relates(s, d).filter("hi = 7").select("lo")).distinct())
_LIST = f"WITH {si.ENTITIES} SELECT key, name, label, mention_count FROM entities WHERE tenant = 'tenant1' AND label = 'label2' ORDER BY mention_count DESC, key LIMIT 50"
for _n in ("adm_list_entities", "topk_entities", "filter_optional"):
    query(_n, _LIST)(lambda s, d: si.entities(s, d).filter("tenant = 'tenant1' AND label = 'label2'").orderBy(F.desc("mention_count"), "key").limit(50).select("key", "name", "label", "mention_count"))
query("adm_history", f"WITH {si.MEMORIES} SELECT session, string_agg(key, ',' ORDER BY created_at, key) AS transcript FROM memories GROUP BY session")(
    lambda s, d: si.memories(s, d).groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "key"))), lambda x: x["key"]), ",").alias("transcript"))
)
query("sort_history", f"WITH {si.MEMORIES} SELECT key, row_number() OVER (PARTITION BY session ORDER BY created_at, key)::INTEGER AS nth FROM memories")(
    lambda s, d: si.memories(s, d).select("key", F.row_number().over(Window.partitionBy("session").orderBy("created_at", "key")).alias("nth"))
)
query("adm_clear", f"{_M} SELECT key, CASE WHEN session = 3 THEN {si.NOW_SQL} END AS invalid_at FROM m")(lambda s, d: mem(s, d).select("key", F.when(F.col("session") == 3, now()).alias("invalid_at")))
