"""Queries of the retrieval operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anamnesis.functions import text as tx
from anamnesis.functions.vector import cosine, embed
from anamnesis.operators import retrieve as r
from anamnesis.plans import stand_ins as si
from anamnesis.registry import query, table

_TOK = r"list_filter(string_split(trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '')"
QUERIES_CTE = f"q AS (SELECT item_id AS query, text FROM benchmark WHERE item_id % {si.EVERY} = 0)"
BM25_CTE = QUERIES_CTE + f""",
terms AS (SELECT DISTINCT query, unnest({_TOK.format('text')}) AS term FROM q),
toks AS (SELECT doc_id AS key, {_TOK.format('text')} AS t FROM documents),
tot AS (SELECT count(*) AS n_docs, avg(len(t)) AS avg_len FROM toks),
tf AS (SELECT key, len, term, count(*) AS tf FROM (SELECT key, len(t) AS len, unnest(t) AS term FROM toks) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT query, key, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score
  FROM tf JOIN df USING (term) JOIN terms USING (term) CROSS JOIN tot GROUP BY query, key),
bm25 AS (SELECT * FROM (SELECT query, key, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM bm) WHERE rank <= 100)"""
VEC_CTE = f"""vq AS (SELECT vec_id AS query, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % {si.EVERY} = 0),
vector AS (SELECT * FROM (SELECT query, key, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM (
  SELECT query, vec_id AS key, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, vq)) WHERE rank <= 100)"""
FUSED_CTE = BM25_CTE + ",\n" + VEC_CTE + f""",
fused AS (SELECT query, key, round(sum(share), 9) AS fused, string_agg(arm, '+' ORDER BY arm) AS signals FROM (
  SELECT query, key, 'bm25' AS arm, 1.0::DOUBLE / (60 + rank) AS share FROM bm25 UNION ALL SELECT query, key, 'vector', 1.0::DOUBLE / (60 + rank) FROM vector) GROUP BY query, key)"""


def bench_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark row whose id is divisible by EVERY, with its whole text."""
    return table(spark, d, "benchmark").filter(F.col("item_id") % si.EVERY == 0).select(F.col("item_id").alias("query"), "text")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").withColumnRenamed("doc_id", "key")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("embedding"), "label")


def stored_vectors(spark: SparkSession, d: str) -> DataFrame:
    """As the table has them: the operators on them compute in double precision."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding")


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return stored_vectors(spark, d).filter(F.col("key") % si.EVERY == 0).select(F.col("key").alias("query"), "embedding")


def bm25_arm(spark: SparkSession, d: str) -> DataFrame:
    return r.bm25(docs(spark, d), bench_queries(spark, d))


def vector_arm(spark: SparkSession, d: str) -> DataFrame:
    return r.vector_top(stored_vectors(spark, d), vector_queries(spark, d))


def fused(spark: SparkSession, d: str) -> DataFrame:
    return r.fuse({"bm25": bm25_arm(spark, d), "vector": vector_arm(spark, d)})


query("ret_bm25", f"WITH {BM25_CTE} SELECT query, key, score, rank::INTEGER AS rank FROM bm25")(bm25_arm)
query("ret_vector", f"WITH {VEC_CTE} SELECT query, key, score, rank::INTEGER AS rank FROM vector")(vector_arm)
query("search_view_scan", f"SELECT term, count(*) AS postings, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({_TOK.format('text')}) AS term FROM documents) GROUP BY term")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf")).groupBy("term").agg(F.sum("tf").alias("postings"), F.count("*").alias("docs"))
)
query("ret_rrf", f"WITH {FUSED_CTE} SELECT query, key, fused, signals FROM fused")(lambda s, d: fused(s, d).drop("seen"))
query("ret_hit_source", f"WITH {FUSED_CTE} SELECT signals, count(*) AS hits FROM fused GROUP BY signals")(lambda s, d: fused(s, d).groupBy("signals").agg(F.count("*").alias("hits")))
query("set_union_signals", f"WITH {FUSED_CTE} SELECT query, signals, count(*) AS n FROM fused GROUP BY ALL")(lambda s, d: fused(s, d).groupBy("query", "signals").agg(F.count("*").alias("n")))
query("sort_fused", f"WITH {FUSED_CTE} SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY fused DESC, key)::INTEGER AS rank FROM fused")(
    lambda s, d: r.top(fused(s, d), None, "fused").select("query", "key", "rank")
)
query("win_minmax_norm", f"WITH {FUSED_CTE} SELECT query, key, round((fused - min(fused) OVER w) / CASE WHEN max(fused) OVER w = min(fused) OVER w THEN 1.0 ELSE max(fused) OVER w - min(fused) OVER w END, 6) AS scaled FROM fused WINDOW w AS (PARTITION BY query)")(
    lambda s, d: fused(s, d).select("query", "key", F.round(r.minmax("fused"), 6).alias("scaled"))
)
query("win_rank", f"WITH {BM25_CTE} SELECT query, key, rank::INTEGER AS rank FROM bm25")(lambda s, d: bm25_arm(s, d).select("query", "key", "rank"))
query("topk_arm", f"WITH {BM25_CTE} SELECT query, key, score FROM bm25 WHERE rank <= 10")(lambda s, d: bm25_arm(s, d).filter("rank <= 10").select("query", "key", "score"))
_SEEDS = f"""WITH {BM25_CTE},
{VEC_CTE},
f AS (SELECT query, key, min((arm, rank)) AS place FROM (SELECT query, key, 0 AS arm, rank FROM bm25 WHERE rank <= 10 UNION ALL SELECT query, key, 1, rank FROM vector WHERE rank <= 10) GROUP BY query, key)
SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY place) AS nth FROM f"""
query("ret_seeds", _SEEDS)(lambda s, d: r.seeds([bm25_arm(s, d), vector_arm(s, d)]))
query("win_topn_per_group", _SEEDS)(lambda s, d: r.seeds([bm25_arm(s, d), vector_arm(s, d)]))
query("set_dedupe_keep_first", _SEEDS)(lambda s, d: r.seeds([bm25_arm(s, d), vector_arm(s, d)]))
_REC = "exp(-0.02 * (epoch_us({now}) - epoch_us({ts})) / 86400e6)".format(now=si.NOW_SQL, ts="created_at")


@query("ret_decay_mult", f"WITH {si.MEMORIES} SELECT key, round({_REC}, 6) AS decay FROM memories")
def ret_decay_mult(s: SparkSession, d: str) -> DataFrame:
    m = si.memories(s, d)
    return m.select("key", F.round(r.decay_multiplier(F.lit(1.0), F.col("created_at"), F.lit(si.NOW).cast("timestamp")), 6).alias("decay"))


@query("life_strength", f"WITH {si.MEMORIES} SELECT key, round(exp(-0.02 * greatest((epoch_us({si.NOW_SQL}) - epoch_us(created_at)) / 86400e6, 0)), 6) AS strength FROM memories")
def life_strength(s: SparkSession, d: str) -> DataFrame:
    return si.memories(s, d).select("key", F.round(r.effective_strength(F.lit(None).cast("double"), F.col("created_at"), F.lit(si.NOW).cast("timestamp")), 6).alias("strength"))


@query("ret_second_rrf", f"WITH {BM25_CTE} SELECT key, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS fused, count(*) AS lists FROM bm25 GROUP BY key")
def ret_second_rrf(s: SparkSession, d: str) -> DataFrame:
    """The queries as sub-queries of one: their lists fused again, each weighing one."""
    return bm25_arm(s, d).groupBy("key").agg(F.round(F.sum(1.0 / (r.RRF + F.col("rank"))), 6).alias("fused"), F.count("*").alias("lists"))


_COVER = f"""len(list_intersect(list_distinct({_TOK.format('q.text')}), {_TOK.format('d.text')}))::DOUBLE / len(list_distinct({_TOK.format('q.text')}))"""


@query("rerank_fake", f"WITH {QUERIES_CTE} SELECT query, doc_id AS key, round({_COVER}, 6) AS score FROM q, documents d")
def rerank_fake(s: SparkSession, d: str) -> DataFrame:
    q = bench_queries(s, d).withColumnRenamed("text", "q")
    return docs(s, d).join(F.broadcast(q), F.lit(True)).select("query", "key", F.round(r.rerank_coverage(F.col("q"), F.col("text")), 6).alias("score"))


@query("ret_rerank", f"""WITH {BM25_CTE}, re AS (SELECT b.query, b.key, round({_COVER}, 6) AS score FROM bm25 b JOIN documents d ON d.doc_id = b.key JOIN q ON q.query = b.query WHERE rank <= 50)
SELECT query, key, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, key)::INTEGER AS rank FROM re""")
def ret_rerank(s: SparkSession, d: str) -> DataFrame:
    rows = bm25_arm(s, d).drop("score").join(docs(s, d).select("key", "text"), "key").join(bench_queries(s, d).withColumnRenamed("text", "q"), "query")
    out = r.rerank(rows, r.rerank_coverage(F.col("q"), F.col("text")))
    return out.select("query", "key", F.col("order").alias("score"), "rank")


@query("set_intersect_tokens", f"WITH {QUERIES_CTE} SELECT query, doc_id AS key, len(list_intersect(list_distinct({_TOK.format('q.text')}), {_TOK.format('d.text')}))::BIGINT AS common FROM q, documents d")
def set_intersect_tokens(s: SparkSession, d: str) -> DataFrame:
    q = bench_queries(s, d).withColumnRenamed("text", "q")
    return docs(s, d).join(F.broadcast(q), F.lit(True)).select("query", "key", F.size(F.array_intersect(tx.tokens(F.col("q")), tx.tokens(F.col("text")))).cast("long").alias("common"))


@query("ret_cosine", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def ret_cosine(s: SparkSession, d: str) -> DataFrame:
    v = vectors(s, d)
    w = v.select((F.col("key") - 1).alias("key"), F.col("key").alias("b"), F.col("embedding").alias("e"))
    return v.join(w, "key").select(F.col("key").alias("a"), "b", F.round(cosine(F.col("embedding"), F.col("e")), 6).alias("cos"))


@query("ret_arm_weight", "SELECT arm, CASE arm WHEN 'graph' THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM (VALUES ('bm25'), ('vector'), ('graph'), ('other')) t(arm)")
def ret_arm_weight(s: SparkSession, d: str) -> DataFrame:
    w = F.when(F.col("arm") == "graph", r.ARM_WEIGHTS["graph"]).otherwise(1.0)
    return s.createDataFrame([("bm25",), ("vector",), ("graph",), ("other",)], "arm string").withColumn("weight", w)


@query("ret_vector_gate", "SELECT count(*) AS rows, 2560::BIGINT AS threshold, count(*) >= 2560 AS ready FROM embeddings")
def ret_vector_gate(s: SparkSession, d: str) -> DataFrame:
    return vectors(s, d).agg(F.count("*").alias("rows")).select("rows", F.lit(64 * 40).cast("long").alias("threshold"), (F.col("rows") >= 64 * 40).alias("ready"))


@query("ret_vector_diag", "SELECT label, count(*) AS corpus, min(len(embedding))::INTEGER AS least_dim, max(len(embedding))::INTEGER AS most_dim FROM embeddings GROUP BY label")
def ret_vector_diag(s: SparkSession, d: str) -> DataFrame:
    return vectors(s, d).groupBy("label").agg(F.count("*").alias("corpus"), F.min(F.size("embedding")).alias("least_dim"), F.max(F.size("embedding")).alias("most_dim"))


_GRAPH = f"""WITH {si.RELATES},
b AS (SELECT lo AS a, hi AS b, belief AS w FROM relates UNION ALL SELECT hi, lo, belief FROM relates),
s0 AS (SELECT s_suppkey AS query, s_suppkey AS node, 0 AS hop, 0.0::DOUBLE AS sum_w FROM supplier WHERE s_suppkey % {si.EVERY} = 0),
s1 AS (SELECT query, b.b AS node, 1 AS hop, max(w) AS sum_w FROM s0 JOIN b ON b.a = node WHERE b.b <> query GROUP BY ALL),
v1 AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1),
s2 AS (SELECT s1.query, b.b AS node, 2 AS hop, max(sum_w + w) AS sum_w FROM s1 JOIN b ON b.a = node WHERE NOT EXISTS (SELECT 1 FROM v1 WHERE v1.query = s1.query AND v1.node = b.b) GROUP BY ALL),
reach AS (SELECT * FROM v1 UNION ALL SELECT * FROM s2)"""


def reached(s: SparkSession, d: str) -> DataFrame:
    edges = si.relates(s, d).withColumnRenamed("belief", "weight")
    start = table(s, d, "supplier").filter(F.col("s_suppkey") % si.EVERY == 0).select(F.col("s_suppkey").alias("query"), F.col("s_suppkey").alias("node"))
    return r.khop(start, edges, 2)


query("join_bfs_khop", f"{_GRAPH} SELECT query, node, hop, round(sum_w, 6) AS sum_w FROM reach")(lambda s, d: reached(s, d).withColumn("sum_w", F.round("sum_w", 6)))
query("agg_avg_path", f"{_GRAPH} SELECT hop, round(avg(CASE WHEN hop > 0 THEN sum_w / hop END), 6) AS mean_weight FROM reach GROUP BY hop")(
    lambda s, d: reached(s, d).groupBy("hop").agg(F.round(F.avg(F.when(F.col("hop") > 0, F.col("sum_w") / F.col("hop"))), 6).alias("mean_weight"))
)
_ARM = f"""{_GRAPH}, {si.ENTITIES},
e AS (SELECT query, node, hop, greatest(belief, CASE WHEN hop > 0 THEN sum_w / hop ELSE 0 END) AS trust FROM reach JOIN entities ON key = node),
m AS (SELECT query, memory, hop, trust FROM (SELECT query, memory, hop, trust, row_number() OVER (PARTITION BY query, node ORDER BY memory) AS n FROM e JOIN mentions ON entity = node) WHERE n <= 50),
g AS (SELECT query, memory AS key, round(1.0 / (1 + min(hop)) * (0.5 + 0.5 * max(trust)), 6) AS score FROM m GROUP BY query, memory)
SELECT query, key, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM g) WHERE rank <= 100"""


@query("ret_graph", _ARM)
def ret_graph(s: SparkSession, d: str) -> DataFrame:
    """Seeds to entities within two hops to their memories, at most 50 an entity."""
    ent = si.entities(s, d).select(F.col("key").alias("node"), "belief")
    e = reached(s, d).join(ent, "node").withColumn("trust", F.greatest("belief", F.when(F.col("hop") > 0, F.col("sum_w") / F.col("hop")).otherwise(0.0)))
    g = r.first_memories(e, si.mentions(s, d), 50)
    return r.top(g, r.POOL, "score")


query("agg_multi", f"{_GRAPH} SELECT node, min(hop) AS hops, round(max(sum_w), 6) AS most, count(DISTINCT query) AS queries FROM reach GROUP BY node")(
    lambda s, d: reached(s, d).groupBy("node").agg(F.min("hop").alias("hops"), F.round(F.max("sum_w"), 6).alias("most"), F.count("*").alias("queries"))
)
query("win_per_entity_cap", "SELECT entity, memory FROM (SELECT DISTINCT l_suppkey AS entity, l_orderkey AS memory, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS n FROM lineitem) WHERE n <= 50")(
    lambda s, d: si.mentions(s, d).withColumn("n", F.row_number().over(Window.partitionBy("entity").orderBy("memory"))).filter("n <= 50").select("entity", "memory")
)
query("win_per_start_cap", f"{_GRAPH} SELECT query, node FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY hop, node) AS n FROM reach) WHERE n <= 200")(
    lambda s, d: reached(s, d).withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("hop", "node"))).filter("n <= 200").select("query", "node")
)
query("prime_entities", f"WITH {si.ENTITIES} SELECT key, name, mention_count FROM entities ORDER BY belief DESC, mention_count DESC, key LIMIT 20")(
    lambda s, d: si.entities(s, d).orderBy(F.desc("belief"), F.desc("mention_count"), "key").limit(20).select("key", "name", "mention_count")
)
query("prime_steps", f"WITH {si.STEPS} SELECT agent, tool_name, outcome, use_count FROM steps ORDER BY use_count DESC, key LIMIT 10")(
    lambda s, d: si.steps(s, d).orderBy(F.desc("use_count"), "key").limit(10).select("agent", "tool_name", "outcome", "use_count")
)
query("prime_render", f"WITH {si.STEPS} SELECT key, '- ' || tool_name || ' (' || outcome || ', used ' || use_count::VARCHAR || 'x)' AS line FROM steps")(
    lambda s, d: si.steps(s, d).select("key", F.concat(F.lit("- "), "tool_name", F.lit(" ("), "outcome", F.lit(", used "), F.col("use_count").cast("string"), F.lit("x)")).alias("line"))
)
_COST = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))"
_PACK = f"WITH {si.MEMORIES} SELECT session, key, running::BIGINT AS running FROM (SELECT session, key, sum({_COST}) OVER (PARTITION BY session ORDER BY turn, agent ROWS UNBOUNDED PRECEDING) AS running FROM memories) WHERE running <= 200"


def packed(s: SparkSession, d: str) -> DataFrame:
    rows = si.memories(s, d).withColumn("query", F.col("session"))
    return r.pack_prefix(rows, 200, [F.col("turn"), F.col("agent")]).select("session", "key", F.col("running").cast("long").alias("running"))


query("win_running_budget", _PACK)(packed)
query("prime_pack", _PACK)(packed)
query("ret_line", f"WITH {si.MEMORIES} SELECT key, CASE WHEN turn % 2 = 0 THEN '- [' || turn::VARCHAR || '] ' || text ELSE '- ' || text END AS line FROM memories")(
    lambda s, d: si.memories(s, d).select("key", r.line(F.when(F.col("turn") % 2 == 0, F.col("turn").cast("string")), F.col("text")).alias("line"))
)
query("ret_token_count", f"WITH {si.MEMORIES} SELECT key, {_COST}::BIGINT AS cost FROM memories")(lambda s, d: si.memories(s, d).select("key", tx.token_cost(F.col("text")).cast("long").alias("cost")))
_TOUCH = f"WITH {si.MEMORIES} SELECT key, CASE WHEN turn < 2 THEN 2 ELSE 0 END AS access_count, CASE WHEN turn < 2 THEN {si.NOW_SQL} ELSE created_at END AS accessed_at FROM memories"


@query("ret_reset_access", _TOUCH)
def ret_reset_access(s: SparkSession, d: str) -> DataFrame:
    m = si.memories(s, d).withColumns({"access_count": F.lit(0), "accessed_at": F.col("created_at")})
    return r.touch(m, m.filter("turn < 2"), F.lit(si.NOW).cast("timestamp_ntz")).select("key", "access_count", "accessed_at")


def mmr_rows(s: SparkSession, d: str) -> DataFrame:
    return vector_arm(s, d).join(stored_vectors(s, d), "key").select("query", "key", F.col("score").alias("fused"), "embedding")


query("ret_mmr")(lambda s, d: r.mmr(mmr_rows(s, d), 10, 0.5))
query("topk_mmr")(lambda s, d: r.mmr(mmr_rows(s, d), 5, 0.7))


def tier_rows(s: SparkSession, d: str) -> DataFrame:
    return si.memories(s, d).select(F.col("session").alias("query"), "key", F.col("type").alias("tier"), (1.0 / (1 + F.col("turn"))).alias("score"), "text")


query("ret_pack")(lambda s, d: r.pack_tiers(tier_rows(s, d), 300))
query("win_greedy_budget")(lambda s, d: r.pack_tiers(tier_rows(s, d), 150))


_DECAY = f"exp(-0.02 * (epoch_us({si.NOW_SQL}) - epoch_us(accessed_at)) / 86400e6)"
IMPL_CTE = BM25_CTE[: BM25_CTE.index(",\nbm25 AS (")] + f""",
{si.DOC_MEMORIES}, {si.ENTITIES}, {si.RELATES},
bm25 AS (SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY round(score * {_DECAY}, 9) DESC, key) AS rank FROM bm JOIN docmem USING (key) QUALIFY rank <= 100),
vq AS (SELECT vec_id AS query, embedding::DOUBLE[] AS q FROM embeddings JOIN benchmark ON item_id = vec_id WHERE vec_id % {si.EVERY} = 0),
vector AS (SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM (
  SELECT query, vec_id AS key, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, vq WHERE vec_id IN (SELECT doc_id FROM documents)) QUALIFY rank <= 100),
sd AS (SELECT query, key FROM bm25 WHERE rank <= 10 UNION SELECT query, key FROM vector WHERE rank <= 10),
b AS (SELECT lo AS a, hi AS b, belief AS w FROM relates UNION ALL SELECT hi, lo, belief FROM relates),
s0 AS (SELECT DISTINCT query, entity AS node, 0 AS hop, 0.0::DOUBLE AS sum_w FROM sd JOIN mentions ON memory = key),
s1 AS (SELECT query, b.b AS node, 1 AS hop, max(w) AS sum_w FROM s0 JOIN b ON b.a = node WHERE NOT EXISTS (SELECT 1 FROM s0 v WHERE v.query = s0.query AND v.node = b.b) GROUP BY ALL),
v1 AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1),
s2 AS (SELECT s1.query, b.b AS node, 2 AS hop, max(sum_w + w) AS sum_w FROM s1 JOIN b ON b.a = node WHERE NOT EXISTS (SELECT 1 FROM v1 WHERE v1.query = s1.query AND v1.node = b.b) GROUP BY ALL),
near AS (SELECT query, node, hop, greatest(belief, CASE WHEN hop > 0 THEN sum_w / hop ELSE 0 END) AS trust FROM (SELECT * FROM v1 UNION ALL SELECT * FROM s2) JOIN entities ON key = node),
held AS (SELECT query, memory, hop, trust FROM near JOIN mentions ON entity = node QUALIFY row_number() OVER (PARTITION BY query, node ORDER BY memory) <= 50),
graph AS (SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM (
  SELECT query, memory AS key, round(1.0 / (1 + min(hop)) * (0.5 + 0.5 * max(trust)) * any_value({_DECAY}), 6) AS score FROM held JOIN docmem ON docmem.key = memory
  WHERE (query, memory) NOT IN (SELECT query, key FROM sd) GROUP BY query, memory) QUALIFY rank <= 100),
fu AS (SELECT query, key, round(sum(share), 9) AS fused, string_agg(arm, '+' ORDER BY arm) AS signals FROM (
  SELECT query, key, 'bm25' AS arm, 1.0::DOUBLE / (60 + rank) AS share FROM bm25 UNION ALL SELECT query, key, 'vector', 1.0::DOUBLE / (60 + rank) FROM vector
  UNION ALL SELECT query, key, 'graph', 0.1::DOUBLE / (60 + rank) FROM graph) GROUP BY query, key),
aged AS (SELECT query, key, signals, round(fused * exp(-0.02 * greatest((epoch_us({si.NOW_SQL}) - epoch_us(accessed_at)) / 86400e6, 0)), 9) AS fused FROM fu JOIN docmem USING (key)),
best AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY fused DESC, key) AS rank FROM aged)"""


def _differing(sql: str, *changes: tuple[str, str]) -> str:
    for old, new in changes:
        if sql.count(old) != 1:
            raise ValueError(f"not once in the SQL: {old}")
        sql = sql.replace(old, new)
    return sql


# The same arms for every text and every vector that is a query, over all vectors and orders; those of no document have no age.
POOL_CTE = _differing(
    IMPL_CTE,
    (" JOIN benchmark ON item_id = vec_id", ""),
    (", vq WHERE vec_id IN (SELECT doc_id FROM documents)", ", vq"),
    (f"any_value({_DECAY})", f"coalesce(any_value({_DECAY}), 1.0)"),
    ("FROM held JOIN docmem", "FROM held LEFT JOIN docmem"),
    ("(query, memory) NOT IN (SELECT query, key FROM sd)", "memory IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sd WHERE sd.query = held.query AND sd.key = held.memory)"),
    ("FROM fu JOIN docmem", "FROM fu LEFT JOIN docmem"),
)


def gathered(s: SparkSession, d: str, whole: bool = False) -> DataFrame:
    """Three arms over the documents as memories, for every benchmark query; the whole
    pool is that of every vector query too, over vectors and orders of no document also."""
    asked = bench_queries(s, d)
    known = si.entities(s, d).withColumn("centrality", F.lit(None).cast("double"))
    edges = si.relates(s, d).select("lo", "hi", F.col("belief").alias("weight"))
    near = vector_queries(s, d)
    if not whole:
        near = near.join(asked.select("query"), "query", "left_semi")
    return r.gather(si.doc_memories(s, d), asked, F.lit(si.NOW).cast("timestamp"), stored_vectors(s, d) if whole else vectors(s, d), near, (si.mentions(s, d), known, edges), strays=whole)


@query("ret_pool_diag", f"WITH {POOL_CTE} SELECT query, count(*) AS pool, round(max(fused), 6) AS best, round(min(fused), 6) AS worst FROM aged GROUP BY query")
def ret_pool_diag(s: SparkSession, d: str) -> DataFrame:
    """The pool that hits are picked from: all arms, fused and faded by age, before any pick."""
    pool = gathered(s, d, whole=True).groupBy("query")
    return pool.agg(F.count("*").alias("pool"), F.round(F.max("fused"), 6).alias("best"), F.round(F.min("fused"), 6).alias("worst"))


@query("ret_gather", f"WITH {IMPL_CTE} SELECT query, key, round(fused, 6) AS score, signals FROM best WHERE rank <= 100")
def ret_gather(s: SparkSession, d: str) -> DataFrame:
    return r.top(gathered(s, d), r.POOL, "fused").select("query", "key", F.round("fused", 6).alias("score"), "signals")


@query("ret_recency", f"WITH {IMPL_CTE} SELECT query, key, rank::INTEGER AS rank FROM best")
def ret_recency(s: SparkSession, d: str) -> DataFrame:
    return r.top(gathered(s, d), None, "fused").select("query", "key", "rank")


@query("ret_retrieve", f"WITH {IMPL_CTE} SELECT query, key, round(fused, 6) AS score, rank::INTEGER AS rank, signals FROM best WHERE rank <= 10")
def ret_retrieve(s: SparkSession, d: str) -> DataFrame:
    """The whole way with the default lambda of one and a budget that holds all."""
    return r.best_hits(gathered(s, d), si.doc_memories(s, d), 10, 1_000_000_000).drop("text")


@query("ret_impl", f"""WITH {IMPL_CTE}, re AS (SELECT b.query, b.key, b.signals, round({_COVER}, 6) AS score FROM best b JOIN documents d ON d.doc_id = b.key JOIN q ON q.query = b.query WHERE b.rank <= 50),
top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM re QUALIFY rank <= 10)
SELECT query, string_agg('- ' || text, chr(10) ORDER BY rank) AS context, count(*) AS hits FROM top JOIN documents ON doc_id = key GROUP BY query""")
def ret_impl(s: SparkSession, d: str) -> DataFrame:
    """Arms, fusion, recency, reranking by coverage, best ten, packing, one context a query."""
    asked = bench_queries(s, d)
    hits = r.best_hits(gathered(s, d), si.doc_memories(s, d), 10, 1_000_000_000, scorer=r.rerank_coverage(F.col("query_text"), F.col("text")), texts=asked)
    lines = F.sort_array(F.collect_list(F.struct("rank", r.line(F.lit(None).cast("string"), F.col("text")).alias("line"))))
    return hits.groupBy("query").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("context"), F.count("*").alias("hits"))


query("ing_embed_fake")(lambda s, d: embed(si.memories(s, d), "key", "text"))


@query("join_correlated_topk", "WITH n AS (SELECT a.vec_id AS q, b.vec_id AS key, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS n FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) SELECT DISTINCT key FROM n WHERE n <= 10")
def join_correlated_topk(s: SparkSession, d: str) -> DataFrame:
    return r.vector_top(vectors(s, d), vector_queries(s, d), 10).select("key").distinct()
