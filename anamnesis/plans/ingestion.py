"""Queries of the ingestion operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anamnesis.functions import text as tx
from anamnesis.operators import ingest as g
from anamnesis.operators.retrieve import vector_blocks
from anamnesis.plans import stand_ins as si
from anamnesis.plans.retrieval import _TOK, vectors
from anamnesis.registry import query, table

ASCII_SQL = "regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')"


def ascii_text(c: str = "text"):  # noqa: ANN201
    """Word boundaries of the oracle are ASCII ones, so both sides drop other characters."""
    return F.regexp_replace(c, r"[^\x00-\x7F]", "")


_KEY = "sha256(tenant || chr(31) || agent || chr(31) || session::VARCHAR || chr(31) || turn::VARCHAR || chr(31) || text)"
query("ing_idem_key", f"WITH {si.MEMORIES} SELECT key, {_KEY} AS digest FROM memories")(
    lambda s, d: si.memories(s, d).select("key", tx.idempotency_key(*[F.col(c) for c in ("tenant", "agent", "session", "turn", "text")]).alias("digest"))
)
_RED = ASCII_SQL
for _p, _to in tx.REDACTIONS:
    _RED = f"regexp_replace({_RED}, '{_p.replace('(?U)', '').replace('(?iU)', '(?i)')}', '{_to}', 'g')"
query("ing_redact", f"SELECT doc_id, md5({_RED}) AS digest, (length({_RED}) - length({ASCII_SQL}))::BIGINT AS grown FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.md5(tx.redacted(ascii_text())).alias("digest"), (F.length(tx.redacted(ascii_text())) - F.length(ascii_text())).cast("long").alias("grown"))
)
query("ing_redact_full", f"SELECT doc_id, md5(trim({_RED})) AS digest FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.md5(F.trim(tx.redacted(ascii_text()))).alias("digest"))
)
query("ing_tokenize", f"SELECT doc_id, len({_TOK.format('text')})::BIGINT AS n, md5(array_to_string({_TOK.format('text')}, ' ')) AS digest FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.size(tx.tokens(F.col("text"))).cast("long").alias("n"), F.md5(tx.normalized(F.col("text"))).alias("digest"))
)
query("ing_truncate", "SELECT doc_id, length(substr(text, 1, 8192))::BIGINT AS kept, md5(substr(text, 1, 8192)) AS digest FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.length(F.substring("text", 1, 8192)).cast("long").alias("kept"), F.md5(F.substring("text", 1, 8192)).alias("digest"))
)
_CAPS = "list_distinct(list_filter(regexp_extract_all(" + ASCII_SQL + r", '\b[A-Z][a-zA-Z0-9]*(?:\s+[A-Z][a-zA-Z0-9]*)*\b'), lambda x: length(x) > 1))"
query("ing_extract_fake", f"SELECT doc_id, array_to_string(list_sort({_CAPS}), '|') AS names, len({_CAPS})::BIGINT AS n FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(F.array_sort(tx.caps_spans(ascii_text())), "|").alias("names"), F.size(tx.caps_spans(ascii_text())).cast("long").alias("n"))
)
query("ing_extract_layered", f"SELECT doc_id, CASE WHEN len({_CAPS}) < 3 THEN 'escalate' ELSE 'cheap' END AS tier FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.when(F.size(tx.caps_spans(ascii_text())) < 3, "escalate").otherwise("cheap").alias("tier"))
)
_WHEN = "CASE turn % 5 WHEN 0 THEN 'on 2023-04-' || lpad((1 + conv_id % 28)::VARCHAR, 2, '0') || ' x' WHEN 1 THEN 'March ' || (1 + conv_id % 28)::VARCHAR || ', 2021' WHEN 2 THEN 'in Sept 2019' WHEN 3 THEN 'year 1987' ELSE 'no date' END"
_TIME = "CASE turn % 5 WHEN 0 THEN make_date(2023, 4, (1 + conv_id % 28)::INT) WHEN 1 THEN make_date(2021, 3, (1 + conv_id % 28)::INT) WHEN 2 THEN DATE '2019-09-01' WHEN 3 THEN DATE '1987-01-01' END"


@query("ing_valid_time", f"SELECT conv_id, turn, ({_TIME})::TIMESTAMP AS valid_time FROM conversations")
def ing_valid_time(s: SparkSession, d: str) -> DataFrame:
    """Dates are written into a text of each turn in every form, then read back."""
    c = table(s, d, "conversations").select("conv_id", "turn", F.expr(_WHEN.replace("::VARCHAR", "").replace("VARCHAR", "STRING")).alias("t"))
    return c.select("conv_id", "turn", tx.valid_time(F.col("t")).cast("timestamp_ntz").alias("valid_time"))


_LINES = "'- ' || role || chr(10) || '2. ' || upper(role) || chr(10) || chr(10) || '* x' || turn::VARCHAR || chr(10) || 'y' || chr(10) || 'z' || chr(10) || 'w'"
query("ing_prospective", "SELECT conv_id, turn, role || '|' || 'x' || turn::VARCHAR || '|y' AS lines FROM conversations")(
    lambda s, d: table(s, d, "conversations").select("conv_id", "turn", F.array_join(tx.list_lines(F.expr(_LINES.replace("::VARCHAR", "")), 3), "|").alias("lines"))
)
query("ret_decompose", "SELECT conv_id, turn, role || '|' || 'x' || turn::VARCHAR || '|y|z' AS lines FROM conversations")(
    lambda s, d: table(s, d, "conversations").select("conv_id", "turn", F.array_join(tx.list_lines(F.expr(_LINES.replace("::VARCHAR", "")), 4), "|").alias("lines"))
)
query("limit_examples", "SELECT conv_id, turn, role AS first FROM conversations")(
    lambda s, d: table(s, d, "conversations").select("conv_id", "turn", F.array_join(tx.list_lines(F.expr(_LINES.replace("::VARCHAR", "")), 1), "|").alias("first"))
)
query("ing_coerce_rel", "SELECT label, CASE WHEN label IN ('Caused By', 'caused-by') THEN 'caused_by' WHEN label = 'subtopic of' THEN 'subtopic_of' ELSE 'associated_with' END AS relation FROM (VALUES ('Caused By'), ('caused-by'), ('subtopic of'), ('knows')) t(label)")(
    lambda s, d: s.createDataFrame([("Caused By",), ("caused-by",), ("subtopic of",), ("knows",)], "label string").withColumn("relation", tx.relation(F.col("label")))
)
query("ing_parse_json", "SELECT event_id, props->>'$.v' AS v FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", F.get_json_object(F.regexp_extract(F.concat(F.lit("```json "), "props", F.lit(" ```")), r"(?s)\{.*\}", 0), "$.v").alias("v"))
)
query("ing_working_ttl", f"WITH {si.MEMORIES} SELECT key, created_at + INTERVAL 3600 SECOND AS expires_at FROM memories WHERE type = 'working'")(
    lambda s, d: si.memories(s, d).filter("type = 'working'").select("key", (F.col("created_at") + F.expr("INTERVAL '3600' SECOND")).alias("expires_at"))
)
_CUT = "TIMESTAMP '2024-01-03 00:00:00'"
for _n in ("ing_ttl_expire", "str_working_ttl"):
    query(_n, f"WITH {si.MEMORIES} SELECT key FROM memories WHERE type <> 'working' OR created_at + INTERVAL 3600 SECOND > {_CUT}")(
        lambda s, d: si.memories(s, d).withColumn("expires_at", F.when(F.col("type") == "working", F.col("created_at") + F.expr("INTERVAL '3600' SECOND"))).filter(F.col("expires_at").isNull() | (F.col("expires_at") > F.expr("TIMESTAMP_NTZ '2024-01-03 00:00:00'"))).select("key")
    )
_CAP = f"WITH {si.MEMORIES} SELECT key, CASE WHEN type = 'working' AND row_number() OVER (PARTITION BY tenant, agent, type ORDER BY created_at DESC, key DESC) > 7 THEN 'episodic' ELSE type END AS type FROM memories"


def capacity(s: SparkSession, d: str) -> DataFrame:
    """An agent's working memories over all its sessions, as one conversation is short."""
    return g.over_capacity(si.memories(s, d).withColumn("session", F.lit(0))).select("key", "type")


for _n in ("win_capacity", "ing_capacity"):
    query(_n, _CAP)(capacity)
query("limit_offset", f"WITH {si.MEMORIES} SELECT key FROM (SELECT key, row_number() OVER (PARTITION BY tenant, agent ORDER BY created_at DESC, key DESC) AS n FROM memories WHERE type = 'working') WHERE n > 7")(
    lambda s, d: si.memories(s, d).filter("type = 'working'").withColumn("n", F.row_number().over(Window.partitionBy("tenant", "agent").orderBy(F.desc("created_at"), F.desc("key")))).filter("n > 7").select("key")
)
query("ing_flush_working", f"WITH {si.MEMORIES} SELECT key, CASE WHEN session % 2 = 0 THEN 'episodic' ELSE type END AS type FROM memories")(
    lambda s, d: si.memories(s, d).select("key", F.when(F.col("session") % 2 == 0, "episodic").otherwise(F.col("type")).alias("type"))
)


def all_turns(s: SparkSession, d: str) -> DataFrame:
    """Turns, a third of them delivered twice."""
    m = si.memories(s, d)
    return m.unionByName(m.filter("turn % 3 = 0"))


_ONCE = f"WITH {si.MEMORIES} SELECT DISTINCT {_KEY} AS key FROM memories"
_NEW = f"WITH {si.MEMORIES} SELECT DISTINCT {_KEY} AS key FROM memories WHERE session % 2 = 1 OR turn % 2 = 1"


def keyed(s: SparkSession, d: str) -> DataFrame:
    return all_turns(s, d).select(tx.idempotency_key(*[F.col(c) for c in ("tenant", "agent", "session", "turn", "text")]).alias("key"), "session", "turn")


def old_keys(s: SparkSession, d: str) -> DataFrame:
    return keyed(s, d).filter("session % 2 = 0 AND turn % 2 = 0").dropDuplicates(["key"])


for _n in ("sink_insert_ignore", "sink_bulk_insert"):
    query(_n, _ONCE)(lambda s, d: g.insert_ignore(old_keys(s, d), keyed(s, d)).select("key"))
query("sink_replace", _ONCE)(lambda s, d: g.replace(old_keys(s, d), keyed(s, d)).select("key"))
query("join_anti_idempotent", _NEW)(lambda s, d: keyed(s, d).join(old_keys(s, d).select("key"), "key", "left_anti").select("key").distinct())
_STORE = f"SELECT tenant, agent, count(*) AS episodes, count(DISTINCT session) AS sessions FROM (WITH {si.MEMORIES} SELECT DISTINCT tenant, agent, session, turn, text FROM memories) GROUP BY ALL"
for _n in ("ing_store", "ing_store_many"):
    query(_n, _STORE)(lambda s, d: g.episodes(all_turns(s, d).drop("key")).groupBy("tenant", "agent").agg(F.count("*").alias("episodes"), F.countDistinct("session").alias("sessions")))
_NAMES = f"names AS (SELECT doc_id AS key, 'tenant' || (doc_id % 4)::VARCHAR AS tenant, unnest({_CAPS}) AS name FROM documents)"


def names(s: SparkSession, d: str) -> DataFrame:
    return g.mentions_of(table(s, d, "documents").select(F.concat(F.lit("tenant"), (F.col("doc_id") % 4).cast("string")).alias("tenant"), F.col("doc_id").alias("key"), ascii_text().alias("text")))


_ACC = f"WITH {_NAMES} SELECT tenant, name, count(*) AS mention_count, round(sum(0.1), 6)::DOUBLE AS reliability_sum, round(1 - pow(0.5, 0.1 * count(*)), 6) AS belief FROM names GROUP BY ALL"


def accumulated(s: SparkSession, d: str) -> DataFrame:
    a = g.accumulate_entities(names(s, d), F.lit(0.1))
    return a.withColumns({c: F.round(c, 6) for c in ("reliability_sum", "belief")})


for _n in ("agg_entity_accum", "ing_graph_pass"):
    query(_n, _ACC)(accumulated)


@query("ing_upsert_entity", _ACC)
def ing_upsert_entity(s: SparkSession, d: str) -> DataFrame:
    """Two batches, the second added to the first, equal one pass over both."""
    n = names(s, d)
    first, second = (g.accumulate_entities(n.filter(F.col("key") % 2 == i), F.lit(0.1)) for i in (0, 1))
    return g.upsert_entities(first, second).withColumns({c: F.round(c, 6) for c in ("reliability_sum", "belief")})


query("ing_increment", f"WITH {_NAMES} SELECT name, count(*) AS mention_count FROM names GROUP BY name")(lambda s, d: names(s, d).groupBy("name").agg(F.count("*").alias("mention_count")))
query("agg_increment_merge", f"WITH {_NAMES} SELECT tenant, sum(1)::BIGINT AS added, count(DISTINCT name) AS targets FROM names GROUP BY tenant")(
    lambda s, d: names(s, d).groupBy("tenant", "name").agg(F.count("*").alias("n")).groupBy("tenant").agg(F.sum("n").alias("added"), F.count("*").alias("targets"))
)
query("agg_belief", "SELECT conv_id, round(1 - pow(0.5, 0.5 * count(*)), 6) AS belief FROM conversations GROUP BY conv_id")(
    lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.round(g.belief(F.sum(F.lit(0.5))), 6).alias("belief"))
)
_PAIR = f"WITH {si.RELATES} SELECT lo, hi, corroboration, round(reliability_sum, 6)::DOUBLE AS reliability_sum, round(belief, 6) AS belief FROM relates"


def pairs(s: SparkSession, d: str) -> DataFrame:
    return si.relates(s, d).withColumns({c: F.round(c, 6) for c in ("reliability_sum", "belief")})


for _n in ("agg_pair_accum", "ing_relate"):
    query(_n, _PAIR)(pairs)
_PAIRS = "WITH {} SELECT memory, count(*)::BIGINT AS pairs FROM (SELECT a.memory FROM mentions a JOIN mentions b ON a.memory = b.memory AND a.entity < b.entity) GROUP BY memory".format(si.RELATES)
for _n in ("join_pair_self", "ing_pairs"):
    query(_n, _PAIRS)(
        lambda s, d: si.mentions(s, d).groupBy("memory").agg(F.array_sort(F.collect_list("entity")).alias("e")).select("memory", F.size(g.pairs_in_order(F.col("e"), 1000)).cast("long").alias("pairs")).filter("pairs > 0")
    )
query("ing_pair_resolution", f"WITH {si.RELATES} SELECT lo, hi, CASE WHEN corroboration > 1 THEN 'caused_by' ELSE 'associated_with' END AS relationship FROM relates")(
    lambda s, d: si.relates(s, d).select("lo", "hi", F.coalesce(F.when(F.col("corroboration") > 1, tx.relation(F.lit("Caused by"))), F.lit("associated_with")).alias("relationship"))
)
query("ing_edges", "SELECT DISTINCT l_orderkey::VARCHAR || '__' || l_suppkey::VARCHAR AS key FROM lineitem")(
    lambda s, d: si.mentions(s, d).select(F.concat_ws("__", F.col("memory").cast("string"), F.col("entity").cast("string")).alias("key"))
)
_MATCH = """WITH r AS (SELECT vec_id AS key, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0),
n AS (SELECT r.key, p.vec_id AS match, round(list_cosine_similarity(r.e, p.embedding::DOUBLE[]), 6) AS similarity FROM r JOIN embeddings p ON p.vec_id <> r.key),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY similarity DESC, match) AS i FROM n) WHERE i = 1)
SELECT key, match, similarity, CASE WHEN similarity >= 0.9 THEN 'merge' WHEN similarity >= 0.6 THEN 'flag' ELSE 'create' END AS verdict FROM b"""
for _n in ("ing_resolve", "ing_best_match", "join_theta_cosine"):
    query(_n, _MATCH)(lambda s, d: g.resolve(vectors(s, d).filter("key % 20 = 0"), vectors(s, d)))
query("ing_resolution_pool", "SELECT label, count(*) AS pool FROM embeddings WHERE vec_id % 20 <> 0 GROUP BY label")(lambda s, d: vectors(s, d).filter("key % 20 <> 0").groupBy("label").agg(F.count("*").alias("pool")))
_STEP = f"WITH {si.STEPS} SELECT key, agent, tool_name, outcome, use_count, last_used_at, arguments FROM steps"
query("ing_step", _STEP)(si.steps)
query("ing_get_steps", f"WITH {si.STEPS} SELECT key, use_count FROM steps WHERE outcome = 'success' AND agent = '7' ORDER BY use_count DESC, key LIMIT 10")(
    lambda s, d: si.steps(s, d).filter("outcome = 'success' AND agent = '7'").orderBy(F.desc("use_count"), "key").limit(10).select("key", "use_count")
)
query("topk_steps", f"WITH {si.STEPS} SELECT key, use_count FROM steps ORDER BY use_count DESC, key LIMIT 10")(lambda s, d: si.steps(s, d).orderBy(F.desc("use_count"), "key").limit(10).select("key", "use_count"))
query("ing_seed", f"WITH {si.ENTITIES}, p AS (SELECT DISTINCT n_name AS name, 'tenant0' AS tenant FROM nation UNION SELECT DISTINCT name, tenant FROM entities WHERE key <= 5) SELECT tenant, name FROM p")(
    lambda s, d: g.insert_ignore(
        si.entities(s, d).filter("key <= 5").select("tenant", "name", F.concat_ws("|", "tenant", "name").alias("key")),
        table(s, d, "nation").select(F.lit("tenant0").alias("tenant"), F.trim("n_name").alias("name")).withColumn("key", F.concat_ws("|", "tenant", "name")),
    ).select("tenant", "name")
)



@query("win_edge_ewa")
def win_edge_ewa(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select((F.col("user_id") % 50).alias("lo"), F.lit(100).alias("hi"), "ts")
    return g.edge_weights(e, F.lit(si.NOW).cast("timestamp")).withColumn("weight", F.round("weight", 6))


def topic_rows(s: SparkSession, d: str) -> DataFrame:
    return vectors(s, d).select(F.col("label").alias("session"), F.col("key").alias("turn"), "embedding")


for _n in ("win_topic_ewa", "ing_topic_shift"):
    query(_n)(lambda s, d: g.topic_shifts(topic_rows(s, d)))


@query("win_turn_index", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id % 8 ORDER BY conv_id, turn) - 1 AS turn_index FROM conversations")
def win_turn_index(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy(F.col("conv_id") % 8).orderBy("conv_id", "turn")
    return table(s, d, "conversations").select("conv_id", "turn", (F.row_number().over(w) - 1).cast("long").alias("turn_index"))


_PREV = "SELECT event_id, user_id, event_type AS step, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events"
query("win_prev_step", f"SELECT event_id, prev, step FROM ({_PREV}) WHERE prev IS NOT NULL AND prev <> step")(
    lambda s, d: table(s, d, "events").select("event_id", F.col("event_type").alias("step"), F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("prev")).filter("prev <> step")
)


@query("vector_block_kernel", """SELECT key, match AS best, similarity AS score FROM (SELECT a.vec_id AS key, b.vec_id AS match, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity,
row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS n FROM embeddings a JOIN embeddings b ON b.vec_id % 20 = 0) WHERE n = 1""")
def vector_block_kernel(s: SparkSession, d: str) -> DataFrame:
    return vector_blocks(vectors(s, d), vectors(s, d).filter(F.col("key") % si.EVERY == 0))
