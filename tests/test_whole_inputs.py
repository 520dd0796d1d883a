"""Queries read their whole tables."""

import math

from anamnesis import catalog
from anamnesis.plans import models_and_facade


def test_engine_stores_every_tenant(spark, small):
    got = {r.tenant: r.memories for r in models_and_facade.engine(spark, small).stats().collect()}
    turns = spark.read.parquet(f"{small}/conversations.parquet").selectExpr("conv_id % 8 AS t", "conv_id", "turn", "role", "text").distinct()
    assert got == {f"tenant{r.t}": r["count"] for r in turns.groupBy("t").count().collect()}


def test_pool_has_all_arms_and_ages(spark, tmp_path):
    tables = {
        "documents": ([(0, "alpha", 0), (1, "beta", 0)], "doc_id long, text string, n_chars long"),
        "benchmark": ([(20, "alpha")], "item_id long, text string"),
        "embeddings": ([(0, [1.0, 0.0], 0), (5, [1.0, 1.0], 0), (20, [0.0, 1.0], 0)], "vec_id long, embedding array<float>, label int"),
        "lineitem": ([(0, 1), (0, 2), (7, 2)], "l_orderkey long, l_suppkey long"),
        "supplier": ([(1, "a", 0), (2, "b", 0)], "s_suppkey long, s_name string, s_nationkey int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r["query"]: (r.pool, r.best, r.worst) for r in catalog.queries()["ret_pool_diag"](spark, str(tmp_path)).collect()}
    # Document 0 is 60 days old; vectors 5 and 20 and order 7, which the graph finds, have no date.
    old, graph = math.exp(-0.02 * 60), 0.1 / 61
    text = {0: (1 / 61 + 1 / 63) * old, 5: 1 / 62, 20: 1 / 61, 7: graph}
    vector = {0: 1 / 61 * old, 5: 1 / 62, 20: 1 / 63, 7: graph}
    assert got == {q: (4, round(max(w.values()), 6), round(min(w.values()), 6)) for q, w in {20: text, 0: vector}.items()}
