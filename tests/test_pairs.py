"""Every query with every memory, in blocks; rounds of neighbour descent."""

import math

import numpy as np
from pyspark.sql import functions as F

from recollex.functions.vectors import dot, rounded
from recollex.operators import descent, exchange, topk
from recollex.plans import catalogue


def test_all_pairs_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in v], float(i % 5)) for i, v in enumerate(rng.normal(size=(300, 7)).astype(np.float32))]
    rows += [(300, None, 0.0), (301, [1.0], 1.0), (302, [1.0, None, 2.0], 1.0), (303, [], 1.0), (304, [float("nan")] * 7, 2.0), (305, [float("inf")] * 7, None), (306, [1.0] * 9, 1.0), (307, [2.0], 1.0)]
    mem = spark.createDataFrame(rows, "node_id long, embedding array<float>, ts double")
    q = mem.where("node_id % 3 = 0 or node_id > 299").select(F.col("node_id").alias("query_id"), F.col("embedding").alias("q"), F.lit(9.0).alias("query_ts"))
    cross = mem.crossJoin(q).select("query_id", "node_id", "ts", "query_ts", dot("embedding", "q").alias("sim"))
    show = lambda df: sorted((r["query_id"], r["node_id"], str(r["ts"]), r["query_ts"], str(r["sim"])) for r in df.collect())
    want = show(cross)
    assert show(topk.similarity(mem, q, "ts", "query_ts")) == want
    monkeypatch.setattr(topk, "MOST_SENT", 250)  # several blocks of queries
    monkeypatch.setattr(exchange, "PAIRS", (5, 11))
    got = topk.similarity(mem, q, "ts", "query_ts")
    assert show(got) == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
    assert topk.similarity(mem, q.limit(0)).count() == topk.similarity(mem.limit(0), q).count() == 0
    for name in ("similarity_all", "temporal_decay"):  # queries are not sent whole to all tasks
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "NestedLoopJoin" not in plan[: plan.index("MapInArrow")]


def test_rounding_equals_decimals(spark):
    rng = np.random.default_rng(5)
    k = rng.integers(-2_000_000, 2_000_000, 20_000)
    x = np.concatenate([rng.uniform(-1, 1, 20_000), (k + 0.5) / 1e6, np.nextafter((k + 0.5) / 1e6, 9), np.nextafter((k + 0.5) / 1e6, -9), k / 1e6, rng.normal(size=2000) * 1e4, 10.0 ** np.arange(-30, 300), -(10.0 ** np.arange(-30, 300)), [0.0, -0.0, -1e-9, np.inf, -np.inf, np.nan]])
    d = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").select(F.round("x", 6).alias("a"), rounded(F.col("x")).alias("b"))
    same = lambda a, b: a is b is None or (a is not None and b is not None and (a == b and math.copysign(1, a) == math.copysign(1, b) or a != a and b != b))
    assert all(same(r["a"], r["b"]) for r in d.collect())


def test_descent_moves_pairs_once_and_vectors_by_row(spark):
    """Groups go on over batches, and a node's pairs cross one exchange."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(60, 4)).astype(np.float32)
    rows = [(int(i // 20), int(i), bool(i % 3 == 0), float("-inf") if i % 2 else 0.5, [float(c) for c in x]) for i, x in enumerate(v)]
    members = spark.createDataFrame(rows, "w long, id long, fresh boolean, floor double, embedding array<float>")
    s = v.astype(np.float64) @ v.astype(np.float64).T
    want = {(i, j) for i in range(60) for j in range(60) if i != j and i // 20 == j // 20 and (i % 3 == 0 or j % 3 == 0) and (i % 2 or s[i, j] >= 0.5)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r["u"], r["v"]): r["sim"] for r in descent._compare(members, 20).collect()}
        few = {(r["u"], r["v"]) for r in descent._compare(members, 3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == want and all(abs(got[i, j] - s[i, j]) < 1e-12 for i, j in got)
    assert few == {(i, j) for i, j in want if sum(s[i, j] < s[a, b] for a, b in want if a == i) < 3}
    pairs = spark.createDataFrame([(1, 2, 0.5, True), (1, 2, 0.5, False), (1, 3, 0.7, True), (1, 4, 0.1, True)], descent.PAIRS + ", fresh boolean")
    best = descent._best(pairs, 2)
    assert {tuple(r) for r in best.collect()} == {(1, 3, 0.7, True), (1, 2, 0.5, False)}
    assert best._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_pairs_exchange_does_not_grow_with_partitions(spark):
    """A query crosses the exchange once for each of a bounded number of columns, not once a shuffle partition."""
    mem = spark.createDataFrame([(i, [float(i), 1.0], float(i)) for i in range(300)], "node_id long, embedding array<float>, ts double")
    q = mem.where("node_id < 5").selectExpr("node_id AS query_id", "embedding AS q", "0D AS query_ts")
    show = lambda df: sorted(tuple(r) for r in df.collect())
    want, parts = show(topk.similarity(mem, q, "ts")), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "600")
    try:
        got = topk.similarity(mem, q, "ts")
        assert got.rdd.getNumPartitions() <= max(exchange.MOST_COLUMNS, 2 * spark.sparkContext.defaultParallelism)
        assert show(got) == want and len(want) == 1500
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_similarity_of_all_reads_no_events(spark):
    plan = catalogue.QUERIES["similarity_all"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "event_id" not in plan and "vec_id" not in plan  # memories were joined before, and written


def test_decay_of_all_reads_no_events(spark):
    plan = catalogue.QUERIES["temporal_decay"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "event_id" not in plan and "vec_id" not in plan
