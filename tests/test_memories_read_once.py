"""What retrievals over a graph read and search only once."""

import pytest

from recollex.operators import exchange, topk
from recollex.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["demo_voice", "ablation_no_rewire", "ablation_ring_only"])
def test_hops_read_no_events(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "event_id" not in plan and "vec_id" not in plan  # memories were joined before, and written


def test_validation_searches_once(spark, monkeypatch):
    found, calls = topk.topk, []
    monkeypatch.setattr(topk, "topk", lambda *a, **k: calls.append(1) or found(*a, **k))
    assert catalogue.QUERIES["validation_report"](spark, SF).count() == 1
    assert len(calls) == 1


def test_columns_do_not_grow_with_partitions(spark):
    """A query and its best cross the exchange once a column, as floats where they are floats: with many partitions, what is sent stays bounded."""
    mem = spark.createDataFrame([(i, [float(i), 1.0], i % 3, 0.0) for i in range(40)], "node_id long, embedding array<float>, modality int, ts double")
    q = mem.where("node_id < 4").selectExpr("node_id AS query_id", "embedding AS q", "0D AS query_ts")
    found = lambda: {(r["query_id"], r["rank"], r["node_id"], r["score"]) for r in topk.topk(mem, q, 3).collect()}
    want, parts = found(), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        most = max(64, 2 * spark.sparkContext.defaultParallelism)
        met = exchange.grid(topk.whole_queries(q, 2, "float"), topk.whole_memories(mem, 2), 3, 1)
        assert met.rdd.getNumPartitions() <= most
        assert "cast(q" not in topk.topk(mem, q, 3)._jdf.queryExecution().optimizedPlan().toString()
        assert found() == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
