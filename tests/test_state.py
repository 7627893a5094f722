"""State by transformWithState and the join of two streams, by value, with a restart from the checkpoint in between."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from recollex.operators.maintain import importance_update
from recollex.streaming import state

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
at = lambda s: START + dt.timedelta(seconds=s)


@pytest.fixture(autouse=True)
def rocksdb(spark):
    for k, v in state.ROCKSDB.items():
        spark.conf.set(k, v)
    yield
    for k in state.ROCKSDB:
        spark.conf.unset(k)


def run(spark, tmp_path, inputs, make, mode):
    """inputs: name -> (schema, batches). Rows of a query over all inputs; it ends after each batch and goes on from its checkpoint."""
    out, frames = [], []
    for name, (schema, _) in inputs.items():
        spark.createDataFrame([], schema).write.mode("append").parquet(str(tmp_path / name))
        frames.append(spark.readStream.schema(schema).parquet(str(tmp_path / name)))
    for step in range(max(len(b) for _, b in inputs.values())):
        for name, (schema, batches) in inputs.items():
            if step < len(batches) and batches[step]:
                spark.createDataFrame(batches[step], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        query = make(*frames).writeStream.outputMode(mode).foreachBatch(lambda df, i: out.append([tuple(r) for r in df.collect()])).option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start()
        if not query.awaitTermination(60):
            query.stop()
            raise TimeoutError(f"batch {step}")
    return [r for rows in out for r in rows]


def test_importance_equals_the_batch_form(spark, tmp_path):
    hits = {0: [1, 2], 1: [1], 2: [3], 5: [1, 3], 6: [2]}
    weights = spark.createDataFrame([(1, 1.0), (2, 4.95), (3, 0.5), (4, 2.0)], "node_id long, importance double")
    want, now = {}, weights
    for step in range(7):
        now = spark.createDataFrame(importance_update(now, spark.createDataFrame([(n,) for n in hits.get(step, [])], "node_id long")).collect(), "node_id long, importance double")
        want |= {(r["node_id"], step): r["importance"] for r in now.collect() if r["node_id"] in hits.get(step, [])}
    batches = [[(1, 0), (2, 0), (1, 0)], [(1, 1)], [(3, 2), (1, 1)], [(1, 5), (3, 5)], [(2, 6)]]
    got = run(spark, tmp_path, {"hits": ("node_id long, step long", batches)}, lambda h: state.importance(h, weights), "update")
    assert {(n, s): w for n, s, w in got} == pytest.approx(want)


def test_importance_with_time_to_live(spark, tmp_path):
    """Micro-batches by processing time never run dry, so the query is stopped when its rows are there."""
    schema, out = "node_id long, step long", []
    spark.createDataFrame([(9, 0), (9, 1)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    hits = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = state.importance(hits, None, 3_600_000).writeStream.outputMode("update").foreachBatch(lambda df, i: out.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "offsets")).trigger(processingTime="1 second").start()
    began = time.monotonic()
    while not out and time.monotonic() - began < 60 and query.isActive:
        time.sleep(0.2)
    query.stop()
    assert out == [(9, 1, pytest.approx((1.0 * 0.999 + 0.1) * 0.999 + 0.1))]


def test_expiry_with_timers(spark, tmp_path):
    batches = [[(1, at(0)), (2, at(0))], [(2, at(20))], [(3, at(60))], [(3, at(61))]]
    got = run(spark, tmp_path, {"rows": ("node_id long, at timestamp", batches)}, lambda rows: state.expiring(rows, 15_000), "append")
    zero = int(START.timestamp() * 1000)
    assert sorted(got) == [(1, zero + 15_000), (2, zero + 35_000)]


@pytest.mark.parametrize("how", ["inner", "leftOuter"])
def test_stream_join(spark, tmp_path, how):
    results = [[(1, 7, at(0)), (2, 8, at(3)), (3, 7, at(30))], [(4, 9, at(32))], [(5, 7, at(2))], [(6, 1, at(120))], [(7, 1, at(121))]]
    seen = [[(7, at(2)), (7, at(9))], [(7, at(33)), (9, at(31))], [(8, at(4))], [(5, at(120))], [(5, at(121))]]
    inputs = {"results": ("query_id long, node_id long, at timestamp", results), "seen": ("object_id long, seen timestamp", seen)}
    got = run(spark, tmp_path, inputs, lambda r, s: state.matched(r, s, how=how).select("query_id", "node_id", F.unix_timestamp("seen").alias("s")), "append")
    zero = int(START.timestamp())
    inner = [(1, 7, 2), (3, 7, 33), (4, 9, 31)]
    # When the third files come, the watermark is at 20: the result at 2 and the detection at 4 seconds are late and dropped.
    alone = [(2, 8, None)] if how == "leftOuter" else []
    assert sorted((q, n, None if s is None else s - zero) for q, n, s in got) == sorted(inner + alone)
