"""The store's base and delta, filters that skip folders, and edges that grow."""

import random

import pytest
from pyspark.sql import functions as F

from recollex.plans.config import RetrievalConfig
from recollex.store import DAY, MemoryStore

ROWS = "node_id long, embedding array<double>, modality int, ts double, seq long"


def batch(spark, rng, ids):
    return [(i, [rng.random(), rng.random()], rng.choice([0, 1, 2, None]), rng.choice([None, rng.random() * 5 * DAY]), 0) for i in ids]


def test_base_and_delta(spark, tmp_path):
    rng, store, want = random.Random(1), MemoryStore(spark, f"file://{tmp_path}/s", 2), {}
    assert store.state().count() == 0
    for step in range(5):
        rows = batch(spark, rng, rng.sample(range(60), 30))
        store.add(spark.createDataFrame(rows, ROWS))
        want |= {r[0]: (r[2], r[3], False) for r in rows}
        gone = rng.sample(range(60), 6)
        store.delete(spark.createDataFrame([(i,) for i in gone], "node_id long"))
        want |= {i: (*want[i][:2], True) for i in gone if i in want}
        if step in (1, 3):
            store.compact()
        whole = lambda df: {r["node_id"]: (r["modality"], r["ts"], r["deleted"]) for r in df.collect()}
        assert whole(store.state()) == want
        for m, a, b in ((1, None, None), (None, DAY, 2.5 * DAY), (2, None, DAY), (0, 3 * DAY, None)):
            ok = lambda r: (m is None or r[0] == m) and (a is None or (r[1] is not None and r[1] >= a)) and (b is None or (r[1] is not None and r[1] <= b))  # noqa: B023, E731
            assert whole(store.state(m, a, b)) == {i: r for i, r in want.items() if ok(r)}
    assert store._numbers("base") and all(n > store._numbers("base")[-1] for n in store._numbers("b"))
    assert whole(MemoryStore(spark, f"file://{tmp_path}/s", 2).state()) == want  # another session's view


def test_filters_skip_folders(spark, tmp_path):
    store = MemoryStore(spark, f"file://{tmp_path}/s", 2)
    store.add(spark.createDataFrame([(i, [1.0, float(i)], i % 3, float(i) * DAY / 10) for i in range(90)], "node_id long, embedding array<double>, modality int, ts double"))
    store.compact()
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    filters = lambda df: df._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    one = store.memories(2, 3 * DAY, 4 * DAY)
    assert "modality" in filters(one) and "day" in filters(one) and not filters(store.memories())
    files = lambda df: df.select(F.input_file_name().alias("f")).distinct().count()
    assert one.count() == len([i for i in range(30, 41) if i % 3 == 2]) and files(one) <= 2 < files(store.memories()) == 27
    q = spark.createDataFrame([(0, [1.0, 0.0], 0.0)], "query_id long, q array<double>, query_ts double")
    assert "modality" in filters(store.query(q, RetrievalConfig(3, 0, modality_filter=1)))
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_growing_store(spark, tmp_path):
    store = MemoryStore(spark, f"file://{tmp_path}/s", 2, growing=True)
    frame = lambda a, b: spark.createDataFrame([(i, [1.0, float(i)], i % 3, 0.0) for i in range(a, b)], "node_id long, embedding array<double>, modality int, ts double")
    store.add(frame(0, 200))
    first = {tuple(r) for r in store.edges().collect()}
    store.add(frame(200, 204))
    more = {tuple(r) for r in store.edges().collect()}
    assert first < more and all(max(e) >= 200 for e in more - first)
    store.delete(spark.createDataFrame([(5,)], "node_id long"))
    assert {tuple(r) for r in store.edges().collect()} == {e for e in more if 5 not in e}
    store.add(frame(5, 6))
    assert {tuple(r) for r in store.edges().collect()} == more
    q = spark.createDataFrame([(0, [1.0, 3.0], 0.0)], "query_id long, q array<double>, query_ts double")
    assert store.query(q, RetrievalConfig(4, 2)).count() == 4
    assert store.stats().first()["edges"] == len(more) // 2
