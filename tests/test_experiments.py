"""Generators by value, and the experiments on small scenes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollex.functions.vectors import half
from recollex.operators import cells, metrics, topk
from recollex.plans import experiments as ex
from recollex.sources import memories as src

DIM = 16


def vectors(df, key, column):
    rows = df.orderBy(key).collect()
    return np.array([r[column] for r in rows], float), rows


def test_generators(spark):
    v, rows = vectors(src.benchmark_corpus(spark, 43, DIM), "node_id", "embedding")
    assert [sum(r["modality"] == m for r in rows) for m in range(3)] == [23, 10, 10] and np.allclose(np.linalg.norm(v, axis=1), 1, atol=1e-4)
    v, rows = vectors(src.frame_queries(spark, 5, DIM), "query_id", "q")
    want = np.random.default_rng(0x5EED0000 + 3).standard_normal(DIM)
    assert np.allclose(v[3], want / np.linalg.norm(want), atol=1e-6) and rows[3]["query_ts"] == 3.0
    v, _ = vectors(src.background(spark, 4, DIM, 3), "node_id", "embedding")
    assert np.allclose(np.linalg.norm(v, axis=1), 1, atol=1e-4) and abs(v[0] @ v[1]) < 0.95
    v, rows = vectors(src.identity_stream(spark, 30, 5, DIM, 0.1, 0.5), "node_id", "embedding")
    s = v @ v.T
    same = np.equal.outer([r["object_id"] for r in rows], [r["object_id"] for r in rows])
    assert s[same].min() > 0.9 > s[~same].max() and rows[7]["ts"] == 3.5
    _, rows = vectors(src.detections(spark, 6, 4, 10, DIM), "node_id", "embedding")
    for f in range(6):
        assert len({r["object_id"] for r in rows[4 * f:4 * f + 4]}) == 4 and rows[4 * f]["ts"] == f / 60
    assert all(r["modality"] == (0 if r["object_id"] < 6 else 1 if r["object_id"] < 8 else 2) for r in rows)
    seen = spark.createDataFrame([(i, i % 2) for i in range(6)], "query_id long, object_id long")
    v, _ = vectors(src.views(seen, DIM, 0.0), "query_id", "q")
    base, _ = vectors(src.identity_stream(spark, 2, 2, DIM, 0.0, 1.0), "node_id", "embedding")
    assert np.allclose(v, base[[0, 1] * 3], atol=1e-6)


def test_half_and_amortized(spark):
    x = [0.1, -1 / 3, 1e-7, 6e-8, 1e-9, 65504.0, 70000.0, 0.0, 2049.0]
    got = spark.createDataFrame([(x,)], "e array<float>").select(half("e").alias("h")).first()["h"]
    with np.errstate(over="ignore"):
        assert np.array_equal(np.array(got), np.array(x, np.float32).astype(np.float16).astype(float))
    ms = spark.createDataFrame([(3.0,), (9.0,)], "ms double")
    assert metrics.amortized(ms, 60).first()[0] == pytest.approx(0.2)


def test_scene_queries(spark):
    s = ex.replace(ex.SCENES["av"], frames=60)
    rows = ex.scene_queries(spark, "av", s, 4).collect()
    assert len({r["query_id"] for r in rows}) == len(rows)
    assert sorted((r["frame"], r["object_id"]) for r in rows if r["occluded"]) == [(23, 0), (53, 1)]
    assert not [r for r in rows if not r["occluded"] and r["frame"] % 30 < 24 and r["object_id"] == r["frame"] // 30]
    per = [sum(r["frame"] == f for r in rows) for f in (24, 25, 55)]
    assert all(5 <= n <= 15 for n in per)
    held = {(r["frame"] // 31, r["object_id"]) for r in ex.scene_queries(spark, "ar", ex.replace(ex.SCENES["ar"], frames=93), 4).collect()}
    assert len(held) == 3


@pytest.mark.parametrize("name", sorted(ex.SCENES))
def test_demo(spark, name):
    row = ex.demo(spark, name, DIM, objects=6, rows=90, frames=12).first()
    assert row["queries"] >= 12 and row["metric"] == ex.SCENES[name].metric and row["within"] == (row["batch_ms_per_query"] <= row["deadline_ms"])
    assert row["hit_rate"] > 0.9 and (name != "av" or row["object_rate"] > 0.9)


def test_sweep_and_sample(spark):
    rows = {r["n"]: r for r in ex.validation_sweep(spark, (40, 60), DIM, 5).collect()}
    assert set(rows) == {40, 60} and all(r["recall"] == 1.0 and r["avg_results"] == 10 and r["qps"] > 0 for r in rows.values())
    assert (rows[60]["n_text"], rows[60]["n_audio"], rows[60]["n_image"]) == (30, 15, 15)
    assert ex.sample_run(spark, 40, DIM, 7).count() == 70


def test_cells(spark, monkeypatch):
    assert cells.sizes(10_000) == (100, 25) and cells.sizes(1) == (1, 1) and cells.sizes(10 ** 9) == (1024, 64)
    rows = {r["method"]: r for r in ex.cells_comparison(spark, (400,), DIM, 20).collect()}
    assert rows["flat"]["recall"] == 1.0 and 0.3 < rows["cells"]["recall"] <= rows["cells_90"]["recall"] and rows["cells_90"]["recall"] > 0.8
    mem = src.background(spark, 200, DIM).withColumn("modality", F.lit(0)).withColumn("ts", F.lit(0.0)).cache()
    q = src.frame_queries(spark, 6, DIM, 5)
    centers = cells.centroids(mem, 8)
    whole = lambda df: sorted((r["query_id"], r["rank"], r["node_id"]) for r in df.collect())
    dealt = cells.assign(mem, centers).cache()
    assert whole(cells.search(dealt, q, centers, 8, 5)) == whole(topk.topk(mem, q, 5))  # all cells: exact
    exact = topk.topk(mem, q, 5).cache()
    enough = cells.probes_for(dealt, q, exact, centers, 5)
    assert cells.probes_for(dealt, q, exact, centers, 5, 1.01) == 8 and metrics.recall_at_k(cells.search(dealt, q, centers, enough, 5), exact, 5).agg(F.avg("recall")).first()[0] >= 0.9
    few = whole(cells.search(dealt, q, centers, 2, 5))
    v, at = vectors(dealt, "node_id", "embedding")
    cell = np.array([r["cell"] for r in at])
    asked, _ = vectors(q, "query_id", "q")
    for i, x in enumerate(asked):
        ok = np.flatnonzero(np.isin(cell, np.argsort(-(centers @ x), kind="stable")[:2]))
        assert [n for a, _, n in few if a == i] == ok[np.argsort(-(v[ok] @ x), kind="stable")][:5].tolist()
    monkeypatch.setattr(cells, "MOST_SENT", 0)
    assert whole(cells.search(dealt, q, centers, 2, 5)) == few


def test_temporal_relevance_and_freshness(spark):
    rows = {r["system"]: r for r in ex.temporal_relevance(spark, 360, 2, 8, DIM, 10, rate=0.5, stale=3.0).collect()}
    assert set(rows) == {"plain", "rerank", "decayed"}
    assert rows["decayed"]["temporal_precision"] > rows["plain"]["temporal_precision"] and rows["decayed"]["stale_rate"] < rows["plain"]["stale_rate"]
    assert all(r["object_recall"] > 0.9 and r["object_precision"] <= r["temporal_precision"] for r in rows.values())
    got = {r["frame"]: r for r in ex.freshness(spark, 40, 4, 4, DIM, rebuild_every=20).collect()}
    assert len(got) == 40 and all(r["visible"] == f // 20 * 20 for f, r in got.items())
    # 0.2 s are 12 frames at 60 Hz: nothing that the index holds is younger from the 12th frame after a rebuild on.
    assert all(r["fresh"] == 0 for f, r in got.items() if f % 20 >= 12) and any(r["fresh"] for f, r in got.items() if f % 20 < 12)


def test_deadline_run(spark):
    row = ex.deadline_run(spark, 40, DIM, 20, 15, 1e7, ex.RetrievalConfig(max_hops=0)).first()
    assert (row["n"], row["misses"], row["within"], row["rate_hz"]) == (15, 0, True, 20) and 0 < row["p50"] <= row["p99"] <= row["max"]
