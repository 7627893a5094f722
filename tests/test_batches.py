"""Batches of queries in executors: ties, slots, blocks, and exact pruning by cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollex.operators import exchange, prune, topk


def frame(spark, v, **cols):
    return spark.createDataFrame([(i, [float(c) for c in x], float(i), i % 3) for i, x in enumerate(v)], "node_id long, embedding array<double>, ts double, modality int")


def asked(mem, n):
    return mem.where(F.col("node_id") < n).select(F.col("node_id").alias("query_id"), F.col("embedding").alias("q"), F.lit(200.0).alias("query_ts"))


@pytest.mark.parametrize(("queries", "memories", "sent", "k"), [(512, 8192, 4_000_000, 4), (3, 5, 40, 4), (7, 2, 12, 9), (5, 3, 12, 200)])
def test_ties_and_blocks(spark, monkeypatch, queries, memories, sent, k):
    """Small integer vectors have very many equal products; repeated vectors too."""
    v = np.random.default_rng(1).integers(-1, 2, (150, 3))
    monkeypatch.setattr(exchange, "QUERIES", queries)
    monkeypatch.setattr(exchange, "MEMORIES", memories)
    monkeypatch.setattr(topk, "MOST_SENT", sent)
    mem = frame(spark, v).cache()
    s = v[:20] @ v.T
    want = {(i, r + 1, int(n)): int(s[i, n]) for i in range(20) for r, n in enumerate(np.lexsort((np.arange(150), -s[i]))[:k])}
    assert {(r["query_id"], r["rank"], r["node_id"]): r["score"] for r in topk.topk(mem, asked(mem, 20), k).collect()} == want


def test_memories_are_read_once_and_queries_not_collected(spark):
    mem = frame(spark, np.eye(4))
    plan = topk.topk(mem, asked(mem, 2), 2)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("MapInArrow") == 1


def test_pruned_maxima(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(6, 8))
    v = np.concatenate([c + rng.normal(scale=0.15, size=(60, 8)) for c in centers] + [np.zeros((2, 8)), rng.normal(size=(40, 8)) * 3])  # clusters, zero vectors, lengths of their own
    odd = spark.createDataFrame([(900, None, 0.0, 0), (901, [1.0], 0.0, 0), (902, [float("nan")] * 8, 0.0, 0), (903, [float("inf")] * 8, 0.0, 0)], "node_id long, embedding array<double>, ts double, modality int")
    mem = frame(spark, v).union(odd)
    c = np.concatenate([centers[:4] + rng.normal(scale=0.1, size=(4, 8)), rng.normal(size=(20, 8)), np.zeros((1, 8)), -centers[:2]])
    cand = spark.createDataFrame([(i, [float(e) for e in x]) for i, x in enumerate(c)] + [(0, [float(e) for e in c[0]]), (70, None), (71, [1.0, 2.0])], "candidate_id long, embedding array<double>")
    for small in (False, True):
        if small:
            monkeypatch.setattr(prune, "PART", 7)
            monkeypatch.setattr(prune, "MOST_SENT", 20)
        index = prune.Cells(mem, 12)
        got = prune.max_similarity(index, cand)
        want = (c @ v.T).max(axis=1)
        out = {r["candidate_id"]: r["max_sim"] for r in got.collect()}
        assert out == pytest.approx({**dict(enumerate(want)), 70: 0.0, 71: 0.0})
        gate = {r["candidate_id"]: r["accepted"] for r in prune.novel(index, cand, 1.0).collect()}
        assert gate == {**{i: bool(w <= 1.0) for i, w in enumerate(want)}, 70: True, 71: True}
    assert prune.skipped(got, index) > 0.2
    assert prune.max_similarity(mem.limit(0), cand).agg(F.max("max_sim")).first()[0] == 0.0


def test_nearest_others_by_blocks(spark, monkeypatch):
    """Ties, several batches of memories a slot, a vector that isn't whole (it made the former build fail), and one modality or none."""
    from recollex.operators import exchange, index

    monkeypatch.setattr(exchange, "MEMORIES", 16)
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(size=(150, 4)), rng.integers(-1, 2, (150, 4))])
    rows = [(i, x.tolist(), i % 3) for i, x in enumerate(v)]
    mem = spark.createDataFrame([*rows, (900, None, 0), (901, [1.0], 1)], "node_id long, embedding array<double>, modality int")
    best = lambda i, at: sorted((j for j in at if j != i), key=lambda j: (-(v[i] @ v[j]), j))
    whole = v[150:]  # products of whole numbers are exact, so ties are
    small = mem.where("node_id between 150 and 299")
    got = {(r["node_id"], r["rank"]): r["dst"] for r in index.knn_graph(small, 7).collect()}
    assert got == {(i, r + 1): j for i in range(150, 300) for r, j in enumerate(best(i, range(150, 300))[:7])} and len(whole) == 150
    near = {(r["node_id"], r["slot"]): (r["dst"], r["kind"]) for r in index.neighbors(mem, 6, 2).collect()}
    want = {(i, s): (j, "near") for i in range(300) for s, j in enumerate(best(i, range(300))[:4])}
    for i in range(300):
        want |= {(i, 4 + s): (best(i, range(m, 300, 3))[0], "bridge") for s, m in enumerate(sorted({0, 1, 2} - {i % 3}))}
    assert near == want
    assert index.knn_graph(mem.where("modality = 1"), 3).where("node_id < 900").count() == 300 and index.knn_graph(mem.limit(0), 3).count() == 0


def test_exhaustive_beam_sees_what_no_link_leads_to(spark):
    from recollex.operators import index
    from recollex.plans.config import BeamConfig

    v = np.random.default_rng(9).integers(-3, 4, (40, 3))
    mem = frame(spark, v)
    links = spark.createDataFrame([(i, 0, (i + 1) % 20) for i in range(40)], "node_id long, slot int, dst long")  # none to 20 and beyond
    got = index.beam_search(mem, links, asked(mem, 40), BeamConfig(5, 40, 40, seeds=2, time_decay=0.0))
    s = v @ v.T
    assert {(r["query_id"], r["rank"], r["node_id"]) for r in got.collect()} == {(i, r + 1, int(n)) for i in range(40) for r, n in enumerate(np.lexsort((np.arange(40), -s[i]))[:5])}


def test_wanted_cells_come_in_small_batches():
    """3,000 candidates that want 99 of 100 cells each; the rows stand for a table, whose batches the function gets."""
    import pyarrow as pa

    index = object.__new__(prune.Cells)
    index.centers, index.n = np.tile([1.0, 0.0], (100, 1)), np.ones(100)
    index.radius, index.low, index.high = np.full(100, 3.2), np.ones(100), np.ones(100)
    rows = type("Rows", (), {"mapInArrow": lambda self, f, schema: f})()
    q = pa.array([[1.0, 0.0]] * 3000, pa.list_(pa.float64()))
    b = pa.RecordBatch.from_arrays([pa.array(range(3000)), q, pa.array([0.5] * 3000)], names=["candidate_id", "q", "found"])
    sizes = [x.num_rows for x in prune._cells_of(rows, index, False, None)(iter([b]))]
    assert sum(sizes) == 3000 * 99 and max(sizes) <= 10_000


def test_pairs_are_scored_where_vectors_are_sent_once(spark):
    v = np.random.default_rng(10).normal(size=(30, 4))
    mem = frame(spark, v).union(spark.createDataFrame([(90, None, 0.0, 0), (91, [1.0], 0.0, 1)], "node_id long, embedding array<double>, ts double, modality int")).withColumn("weight", F.lit(2.0))
    q = asked(mem, 6)
    pairs = spark.createDataFrame([(i, j, float(i)) for i in range(6) for j in (*range(i, 30, 3), 90, 91, 95)] + [(77, 1, 0.0)], "query_id long, node_id long, parent double")
    scored = exchange.score(pairs, q, mem, 4, 2, 3, rate=0.01)
    assert "Join" not in scored._jdf.queryExecution().executedPlan().toString()  # a join sends a vector with each pair
    got = {(r["query_id"], r["node_id"]): (r["parent"], r["modality"], r["own"]) for r in scored.collect()}
    want = {(i, j): (float(i), j % 3, pytest.approx(2 * (v[i] @ v[j]) * np.exp(-0.01 * (200.0 - j)))) for i in range(6) for j in range(i, 30, 3)}
    assert got == want | {(i, j): (float(i), m, None) for i in range(6) for j, m in ((90, 0), (91, 1))}
