"""Invariants of the graph, a model of retrieval in numpy, edge cases, and the catalogue against SQL."""

import glob
import os
from decimal import Decimal

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from recollex.operators import graph, index, maintain, metrics, topk
from recollex.plans import catalogue
from recollex.plans.config import BeamConfig, GraphConfig, RetrievalConfig
from recollex.plans.retrieve import retrieve
from recollex.sources import memories as src

SF = "/root/testdata/sf0.001"
MEM = "node_id long, embedding array<float>, modality int, ts double"


@pytest.mark.parametrize("sizes,dim", [((100, 50, 50), 64), ((50, 25, 25), 256)])
def test_generator_and_graph(spark, sizes, dim):
    mem = src.synthetic(spark, *sizes, dim).cache()
    rows = mem.orderBy("node_id").collect()
    assert [r["modality"] for r in rows] == [m for m, n in enumerate(sizes) for _ in range(n)]
    assert all(abs(np.linalg.norm(r["embedding"]) - 1) < 1e-4 for r in rows)
    assert [r["embedding"] for r in src.synthetic(spark, *sizes, dim).repartition(3).orderBy("node_id").collect()] == [r["embedding"] for r in rows]
    e = {(r[0], r[1]) for r in graph.build(mem).collect()}
    assert all((b, a) in e and a != b for a, b in e)
    near = {}
    for a, b in e:
        near.setdefault(a, set()).add(rows[b]["modality"])
    assert all(near[r["node_id"]] >= {0, 1, 2} - {r["modality"]} for r in rows)
    assert len(e) / len(rows) < 30 and max(sum(a == i for a, _ in e) for i in range(len(rows))) < 200


def model(emb, mod, ts, edges, q, at, cfg):
    fin = (emb @ q) * np.exp(-cfg.time_decay * np.maximum(0, at - ts))
    ok = [i for i in range(len(emb)) if cfg.modality_filter is None or mod[i] == cfg.modality_filter]
    seeds = sorted(ok, key=lambda i: (-fin[i], i))[:cfg.top_k]
    got = {i: (fin[i], 0) for i in seeds}
    front = dict.fromkeys(seeds)
    for h in range(1, cfg.max_hops + 1):
        new = {}
        for i in front:
            for j in edges.get(i, ()):
                if j not in got:
                    new[j] = max(new.get(j, -np.inf), got[i][0])
        for j, p in new.items():
            own = 0.8 * fin[j] if j in ok else -np.inf
            got[j] = (max(p * cfg.hop_decay, own), h)
        front = new
    return sorted(((-round(s, 9), i, h) for i, (s, h) in got.items()))[:cfg.top_k]


@pytest.mark.parametrize("k,hops,rate,modality", [(1, 0, 0.0, None), (5, 1, 1e-6, None), (10, 3, 1e-3, None), (64, 2, 1e-6, 2), (500, 2, 0.0, None)])
def test_model(spark, k, hops, rate, modality):
    mem = src.synthetic(spark, 40, 20, 20, 16, span=1e4).cache()
    edges = graph.build(mem)
    rows = mem.orderBy("node_id").collect()
    emb = np.array([r["embedding"] for r in rows], float)
    near = {}
    for a, b in edges.collect():
        near.setdefault(a, []).append(b)
    cfg = RetrievalConfig(k, hops, rate, modality_filter=modality, normalize_query=False)
    q = mem.where("node_id in (3, 50)").select(F.col("node_id").alias("query_id"), F.col("embedding").alias("q"), F.lit(9e3).alias("query_ts"))
    got = retrieve(mem, edges, q, cfg).orderBy("query_id", "rank").collect()
    for i in (3, 50):
        want = model(emb, np.array([r["modality"] for r in rows]), np.array([r["ts"] for r in rows]), near, emb[i], 9e3, cfg)
        assert [(-round(r["score"], 9), r["node_id"], r["hops"]) for r in got if r["query_id"] == i] == want


def test_edge_cases(spark):
    none = spark.createDataFrame([], MEM)
    q = spark.createDataFrame([(1, [1.0, 0.0], 5.0)], "query_id long, q array<float>, query_ts double")
    assert retrieve(none, graph.build(none), q).count() == 0
    one = spark.createDataFrame([(7, [0.0, 0.0], 0, 9.0)], MEM)
    assert [(r["node_id"], r["score"]) for r in retrieve(one, graph.build(one), q).collect()] == [(7, 0.0)]
    old = spark.createDataFrame([(1, [-1.0, 0.0], 0, 0.0), (2, [-1.0, 0.0], 0, 99.0)], MEM)
    got = retrieve(old, None, q, RetrievalConfig(time_decay=0.1, max_hops=0)).orderBy("rank").collect()
    assert [r["node_id"] for r in got] == [1, 2] and abs(got[1]["score"] + 1) < 1e-6  # decay moves to 0; the future doesn't decay
    gone = old.withColumn("deleted", F.col("node_id") == 1)
    assert [r["node_id"] for r in retrieve(gone, None, q, RetrievalConfig(max_hops=0)).collect()] == [2]
    c = spark.createDataFrame([(1, [1.0, 0.0])], "candidate_id long, embedding array<float>")
    assert [tuple(r) for r in topk.novel(none, c, 0.5).collect()] == [(1, 0.0, True)]
    assert graph.build(spark.createDataFrame([(5, [1.0], 0, 0.0), (9, [1.0], 1, 0.0)], MEM)).count() == 2


def test_maintenance(spark):
    w = spark.createDataFrame([(1, 1.0), (2, 4.99)], "node_id long, importance double")
    hit = spark.createDataFrame([(2,), (2,)], "node_id long")
    assert [round(r[1], 6) for r in maintain.importance_update(w, hit).orderBy("node_id").collect()] == [0.999, 5.0]
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 2)], "src long, dst long")
    v = spark.createDataFrame([(0, 1, 0), (0, 2, 1), (0, 3, 2)], "query_id long, node_id long, hops int")
    hits = maintain.edge_hits(e, v)
    assert {(r[0], r[1]): r[2] for r in hits.collect()} == {(1, 2): 0, (2, 1): 1, (2, 3): 0, (3, 2): 1}
    r = spark.createDataFrame([(0, 1, 1), (0, 2, 3)], "query_id long, rank int, node_id long")
    assert {tuple(x) for x in maintain.rewire(e, hits, r, 0).collect()} == {(1, 2), (2, 1), (2, 3), (3, 2), (1, 3), (3, 1)}


def test_beam_joins_and_recall(spark):
    mem = src.synthetic(spark, 60, 30, 30, 16).cache()
    n = index.neighbors(mem, 12, 2).cache()
    q = src.queries(mem, (0, 7, 42))
    want = {(r["query_id"], r["node_id"]) for r in topk.topk(mem, q, 5).collect()}
    got = index.beam_search(mem, n, q, BeamConfig(5, 40, 40, time_decay=0.0))
    assert len({(r["query_id"], r["node_id"]) for r in got.collect()} & want) >= 0.9 * len(want)
    whole = lambda df: sorted((r["query_id"], r["rank"], r["node_id"], round(r["score"], 6), r["modality"]) for r in df.collect())
    # A beam of 6 that fills and ends early, a beam cut short by its iterations, and half precision with a filter.
    for cfg in (BeamConfig(4, 6, 30, 3, 2), BeamConfig(5, 40, 3, 1, 4, 1e-3), BeamConfig(5, 12, 4, 4, 3, half=True, modality_filter=1)):
        assert whole(index.beam_joins(mem, n, q, cfg)) == whole(index.beam_search(mem, n, q, cfg))
    assert index.beam_joins(mem, n, q.limit(0), BeamConfig(5)).count() == 0


def test_percentiles(spark):
    s = spark.createDataFrame([("a", float(v)) for v in (5, 1, 3, 3, 9)] + [("b", 2.0)], "run string, ms double")
    got = {r["run"]: r for r in metrics.lower_percentiles(s, "ms", "run", {"p50": 0.5, "p99": 0.99}).collect()}
    assert got["a"]["p50"] == 3 and got["a"]["p99"] == 5 and got["b"]["p99"] == 2


@pytest.mark.parametrize("name", ["topk_decayed", "retrieve_full", "nsn_edges", "knn_bridges", "novelty_gate", "importance_update", "latency_percentiles", "recall_at_k", "upsert_latest", "corpus_summary"])
def test_catalogue(spark, name):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = catalogue.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({catalogue.SQL[name]})").fetchall()
    plain = lambda rows: sorted((tuple(float(x) if isinstance(x, Decimal) else x for x in r) for r in rows), key=str)
    assert plain(got.select(*cols).collect()) == plain(want)


def test_entry_names():
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_graph_switches(spark):
    mem = src.synthetic(spark, 20, 10, 10, 8).cache()
    off = GraphConfig(ring=False, skips=False, hubs=False, rewire=True, bridges=False)
    assert graph.build(mem, off).count() == 0
    assert graph.build(mem, GraphConfig(skips=False, hubs=False, rewire=False, bridges=False)).count() == 2 * 3 * 40


def test_topk_parts_and_odd_vectors(spark, monkeypatch):
    """Batches cut into parts give what one part gives; vectors that aren't whole take no part."""
    import numpy as np
    from recollex.operators import topk

    v = np.random.default_rng(5).normal(size=(60, 4))
    mem = spark.createDataFrame([(i, x.tolist(), float(i), 0) for i, x in enumerate(v)] + [(90, None, 0.0, 0), (91, [1.0], 0.0, 0), (92, [1.0, None, 1.0, 1.0], 0.0, 0), (93, [float("nan")] * 4, 0.0, 0)], "node_id long, embedding array<double>, ts double, modality int")
    q = spark.createDataFrame([(i, x.tolist(), 60.0) for i, x in enumerate(v[:20])] + [(99, None, 0.0)], "query_id long, q array<double>, query_ts double")
    whole = topk.topk(mem, q, 3, rate=0.01).collect()
    score = (v[:20] @ v.T) * np.exp(-0.01 * (60.0 - np.arange(60)))
    assert {(r["query_id"], r["rank"], r["node_id"]) for r in whole} == {(i, j + 1, int(n)) for i in range(20) for j, n in enumerate(np.argsort(-score[i])[:3])}
    monkeypatch.setattr(topk, "MOST_SENT", 12)
    assert {tuple(r)[:3] for r in topk.topk(mem, q, 3, rate=0.01).collect()} == {tuple(r)[:3] for r in whole}


@pytest.mark.parametrize("rule", ["floor", "count"])
def test_percentiles_of_one_huge_run(spark, rule):
    """Nearly all samples in one run, a null run, ties, nulls and NaN-free extremes; ranges of one run are counted side by side."""
    import numpy as np

    rng = np.random.default_rng(3)
    runs = {"big": rng.integers(0, 4000, 20_000) / 8, "one": np.array([7.0]), None: np.array([3.0, 1.0, 1.0, -2.0])}
    rows = [(k, float(v)) for k, vs in runs.items() for v in vs] + [("big", None), ("none", None)]
    s = spark.createDataFrame(rows, "run string, ms double").repartition(5)
    got = {r["run"]: r.asDict() for r in metrics.lower_percentiles(s, "ms", "run", rule=rule).collect()}
    assert set(got) == set(runs)
    for k, v in runs.items():
        v = np.sort(v)
        for name, p in metrics.PERCENTILES.items():
            assert got[k][name] == v[int(np.floor(p * (len(v) - 1))) if rule == "floor" else min(int(np.floor(len(v) * p)), len(v) - 1)]
    assert "Window" not in metrics.lower_percentiles(s, "ms", "run")._jdf.queryExecution().executedPlan().toString()


def test_recall_of_few_true_nodes(spark):
    answer = spark.createDataFrame([(1, 5), (1, 6), (2, 9)], "query_id long, node_id long")
    truth = spark.createDataFrame([(1, 5), (1, 7), (2, 9), (3, 1)], "query_id long, node_id long")
    assert {tuple(r) for r in metrics.recall_at_k(answer, truth, 10).collect()} == {(1, 0.5), (2, 1.0), (3, 0.0)}


def test_beam_search_by_joins_sends_nothing_from_the_driver(spark, monkeypatch):
    """Rounds broadcast nothing and the state is a row a query, which replaces the one before; vectors that aren't whole take no part."""
    import os

    from recollex.functions import lineage

    mem = src.synthetic(spark, 60, 30, 30, 16).select("node_id", "embedding", "modality", "ts")
    q, n = src.queries(mem, (0, 7, 42)), index.neighbors(mem, 12, 2)
    states, write = [], lineage.materialize
    monkeypatch.setattr(index, "materialize", lambda df, tag: states.append((tag, df, write(df, tag))) or states[-1][2])
    cfg = BeamConfig(5, 6, 9, 2, 3, 1e-3)
    want = sorted((r["query_id"], r["rank"], r["node_id"], round(r["score"], 6)) for r in index.beam_search(mem, n, q, cfg).collect())
    monkeypatch.setattr(index, "MOST_SENT", 0)
    odd = mem.union(spark.createDataFrame([(900, None, 0, 0.0), (901, [1.0], 1, 0.0)], mem.schema))
    links = n.union(spark.createDataFrame([(0, 50, 900, "near"), (7, 51, 901, "near")], n.schema))
    states.clear()
    got = index.beam_search(mem, n, q, cfg)
    assert sorted((r["query_id"], r["rank"], r["node_id"], round(r["score"], 6)) for r in got.collect()) == want
    beams = [(df, kept) for tag, df, kept in states if tag == "beam"]
    assert len(beams) > 3 and all("Broadcast" not in df._jdf.queryExecution().executedPlan().toString() for df, _ in beams[1:])  # the first has ranges' counts, a row a partition
    there = [os.path.exists(kept.inputFiles()[0].removeprefix("file:")) for _, kept in beams]
    assert there == [False] * (len(beams) - 1) + [True] and beams[-1][1].count() == 3
    assert {r["node_id"] for r in index.beam_joins(odd, links, q, BeamConfig(40, 40, 40)).collect()}.isdisjoint({900, 901})
