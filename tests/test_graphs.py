"""Graphs that grow, edges in buckets, neighbour descent, bits and half floats."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollex.functions.lineage import shared_root
from recollex.functions.vectors import float_bits, pack_half
from recollex.operators import descent, expand, graph, growing, index, topk
from recollex.plans.config import GraphConfig, RetrievalConfig
from recollex.sources import memories as src

SF = "/root/testdata/sf0.001"


def test_growing_equals_one_build(spark, tmp_path):
    rng = np.random.default_rng(4)
    ids = rng.permutation(5000)[:1212].tolist()
    kind = {i: int(m) for i, m in zip(ids, rng.integers(0, 3, len(ids)), strict=True)}
    frame = lambda part: spark.createDataFrame([(i, kind.get(i)) for i in part], "node_id long, modality int")
    g = growing.GrowingGraph(spark, f"file://{tmp_path}/g")
    for b, part in enumerate((ids[:1000], ids[1000:1200], [*ids[1200:1210], *ids[5:9], ids[1201], None], [])):
        g.insert(frame(part), b)
    g.insert(frame([*ids[1200:1210], *ids[5:9], ids[1201], None]), 2)  # a batch that runs again
    at = g.ids().orderBy("idx").collect()
    assert [r["idx"] for r in at] == list(range(1210)) and [r["node_id"] for r in at] == sorted(ids[:1000]) + sorted(ids[1000:1200]) + sorted(ids[1200:1210])
    # One build over the same order.
    whole = growing.GrowingGraph(spark, f"file://{tmp_path}/one")
    place, rows = {}, []
    for r in at:
        before = dict(place)
        place[r["modality"]] = place.get(r["modality"], 0) + 1
        rows.append((r["node_id"], r["modality"], r["idx"], r["place"], {m: before.get(m, 0) for m in range(3)}))
        assert r["place"] == before.get(r["modality"], 0)
    new = spark.createDataFrame(rows, growing.IDS + ", before map<int, long>")
    pairs = lambda df: {tuple(r) for r in df.collect()}
    one = pairs(growing.edges_of(new, new.drop("before")))
    assert pairs(g.edges()) == one | {(b, a) for a, b in one}
    assert all(a != b for a, b in one)
    # The last insertion of under 1 % of nodes wrote about as many edges; no other file changed.
    share = spark.read.parquet(f"file://{tmp_path}/g/edges/b=000000000002").count() / len(one)
    assert 0.004 < share < 0.016
    gone = frame(ids[:7])
    assert all(a not in ids[:7] and b not in ids[:7] for a, b in pairs(g.edges(gone)))
    assert whole.edges().count() == 0
    # Every node but the first of each modality has a bridge to each other modality that came before it.
    linked = {(a, kind[b]) for a, b in one if kind[a] != kind[b]}
    assert all((r[0], m) in linked for r in rows for m, c in r[4].items() if m != r[1] and c)
    only_ring = growing.edges_of(new, new.drop("before"), GraphConfig(skips=False, hubs=False, rewire=False, bridges=False))
    order = [r["node_id"] for r in at]
    assert pairs(only_ring) == {(order[i], order[i - j]) for i in range(1210) for j in (1, 2, 3) if i >= j}


def test_hops_shuffle_no_edges(spark):
    mem = src.memories(spark, SF)
    q = src.queries(mem)
    edges, stored = graph.store(graph.build(mem), mem, "hops", f"{shared_root(spark)}/hops", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        front = topk.topk(mem, q, 5).select("query_id", "node_id", "score").checkpoint() if spark.sparkContext.getCheckpointDir() else topk.topk(mem, q, 5)
        step = front.join(edges, front["node_id"] == edges["src"]).select("query_id", F.col("dst").alias("node_id"), "score")
        plan = step._jdf.queryExecution().executedPlan().toString()
        at = plan.index("FileScan parquet spark_catalog.default.hops_edges")
        above = plan[plan.rindex("SortMergeJoin", 0, at) : at]
        assert above.count("Exchange") == 1 and "Bucketed: true" in plan[at:]  # the frontier's, none between the scan of edges and the join
        assert "Exchange" not in "\n".join(plan[:at].splitlines()[-3:])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    cfg = RetrievalConfig(max_hops=2, time_decay=1e-6)
    seeds = topk.topk(mem, q, 5, rate=1e-6)
    whole = lambda e, m: sorted((r["query_id"], r["node_id"], round(r["score"], 9), r["hops"]) for r in expand.expand(seeds, e, m, q, cfg).collect())
    assert whole(edges, stored) == whole(graph.build(mem), mem)


def test_expansion_ends_at_an_empty_level(spark):
    mem = spark.createDataFrame([(i, [1.0, float(i)], 0, 0.0) for i in range(4)], "node_id long, embedding array<double>, modality int, ts double")
    q = spark.createDataFrame([(0, [1.0, 0.0], 0.0)], "query_id long, q array<double>, query_ts double")
    edges = spark.createDataFrame([(0, 1), (1, 0)], "src long, dst long")
    seeds = topk.topk(mem.where("node_id = 0"), q, 1)
    out = expand.expand(seeds, edges, mem, q, RetrievalConfig(max_hops=1000)).collect()  # a thousand levels would not end in time
    assert {(r["node_id"], r["hops"]) for r in out} == {(0, 0), (1, 1)}


def test_descent(spark):
    mem = src.memories(spark, SF)
    got, changes = descent.descend(mem, 8)
    want = {(r["node_id"], r["dst"]) for r in index.knn_graph(mem, 8).collect()}
    rows = got.collect()
    assert len({(r["node_id"], r["dst"]) for r in rows} & want) >= 0.9 * len(want) and len(rows) == len(want)
    assert changes[-1] < changes[0] and all(r["node_id"] != r["dst"] for r in rows)
    few = spark.createDataFrame([(i, [float(i), 1.0], 0) for i in range(4)] + [(9, None, 0), (8, [1.0], 0)], "node_id long, embedding array<double>, modality int")
    assert {(r["node_id"], r["dst"]) for r in descent.descend(few, 8)[0].collect()} == {(a, b) for a in range(4) for b in range(4) if a != b}
    assert descent.descend(few.limit(0), 8)[0].count() == 0


def test_bits_and_seeds(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=200), [0.0, -0.0, np.inf, -np.inf, 1e-45, 2.0**-126, 3.4e38], 2.0 ** np.arange(-149, 128), np.nextafter(2.0 ** np.arange(-126, 128).astype(np.float32), np.float32(0))]).astype(np.float32)
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double")
    assert {r["i"]: r["b"] for r in d.select("i", float_bits(F.col("x")).alias("b")).collect()} == {i: int(v.view(np.uint32)) for i, v in enumerate(x)}
    q = np.array([0.25, -1.5, 7.0])
    want = int(np.float32(0.25).view(np.uint32)) ^ int(np.float32(-1.5).view(np.uint32))
    assert index.seeds(q, 3, 1000).tolist() == [(want + i * 7919) % 2**32 % 1000 for i in range(3)]


def test_packed_halves(spark, tmp_path):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(50, 64)).astype(np.float32)
    rows = [(i, [float(c) for c in x], 0, 0.0) for i, x in enumerate(v)] + [(90, None, 0, 0.0), (91, [None] * 64, 0, 0.0), (92, [1.0], 0, 0.0)]
    mem = spark.createDataFrame(rows, "node_id long, embedding array<float>, modality int, ts double").coalesce(1)
    q = mem.where("node_id < 5").select(F.col("node_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"), F.lit(0.0).alias("query_ts"))
    packed = pack_half(mem)
    assert {r["node_id"]: r["n"] for r in packed.where("node_id >= 49").select("node_id", F.octet_length("embedding").alias("n")).collect()} == {49: 128, 90: None, 91: None, 92: 2}
    s = v[:5].astype(np.float64) @ v.astype(np.float16).astype(np.float64).T
    want = {(i, r + 1, int(n)) for i in range(5) for r, n in enumerate(np.argsort(-s[i], kind="stable")[:6])}
    assert {tuple(r)[:3] for r in topk.topk(packed, q, 6).collect()} == want
    size = {}
    for name, df in (("float", mem), ("half", packed)):
        df.write.option("compression", "none").parquet(str(tmp_path / name))
        size[name] = sum(f.stat().st_size for f in (tmp_path / name).glob("*.parquet"))
    assert size["half"] < 0.62 * size["float"]


def test_places_of_many_rows_are_dense(spark):
    """More rows than the sample that ranges are drawn from."""
    ids = spark.range(60_000).select((F.col("id") * 7919 % 60_000 * 2).alias("node_id"), (F.col("id") % 3).cast("int").alias("kind"))
    got = graph.ranked(ids, "node_id", "place").collect()
    assert len(got) == 60_000 and all(r["node_id"] == 2 * r["place"] for r in got)
    places = {}
    for r in sorted(graph.ranked(ids, "node_id", "place", "kind").collect()):
        places.setdefault(r["kind"], []).append(r["place"])
    assert all(p == list(range(20_000)) for p in places.values())
