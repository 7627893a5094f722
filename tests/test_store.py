"""Store, protocol, streams, reports."""

import json

from pyspark.sql import functions as F

from recollex.plans.config import RetrievalConfig
from recollex.server import serve
from recollex.sources import memories as src
from recollex.sources import reports
from recollex.store import MemoryStore
from recollex.streaming import insert


def test_protocol(spark, tmp_path):
    store = MemoryStore(spark, f"file://{tmp_path}/log", 2)
    lines = [{"cmd": "ADD", "id": 1, "modality": 0, "embedding": [3, 0], "timestamp": 1}, {"cmd": "ADD", "id": 2, "modality": 2, "embedding": [0, 1], "timestamp": 1}, {"cmd": "ADD", "id": 3, "embedding": [1]},
             {"cmd": "QUERY", "embedding": [1, 0], "top_k": 1, "bfs_max_hops": 1, "timestamp": 1}, {"cmd": "DELETE", "id": 1}, {"cmd": "DELETE", "id": 77}, {"cmd": "QUERY", "embedding": [1, 0], "top_k": 5, "timestamp": 1},
             {"cmd": "STATS"}, {"cmd": "SAVE", "path": f"file://{tmp_path}/saved"}, {"cmd": "WHAT"}, {"cmd": "SHUTDOWN"}, {"cmd": "STATS"}]
    out = [json.loads(x) for x in serve(store, [json.dumps(x) for x in lines[:9]] + ["{broken"] + [json.dumps(x) for x in lines[9:]])]
    assert out[0] == out[1] == out[4] == {"ok": True} and "error" in out[2]
    assert [(r["id"], r["score"], r["hops"]) for r in out[3]["results"]] == [(1, 1.0, 0)]
    assert [r["id"] for r in out[6]["results"]] == [2] and out[7]["n"] == 2 and "error" in out[9] and "error" in out[10]
    assert len(out) == 12 and out[11] == {"ok": True}
    again = MemoryStore(spark, f"file://{tmp_path}/other", 2)
    again.load(f"file://{tmp_path}/saved")
    again.add(spark.createDataFrame([(1, [1.0, 0.0], 0, 2.0)], "node_id long, embedding array<double>, modality int, ts double"))  # revives
    assert again.memories().count() == 2
    again.compact()
    assert MemoryStore(spark, f"file://{tmp_path}/other", 2).memories().count() == 2


def test_stream(spark, tmp_path):
    mem = src.synthetic(spark, 20, 10, 10, 8).select("node_id", "embedding", "modality", "ts")
    store = MemoryStore(spark, f"file://{tmp_path}/log", 8)
    for part in range(2):
        mem.where(F.col("node_id") % 2 == part).write.mode("append").parquet(f"{tmp_path}/in")
        s = spark.readStream.schema(mem.schema).parquet(f"{tmp_path}/in")
        insert.insert_stream(s, store, f"{tmp_path}/offsets").awaitTermination()  # restarts from its checkpoint
        assert store.memories().count() == 20 * (part + 1)
    q = src.queries(store.memories(), (0, 7))
    assert [r["node_id"] for r in store.query(q, RetrievalConfig(1, 0)).orderBy("query_id").collect()] == [0, 7]
    ts = spark.readStream.schema(mem.schema).parquet(f"{tmp_path}/in").withColumn("at", F.timestamp_seconds("ts"))
    w = insert.sliding_counts(ts).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    w.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == 80  # each row stands in two windows
    hits = spark.readStream.schema(mem.schema).parquet(f"{tmp_path}/in").select((F.col("node_id") % 3).alias("node_id"), F.lit(0).cast("long").alias("step"))
    i = insert.importance_stream(hits).writeStream.format("memory").queryName("i").outputMode("update").trigger(availableNow=True).start()
    i.awaitTermination()
    assert {r["node_id"] for r in spark.table("i").collect()} == {0, 1, 2}


def test_reports(spark, tmp_path):
    for i, t in enumerate(['{"n": 10, "variant": "full", "recall": 0.9}', '{"n": 10, "variant": "flat"}', "not json"]):
        (tmp_path / f"{i}.json").write_text(t)
    t = reports.ablation_table(reports.read_ablations(spark, f"{tmp_path}/*.json"))
    assert [(r["n"], r["full"], r["flat"], r["h1"]) for r in t.collect()] == [(10, 0.9, 0.0, None)]
    assert "0.900" in reports.markdown(t) and "no\\_hubs" in reports.latex(t)
    lines = spark.createDataFrame([('{"cmd": "ADD", "id": 4, "embedding": [1, 2]}',), ("bad",)], "value string")
    assert [(r["cmd"], r["id"]) for r in src.requests(lines).collect()] == [("ADD", 4), (None, None)]
