"""A JSON-line protocol over a store: ADD, QUERY, DELETE, STATS, SAVE, LOAD, SHUTDOWN."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable, Iterator

from pyspark.sql import functions as F

from recollex.plans.config import RetrievalConfig
from recollex.store import MemoryStore


def handle(store: MemoryStore, line: str) -> tuple[str, bool]:
    """The answer to one line, and whether to go on."""
    try:
        r = json.loads(line)
        cmd = r["cmd"]
    except (ValueError, KeyError, TypeError):
        return json.dumps({"error": "not a request"}), True
    spark = store.spark
    if cmd in ("ADD", "QUERY") and store.dim is not None and len(r.get("embedding") or []) != store.dim:
        return json.dumps({"error": f"embedding must have {store.dim} values"}), True
    if cmd == "ADD":
        row = (int(r["id"]), [float(x) for x in r["embedding"]], int(r.get("modality", 0)), float(r.get("timestamp", 0.0)))
        store.add(spark.createDataFrame([row], "node_id long, embedding array<double>, modality int, ts double"))
        return json.dumps({"ok": True}), True
    if cmd == "DELETE":
        store.delete(spark.createDataFrame([(int(r["id"]),)], "node_id long"))
        return json.dumps({"ok": True}), True
    if cmd == "QUERY":
        m = int(r.get("modality_filter", -1))
        cfg = RetrievalConfig(top_k=int(r.get("top_k", 10)), max_hops=int(r.get("bfs_max_hops", 2)), modality_filter=None if m < 0 else m)
        q = spark.createDataFrame([(0, [float(x) for x in r["embedding"]], float(r.get("timestamp", 0.0)))], "query_id long, q array<double>, query_ts double")
        rows, ms = store.timed_query(q, cfg)
        return json.dumps({"results": [{"id": x["node_id"], "score": round(x["score"], 6), "modality": x["modality"], "hops": x["hops"]} for x in rows], "ms": round(ms, 3)}), True
    if cmd == "STATS":
        s = store.stats().first()
        return json.dumps({"n": s["n"], "edges": s["edges"], "vector_mb": s["vector_mb"] or 0.0}), True
    if cmd in ("SAVE", "LOAD"):
        (store.save if cmd == "SAVE" else store.load)(r["path"])
        return json.dumps({"ok": True}), True
    if cmd == "SHUTDOWN":
        return json.dumps({"ok": True}), False
    return json.dumps({"error": f"unknown command {cmd}"}), True


def serve(store: MemoryStore, lines: Iterable[str]) -> Iterator[str]:
    for line in lines:
        if line.strip():
            answer, more = handle(store, line)
            yield answer
            if not more:
                return


def paced(store: MemoryStore, queries, rate: float, cfg: RetrievalConfig = RetrievalConfig()) -> list[tuple[int, float]]:
    """Runs each query at its time at a fixed rate; frame and latency in ms."""
    out, began = [], time.perf_counter()
    for i, q in enumerate(queries):
        time.sleep(max(0.0, began + i / rate - time.perf_counter()))
        out.append((i, store.timed_query(q.withColumn("query_ts", F.lit(float(i))), cfg)[1]))
    return out
