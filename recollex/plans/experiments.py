"""Experiments over generated sensors: demos, temporal relevance, freshness between rebuilds, sizes, cells, deadlines.

Corpora and queries are tables whose rows come from their own ids. An experiment asks all its queries as one batch, so times
are those of batches divided by their queries; only deadline_stream() measures frames one by one, as they arrive."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.functions.lineage import cut, shared_root
from recollex.functions.vectors import draw
from recollex.operators import cells, graph, metrics, topk
from recollex.plans.config import GraphConfig, RetrievalConfig
from recollex.plans.retrieve import DEMOS, demo_hit, retrieve
from recollex.sources import memories as src


@dataclass(frozen=True)
class Scene:
    """A sensor: objects, memories and frames, turns of memories and of queries, rates, and how a frame chooses its object.
    shares are of text, audio and image among the memories; time runs at `clock` rows a second."""

    objects: int
    rows: int
    frames: int
    drift: float
    query_drift: float
    hz: int
    clock: float
    shares: tuple[float, float, float]
    hold: int
    budget_ms: float
    metric: str


# Sizes, turns, rates and budgets of the four demos.
SCENES = {
    "av": Scene(40, 2400, 600, 0.08, 0.10, 60, 1.0, (0, 0, 1), 1, 1.0, "track_recovery_rate"),
    "robot": Scene(150, 10000, 10000, 0.05, 0.06, 1000, 1000.0, (1 / 3, 1 / 3, 1 / 3), 1, 1.0, "relevant_hit_rate"),
    "ar": Scene(300, 27000, 4500, 0.12, 0.15, 90, 90.0, (0, 0, 1), 31, 5.0, "cache_hit_rate"),
    "voice": Scene(20, 9000, 900, 0.15, 0.18, 30, 30.0, (0.2, 0.8, 0), 301, 20.0, "cross_modal_hit_rate"),
}
OCCLUSION_PERIOD, OCCLUSION_LENGTH = 30, 24
VALIDATION_SIZES = (1000, 2000, 4000, 8000, 16000)


def scene_memories(spark: SparkSession, s: Scene, dim: int, seed: int = 42) -> DataFrame:
    """Memories of drawn objects with drawn modalities."""
    part = draw("modality", F.col("node_id"), F.lit(0), seed) / 4294967296.0
    modality = F.when(part < s.shares[0], 0).when(part < s.shares[0] + s.shares[1], 1).otherwise(2)
    seen = spark.range(s.rows).select(F.col("id").alias("node_id"), (draw("object", F.col("id"), F.lit(0), seed) % s.objects).alias("object_id"), (F.col("id") / s.clock).alias("ts"))
    return src.views(seen.withColumn("modality", modality.cast("int")), dim, s.drift, seed, 8, "node_id", "embedding")


def scene_queries(spark: SparkSession, name: str, s: Scene, dim: int, seed: int = 42) -> DataFrame:
    """query_id, q, query_ts, object_id, frame, occluded. A frame asks for one drawn object, held for s.hold frames. In "av" it
    asks for 5 to 15, leaves out the one that is hidden, and asks for that one in the last frame of its occlusion."""
    frames = spark.range(s.frames).select(F.col("id").alias("frame"))
    if name != "av":
        seen = frames.select("frame", F.lit(0).alias("slot"), (draw("seen", F.floor(F.col("frame") / s.hold), F.lit(0), seed) % s.objects).alias("object_id"), F.lit(False).alias("occluded"))
    else:
        period, place = F.floor(F.col("frame") / OCCLUSION_PERIOD), F.col("frame") % OCCLUSION_PERIOD
        hidden = F.when(place < OCCLUSION_LENGTH, period % s.objects).otherwise(-1)
        slots = F.explode(F.sequence(F.lit(0), (draw("count", F.col("frame"), F.lit(0), seed) % 11 + 4).cast("int")))
        seen = frames.select("frame", hidden.alias("hidden"), slots.alias("slot")).withColumn("object_id", draw("seen", F.col("frame"), F.col("slot"), seed) % s.objects).where("object_id <> hidden")
        back = frames.where(place == OCCLUSION_LENGTH - 1).select("frame", F.lit(15).alias("slot"), hidden.alias("object_id"), F.lit(True).alias("occluded"))
        seen = seen.select("frame", "slot", "object_id", F.lit(False).alias("occluded")).unionByName(back)
    seen = seen.select((F.col("frame") * 16 + F.col("slot")).alias("query_id"), "object_id", "frame", "occluded", ((s.rows + F.col("frame")) / s.clock).alias("query_ts"))
    return src.views(seen, dim, s.query_drift, seed)


def demo(spark: SparkSession, name: str, dim: int = 768, **changes) -> DataFrame:
    """One row: demo, frame_rate_hz, deadline_ms, num_frames, corpus_size, embedding_dim, queries, batch_ms_per_query,
    metric, hit_rate (of queries with an answer that is a hit), object_rate (of queries whose first answer is their object)
    and within, as a report. changes replace fields of the scene."""
    cfg, threshold = DEMOS[name]
    s = replace(SCENES[name], **changes)
    mem, q = cut(scene_memories(spark, s, dim)), cut(scene_queries(spark, name, s, dim))
    edges = graph.build(mem)
    began = time.perf_counter()
    got = cut(retrieve(mem, edges, q, cfg))
    ms = (time.perf_counter() - began) * 1000
    owner = mem.select("node_id", F.col("object_id").alias("found"))
    rows = got.join(owner, "node_id").join(q.select("query_id", "object_id", "occluded"), "query_id")
    per = rows.groupBy("query_id").agg(F.max(demo_hit(name, threshold, F.col("occluded")).cast("int")).alias("hit"), F.max(((F.col("rank") == 1) & (F.col("found") == F.col("object_id"))).cast("int")).alias("own"))
    each = q.select("query_id").join(per, "query_id", "left")
    out = each.agg(F.count("*").alias("queries"), F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(0.0)).alias("hit_rate"), F.coalesce(F.avg(F.coalesce("own", F.lit(0))), F.lit(0.0)).alias("object_rate"))
    each_ms = F.lit(ms) / F.greatest(F.col("queries"), F.lit(1))
    return out.select(F.lit(name).alias("demo"), F.lit(s.hz).alias("frame_rate_hz"), F.lit(s.budget_ms).alias("deadline_ms"), F.lit(s.frames).alias("num_frames"), F.lit(s.rows).alias("corpus_size"), F.lit(dim).alias("embedding_dim"), "queries", each_ms.alias("batch_ms_per_query"), F.lit(s.metric).alias("metric"), "hit_rate", "object_rate", (each_ms <= s.budget_ms).alias("within"))


def sample_run(spark: SparkSession, n: int = 2000, dim: int = 768, queries: int = 100, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """Answers to random unit queries over a synthetic corpus and its graph."""
    mem = cut(src.benchmark_corpus(spark, n, dim))
    return retrieve(mem, graph.build(mem), src.frame_queries(spark, queries, dim), cfg)


def validation_sweep(spark: SparkSession, sizes: Sequence[int] = VALIDATION_SIZES, dim: int = 768, queries: int = 100, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """A row a size: the corpus summary, build_ms, topk_ms, total_ms and qps of the batch, mean greatest hop and number of
    results a query, and the recall of the seeds against all similarities computed by a join (for sizes like the defaults)."""

    def timed(make) -> tuple[DataFrame, float]:
        began = time.perf_counter()
        return cut(make()), (time.perf_counter() - began) * 1000

    out = []
    for n in sizes:
        mem, q = cut(src.benchmark_corpus(spark, n, dim)), cut(src.frame_queries(spark, queries, dim))
        edges, build_ms = timed(lambda: graph.build(mem))  # noqa: B023
        seeds, topk_ms = timed(lambda: retrieve(mem, None, q, replace(cfg, max_hops=0)))  # noqa: B023
        got, total_ms = timed(lambda: retrieve(mem, edges, q, cfg))  # noqa: B023
        exact = topk.similarity(mem, q, "ts", "query_ts").withColumn("score", F.col("sim") * F.exp(-cfg.time_decay * F.greatest(F.lit(0.0), F.col("query_ts") - F.col("ts"))))
        recall = metrics.recall_at_k(seeds, topk.best(exact, min(n, cfg.top_k)), min(n, cfg.top_k)).agg(F.avg("recall").alias("recall"))
        per = got.groupBy("query_id").agg(F.max("hops").alias("h"), F.count("*").alias("c")).agg(F.avg("h").alias("avg_hops"), F.avg("c").alias("avg_results"))
        ms = {"build_ms": build_ms, "topk_ms": topk_ms, "total_ms": total_ms, "qps": 1000.0 * queries / total_ms}
        out.append(graph.summary(mem, edges, dim).join(F.broadcast(recall)).join(F.broadcast(per)).select("*", *[F.lit(v).alias(c) for c, v in ms.items()]))
    return reduce(DataFrame.unionByName, out)


def cells_comparison(spark: SparkSession, sizes: Sequence[int] = (2000, 10000), dim: int = 768, queries: int = 300, k: int = 10) -> DataFrame:
    """n, method, cells, probes, ms_per_query of the batch, recall. Methods: "flat", all memories; "cells", cells.sizes() of them;
    "cells_90", as many times more as other queries of the same kind need for a recall of 0.9."""
    out = []
    for n in sizes:
        mem = cut(src.background(spark, n, dim).select("node_id", "embedding", F.lit(0).alias("modality"), F.lit(0.0).alias("ts")))
        q = cut(src.frame_queries(spark, queries, dim, 99))
        count, probes = cells.sizes(n)
        centers = cells.centroids(mem, count)
        dealt = cut(cells.assign(mem, centers))
        tuning = cut(src.frame_queries(spark, queries, dim, 7_000_000))
        more = cells.probes_for(dealt, tuning, cut(topk.topk(mem, tuning, k)), centers, k, step=probes)
        flat = None
        for method, many in (("flat", 0), ("cells", probes), ("cells_90", more)):
            began = time.perf_counter()
            got = cut(cells.search(dealt, q, centers, many, k) if many else topk.topk(mem, q, k))
            ms = (time.perf_counter() - began) * 1000 / max(1, queries)
            flat = got if flat is None else flat
            recall = metrics.recall_at_k(got, flat, min(n, k)).agg(F.avg("recall").alias("recall"))
            facts = {"n": n, "method": method, "cells": len(centers) if many else 1, "probes": min(many, len(centers)) if many else 1, "ms_per_query": ms}
            out.append(recall.select(*[F.lit(v).alias(c) for c, v in facts.items()], "recall"))
    return reduce(DataFrame.unionByName, out)


def temporal_relevance(spark: SparkSession, frames: int = 600, per_frame: int = 10, objects: int = 100, dim: int = 768, queries: int = 100, k: int = 10, rate: float = 0.1, recent: float = 2.0, stale: float = 5.0, seed: int = 42) -> DataFrame:
    """system ("plain", "rerank" of the 5 k most similar, "decayed"), temporal_precision (age up to `recent`), object_precision
    (that, and the right object), stale_rate (age beyond `stale`), object_recall. Queries are new views of objects that were
    seen in the last `recent` seconds."""
    mem = cut(src.detections(spark, frames, per_frame, objects, dim, seed=seed))
    last = mem.agg(F.max("ts").alias("query_ts"))
    seen = cut(graph.ranked(mem.join(F.broadcast(last)).where(F.col("query_ts") - F.col("ts") < recent).select("object_id", "query_ts").distinct(), "object_id", "place"))
    wanted = spark.range(queries).select(F.col("id").alias("query_id"), (draw("target", F.col("id"), F.lit(0), seed) % max(1, seen.count())).alias("place"))
    q = cut(src.views(wanted.join(seen, "place").select("query_id", "object_id", "query_ts"), dim, 0.1, seed))
    facts = mem.select("node_id", "ts", F.col("object_id").alias("found"))
    age, own = F.col("query_ts") - F.col("ts"), F.col("found") == F.col("object_id")
    out = []
    for system, got in {"plain": topk.topk(mem, q, k), "rerank": topk.overfetch_rerank(mem, q, k, 5 * k, rate), "decayed": topk.topk(mem, q, k, rate=rate)}.items():
        rows = got.select("query_id", "node_id").join(facts, "node_id").join(q.select("query_id", "object_id", "query_ts"), "query_id")
        share = lambda c: F.avg(c.cast("double"))
        per = rows.groupBy("query_id").agg(share(age <= recent).alias("t"), share((age <= recent) & own).alias("o"), share(age > stale).alias("s"), F.max(own.cast("int")).alias("r"))
        out.append(per.agg(F.avg("t").alias("temporal_precision"), F.avg("o").alias("object_precision"), F.avg("s").alias("stale_rate"), F.avg("r").alias("object_recall")).select(F.lit(system).alias("system"), "*"))
    return reduce(DataFrame.unionByName, out)


def freshness(spark: SparkSession, frames: int = 600, per_frame: int = 10, objects: int = 100, dim: int = 768, k: int = 10, rebuild_every: int = 60, hz: float = 60.0, fresh: float = 0.2, seed: int = 42) -> DataFrame:
    """frame, visible (the last frame that the index holds), fresh (1 if a result is younger than `fresh` seconds). The index is
    rebuilt every rebuild_every frames, and what comes between is not found; each build answers the frames until the next."""
    mem = cut(src.detections(spark, frames, per_frame, objects, dim, rate=hz, seed=seed).withColumn("frame", F.floor(F.col("node_id") / per_frame)))
    asked = spark.range(frames).select(F.col("id").alias("query_id"), (draw("asked", F.col("id"), F.lit(0), seed) % objects).alias("object_id"), (F.col("id") / hz).alias("query_ts"))
    q = cut(src.views(asked, dim, 0.1, seed))
    out = []
    for at in range(0, frames, rebuild_every):
        now = q.where((F.col("query_id") >= at) & (F.col("query_id") < at + rebuild_every))
        got = topk.topk(mem.where(F.col("frame") <= at), now, k).join(mem.select("node_id", "ts"), "node_id").join(now.select("query_id", "query_ts"), "query_id")
        out.append(metrics.any_row(got, F.col("query_ts") - F.col("ts") < fresh, "fresh").select(F.col("query_id").alias("frame"), F.lit(at).cast("long").alias("visible"), "fresh"))
    return reduce(DataFrame.unionByName, out)


def deadline_stream(spark: SparkSession, mem: DataFrame, edges: DataFrame | None, dim: int, rate_hz: int, frames: int, cfg: RetrievalConfig = RetrievalConfig(), run: str = "stream", limit_s: float = 600.0) -> DataFrame:
    """run, frame, ms: from the time at which a frame is due until its answer is written, of `frames` frames that a stream
    deals at rate_hz. A micro-batch takes all frames that are due. Answers and times go to the shared folder under the
    batch's id, so a batch that runs again replaces itself. Ends at limit_s with the frames answered by then."""
    root = f"{shared_root(spark).rstrip('/')}/deadline-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    done = [0]

    def answer(batch: DataFrame, batch_id: int) -> None:
        due = batch.where(F.col("value") < frames).select(F.col("value").alias("id"), "timestamp").persist()
        if n := due.count():
            retrieve(mem, edges, src.frame_vectors(due, dim), cfg).write.mode("overwrite").parquet(f"{root}/answers/b={batch_id}")
            late = (F.lit(time.time() * 1000) - F.unix_millis("timestamp")).alias("ms")
            due.select(F.lit(run).alias("run"), F.col("id").alias("frame"), late).write.mode("overwrite").parquet(f"{root}/times/b={batch_id}")
            done[0] += n
        due.unpersist()

    stream = spark.readStream.format("rate").option("rowsPerSecond", rate_hz).load().writeStream.foreachBatch(answer).option("checkpointLocation", f"{root}/offsets").start()
    began = time.perf_counter()
    while done[0] < frames and time.perf_counter() - began < limit_s and not stream.awaitTermination(0.2):
        pass
    stream.stop()
    schema = "run string, frame long, ms double"
    return spark.read.schema(schema).parquet(f"{root}/times/b=*") if done[0] else spark.createDataFrame([], schema)


def deadline_run(spark: SparkSession, n: int = 2000, dim: int = 768, rate_hz: int = 60, frames: int = 600, budget_ms: float = 1.0, cfg: RetrievalConfig = RetrievalConfig(), graph_config: GraphConfig = GraphConfig()) -> DataFrame:
    """The report of deadline_stream() over a synthetic corpus, one row: the configuration, n, misses, miss_rate, percentiles,
    mean, stddev, max and within."""
    mem = cut(src.benchmark_corpus(spark, n, dim))
    samples = cut(deadline_stream(spark, mem, graph.build(mem, graph_config) if cfg.max_hops else None, dim, rate_hz, frames, cfg))
    report = metrics.benchmark_report(samples, "ms", "run", budget_ms)
    head = {"rate_hz": rate_hz, "budget_ms": budget_ms, "frames": frames, "corpus_size": n, "embedding_dim": dim, "top_k": cfg.top_k, "max_hops": cfg.max_hops}
    return report.select(*[F.lit(v).alias(c) for c, v in head.items()], "n", "misses", "miss_rate", "p50", "p90", "p99", "p999", "p9999", "mean", "stddev", "max", "within")
