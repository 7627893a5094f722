"""Retrieval: similarity, decay, seeds, expansion, and the best of what was reached."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollex.functions.vectors import normalize
from recollex.operators import expand, graph, topk
from recollex.plans.config import ABLATIONS, TEXT, RetrievalConfig


def retrieve(mem: DataFrame, edges: DataFrame | None, queries: DataFrame, cfg: RetrievalConfig = RetrievalConfig(), seeds: DataFrame | None = None) -> DataFrame:
    """query_id, rank, node_id, score, modality, hops. Deleted memories are neither seeds nor passed nor returned. seeds: what
    topk() finds by cfg, where the caller has it already."""
    if "deleted" in mem.columns:
        mem = mem.where(~F.coalesce("deleted", F.lit(False)))
    if cfg.normalize_query:
        queries = queries.withColumn("q", normalize("q"))
    queries = queries.select("query_id", "q", "query_ts")
    where = F.col("modality") == cfg.modality_filter if cfg.modality_filter is not None else None
    if seeds is None:
        seeds = topk.topk(mem, queries, cfg.top_k, rate=cfg.time_decay, where=where, importance=cfg.use_importance)
    if edges is None or cfg.max_hops == 0:
        reached = seeds.withColumn("hops", F.lit(0))
    else:
        reached = expand.expand(seeds, edges, mem, queries, cfg)
    if where is not None and cfg.modality_filter_scope == "results":
        reached = reached.where(where)
    return topk.best(reached, cfg.top_k).select("query_id", "rank", "node_id", "score", "modality", "hops")


def ablation(mem: DataFrame, queries: DataFrame, name: str, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    g, hops = ABLATIONS[name]
    edges = graph.build(mem, g) if hops else None
    return retrieve(mem, edges, queries, replace(cfg, max_hops=hops))


#: The score from which an object counts that was hidden before.
OCCLUDED_HIT = 0.70
#: Name to configuration and the score from which a result counts as a hit.
DEMOS = {
    "av": (RetrievalConfig(10, 2, 1e-6), 0.75),
    "robot": (RetrievalConfig(5, 1, 1e-3), 0.70),
    "ar": (RetrievalConfig(20, 2, 1e-7), 0.65),
    "voice": (RetrievalConfig(15, 2, 1e-5, hop_decay=0.6), 0.60),
}


def demo_hit(name: str, threshold: float, hidden: Column | None = None) -> Column:
    """Whether a row of an answer makes it a hit; in "av" a lower score is enough for what was hidden."""
    score = F.col("score")
    if name == "av":
        return (F.col("rank") == 1) & (score > (threshold if hidden is None else F.when(hidden, OCCLUDED_HIT).otherwise(threshold)))
    if name == "robot":
        return (F.col("rank") == 1) & (score > threshold)
    return (F.col("modality") == TEXT) & (score > threshold) if name == "voice" else score > threshold
