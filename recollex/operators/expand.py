"""Breadth-first expansion of seeds over the graph, level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollex.functions.lineage import cut
from recollex.functions.vectors import blended
from recollex.operators import exchange, topk
from recollex.plans.config import RetrievalConfig


def own_scores(reached: DataFrame, mem: DataFrame, queries: DataFrame, cfg: RetrievalConfig, grid: tuple[int, int, int]) -> DataFrame:
    """reached with modality and the node's own final score (null where the seed filter leaves it out). Only nodes that
    a hop reaches are scored. grid: see layout()."""
    weight: Column = F.coalesce(F.col("importance"), F.lit(1.0)).cast("double") if cfg.use_importance else F.lit(1.0)
    held = mem.select("node_id", "embedding", "ts", "modality", weight.alias("weight"))
    own: Column = F.col("own")
    if cfg.modality_filter is not None:
        own = F.when(F.col("modality") == cfg.modality_filter, own)
    return exchange.score(reached, queries, held, *grid, rate=cfg.time_decay).withColumn("own", own)


def layout(mem: DataFrame, queries: DataFrame) -> tuple[int, int, int]:
    """Length of the queries' vectors, blocks of queries, and columns of memories: a task holds one of each."""
    n, dims = queries.agg(F.count("*"), F.coalesce(F.mode(F.size("q")), F.lit(1))).first()
    dims, size = max(1, dims), lambda rows: max(1, -(-rows * max(1, dims) // topk.MOST_SENT))
    blocks = size(n)
    return dims, blocks, max(size(mem.count()), exchange.wide(mem, blocks))


def expand(seeds: DataFrame, edges: DataFrame, mem: DataFrame, queries: DataFrame, cfg: RetrievalConfig) -> DataFrame:
    """query_id, node_id, score, modality, hops of seeds and all nodes within cfg.max_hops; a node takes the best parent of
    the level that first reaches it; the expansion ends where a level is empty. mem holds the nodes that may be passed. The last
    level isn't written: who reads the result more than once should."""
    if cfg.max_hops < 1:
        return seeds.select("query_id", "node_id", "score", "modality", F.lit(0).alias("hops"))
    grid = layout(mem, queries)
    visited = cut(seeds.select("query_id", "node_id", "score", "modality", F.lit(0).alias("hops")))
    front = visited
    for h in range(1, cfg.max_hops + 1):
        steps = front.join(edges, front["node_id"] == edges["src"]).select("query_id", F.col("dst").alias("node_id"), F.col("score").alias("parent"))
        new = steps.groupBy("query_id", "node_id").agg(F.max("parent").alias("parent")).join(visited.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
        front = own_scores(new, mem, queries, cfg, grid).select("query_id", "node_id", blended(F.col("parent"), F.col("own"), cfg.hop_decay, cfg.own_weight).alias("score"), "modality", F.lit(h).alias("hops"))
        if h == cfg.max_hops:
            return visited.union(front)
        front = cut(front)  # it is read twice: by the next level, and as part of what was visited
        if front.isEmpty():
            break
        visited = visited.union(front)
    return visited
