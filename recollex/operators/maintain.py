"""Row updates: importance, edge counters, upserts, deletions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FADE, BOOST, MOST = 0.001, 0.1, 5.0


def importance_update(weights: DataFrame, retrieved: DataFrame, fade: float = FADE, boost: float = BOOST, most: float = MOST) -> DataFrame:
    """node_id, importance: all fade, then each retrieved node gains the boost once, up to the most."""
    hit = retrieved.select("node_id").distinct().withColumn("hit", F.lit(True))
    faded = F.col("importance") * F.lit(1 - fade)
    return weights.join(hit, "node_id", "left").select("node_id", F.when(F.col("hit"), F.least(faded + F.lit(boost), F.lit(most))).otherwise(faded).alias("importance"))


def edge_hits(edges: DataFrame, visited: DataFrame) -> DataFrame:
    """src, dst, hits of every edge: how often it led from a visited node back to one a hop nearer to the seeds. visited:
    query_id, node_id, hops."""
    child = visited.select("query_id", F.col("node_id").alias("src"), F.col("hops").alias("h_src"))
    parent = visited.select("query_id", F.col("node_id").alias("dst"), F.col("hops").alias("h_dst"))
    used = child.join(edges, "src").join(parent, ["query_id", "dst"]).where("h_dst = h_src - 1").groupBy("src", "dst").agg(F.count("*").alias("hits"))
    return edges.join(used, ["src", "dst"], "left").select("src", "dst", F.coalesce("hits", F.lit(0)).alias("hits"))


def low_utility(hits: DataFrame, least: int) -> DataFrame:
    return hits.where(F.col("hits") <= least)


def reset(hits: DataFrame) -> DataFrame:
    return hits.withColumn("hits", F.lit(0).cast("long"))


def rewire(edges: DataFrame, hits: DataFrame, retrieved: DataFrame, least: int) -> DataFrame:
    """src, dst without edges of low utility (in both directions), with edges between neighbours in rank of one answer."""
    used = hits.where(F.col("hits") > least)
    kept = edges.join(used.select("src", "dst").union(used.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), ["src", "dst"], "left_semi")
    a = retrieved.select("query_id", "rank", F.col("node_id").alias("src"))
    b = retrieved.select("query_id", (F.col("rank") - 1).alias("rank"), F.col("node_id").alias("dst"))
    new = a.join(b, ["query_id", "rank"]).where("src <> dst").select("src", "dst")
    return kept.union(new).union(new.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def latest(events: DataFrame, key: str = "node_id") -> DataFrame:
    """The last event of each key by batch_id, then seq; an aggregation, so tasks reduce before the shuffle."""
    cols = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct("batch_id", "seq")).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in cols])
