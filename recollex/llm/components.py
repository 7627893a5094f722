"""Connected components of an edge table, by alternating large-star and small-star rounds.

A vertex with more than a HOT_PARTS-th of all edges is the hub of so many that a join by vertex would put them into one
task. There are at most 2 * HOT_PARTS such vertices, so what their edges need is sent to all tasks instead.

Defined cases: edges with a null end and loops are left out; repeated edges count once; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Edges per file of a round's table; a round that has few left writes few files.
FILE_EDGES = 250_000
HOT_PARTS, HOT_LEAST = 1024, 128


def _by_vertex(edges: DataFrame, least: DataFrame, hot: int) -> DataFrame:
    """edges with the m of their u in least (u, m, n). n adds up to twice the edges, so few u have more than `hot`."""
    hubs = [(r["u"], r["m"]) for r in least.where(F.col("n") > hot).collect()]
    joined = edges.join(least.select("u", "m"), "u")
    if not hubs:
        return joined
    sent = F.broadcast(edges.sparkSession.createDataFrame(hubs, "u long, m long"))
    return edges.join(sent, "u").unionByName(edges.join(sent, "u", "left_anti").join(least.where(F.col("n") <= hot).select("u", "m"), "u"))


def connected_components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """edges: a, b (longs). Returns v, root for every vertex of an edge with a <> b; root is the component's smallest."""
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    seen, left = None, e.count()
    for _ in range(most_rounds):
        # Large star: every larger neighbour goes to the least of the neighbours and itself.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        big = _by_vertex(both.where("v > u"), least, max(HOT_LEAST, 2 * left // HOT_PARTS)).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a vertex and its smaller neighbours go to the least of them.
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(small.coalesce(1 + left // FILE_EDGES), "cc")  # a round never adds edges
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen, left = now, now[0]
    else:
        raise RuntimeError(f"components had not settled after {most_rounds} rounds")
    stars = e.groupBy("u").agg(F.min("v").alias("root"))
    return stars.select(F.col("u").alias("v"), "root").union(stars.select(F.col("root").alias("v"), "root").distinct()).coalesce(1 + left // FILE_EDGES)
