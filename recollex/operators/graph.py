"""The shortcut graph: ring, skips, hubs, rewiring and bridges between modalities."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollex.functions.lineage import cut
from recollex.functions.vectors import draw
from recollex.plans.config import GraphConfig


def ranked(df: DataFrame, order: str, name: str, group: str | None = None) -> DataFrame:
    """df with dense places from 0 by `order` (within group): rows are ranked inside range partitions and shifted by the
    counts of those before, so no single task sees all rows. The ranges come from a sample, which another run of the same plan
    may draw otherwise; so rows are written with their ranges, and rows and counts are read from there."""
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    df = cut(df.repartitionByRange(int(parts), order).withColumn("_part", F.spark_partition_id()).withColumn("_g", F.col(group) if group else F.lit(0)))
    inside = df.withColumn("_in", F.row_number().over(W.partitionBy("_part", "_g").orderBy(order)) - 1)
    counts = inside.groupBy("_part", "_g").agg(F.count("*").alias("_n"))
    before = counts.select("_part", "_g", F.coalesce(F.sum("_n").over(W.partitionBy("_g").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return inside.join(before, ["_part", "_g"]).withColumn(name, (F.col("_in") + F.col("_before")).cast("long")).drop("_part", "_g", "_in", "_before")


def pairs(df: DataFrame) -> DataFrame:
    """Undirected: a < b, distinct, no loops."""
    return df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def symmetric(df: DataFrame) -> DataFrame:
    """src, dst both ways of pairs a, b."""
    p = pairs(df)
    return p.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(p.select(F.col("b").alias("src"), F.col("a").alias("dst")))


def ring(ids: DataFrame, n: int, k: int) -> DataFrame:
    return ids.select(F.col("idx").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(max(1, k // 2)))).alias("j")).select("a", ((F.col("a") + F.col("j")) % n).alias("b"))


def skips(ids: DataFrame, n: int) -> DataFrame:
    levels = ids.select("idx", F.explode(F.sequence(F.lit(1), F.lit(max(1, int(math.log2(n)) if n > 1 else 1)))).alias("l")).withColumn("step", F.expr("shiftleft(1L, l)"))
    return levels.where("idx % step = 0").select(F.col("idx").alias("a"), ((F.col("idx") + F.col("step")) % n).alias("b"))


def hubs(ids: DataFrame, n: int, seed: int) -> DataFrame:
    many = max(2, int(math.log2(max(2, n))) // 2)
    at = ids.where(F.col("idx") % max(1, math.isqrt(n)) == 0).select(F.col("idx").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(many))).alias("e"))
    return at.select("a", (draw("hub", F.col("a"), F.col("e"), seed) % n).alias("b"))


def rewired(ids: DataFrame, n: int, k: int, p: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Ring pairs that lose their edge, and the edges that replace them."""
    drawn = ids.select(F.col("idx").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(max(1, k // 2)))).alias("j")).where(draw("coin", F.col("a"), F.col("j"), seed) / F.lit(4294967296.0) < p)
    return drawn.select("a", ((F.col("a") + F.col("j")) % n).alias("b")), drawn.select("a", (draw("rewire", F.col("a"), F.col("j"), seed) % n).alias("b"))


def bridges(mem: DataFrame, seed: int) -> DataFrame:
    """mem: idx, modality. From each node to a drawn node of each other modality that has any."""
    sizes = [(r["modality"], r["n"]) for r in mem.groupBy("modality").agg(F.count("*").alias("n")).collect()]  # one row a modality
    placed = ranked(mem.select("idx", "modality"), "idx", "place", "modality").select(F.col("idx").alias("b"), F.col("modality").alias("m2"), "place")
    other = F.broadcast(mem.sparkSession.createDataFrame(sizes or [(0, 0)], "m int, n long").where("n > 0"))
    wanted = mem.join(other, mem["modality"] != other["m"]).select(F.col("idx").alias("a"), "m", (draw("bridge", F.col("idx"), F.col("m"), seed) % F.col("n")).alias("want"))
    return wanted.join(placed, (wanted["m"] == placed["m2"]) & (wanted["want"] == placed["place"])).select("a", "b")


def build(mem: DataFrame, cfg: GraphConfig = GraphConfig()) -> DataFrame:
    """src, dst (node ids), both ways, written once: the graph is an index that many queries read. Rewiring takes pairs away from ring, skips and hubs, and bridges come last."""
    ids = cut(ranked(mem.select("node_id", "modality"), "node_id", "idx"))
    n = ids.count()
    none = mem.sparkSession.createDataFrame([], "a long, b long")
    if n < 2:
        return none.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    first = none
    for on, part in ((cfg.ring, lambda: ring(ids, n, cfg.k)), (cfg.skips, lambda: skips(ids, n)), (cfg.hubs, lambda: hubs(ids, n, cfg.seed))):
        if on:
            first = first.union(part())
    edges = pairs(first)
    if cfg.rewire and cfg.ring:
        gone, new = rewired(ids, n, cfg.k, cfg.p, cfg.seed)
        edges = edges.join(pairs(gone), ["a", "b"], "left_anti").union(new)
    if cfg.bridges:
        edges = edges.union(bridges(ids, cfg.seed))
    back = ids.select(F.col("idx"), "node_id")
    s = symmetric(edges)
    return cut(s.join(back.select(F.col("idx").alias("src"), F.col("node_id").alias("s")), "src").join(back.select(F.col("idx").alias("dst"), F.col("node_id").alias("d")), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst")))


def store(edges: DataFrame, mem: DataFrame, name: str, path: str, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Edges by source and memories by id as tables of as many buckets, `<name>_edges` and `<name>_memories` under path: a hop
    then shuffles its frontier only, to the buckets, and neither edges nor vectors."""
    for what, df, key in (("edges", edges, "src"), ("memories", mem, "node_id")):
        df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).option("path", f"{path.rstrip('/')}/{name}_{what}").saveAsTable(f"{name}_{what}")
    return mem.sparkSession.table(f"{name}_edges"), mem.sparkSession.table(f"{name}_memories")


def rows(edges: DataFrame) -> DataFrame:
    """src, neighbors: sorted targets of each node."""
    return edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("neighbors"))


def degree_stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").count().agg(F.max("count").alias("max_degree"), F.avg("count").alias("avg_degree"), F.count("*").alias("nodes"))


def summary(mem: DataFrame, edges: DataFrame, dim: int) -> DataFrame:
    """Sizes of a corpus in one row."""
    by = lambda m: F.sum((F.col("modality") == m).cast("long"))
    a = mem.agg(F.count("*").alias("n"), by(0).alias("n_text"), by(1).alias("n_audio"), by(2).alias("n_image"))
    e = edges.agg(F.count("*").alias("directed"))
    return a.join(F.broadcast(e)).select("n", (F.col("directed") / 2).cast("long").alias("edges"), F.lit(dim).alias("dim"), (F.col("directed") / F.col("n")).alias("avg_degree"), "n_text", "n_audio", "n_image", (F.col("n") * (4 * dim + 8) + 4 * (F.col("n") + 1 + F.col("directed"))).cast("long").alias("bytes"))
