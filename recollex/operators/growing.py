"""A shortcut graph that grows: insertions add edges and change none.

Nodes have a place in the order of their insertion, and every edge of a node leads to nodes before it: ring and skips by
distance, hubs at square places, rewired pairs, and bridges to a drawn earlier node of each other modality. So what a batch
adds depends on its own rows, on the counts before it, and on where its drawn targets are; the edges of all batches are those
of one build over the same order. Ids and edges are a log of Parquet folders, one a batch; a batch that runs again replaces
itself. Deleted nodes keep their place and lose their edges when edges are read.

Defined cases: ids that are in the graph already, repeated ones in a batch (the smallest modality counts) and null ids add
nothing; a null modality is one of its own, -1; an empty batch adds an empty folder; the first node has no edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.functions.lineage import materialize
from recollex.functions.vectors import draw
from recollex.operators.prefix import running
from recollex.plans.config import GraphConfig

IDS = "node_id long, modality int, idx long, place long"
EDGES = "src long, dst long"


def order(mem: DataFrame, n: int, of_modality: dict[int, int]) -> DataFrame:
    """IDS of the new nodes after n others, of which of_modality counts each modality's, and before: how many nodes of each
    modality come earlier."""
    new = mem.where("node_id is not null").groupBy("node_id").agg(F.min(F.coalesce(F.col("modality").cast("int"), F.lit(-1))).alias("modality"))
    kinds = sorted({r["modality"] for r in new.select("modality").distinct().collect()} | set(of_modality))  # one row a modality
    ones = [f"is_{i}" for i in range(len(kinds))]
    rows = new.withColumn("one", F.lit(1).cast("long")).withColumn("all", F.lit(0))
    for c, m in zip(ones, kinds, strict=True):
        rows = rows.withColumn(c, (F.col("modality") == m).cast("long"))
    out = running(rows, "all", ["node_id"], sums=["one", *ones])
    earlier = F.map_from_arrays(F.array(*[F.lit(m) for m in kinds] or [F.lit(0)]), F.array(*[F.col(f"{c}_upto") - F.col(c) + of_modality.get(m, 0) for c, m in zip(ones, kinds, strict=True)] or [F.lit(0).cast("long")]))
    out = out.withColumn("before", earlier)
    return out.select("node_id", "modality", (F.col("one_upto") - 1 + n).alias("idx"), F.element_at("before", F.col("modality")).alias("place"), "before")


def edges_of(new: DataFrame, ids: DataFrame, cfg: GraphConfig = GraphConfig()) -> DataFrame:
    """src, dst, one way, of the nodes in `new` (see order()) to nodes before them. ids: all nodes so far, `new` among them."""
    i = F.col("idx")
    log2 = lambda c: F.floor(F.log2(c + 0.5)).cast("int")
    to = lambda tag, e: draw(tag, i, e, cfg.seed) % i
    ring = new.select("node_id", "idx", F.explode(F.sequence(F.lit(1), F.lit(max(1, cfg.k // 2)))).alias("j")).where("idx - j >= 0")
    lost = draw("coin", i, F.col("j"), cfg.seed) / F.lit(4294967296.0) < cfg.p if cfg.rewire else F.lit(False)
    parts = []
    if cfg.ring:
        parts.append(ring.select("node_id", F.when(lost, to("rewire", F.col("j"))).otherwise(i - F.col("j")).alias("at")))
    if cfg.skips:
        levels = new.where("idx > 1").select("node_id", "idx", F.explode(F.sequence(F.lit(1), log2(i))).alias("l")).withColumn("step", F.expr("shiftleft(1L, l)"))
        parts.append(levels.where("idx % step = 0").select("node_id", (i - F.col("step")).alias("at")))
    if cfg.hubs:
        root = F.round(F.sqrt(i)).cast("long")
        hub = new.where((i > 0) & (root * root == i)).select("node_id", "idx", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(2), (log2(i) / 2).cast("int")))).alias("e"))
        parts.append(hub.select("node_id", to("hub", F.col("e")).alias("at")))
    none = new.sparkSession.createDataFrame([], EDGES)
    found = none
    if parts:
        wanted = parts[0]
        for p in parts[1:]:
            wanted = wanted.unionByName(p)
        found = wanted.distinct().join(ids.select(F.col("idx").alias("at"), F.col("node_id").alias("dst")), "at").select(F.col("node_id").alias("src"), "dst")
    if cfg.bridges:
        other = new.select("node_id", "idx", "modality", F.explode("before").alias("m", "c")).where("m <> modality AND c > 0")
        wanted = other.select("node_id", "m", (draw("bridge", i, F.col("m"), cfg.seed) % F.col("c")).alias("place"))
        found = found.unionByName(wanted.join(ids.select(F.col("modality").alias("m"), "place", F.col("node_id").alias("dst")), ["m", "place"]).select(F.col("node_id").alias("src"), "dst"))
    return found.distinct()


class GrowingGraph:
    """The log of ids and edges under a path of the shared folder."""

    def __init__(self, spark: SparkSession, path: str, cfg: GraphConfig = GraphConfig()) -> None:
        self.spark, self.path, self.cfg = spark, path.rstrip("/"), cfg

    def _read(self, what: str, schema: str, before: int | None = None) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        at = [f"{self.path}/{what}/{n}" for n in names if n.startswith("b=") and (before is None or int(n[2:]) < before)]
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def insert(self, mem: DataFrame, batch: int) -> None:
        """Adds nodes (node_id, modality) as batch number `batch`; batches are inserted in the order of their numbers."""
        old = self._read("ids", IDS, batch)
        counts = {r["modality"]: r["n"] for r in old.groupBy("modality").agg(F.count("*").alias("n")).collect()}  # one row a modality
        fresh = mem.select("node_id", "modality").join(old.select("node_id"), "node_id", "left_anti")
        new = materialize(order(fresh, sum(counts.values()), counts), "growing")
        ids = new.select("node_id", "modality", "idx", "place")
        ids.write.mode("overwrite").parquet(f"{self.path}/ids/b={batch:012d}")
        edges_of(new, old.unionByName(ids), self.cfg).write.mode("overwrite").parquet(f"{self.path}/edges/b={batch:012d}")

    def ids(self) -> DataFrame:
        return self._read("ids", IDS)

    def edges(self, gone: DataFrame | None = None) -> DataFrame:
        """src, dst both ways, without those of the nodes in gone (node_id)."""
        one = self._read("edges", EDGES)
        if gone is not None:
            for end in ("src", "dst"):
                one = one.join(gone.select(F.col("node_id").alias(end)), end, "left_anti")
        return one.select("src", "dst").union(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
