"""A store of memories: a log of insertions and deletions in Parquet, read as its latest state.

compact() turns the log into a base, one row a node, in folders by modality and day; what is committed after it is the delta.
The state is the base without the nodes of the delta, and the delta's latest rows; filters on modality and time therefore skip
folders of the base, and only the delta is reduced. A growing store adds edges with each insertion instead of rebuilding."""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.functions.vectors import normalize
from recollex.operators import graph
from recollex.operators.growing import GrowingGraph
from recollex.operators.maintain import latest
from recollex.plans.config import GraphConfig, RetrievalConfig
from recollex.plans.retrieve import retrieve
from recollex.sources.memories import MEMORY

LOG = MEMORY + ", batch_id long, seq long"
DAY = 86_400


class MemoryStore:
    """add, delete, query, stats, save, load. Each commit is one directory of the log, named by its batch, so a batch that
    runs again replaces itself; edges are rebuilt when the rule of needs_rebuild() says so."""

    def __init__(self, spark: SparkSession, path: str, dim: int | None = None, graph_config: GraphConfig = GraphConfig(), growing: bool = False) -> None:
        self.spark, self.path, self.dim, self.graph_config = spark, path.rstrip("/"), dim, graph_config
        self._edges: DataFrame | None = None
        self._built_at = 0
        self._growing = GrowingGraph(spark, f"{self.path}/graph", graph_config) if growing else None
        self._batch = self._last() + 1

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p, jvm

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the log's batches ("b") or of the whole bases ("base"), in order."""
        fs, p, jvm = self._fs()
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        found = [int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=")]
        if kind == "base":
            found = [n for n in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/base={n:012d}/_SUCCESS"))]
        return sorted(found)

    def _last(self) -> int:
        return max([-1, *self._numbers("b"), *self._numbers("base")])

    def commit(self, rows: DataFrame, batch_id: int | None = None) -> int:
        b = self._batch if batch_id is None else batch_id
        rows.withColumn("batch_id", F.lit(b).cast("long")).withColumn("seq", F.coalesce(F.col("seq"), F.lit(0)).cast("long") if "seq" in rows.columns else F.lit(0).cast("long")).selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in LOG.split(", ")]).write.mode("overwrite").parquet(f"{self.path}/b={b:012d}")
        self._batch = max(self._batch, b + 1)
        return b

    def add(self, rows: DataFrame, batch_id: int | None = None) -> int:
        """rows: node_id, embedding, modality, ts [, importance, seq]. Vectors are brought to unit length. Rows of another
        dimension aren't stored (see invalid())."""
        if self.dim is not None:
            rows = rows.where(F.size("embedding") == self.dim)
        if "importance" not in rows.columns:
            rows = rows.withColumn("importance", F.lit(1.0))
        b = self.commit(rows.withColumn("embedding", normalize("embedding").cast("array<float>")).withColumn("deleted", F.lit(False)), batch_id)
        if self._growing:
            self._growing.insert(self.spark.read.schema(LOG).parquet(f"{self.path}/b={b:012d}").select("node_id", "modality"), b)
        return b

    def invalid(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.size("embedding") != (self.dim or -1)).select("node_id", F.size("embedding").alias("dim")) if self.dim else rows.limit(0).select("node_id", F.lit(0).alias("dim"))

    def delete(self, ids: DataFrame, batch_id: int | None = None) -> int:
        """Unknown ids are ignored; adding a deleted id again brings it back."""
        return self.commit(self.state().join(ids.select("node_id").distinct(), "node_id", "left_semi").withColumn("deleted", F.lit(True)), batch_id)

    def state(self, modality: int | None = None, since: float | None = None, until: float | None = None) -> DataFrame:
        """The latest row of every node; with a modality or bounds of ts (inclusive), of those nodes only."""
        cols = [c.split()[0] for c in MEMORY.split(", ")]
        bases = self._numbers("base")
        after = [n for n in self._numbers("b") if not bases or n > bases[-1]]
        delta = latest(self.spark.read.schema(LOG).parquet(*[f"{self.path}/b={n:012d}" for n in after])).select(*cols) if after else self.spark.createDataFrame([], MEMORY)

        def asked(df: DataFrame) -> DataFrame:
            for on, holds in ((modality, F.col("modality") == modality), (since, F.col("ts") >= since), (until, F.col("ts") <= until)):
                df = df.where(holds) if on is not None else df
            return df.select(*cols)

        if not bases:
            return asked(delta)
        base = self.spark.read.schema(MEMORY + ", day long").parquet(f"{self.path}/base={bases[-1]:012d}")
        for at, holds in ((since, F.col("day") >= int((since or 0) // DAY)), (until, F.col("day") <= int((until or 0) // DAY))):
            base = base.where(holds) if at is not None else base
        base = asked(base)
        return base.join(delta.select("node_id"), "node_id", "left_anti").select(*cols).unionByName(asked(delta)) if after else base

    def memories(self, modality: int | None = None, since: float | None = None, until: float | None = None) -> DataFrame:
        return self.state(modality, since, until).where("not deleted")

    def needs_rebuild(self, n: int) -> bool:
        return self._edges is None or n >= 2 * max(1, self._built_at) or n - self._built_at > 1000

    def edges(self) -> DataFrame:
        if self._growing:
            return self._growing.edges(self.state().where("deleted").select("node_id"))
        mem = self.memories()
        n = mem.count()
        if self.needs_rebuild(n):
            self._edges, self._built_at = graph.build(mem, self.graph_config), n
        return self._edges

    def query(self, queries: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
        mem = self.memories() if cfg.max_hops else self.memories(cfg.modality_filter)  # hops pass through all modalities
        return retrieve(mem, self.edges() if cfg.max_hops else None, queries, cfg)

    def timed_query(self, queries: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> tuple[list, float]:
        t = time.perf_counter()
        rows = self.query(queries, cfg).orderBy("query_id", "rank").collect()
        return rows, (time.perf_counter() - t) * 1000

    def stats(self) -> DataFrame:
        s = self.state()
        e = self.edges().agg((F.count("*") / 2).cast("long").alias("edges"))
        return s.agg(F.count("*").alias("n"), F.sum(F.col("deleted").cast("long")).alias("deleted"), (F.sum(F.size("embedding")) * 4 / 1e6).alias("vector_mb")).join(F.broadcast(e))

    def save(self, path: str) -> None:
        self.state().write.mode("overwrite").parquet(path)

    def load(self, path: str) -> int:
        return self.commit(self.spark.read.schema(MEMORY).parquet(path))

    def compact(self) -> None:
        """Writes the state as a base and drops the batches and bases before it. A base counts once it is whole."""
        b = self._last()
        if b < 0:
            return
        day = F.floor(F.col("ts") / DAY)
        self.state().withColumn("day", day).repartition("modality", "day").write.mode("overwrite").partitionBy("modality", "day").parquet(f"{self.path}/base={b + 1:012d}")
        self._batch = max(self._batch, b + 2)
        fs, _, jvm = self._fs()
        for kind in ("b", "base"):
            for n in self._numbers(kind):
                if n <= b:
                    fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}={n:012d}"), True)

    def with_graph(self, cfg: GraphConfig) -> "MemoryStore":
        other = MemoryStore(self.spark, self.path, self.dim, cfg)
        other.graph_config = replace(cfg)
        return other
