"""Exact greatest similarity with whole cells of memories left out.

Memories are dealt to the nearest of some centroids. By the triangle inequality for angles no memory of a cell is nearer to a
vector than the cell's centroid is, less the cell's radius; so a candidate first meets the cell of its nearest centroid, and
after that only cells whose bound is above what it found (for a gate: cells that may hold something above the threshold, and
only if none was found). Candidates and memories meet cell by cell in executors, large cells in parts.

Defined cases: memories and candidates whose vector is null, of another length than most memories' or holds null, NaN or
infinities take no part in a search; such candidates, and all candidates of an empty table, have 0; vectors needn't be of unit length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollex.functions.lineage import cut
from recollex.operators import cells, exchange
from recollex.operators.topk import MOST_SENT, whole_memories, whole_queries

#: Memories of a cell that a task sees at most.
PART = 200_000
#: Rows of candidates and cells that a task makes at once.
WANTED = 8192
#: Bounds are raised by this share of the vectors' lengths, above what rounding takes from them.
SLACK = 1e-9


class Cells:
    """Memories dealt to cells, with what bounds need: direction of the centroid, radius as an angle, least and greatest length."""

    def __init__(self, mem: DataFrame, n_cells: int | None = None) -> None:
        dims = (mem.groupBy(F.size("embedding").alias("d")).count().where("d > 0").orderBy(F.desc("count"), "d").first() or {"d": 1})["d"]
        finite = ~F.exists("embedding", lambda x: F.abs(x) == float("inf"))
        mem = whole_memories(mem.where(finite).withColumn("one", F.lit(0)).withColumn("ts", F.lit(0.0)), dims, "one")
        self.dims, n = dims, mem.count()
        c = cells.centroids(mem, n_cells or cells.sizes(n)[0]) if n else np.zeros((1, dims))
        length = np.linalg.norm(c, axis=1, keepdims=True)
        self.centers = centers = np.where(length > 0, c / np.where(length > 0, length, 1), np.eye(1, c.shape[1]))

        def place(batches):
            for b in batches:
                if b.num_rows:
                    e = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                    long = np.linalg.norm(e, axis=1)
                    cos = (e / np.where(long > 0, long, 1)[:, None]) @ centers.T
                    cell = cos.argmax(axis=1)
                    angle = np.arccos(np.clip(cos[np.arange(len(e)), cell], -1, 1))
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(angle), pa.array(long)], names=[*b.schema.names, "cell", "angle", "long"])

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in mem.schema)
        self.dealt = cut(mem.mapInArrow(place, fields + ", cell int, angle double, long double"))
        stats = self.dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("r"), F.min("long").alias("low"), F.max("long").alias("high")).collect()  # one row a cell: 1,024 at most
        self.n, self.radius, self.low, self.high = (np.zeros(len(centers)) for _ in range(4))
        for s in stats:
            self.n[s["cell"]], self.radius[s["cell"]], self.low[s["cell"]], self.high[s["cell"]] = s["n"], s["r"], s["low"], s["high"]

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """No memory of a cell has a greater product with q; -inf for empty cells."""
        long = np.linalg.norm(q, axis=1)[:, None]
        angle = np.arccos(np.clip(q @ self.centers.T / np.where(long > 0, long, 1), -1, 1))
        near = np.cos(np.maximum(0.0, angle - self.radius))
        best = long * np.where(near >= 0, self.high, self.low) * near + SLACK * (1 + long * self.high)
        return np.where(self.n > 0, best, -np.inf)

    def meet(self, wanted: DataFrame) -> DataFrame:
        """candidate_id, found: greatest product in the cells wanted (candidate_id, q, cell)."""
        spark, asked = wanted.sparkSession, {r["cell"]: r["n"] for r in wanted.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row a cell
        base, layout = 0, []
        for c, n in sorted(asked.items()):
            blocks, parts = int(-(-n * self.dims // MOST_SENT)), int(-(-self.n[c] // PART))
            layout.append((c, base, blocks, parts))
            base += blocks * parts
        if not layout:
            return spark.createDataFrame([], "candidate_id long, found double")
        sent = F.broadcast(spark.createDataFrame(layout, "cell int, base long, blocks int, parts int"))
        at = lambda n, each: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(each)
        left = wanted.join(sent, "cell").select("*", at("parts", "p")).select((F.col("base") + F.pmod(F.xxhash64("candidate_id"), F.col("blocks")) * F.col("parts") + F.col("p")).alias("slot"), F.col("candidate_id").alias("query_id"), "q", F.lit(0.0).alias("query_ts"))
        right = self.dealt.join(sent, "cell").select("*", at("blocks", "b")).withColumn("slot", F.col("base") + F.col("b") * F.col("parts") + F.pmod(F.xxhash64("node_id"), F.col("parts")))
        best = exchange.meet(left, right, 1, carry="one", parts=min(base, 4 * exchange.tasks(wanted)))
        return best.groupBy(F.col("query_id").alias("candidate_id")).agg(F.max("score").alias("found"))


def _cells_of(rows: DataFrame, index: Cells, first: bool, gate: float | None) -> DataFrame:
    """rows (candidate_id, q [, found]) with the cells that they have to meet: the one of the nearest centroid, or all others
    whose bound is above what was found."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            q = b.column("q").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            nearest = np.where(index_n > 0, q @ centers.T, -np.inf).argmax(axis=1)
            if first:
                row, cell = np.arange(len(q)), nearest
            else:
                found = b.column("found").to_numpy(zero_copy_only=False)
                need = bounds(q) > (found if gate is None else np.where(found > gate, np.inf, gate))[:, None]
                need[np.arange(len(q)), nearest] = False
                row, cell = np.nonzero(need)
            for low in range(0, len(row), WANTED):  # a candidate may want a thousand cells
                got = b.select(["candidate_id", "q"]).take(pa.array(row[low : low + WANTED]))
                yield got.append_column("cell", pa.array(cell[low : low + WANTED].astype(np.int32)))

    index_n, centers = index.n, index.centers
    frozen = object.__new__(Cells)  # what tasks need of it, without its tables
    frozen.centers, frozen.n, frozen.radius, frozen.low, frozen.high = index.centers, index.n, index.radius, index.low, index.high
    bounds = frozen.bounds
    return rows.mapInArrow(run, "candidate_id long, q array<double>, cell int")


def max_similarity(mem: DataFrame | Cells, candidates: DataFrame, gate: float | None = None) -> DataFrame:
    """candidate_id, max_sim, seen (memories that it met). With a gate max_sim is exact only up to it: above it, it says
    that there is one; below, that there is none."""
    index = mem if isinstance(mem, Cells) else Cells(mem)
    ids = candidates.select("candidate_id").distinct()
    finite = ~F.exists("q", lambda x: F.abs(x) == float("inf"))
    q = whole_queries(candidates.select(F.col("candidate_id").alias("query_id"), F.col("embedding").alias("q"), F.lit(0.0).alias("query_ts")), index.dims)
    q = cut(q.where(finite).dropDuplicates(["query_id"]).select(F.col("query_id").alias("candidate_id"), "q"))
    if not index.n.any():
        return ids.select("candidate_id", F.lit(0.0).alias("max_sim"), F.lit(0).cast("long").alias("seen"))
    one = cut(_cells_of(q, index, True, gate))
    found = cut(one.join(index.meet(one), "candidate_id"))
    two = cut(_cells_of(found.drop("cell"), index, False, gate))
    sizes = F.broadcast(mem_sizes(candidates, index))
    seen = one.select("candidate_id", "cell").unionByName(two.select("candidate_id", "cell")).join(sizes, "cell").groupBy("candidate_id").agg(F.sum("n").alias("seen"))
    best = found.select("candidate_id", "found").unionByName(index.meet(two)).groupBy("candidate_id").agg(F.max("found").alias("max_sim"))
    zero = F.lit(0).cast("long")
    return ids.join(best, "candidate_id", "left").join(seen, "candidate_id", "left").select("candidate_id", F.coalesce("max_sim", F.lit(0.0)).alias("max_sim"), F.coalesce("seen", zero).alias("seen"))


def mem_sizes(df: DataFrame, index: Cells) -> DataFrame:
    return df.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(index.n)], "cell int, n long")


def novel(mem: DataFrame | Cells, candidates: DataFrame, threshold: float) -> DataFrame:
    """candidate_id, accepted (no memory above the threshold), seen."""
    return max_similarity(mem, candidates, threshold).select("candidate_id", (F.col("max_sim") <= threshold).alias("accepted"), "seen")


def skipped(answers: DataFrame, index: Cells) -> float:
    """Share of all pairs of candidates and memories that weren't looked at."""
    n, seen = answers.agg(F.count("*"), F.sum("seen")).first()
    return 1 - (seen or 0) / max(1, n * int(index.n.sum()))
