"""Search of the nearest cells only: memories are dealt to the nearest of some centroids, queries look into few cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollex.functions.vectors import dot
from recollex.operators.metrics import recall_at_k
from recollex.operators.topk import best

#: Vectors that the centroids are fitted on, whatever the size; every memory is dealt to a cell.
SAMPLE = 100_000
#: Bytes of queries that may be sent to every task; more are joined by cell, with each cell's memories split.
MOST_SENT = 64 << 20
SPLIT = 16


def sizes(n: int) -> tuple[int, int]:
    """Cells and cells probed for n memories."""
    cells = max(1, min(int(n ** 0.5), 1024))
    return cells, max(1, min(cells // 4, 64))


def centroids(mem: DataFrame, cells: int, seed: int = 42, sample: int = SAMPLE) -> np.ndarray:
    """Centroids of the memories with the `sample` smallest hashes of their ids: at most 1,024 rows, kept on the driver."""
    rows = mem.orderBy(F.xxhash64("node_id")).limit(sample).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return np.array(KMeans(k=cells, seed=seed, maxIter=10).fit(rows).clusterCenters())


def _near(df: DataFrame, vector: str, centers: np.ndarray, probes: int) -> DataFrame:
    """df with cells: the `probes` of greatest inner product, ties to the smaller."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches):
        for b in batches:
            if b.num_rows:
                e = b.column(vector).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                top = np.argsort(-(e @ centers.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(top))], names=[*b.schema.names, "cells"])

    return df.mapInArrow(run, fields + ", cells array<int>")


def assign(mem: DataFrame, centers: np.ndarray) -> DataFrame:
    """mem with cell."""
    return _near(mem, "embedding", centers, 1).withColumn("cell", F.col("cells")[0]).drop("cells")


def search(dealt: DataFrame, queries: DataFrame, centers: np.ndarray, probes: int, k: int) -> DataFrame:
    """query_id, rank, node_id, score: the k best among memories of the query's nearest cells. dealt: see assign()."""
    wanted = _near(queries.select("query_id", "q"), "q", centers, probes).select("query_id", "q", F.explode("cells").alias("cell"))
    if queries.count() * probes * (centers.shape[1] * 8 + 32) <= MOST_SENT:
        pairs = dealt.join(F.broadcast(wanted), "cell")
    else:
        part = F.pmod(F.xxhash64("node_id"), F.lit(SPLIT)).cast("int")
        pairs = dealt.withColumn("part", part).join(wanted.withColumn("part", F.explode(F.array(*map(F.lit, range(SPLIT))))), ["cell", "part"])
    return best(pairs.select("query_id", "node_id", dot("embedding", "q").alias("score")), k).select("query_id", "rank", "node_id", "score")


def probes_for(dealt: DataFrame, queries: DataFrame, exact: DataFrame, centers: np.ndarray, k: int, least: float = 0.9, step: int = 1) -> int:
    """The first of step, 2 * step, 3 * step ... probes with a mean recall of `exact` (the queries' k best by a whole search) of
    `least` or more, one search each. All cells give a whole search, so there is one."""
    for probes in range(step, len(centers), step):
        if (recall_at_k(search(dealt, queries, centers, probes, k), exact, k).agg(F.avg("recall")).first()[0] or 0.0) >= least:
            return probes
    return len(centers)
