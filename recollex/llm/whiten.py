"""Whitening of embeddings over exact integers.

Components become integers x; the fit list is each distinct x vector once. Sums are exact, so are centred rows (n * x - S, then
one division); MLlib's RowMatrix multiplies them in Spark, the small covariance is taken apart in the driver, and the
whitening matrix, dims x components, goes to all tasks.

Defined cases: rows whose vector is null, empty, of another length than most vectors' (the shorter of two equally frequent
ones), or holds null or non-finite entries or ones beyond 2 ** 40 are left out; null vec_id stays null; repeated rows and ids
are rows each, and count once in the fit; directions without variance (eigenvalue below 1e-12 of the trace) have no component,
so a table of equal vectors has no rows; an empty table has none; a deviation beyond 64 bits is null; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SCALE, SHIFT, MOST_ENTRY = 64, 1_000_000, float(1 << 40)
LEAST = 1e-12


def integers(embeddings: DataFrame) -> DataFrame:
    """vec_id, x (longs) of the whole vectors."""
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > MOST_ENTRY))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("size(embedding) > 0").where(~bad)
    size = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("embedding") == (size["d"] if size else 0)).select("vec_id", F.transform("embedding", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def totals(fit: DataFrame) -> tuple[int, list[int]]:
    """Rows and exact sums by dimension: a row of sums a task, added up by Spark."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_pylist([{"n": b.num_rows, "s": x.sum(axis=0).tolist()}], pa.schema([("n", pa.int64()), ("s", pa.list_(pa.int64()))]))

    part = fit.select("x").mapInArrow(run, "n long, s array<long>").select("n", F.posexplode("s").alias("i", "s"))
    by = part.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()  # one row a dimension
    return (int(by[0]["n"]) if by else 0), [int(r["s"]) for r in by]


def gramian(rows: DataFrame, column: str) -> np.ndarray:
    """Sum of products of all pairs of dimensions, over the rows of a column of arrays, by MLlib."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact: 64 bits where they hold it, Python's integers elsewhere."""
    wide = n * max(1, int(np.abs(x).max(initial=0))) >= 1 << 62
    return x.astype(object) * n - sums.astype(object) if wide else x * n - sums


def _deviation(c: np.ndarray) -> list[int | None]:
    if c.dtype != object and len(c) and c.shape[1] * int(np.abs(c).max()) ** 2 < 1 << 63:
        return (c * c).sum(axis=1).tolist()
    sums = [sum(int(v) ** 2 for v in row) for row in c]
    return [s if s < 1 << 63 else None for s in sums]


def whiten(embeddings: DataFrame, components: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error; see the contract of the query."""
    spark = embeddings.sparkSession
    rows = materialize(integers(embeddings), "whiten-rows")
    fit = materialize(rows.select("x").distinct(), "whiten-fit")
    n, sums = totals(fit)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n:
        return spark.createDataFrame([], schema)
    total = np.array(sums, dtype=np.int64 if max(map(abs, sums)) < 1 << 62 else object)

    def centre(batches):
        for pdf in batches:
            yield pd.DataFrame({"c": list(_centred(np.stack(pdf["x"]), n, total).astype(np.float64) / n) if len(pdf) else []})

    centred = materialize(fit.mapInPandas(centre, "c array<double>"), "whiten-centred")
    v = gramian(centred, "c") / n
    e, vectors = np.linalg.eigh((v + v.T) / 2)
    trace = float(np.trace(v))
    order = [i for i in np.argsort(-e, kind="stable") if e[i] > LEAST * trace][:components]
    if not order:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast((vectors[:, order] / np.sqrt(e[order]), e[order] / trace))

    def project(batches):
        w = sent.value[0]
        for pdf in batches:
            yield pd.DataFrame({"w": list(np.stack(pdf["c"]) @ w) if len(pdf) else []})

    error = float(np.abs(gramian(centred.mapInPandas(project, "w array<double>"), "w") / n - np.eye(len(order))).max())

    def run(batches):
        w, explained = sent.value
        k = len(explained)
        for pdf in batches:
            if not len(pdf):
                continue
            c = _centred(np.stack(pdf["x"]), n, total)
            at = np.repeat(np.arange(len(pdf)), k)
            yield pd.DataFrame({
                "vec_id": pdf["vec_id"].to_numpy()[at], "no_id": pdf["no_id"].to_numpy()[at], "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(pdf)), "n": np.int64(n),
                "deviation": pd.array(_deviation(c), dtype="Int64")[at], "whitened": ((c.astype(np.float64) / n) @ w).ravel(), "explained": np.tile(explained, len(pdf)), "identity_error": error,
            })

    # A null id would make pandas turn all ids of its batch to floats.
    known = rows.select(F.coalesce("vec_id", F.lit(0)).alias("vec_id"), F.col("vec_id").isNull().alias("no_id"), "x")
    out = known.mapInPandas(run, schema.replace("component", "no_id boolean, component"))
    return out.withColumn("vec_id", F.when(~F.col("no_id"), F.col("vec_id"))).drop("no_id")
