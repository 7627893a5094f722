"""Memories from tables, files and generators."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMORY = "node_id long, embedding array<float>, modality int, ts double, importance double, deleted boolean"
#: Every memory whose id it divides is a query.
QUERY_STEP = 20
REQUEST = "cmd string, id long, modality int, embedding array<double>, timestamp double, top_k int, bfs_max_hops int, modality_filter int"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with the time of the event of the same id; modality by id."""
    e, v = read(spark, sf_dir, "embeddings"), read(spark, sf_dir, "events").select("event_id", "ts")
    ts = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts")
    return e.join(v, e["vec_id"] == v["event_id"]).select(F.col("vec_id").alias("node_id"), "embedding", (F.col("vec_id") % 3).cast("int").alias("modality"), ts, "label")


def queries(mem: DataFrame, ids: Sequence[int] | None = None, step: int = QUERY_STEP) -> DataFrame:
    """Memories as queries at the time of the latest memory: those of the ids given, or of all ids that step divides."""
    last = mem.agg(F.max("ts").alias("query_ts"))
    return mem.where(F.col("node_id") % step == 0 if ids is None else F.col("node_id").isin(list(ids))).select(F.col("node_id").alias("query_id"), F.col("embedding").alias("q")).join(F.broadcast(last))


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MEMORY).parquet(path)


def save(mem: DataFrame, path: str) -> None:
    mem.write.mode("overwrite").parquet(path)


def validate(mem: DataFrame, dim: int) -> DataFrame:
    """node_id, dim_ok, norm_ok (within 1e-4 of 1) of each row."""
    from recollex.functions.vectors import norm

    return mem.select("node_id", (F.size("embedding") == dim).alias("dim_ok"), (F.abs(norm("embedding") - 1) < 1e-4).alias("norm_ok"))


def requests(lines: DataFrame, column: str = "value") -> DataFrame:
    """Fields of JSON requests, one a row; absent fields are null."""
    return lines.select(F.from_json(column, REQUEST).alias("r")).select("r.*")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.sqrt((x * x).sum(axis=-1, keepdims=True)) + 1e-8)


def synthetic(spark: SparkSession, n_text: int, n_audio: int, n_image: int, dim: int, seed: int = 42, span: float = 1e7) -> DataFrame:
    """Rows around one mean a modality (half a standard normal), unit length, times uniform over span. Each row draws from a
    generator of its own id, so the rows don't depend on partitions."""
    means = [0.5 * np.random.default_rng([seed, 1 << 40, m]).standard_normal(dim) for m in range(3)]

    def rows(batches):
        for b in batches:
            m = np.where(b["id"] < n_text, 0, np.where(b["id"] < n_text + n_audio, 1, 2))
            vs, ts = [], []
            for i, k in zip(b["id"], m, strict=True):
                g = np.random.default_rng([seed, int(i)])
                vs.append(_unit(means[k] + g.standard_normal(dim)).astype(np.float32))
                ts.append(g.uniform(0, span))
            yield pd.DataFrame({"node_id": b["id"], "embedding": vs, "modality": m.astype(np.int32), "ts": ts, "importance": 1.0, "deleted": False})

    return spark.range(n_text + n_audio + n_image).mapInPandas(rows, MEMORY)


def benchmark_corpus(spark: SparkSession, n: int, dim: int, seed: int = 42) -> DataFrame:
    """Half text, a quarter audio, a quarter image."""
    return synthetic(spark, n - n // 4 - n // 4, n // 4, n // 4, dim, seed)


def frame_vectors(ids: DataFrame, dim: int, seed: int = 0x5EED0000) -> DataFrame:
    """query_id, q, query_ts of the frames in column id, which may be a stream: a unit query from the frame's own seed, at its time."""

    def rows(batches):
        for b in batches:
            yield pd.DataFrame({"query_id": b["id"], "q": [_unit(np.random.default_rng(seed + int(i)).standard_normal(dim)).astype(np.float32) for i in b["id"]], "query_ts": b["id"].astype(float)})

    return ids.select("id").mapInPandas(rows, "query_id long, q array<float>, query_ts double")


def frame_queries(spark: SparkSession, frames: int, dim: int, seed: int = 0x5EED0000) -> DataFrame:
    """One unit query a frame, from the frame's own seed, at the frame's time."""
    return frame_vectors(spark.range(frames), dim, seed)


def views(seen: DataFrame, dim: int, drift: float, seed: int = 42, tag: int = 10, key: str = "query_id", vector: str = "q") -> DataFrame:
    """seen (key, object_id ...) with a unit vector a row: that of its object in identity_stream(), turned by the drift. The
    drift is drawn from tag and key, so rows don't depend on partitions."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in seen.schema.fields)

    def gen(batches):
        for b in batches:
            vs = [_unit(_unit(np.random.default_rng([seed, 7, int(o)]).standard_normal(dim)) + drift / np.sqrt(dim) * np.random.default_rng([seed, tag, int(i)]).standard_normal(dim)).astype(np.float32) for i, o in zip(b[key], b["object_id"], strict=True)]
            yield b.assign(**{vector: vs})

    return seen.mapInPandas(gen, f"{fields}, {vector} array<float>")


def identity_stream(spark: SparkSession, rows: int, identities: int, dim: int, drift: float, seconds_per_row: float, seed: int = 42, shares: tuple[float, float, float] = (0, 0, 1), scaled: bool = True) -> DataFrame:
    """A sensor that sees identities again: unit(base of identity + drift * normal). scaled divides the drift by the root of
    dim, so that it is an angle rather than growing with dim. object_id is the identity; shares are of modalities."""
    scale = drift / np.sqrt(dim) if scaled else drift
    cuts = np.cumsum(shares)

    def gen(batches):
        for b in batches:
            who = b["id"].to_numpy() % identities
            vs = [_unit(_unit(np.random.default_rng([seed, 7, int(w)]).standard_normal(dim)) + scale * np.random.default_rng([seed, 8, int(i)]).standard_normal(dim)).astype(np.float32) for i, w in zip(b["id"], who, strict=True)]
            m = np.minimum(np.searchsorted(cuts, (who + 0.5) / identities), 2).astype(np.int32)
            yield pd.DataFrame({"node_id": b["id"], "embedding": vs, "modality": m, "ts": b["id"] * seconds_per_row, "importance": 1.0, "deleted": False, "object_id": who})

    return spark.range(rows).mapInPandas(gen, MEMORY + ", object_id long")


def background(spark: SparkSession, rows: int, dim: int, seed: int = 42) -> DataFrame:
    """Unit vectors that belong to no identity."""
    return frame_queries(spark, rows, dim, seed).select(F.col("query_id").alias("node_id"), F.col("q").alias("embedding"))


def detections(spark: SparkSession, frames: int, per_frame: int, objects: int, dim: int, noise: float = 0.15, rate: float = 60.0, seed: int = 42) -> DataFrame:
    """per_frame distinct objects a frame, modality by object (60 / 20 / 20)."""
    seen = spark.range(frames).select(F.col("id").alias("frame"), F.explode(F.sequence(F.lit(0), F.lit(per_frame - 1))).alias("slot"))
    seen = seen.select("frame", (F.col("frame") * per_frame + F.col("slot")).alias("id"), ((F.pmod(F.xxhash64("frame", F.lit(seed)), F.lit(objects)) + F.col("slot") * max(1, objects // per_frame)) % objects).alias("object_id"))

    def gen(batches):
        for b in batches:
            vs = [_unit(_unit(np.random.default_rng([seed, 7, int(o)]).standard_normal(dim)) + noise / np.sqrt(dim) * np.random.default_rng([seed, 9, int(i)]).standard_normal(dim)).astype(np.float32) for i, o in zip(b["id"], b["object_id"], strict=True)]
            m = np.select([b["object_id"] < 0.6 * objects, b["object_id"] < 0.8 * objects], [0, 1], 2).astype(np.int32)
            yield pd.DataFrame({"node_id": b["id"], "embedding": vs, "modality": m, "ts": b["frame"] / rate, "importance": 1.0, "deleted": False, "object_id": b["object_id"]})

    return seen.mapInPandas(gen, MEMORY + ", object_id long")
