"""Quality and latency metrics over answers (query_id, rank, node_id, score, modality ...)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollex.operators.prefix import running

PERCENTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999, "p9999": 0.9999}


def recall_at_k(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """query_id, recall: share of the k true nodes, or of those that there are, that the answer has."""
    hit = results.select("query_id", "node_id").join(truth.select("query_id", "node_id"), ["query_id", "node_id"], "left_semi").groupBy("query_id").count()
    of = truth.groupBy("query_id").agg(F.least(F.count("*"), F.lit(k)).alias("of"))
    return of.join(hit, "query_id", "left").select("query_id", (F.coalesce("count", F.lit(0)) / F.col("of").cast("double")).alias("recall"))


def cross_modal_rate(results: DataFrame, top: int) -> DataFrame:
    """rate of answers whose first `top` rows have two modalities or more."""
    return results.where(F.col("rank") <= top).groupBy("query_id").agg((F.countDistinct("modality") >= 2).cast("double").alias("x")).agg(F.avg("x").alias("rate"))


def share(results: DataFrame, holds: Column, name: str) -> DataFrame:
    """query_id, share of the answer's rows for which `holds`."""
    return results.groupBy("query_id").agg(F.avg(holds.cast("double")).alias(name))


def any_row(results: DataFrame, holds: Column, name: str) -> DataFrame:
    return results.groupBy("query_id").agg(F.max(holds.cast("int")).alias(name))


def lower_percentiles(samples: DataFrame, value: str, key: str, at: Mapping[str, float] = PERCENTILES, rule: str = "floor") -> DataFrame:
    """Exact percentiles as one of the samples: place floor(p * (n - 1)), or min(floor(n * p), n - 1) with rule "count".

    Samples are first counted by value; ranges of (key, value) then count on, so a key of any size is spread over all tasks,
    and what is left is one row a key."""
    counted = samples.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("count"))
    upto = running(counted, key, [value], sums=["count"])
    total = upto.groupBy(F.col(key).alias("_key")).agg(F.sum("count").alias("n"))
    place = lambda p: F.floor(F.lit(p) * (F.col("n") - 1)) if rule == "floor" else F.least(F.floor(F.col("n") * F.lit(p)), F.col("n") - 1)
    return upto.join(total, F.col(key).eqNullSafe(F.col("_key"))).groupBy(key).agg(*[F.min(F.when(F.col("count_upto") > place(p), F.col(value))).alias(name) for name, p in at.items()])


def latency_stats(samples: DataFrame, value: str, key: str) -> DataFrame:
    """Mean, sample deviation (0 for one sample), greatest."""
    return samples.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stddev"), F.max(value).alias("max"))


def deadline_report(samples: DataFrame, value: str, key: str, budget: float) -> DataFrame:
    """Samples over the budget, their share, p99, and whether p99 is within it."""
    over = samples.groupBy(key).agg(F.count(value).alias("n"), F.sum((F.col(value) > budget).cast("long")).alias("misses"))
    p = lower_percentiles(samples, value, key, {"p99": 0.99})
    return over.join(p, key).select(key, "n", "misses", (F.col("misses") / F.col("n")).alias("miss_rate"), "p99", ((F.col("n") > 0) & (F.col("p99") <= budget)).alias("within"))


def amortized(rebuild_ms: DataFrame, frames: int) -> DataFrame:
    return rebuild_ms.agg((F.sum("ms") / F.lit(float(frames))).alias("ms_per_frame"))


def throughput(samples: DataFrame, value: str, key: str) -> DataFrame:
    return samples.groupBy(key).agg(F.avg(value).alias("mean_ms"), (F.lit(1000.0) / F.avg(value)).alias("qps"))


def benchmark_report(samples: DataFrame, value: str, key: str, budget: float) -> DataFrame:
    """A row a run: samples, misses of the budget and their share, percentiles, mean, deviation, greatest, and the verdict."""
    stats = latency_stats(samples, value, key).drop("n")
    places = lower_percentiles(samples, value, key, {p: v for p, v in PERCENTILES.items() if p != "p99"})
    return deadline_report(samples, value, key, budget).join(stats, key).join(places, key).select(key, "n", "misses", "miss_rate", *PERCENTILES, "mean", "stddev", "max", "within")


def answer_report(results: DataFrame, queries: DataFrame, hit: Column) -> DataFrame:
    """One row: queries, results, share of queries with a row for which `hit` holds, mean first score, mean greatest hop."""
    per = results.groupBy("query_id").agg(F.count("*").alias("c"), F.max(hit.cast("int")).alias("hit"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("first"), F.max("hops").alias("hop"))
    each = queries.select("query_id").join(per, "query_id", "left")
    share = lambda c: F.avg(F.coalesce(c, F.lit(0)).cast("double"))
    return each.agg(F.count("*").alias("queries"), F.coalesce(F.sum("c"), F.lit(0)).alias("results"), share("hit").alias("hit_rate"), F.avg("first").alias("first_score"), share("hop").alias("avg_hops"))
