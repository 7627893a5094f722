"""Reading and writing of result reports as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VARIANTS = ("full", "no_bridges", "no_hubs", "no_rewire", "ring_only", "flat", "h1", "h3")


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def environment(spark: SparkSession) -> DataFrame:
    """Session settings, as key and value."""
    return spark.createDataFrame(sorted(spark.sparkContext.getConf().getAll()), "key string, value string")


def result_lines(results: DataFrame) -> DataFrame:
    """query_id, line: one JSON answer a query."""
    row = F.struct("rank", F.col("node_id").alias("id"), F.round("score", 6).alias("score"), "modality", "hops")
    listed = F.transform(F.sort_array(F.collect_list(row)), lambda r: r.dropFields("rank"))
    return results.groupBy("query_id").agg(F.to_json(F.struct(listed.alias("results"))).alias("line"))


def read_ablations(spark: SparkSession, pattern: str) -> DataFrame:
    """n, variant, recall, cross_modal, p99_ms from files of JSON objects; broken files give no row, absent fields 0."""
    raw = spark.read.schema("n long, variant string, recall double, cross_modal double, p99_ms double, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("multiLine", True).json(pattern).cache()
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return raw.where("_bad is null and n is not null").select("n", F.coalesce("variant", F.lit("full")).alias("variant"), *map(zero, ("recall", "cross_modal", "p99_ms")))


def ablation_table(rows: DataFrame, value: str = "recall") -> DataFrame:
    """One row an n, one column a variant, in the fixed order."""
    return rows.groupBy("n").pivot("variant", list(VARIANTS)).agg(F.first(value)).orderBy("n")


def markdown(table: DataFrame) -> str:
    head = "| " + " | ".join(table.columns) + " |\n|" + "---|" * len(table.columns) + "\n"
    return head + "".join("| " + " | ".join("-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r) + " |\n" for r in table.collect())


def latex(table: DataFrame) -> str:
    body = "".join(" & ".join("--" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r) + r" \\" + "\n" for r in table.collect())
    return "\\begin{tabular}{" + "r" * len(table.columns) + "}\n" + " & ".join(c.replace("_", r"\_") for c in table.columns) + " \\\\\n" + body + "\\end{tabular}\n"
