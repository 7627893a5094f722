"""A pipeline over documents: language ID, near duplicates, decontamination, secrets, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns the columns of documents for the rows
that it keeps, the last one the pieces of packed sequences. run() writes each stage to the shared folder and reads it back.

Defined cases, for every stage: an empty table gives no rows; nulls in any column, repeated rows and texts of any length are
kept or judged as the stage says; other columns, whatever their names, are carried along (all but the last stage).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.llm import decontam, langid, neardup, packing, secrets
from recollex.llm.common import materialize, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows without a language of sufficient posterior; null and empty texts have none. Rows are told apart by doc_id
    and a hash of text, declared language and source, so repeated rows go or stay together."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "lang", "source", F.xxhash64("text", "lang", "source").alias("_th"))
    judged = langid.identify_documents(rows, ["doc_id", "_th"])
    gone = judged.where(~F.col("accepted")).select(F.col("doc_id").alias("_d"), F.col("_th").alias("_t")).distinct()
    return rows.join(gone, rows["doc_id"].eqNullSafe(gone["_d"]) & (rows["_th"] == gone["_t"]), "left_anti").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of links, that of the smallest doc_id. Rows that repeat one (doc_id, text) count once;
    rows of one doc_id with other texts are documents of their own; rows with null doc_id stay, and so do texts without words."""
    total, distinct = docs.where("doc_id is not null").agg(F.count("*"), F.countDistinct("doc_id")).first()
    if total == distinct:
        gone = neardup.join(docs).where("class_id <> doc_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # An id in the order of doc_id tells rows with other texts apart: ranks within an id, of bounded number by a hash of the text.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("th"))
    one = rows.where("id is not null").groupBy("id", "th").agg(F.first("row").alias("row"))
    order = one.select("id", "th").repartitionByRange("id", "th").sortWithinPartitions("id", "th").withColumn("doc_id", F.monotonically_increasing_id())
    order = materialize(order, "pipeline-order")
    single = materialize(one.join(order, ["id", "th"]).select("doc_id", "row"), "pipeline-ids")
    gone = neardup.join(single.select("doc_id", "row.text")).where("class_id <> doc_id").select("doc_id")
    kept = single.join(gone, "doc_id", "left_anti").select("row")
    return kept.unionByName(rows.where("id is null").select("row")).select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item; null texts hold none."""
    return decontam.phrase_matches(docs, table(spark, sf_dir, "benchmark")).where(F.size("hits") == 0).select("row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, null texts too; secrets in their texts are replaced by a mark."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; see packing.pack() for the columns. A null text is its end id alone."""
    return packing.pack(docs)


STAGES = [("language_id", language), ("ngram_jaccard_join", near_duplicates), ("decontamination", decontaminate), ("secret_scan", mask_secrets), ("packing", pack)]

#: Language models, MinHash and a tokenizer are in it: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
