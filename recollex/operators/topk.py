"""Similarity of a batch of queries to all memories, and the best of each query.

A batch of queries is a table of any size. It is cut into blocks of about MOST_SENT values by a hash of the query's id, which
meet columns of memories in executors (see exchange.py); k rows a query and column are shuffled once more.

Defined cases: memories and queries whose vector is null, of another length than most queries' or holds null or NaN take no
part; ties go to the smaller node_id; an empty side gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollex.functions.vectors import decayed, unpack_half
from recollex.operators import exchange

#: Values of a block of queries, which a task holds.
MOST_SENT = 4_000_000


def best(scored: DataFrame, k: int, by: str = "score", key: str = "query_id") -> DataFrame:
    """rank 1..k within key by falling score, then rising node_id."""
    order = W.partitionBy(key).orderBy(F.desc(by), F.asc("node_id"))
    return scored.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def similarity(mem: DataFrame, queries: DataFrame, *carry: str) -> DataFrame:
    """query_id, node_id, carry, sim of every query and memory: as many rows as their product. carry: columns of either."""
    n, width = queries.agg(F.count("*"), F.max(F.size("q"))).first()
    blocks = max(1, -(-n * max(1, width or 0) // MOST_SENT))
    return exchange.every(queries, mem, max(0, width or 0), blocks, exchange.wide(mem, blocks), *carry).select("query_id", "node_id", *carry, "sim")


def _whole(vector: str, dims: int) -> Column:
    """Whether a vector has dims components and no null or NaN among them."""
    return (F.size(vector) == dims) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))


def topk(mem: DataFrame, queries: DataFrame, k: int, *, rate: float = 0.0, where: Column | None = None, importance: bool = False, carry: str = "modality") -> DataFrame:
    """query_id, rank, node_id, score, and `carry`: the k best by decayed similarity among memories for which `where` holds.
    Memories' vectors may be arrays or what pack_half() makes of them."""
    if where is not None:
        mem = mem.where(where)
    n, dims = queries.agg(F.count("*"), F.coalesce(F.mode(F.size("q")), F.lit(1))).first()
    blocks = max(1, -(-n * max(1, dims) // MOST_SENT))
    packed = {"unpack": unpack_half} if dict(mem.dtypes)["embedding"] == "binary" else {}
    kind = "float" if dict(queries.dtypes)["q"] == "array<float>" else "double"  # floats travel as such; products are of doubles
    queries, mem = whole_queries(queries, dims, kind), whole_memories(mem, dims, carry, importance)
    return best(exchange.grid(queries, mem, k, blocks, rate=rate, carry=carry, **packed), k).select("query_id", "rank", "node_id", "score", carry)


def whole_queries(queries: DataFrame, dims: int, kind: str = "double") -> DataFrame:
    return queries.where(_whole("q", dims)).select("query_id", F.col("q").cast(f"array<{kind}>").alias("q"), F.coalesce(F.col("query_ts").cast("double"), F.lit(0.0)).alias("query_ts"))


def whole_memories(mem: DataFrame, dims: int, carry: str = "modality", importance: bool = False) -> DataFrame:
    weight = F.coalesce(F.col("importance"), F.lit(1.0)).cast("double") if importance else F.lit(1.0)
    if dict(mem.dtypes)["embedding"] == "binary":
        mem = mem.where(F.octet_length("embedding") == 2 * dims)  # a NaN has all bits of its exponent set; packing keeps it
    else:
        mem = mem.where(_whole("embedding", dims))
    return mem.select("node_id", "embedding", F.col("ts").cast("double").alias("ts"), F.col(carry).cast("int").alias(carry), weight.alias("weight"))


def overfetch_rerank(mem: DataFrame, queries: DataFrame, k: int, fetch: int, rate: float) -> DataFrame:
    """The k best after decay among the `fetch` most similar."""
    first = topk(mem.withColumn("one", F.lit(0)), queries, fetch, carry="one").select("query_id", "node_id", F.col("score").alias("sim"))
    late = first.join(mem.select("node_id", "ts", "modality"), "node_id").join(queries.select("query_id", "query_ts"), "query_id")
    return best(late.withColumn("score", decayed(F.col("sim"), F.col("query_ts") - F.col("ts"), rate)), k).select("query_id", "rank", "node_id", "score", "modality")


def max_similarity(mem: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidate_id, max_sim: of each candidate to the memories; 0 where there are none."""
    as_queries = candidates.select(F.col("candidate_id").alias("query_id"), F.col("embedding").alias("q"), F.lit(0.0).alias("query_ts"))
    found = topk(mem.withColumn("one", F.lit(0)), as_queries, 1, carry="one").select("query_id", "score")
    return candidates.select("candidate_id").join(found, F.col("candidate_id") == F.col("query_id"), "left").select("candidate_id", F.coalesce("score", F.lit(0.0)).alias("max_sim"))


def novel(mem: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """max_similarity() with accepted: not above the threshold."""
    return max_similarity(mem, candidates).withColumn("accepted", F.col("max_sim") <= threshold)
