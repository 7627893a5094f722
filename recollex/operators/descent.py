"""The k-NN graph by neighbour descent: neighbours of a node are likely neighbours of each other.

Every round each node brings together those that it points to and some that point to it; the pairs among them that are new
and beat what both ends have become candidates, and each node keeps its best. What is shuffled in a round is a few vectors a
neighbour, so it grows with nodes times neighbours, not with the square of nodes. Rounds end when few neighbours change.

Defined cases: memories whose vector is null, of another length than most or holds null or NaN are left out; node ids are
distinct; with fewer than k + 1 memories all others are neighbours; ties go to the smaller id; an empty table has no rows. The
result is approximate (index.knn_graph() is exact), the same for the same table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollex.functions.lineage import cut
from recollex.operators.topk import whole_memories

#: Random groups that a node is in at the start.
DEALS = 3
PAIRS = "u long, v long, sim double"
_PAIRS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("sim", pa.float64())])


def _pairs(p: pa.RecordBatch, most: int) -> tuple[np.ndarray, ...]:
    """u, v, sim of the pairs among members that are worth a look: one of them new, no worse than what u has, and among the
    `most` best of u here (more at ties): u keeps no more of them anyway."""
    n = p.num_rows
    ids, fresh, floor = (p.column(c).to_numpy(zero_copy_only=False) for c in ("id", "fresh", "floor"))
    e = p.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    s = e @ e.T
    worth = (s >= floor[:, None]) & (fresh[:, None] | fresh[None, :]) & (ids[:, None] != ids[None, :])
    if n - 1 > most:
        seen = np.where(worth, s, -np.inf)
        worth &= seen >= np.partition(seen, n - most, axis=1)[:, n - most, None]
    i, j = np.nonzero(worth)
    return ids[i], ids[j], s[i, j]


def _compare(members: DataFrame, most: int) -> DataFrame:
    """Pairs of each group w of members (w, id, fresh, floor, embedding). Groups stream past in their order, so that no row
    holds a group's vectors."""

    def run(batches):
        left = None
        for b in batches:
            if not b.num_rows:
                continue
            if left is not None:
                b = pa.Table.from_batches([left, b]).combine_chunks().to_batches()[0]
            w = b.column("w").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(w[1:] != w[:-1]) + 1).tolist()]
            left = b.slice(cuts[-1])  # it may go on in the next batch
            out = [_pairs(b.slice(low, high - low), most) for low, high in zip(cuts, cuts[1:], strict=False)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], schema=_PAIRS)
        if left is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _pairs(left, most)], schema=_PAIRS)

    return members.select("w", "id", "fresh", "floor", "embedding").repartition("w").sortWithinPartitions("w").mapInArrow(run, PAIRS)


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The k best v of each u; a pair that was there before stays old. All of a u's pairs are in one task after one exchange."""
    once = pairs.repartition("u").groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    return once.withColumn("r", F.row_number().over(W.partitionBy("u").orderBy(F.desc("sim"), "v"))).where(F.col("r") <= k).drop("r")


def descend(mem: DataFrame, k: int, pool: int | None = None, rounds: int = 12, least_change: float = 0.002, seed: int = 7) -> tuple[DataFrame, list[int]]:
    """node_id, rank, dst, sim of the k nearest found, and the number of changed neighbours of each round. pool: neighbours kept
    on the way (by default 4 k, 32 at least); the more, the higher the recall."""
    pool = max(pool or max(4 * k, 32), k)
    dims = (mem.groupBy(F.size("embedding").alias("d")).count().where("d > 0").orderBy(F.desc("count"), "d").first() or {"d": 1})["d"]
    nodes = cut(whole_memories(mem.withColumn("one", F.lit(0)).withColumn("ts", F.lit(0.0)), dims, "one").select(F.col("node_id").alias("id"), "embedding"))
    n = nodes.count()
    # The start: random groups, of which all are compared; dealt more than once, as nothing would lead out of a group.
    groups = max(1, n // pool)
    group = F.explode(F.array(*[F.pmod(F.xxhash64("id", F.lit(seed), F.lit(t)), F.lit(groups)) * DEALS + t for t in range(DEALS)]))
    dealt = nodes.select(group.alias("w"), "id", F.lit(True).alias("fresh"), F.lit(float("-inf")).alias("floor"), "embedding")
    graph, changes = cut(_best(_compare(dealt, pool).withColumn("fresh", F.lit(True)), pool)), []
    for i in range(rounds):
        have = graph.groupBy("u").agg(F.count("*").alias("c"), F.min("sim").alias("least"))
        known = nodes.join(have, F.col("id") == F.col("u"), "left").select("id", "embedding", F.when(F.col("c") >= pool, F.col("least")).otherwise(float("-inf")).alias("floor"))
        # Both directions of links, those back at most pool a node; lists without a new member bring no pairs, and get no vectors.
        links = graph.select(F.col("u").alias("w"), F.col("v").alias("id"), "fresh", F.lit(0).alias("back")).unionByName(graph.select(F.col("v").alias("w"), F.col("u").alias("id"), "fresh", F.lit(1).alias("back")))
        placed = links.repartition("w").withColumn("r", F.row_number().over(W.partitionBy("w", "back").orderBy(F.xxhash64("id", "w", F.lit(seed + i)))))
        lists = placed.where((F.col("back") == 0) | (F.col("r") <= pool)).groupBy("w", "id").agg(F.max("fresh").alias("fresh"))
        lists = lists.withColumn("any", F.max("fresh").over(W.partitionBy("w"))).where("any").drop("any")  # 2 * pool at most
        found = _compare(lists.join(known, "id"), pool)
        graph = cut(_best(graph.withColumn("fresh", F.lit(False)).unionByName(found.withColumn("fresh", F.lit(True))), pool))
        changes.append(graph.where("fresh").count())
        if changes[-1] <= least_change * n * pool:
            break
    near = graph.withColumn("rank", F.row_number().over(W.partitionBy("u").orderBy(F.desc("sim"), "v")).cast("int")).where(F.col("rank") <= k)
    return near.select(F.col("u").alias("node_id"), "rank", F.col("v").alias("dst"), "sim"), changes
