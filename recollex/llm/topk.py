"""Exact top-k search by exhaustive term-at-a-time accumulation.

A dimension is a term: an integer vector is a sparse row of (dimension, weight). Candidates are cut into blocks by a hash
of their id and inverted: each dimension of a block has postings (candidate, weight). A block of queries walks over its
terms, one at a time, and scatters weight times postings into a dense array of scores (queries by candidates); the k best
of each row are selected by partition, and the lists of all blocks are merged by one grouped top-k. Blocks of queries
meet blocks of candidates through an equi-join on the number of the query block.

Defined cases: vectors that are null or hold null or non-finite components take no part, and neither do null ids; components
that a shorter vector lacks are 0; an id stands for all its distinct vectors, and the score of two ids is the greatest of
their vectors', so repeated rows and ids give one list with each candidate once; a candidate with the query's id is its own;
a query without candidates gives no rows; ties go to the smaller id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMA = "query_id long, vec_id long, score long"
_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantized(df: DataFrame, scale: float = 256.0, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, v: floor(scale * component) as longs; rows that take no part are left out."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return df.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")).alias("v"))


def _postings(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """dimension, row, weight of all entries that are not 0, by dimension."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    dim = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keep = flat != 0
    dim, row, flat = dim[keep], row[keep], flat[keep]
    order = np.argsort(dim, kind="stable")
    return dim[order], row[order], flat[order]


def _greatest(scores: np.ndarray, ids: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """One row or column an id, with the greatest scores of its vectors."""
    order = np.argsort(ids, kind="stable")
    one, first = np.unique(ids[order], return_index=True)
    return (scores, ids) if len(one) == len(ids) else (np.maximum.reduceat(np.take(scores, order, axis), first, axis), one)


def accumulate(qids: np.ndarray, queries: pa.ListArray, cids: np.ndarray, cands: pa.ListArray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidate ids of each query id in one pair of blocks: query id, candidate id, score."""
    qd, qr, qw = _postings(queries)
    cd, cr, cw = _postings(cands)
    scores = np.zeros((len(qids), len(cids)), dtype=np.int64)
    for d in np.intersect1d(qd, cd):
        a, b = slice(*np.searchsorted(qd, [d, d + 1])), slice(*np.searchsorted(cd, [d, d + 1]))
        add = qw[a, None] * cw[None, b]
        if a.stop - a.start == len(qids) and b.stop - b.start == len(cids):
            scores += add
        else:
            scores[np.ix_(qr[a], cr[b])] += add
    scores, qids = _greatest(scores, qids, 0)
    scores, cids = _greatest(scores, cids, 1)
    out = []
    for i, q in enumerate(qids):
        row, free = scores[i], cids != q
        own = np.flatnonzero(free)
        if len(own) > k:
            cut = np.partition(row[own], len(own) - k)[len(own) - k]
            own = own[row[own] >= cut]
        best = own[np.lexsort((cids[own], -row[own]))][:k]
        out.append((np.full(len(best), q), cids[best], row[best]))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def search(queries: DataFrame, candidates: DataFrame, k: int = 5, query_block: int = 512, candidate_block: int = 4096) -> DataFrame:
    """queries, candidates: (id, v) of longs. Returns query_id, rank, vec_id, score."""
    queries, candidates = queries.dropDuplicates(["id", "v"]), candidates.dropDuplicates(["id", "v"])
    nq, nc = queries.count(), candidates.count()
    qb, cb = max(1, -(-nq // query_block)), max(1, -(-nc // candidate_block))
    pack = lambda df, n, b: df.groupBy(F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int").alias(b)).agg(F.collect_list("id").alias(f"{b}_ids"), F.collect_list("v").alias(f"{b}_v"))
    left, right = pack(queries, qb, "qb"), pack(candidates, cb, "cb")
    grid = right.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1)))).join(left, "qb")

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                qi, qv, ci, cv = (b.column(n)[r].values for n in ("qb_ids", "qb_v", "cb_ids", "cb_v"))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in accumulate(qi.to_numpy(), qv, ci.to_numpy(), cv, k)], schema=_ARROW)

    found = grid.repartition(max(1, min(qb * cb, 4096)), "qb", "cb").mapInArrow(run, SCHEMA).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
