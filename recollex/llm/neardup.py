"""N-gram Jaccard join with Bayesian pruning of candidates.

A text is the set of its word shingles. Texts with equal sets collapse to one representative first. MinHash bands tie
representatives into families (connected components of shared bands); within a family, pairs are compared on MinHash
values a few at a time, and a pair is dropped once the posterior probability that its similarity reaches the threshold
(uniform prior) falls below `tolerance`. Pairs that are left are verified exactly on their whole shingle sets. Families
are processed by blocks of representatives; what leaves a block is one row per representative (its number of links and
the smallest member that it is tied to), never its pairs.

With 24 bands of 5 values a pair of similarity 0.8 shares a band with probability 0.99993; the tolerance is 1e-6.

Defined cases: null texts and those without words have no links; texts of fewer words than a shingle are one shingle; rows
with null doc_id have null class and no links; repeated rows are copies of each other; representatives are told apart by
a 64-bit hash of their set; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, row_chunks, texts_of, word_hashes
from .components import connected_components

BANDS, ROWS, STEP = 24, 5, 8
HASHES = BANDS * ROWS
BLOCK = 1024
_rng = np.random.default_rng(20240229)
_A, _B = ((_rng.integers(1, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32) for _ in range(2))
_X = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def least_matches(threshold: float, tolerance: float) -> np.ndarray:
    """For 0..HASHES compared values, the least number of equal ones with which a pair stays. Under a uniform prior the
    posterior is a Beta, whose tail beyond the threshold is a sum of binomial terms."""
    out = np.zeros(HASHES + 1, np.int64)
    for n in range(1, HASHES + 1):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                out[n] = m
                break
    return out


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    out = []
    p = np.uint64(0xD6E8FEB86659FD93)
    h = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        h = h * p + words[k:k + len(h)]
    h = mix64(h)
    for n, e in zip(counts, ends, strict=True):
        if n >= size:
            out.append(np.unique(h[e - n:e - size + 1]))
        elif n:
            short = np.full(1, n, np.uint64)
            for w in words[e - n:e]:
                short = short * p + w
            out.append(mix64(short + np.uint64(1)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minhash(s: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    half = (s >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(half), 1024):
        x = (half[at:at + 1024, None] ^ _X) * _A
        x ^= x >> np.uint32(15)
        x *= _B
        x ^= x >> np.uint32(16)
        np.minimum(low, x.min(axis=0), out=low)
    return low


def set_hash(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix64(np.array([mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(s))]))[0].astype(np.int64))


def band_keys(sig: np.ndarray) -> np.ndarray:
    k = np.arange(BANDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for c in sig.reshape(BANDS, ROWS).T.astype(np.uint64):
            k = mix64(k * np.uint64(0x9E3779B97F4A7C15) + c)
    return k.astype(np.int64)


def linked_pairs(sigs: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, threshold: tuple[int, int], least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (places) that reach the threshold num / den: within left, or between left and right."""
    cols = left if right is None else right
    same = (sigs[left][:, None, :STEP] == sigs[cols][None, :, :STEP]).sum(axis=2) if len(left) * len(cols) <= 1 << 16 else sum((sigs[left, k][:, None] == sigs[cols, k][None, :]).astype(np.int16) for k in range(STEP))
    keep = same >= least[STEP]
    if right is None:
        keep = np.triu(keep, 1)
    i, j = np.nonzero(keep)
    m = same[i, j].astype(np.int64)
    i, j = left[i], cols[j]
    for at in range(STEP, HASHES, STEP):
        if not len(i):
            return i, j
        m += (sigs[i, at:at + STEP] == sigs[j, at:at + STEP]).sum(axis=1)
        ok = m >= least[at + STEP]
        i, j, m = i[ok], j[ok], m[ok]
    num, den = threshold
    if len(i) <= 16:
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    else:
        who = np.unique(np.concatenate([i, j]))
        flat = np.concatenate([sets[a] for a in who])
        row = np.repeat(np.arange(len(who)), [len(sets[a]) for a in who])
        _, col, n = np.unique(flat, return_inverse=True, return_counts=True)
        shared = n[col] > 1  # what one member alone has adds nothing
        row, col = row[shared], np.unique(col[shared], return_inverse=True)[1]
        inter = np.zeros((len(who), len(who)), np.float32)
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        for at in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
            part = slice(*np.searchsorted(col, [at, at + 4096]))
            a = np.zeros((len(who), 4096), np.float32)
            a[row[part], col[part] - at] = 1
            inter += a @ a.T
        both = inter[np.searchsorted(who, i), np.searchsorted(who, j)].astype(np.int64)
    sizes = np.array([len(s) for s in sets], np.int64)
    ok = den * both >= num * (sizes[i] + sizes[j] - both)
    return i[ok], j[ok]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places the smallest place that pairs tie it to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, rid (hash of the set), n (its size), bands."""

    def run(batches):
        for b in batches:
            for x in row_chunks(b, "text", 1 << 20):
                rid, n, bands = [], [], []
                for s in shingle_sets(texts_of(x, "text"), size):
                    rid.append(set_hash(s) if len(s) else None)
                    n.append(len(s))
                    bands.append(band_keys(minhash(s)) if len(s) else [])
                yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(rid, pa.int64()), pa.array(n, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "rid", "n", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, rid long, n long, bands array<long>")


def join(docs: DataFrame, *, shingle: int = 5, threshold: tuple[int, int] = (4, 5), tolerance: float = 1e-6) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its component of links), n_links (documents, copies included, that reach the
    threshold with it), rep_id (smallest doc_id with the same shingle set)."""
    least = least_matches(threshold[0] / threshold[1], tolerance)
    seen = materialize(signatures(docs, shingle), "near-signatures")
    usable = seen.where("rid is not null and doc_id is not null")
    reps = materialize(usable.groupBy("rid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "near-reps")
    banded = reps.select("rid", F.posexplode("bands").alias("band", "key"))
    hubs = banded.groupBy("band", "key").agg(F.min("rid").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    ties = banded.join(hubs, ["band", "key"]).where("rid <> hub").select(F.col("rid").alias("a"), F.col("hub").alias("b")).distinct()
    families = materialize(connected_components(ties).select(F.col("v").alias("rid"), F.col("root").alias("fam")), "near-families")
    sizes = families.groupBy("fam").agg(F.count("*").alias("size"))
    members = families.join(sizes, "fam").join(reps.select("rid", "rep", "copies"), "rid")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    members = materialize(members.select(F.col("rep").alias("doc_id"), "rid", "fam", "copies", blocks.alias("blocks"), F.pmod(F.xxhash64("rid"), blocks).cast("int").alias("block")), "near-members")
    bins = max(1, -(-members.count() // BLOCK))
    # Members grow with the corpus, so they are never broadcast, whatever they are here.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(members.hint("merge"), "doc_id")
    payload = "rid long, fam long, copies long, blocks int, block int, sig binary, shingles binary"

    def describe(batches):
        for b in batches:
            for x in row_chunks(b, "text", 1 << 20):
                rid = x.column("rid").to_pylist()
                sets = shingle_sets(texts_of(x, "text"), shingle)
                at = [i for i, s in enumerate(sets) if len(s) and set_hash(s) == rid[i]]
                y = x.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*[y.column(c) for c in ("rid", "fam", "copies", "blocks", "block")], pa.array([minhash(sets[i]).tobytes() for i in at], pa.binary()), pa.array([sets[i].tobytes() for i in at], pa.binary())], names=["rid", "fam", "copies", "blocks", "block", "sig", "shingles"])

    described = texts.mapInArrow(describe, payload)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = described.withColumn("other", other).select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    dealt = dealt.withColumn("bin", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("fam"), F.lit(bins))).otherwise(F.col("fam")))

    def compare(key, t):
        fam, rid = t.column("fam").to_numpy(), t.column("rid").to_numpy()
        first = np.sort(np.unique(np.stack([fam, rid]), axis=1, return_index=True)[1])  # repeated rows
        t = t.take(pa.array(first))
        fam, rid, copies, block = (t.column(c).to_numpy() for c in ("fam", "rid", "copies", "block"))
        order = np.lexsort((rid, fam))
        fam, rid, copies, block = fam[order], rid[order], copies[order], block[order]
        sigs = np.stack([np.frombuffer(x, np.uint32) for x in t.column("sig").take(pa.array(order)).to_pylist()])
        sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").take(pa.array(order)).to_pylist()]
        i, j = int(key[2].as_py()), int(key[3].as_py())
        a, b = [], []
        starts = np.flatnonzero(np.concatenate([[True], fam[1:] != fam[:-1]]))
        for s, e in zip(starts, [*starts[1:], len(fam)], strict=True):
            at = np.arange(s, e)
            x, y = linked_pairs(sigs, sets, at, None, threshold, least) if i == j else linked_pairs(sigs, sets, at[block[s:e] == i], at[block[s:e] == j], threshold, least)
            a.append(x)
            b.append(y)
        a, b = np.concatenate(a), np.concatenate(b)
        links = np.bincount(a, copies[b], len(rid)) + np.bincount(b, copies[a], len(rid))
        tied = np.flatnonzero(links > 0)
        roots = _roots(len(rid), a, b)
        return pa.table({"rid": rid[tied], "links": links[tied].astype(np.int64), "root": rid[roots[tied]]})

    found = materialize(dealt.groupBy("blocks", "bin", "i", "j").applyInArrow(compare, "rid long, links long, root long"), "near-links")
    classes = connected_components(found.select(F.col("rid").alias("a"), F.col("root").alias("b"))).select(F.col("v").alias("rid"), "root")
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    per = materialize(reps.select("rid", "rep", "copies").join(classes, "rid", "left").join(links, "rid", "left").select("rid", "rep", "copies", F.coalesce("root", "rid").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "near-classes")
    ids = per.groupBy("root").agg(F.min("rep").alias("class_id"))
    per = per.join(ids, "root").select(F.col("rid"), "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("rep").alias("rep_id"))
    own = F.col("doc_id").isNotNull()
    return seen.select("doc_id", "rid").join(per, "rid", "left").select(
        "doc_id", F.when(own, F.coalesce("class_id", "doc_id")).alias("class_id"), F.when(own, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), F.when(own, F.coalesce("rep_id", "doc_id")).alias("rep_id"),
    )
