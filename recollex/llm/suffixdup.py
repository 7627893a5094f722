"""Removal of repeated byte strings by longest-previous-factor arrays.

A byte goes if a string of `least` bytes that covers it also starts earlier (smaller doc_id, or same document and earlier
start): its window's longest previous factor is at least that long. Only windows that can repeat are ever sorted:

1. Each window has an anchor, the k-gram in it with the smallest hash (leftmost on ties). Equal windows have equal anchors
   at equal places, and the windows of one anchor are a run of starts. Of each anchor go two hashes: of its k-gram and of
   the whole bytes that its windows cover (its context). Within a task, all but the first of equal contexts are settled
   at once, so a passage that a third of all rows share leaves a task as one row.
2. Dealt by the k-gram's hash, all but the earliest of equal contexts are settled; an anchor with several contexts (at the
   edges of repeats) is to be sorted, one row for each context.
3. The contexts of those are fetched from the texts, dealt by k-gram and sorted as suffixes cut at `least` bytes, ties by
   position. Common prefixes of neighbours are counted in bytes; previous and next smaller positions in this order, with
   the least common prefix on the way, give the longest previous factor of each suffix. A window goes if it has all bytes.

A k-gram with very many contexts (more than a bounded number) is split by context in steps 2 and 3, as no task could
hold it; the windows that are first in their part then meet in a fourth step, dealt by a hash of the window.

Hashes of k-gram and context (128 bits together) decide in step 2, of k-gram and window in step 4; step 3 compares bytes.

Defined cases: null text is empty; texts shorter than `least` bytes stay whole; repeated rows (same doc_id and text) are
one document and get the same result each; rows with null doc_id, and rows that share a doc_id but not the text, stay whole
and remove nothing elsewhere, as their order is not defined; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, row_chunks, texts_of

KGRAM = 32
#: A k-gram is split if it has more contexts than a HOT_PARTS-th of all, within these bounds (a task needs some 7 KB a
#: context); tasks report those with HOT_HERE or more. Up to SENT_ROWS of them are broadcast, more are joined.
HOT_LEAST, HOT_MOST, HOT_PARTS, HOT_HERE, SENT_ROWS = 512, 20_000, 1024, 8, 1 << 16
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_up = np.ones(1, np.uint64)
_down = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _up, _down
    if len(_up) < n:
        one = np.ones(1, np.uint64)
        _up = np.cumprod(np.concatenate([one, np.full(n, _P, np.uint64)]), dtype=np.uint64)
        _down = np.cumprod(np.concatenate([one, np.full(n, _PINV, np.uint64)]), dtype=np.uint64)
    return _up[:n], _down[:n]


def anchor_runs(texts: list[bytes], least: int) -> tuple[np.ndarray, ...]:
    """row, at, lo, hi, kh, ch of each anchor: the text it is in, its place there, its first and last window's start, hashes."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    n = len(raw)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    if n < least:
        return none
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    kh = mix64((sums[KGRAM:] - sums[:-KGRAM]) * down[:n - KGRAM + 1])
    key = (kh & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(kh), dtype=np.uint64)
    wide, m, got = least - KGRAM + 1, key, 1
    while 2 * got <= wide:
        m = np.minimum(m[:-got], m[got:])
        got *= 2
    if got < wide:
        m = np.minimum(m[:len(m) - (wide - got)], m[wide - got:])
    doc = np.repeat(np.arange(len(texts)), np.maximum(sizes - least + 1, 0))
    if not len(doc):
        return none
    inside = np.maximum(sizes - least + 1, 0)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(inside) - inside, inside) + begins[doc]
    anchor = (m[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.concatenate([new[1:], [len(doc)]]) - 1
    lo, hi, at, row = start[new], start[last], anchor[new], doc[new]
    ch = mix64((sums[hi + least] - sums[lo]) * down[lo] + (at - lo).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + (hi - lo).astype(np.uint64) * np.uint64(0x165667B19E3779F9))
    base = begins[row]
    return row, at - base, lo - base, hi - base, kh[at], ch


def merged(doc: np.ndarray, lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the spans [lo, end) of each document."""
    if not len(doc):
        return doc, lo, end
    order = np.lexsort((lo, doc))
    doc, lo, end = doc[order], lo[order], end[order]
    shift = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])) * (int(end.max()) + 1)
    most = np.maximum.accumulate(end + shift)
    new = np.flatnonzero(np.concatenate([[True], lo[1:] + shift[1:] > most[:-1]]))
    last = np.concatenate([new[1:], [len(doc)]]) - 1
    return doc[new], lo[new], most[last] - shift[last]


def _concat(parts: list[tuple]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _smaller(pos: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each place the least of `common` on the way back to the nearest place of a smaller position; common[i] is between
    i - 1 and i. A way on which it falls to 0 ends there."""
    at, least = np.arange(-1, len(pos) - 1), common.copy()
    if len(pos):
        least[0] = 0
    open_ = np.flatnonzero(least > 0)
    open_ = open_[pos[at[open_]] > pos[open_]]
    while len(open_):  # what lies between i and at[i] is larger than i's position, so a step over at[i]'s own way is safe
        over = at[open_]
        least[open_] = np.minimum(least[open_], least[over])
        at[open_] = at[over]
        open_ = open_[(least[open_] > 0) & (at[open_] >= 0)]
        open_ = open_[pos[at[open_]] > pos[open_]]
    return np.where(at >= 0, least, 0)


def previous_factors(pos: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Longest previous factors of suffixes in sorted order: pos, their positions (distinct); common, the length of the
    prefix that each shares with the one before it."""
    after = np.append(common[1:], 0)
    return np.maximum(_smaller(pos, common), _smaller(pos[::-1], after[::-1])[::-1])


def _common_bytes(words: np.ndarray, a: np.ndarray, b: np.ndarray, offs: list[int], least: int) -> np.ndarray:
    """How many of the first `least` bytes at places a and b are the same; words holds 8 bytes of each place."""
    out = np.full(len(a), least, np.int64)
    open_ = np.arange(len(a))
    for o in offs:
        differ = words[a[open_] + o] ^ words[b[open_] + o]
        here = differ != 0
        out[open_[here]] = o + sum((differ[here] < np.uint64(1 << 8 * k)).astype(np.int64) for k in range(1, 8))
        open_ = open_[~here]
    return out


def _offsets(least: int) -> list[int]:
    """Where 8-byte words that cover `least` bytes begin."""
    return [*range(0, least - 8, 8), least - 8]


def window_hashes(words: np.ndarray, places: np.ndarray, least: int) -> np.ndarray:
    h = np.zeros(len(places), np.uint64)
    for o in _offsets(least):
        h = mix64(h * np.uint64(_P) + words[places + o])
    return h


def suffix_repeats(doc: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, group: np.ndarray, contexts: list[bytes], least: int) -> tuple[np.ndarray, ...]:
    """Of each window of the contexts: context, start, longest previous factor (in its group), place; and the words there."""
    block = np.frombuffer(b"".join(contexts) + b"\0" * 8, np.uint8)
    sizes = np.array([len(c) for c in contexts], np.int64)
    begin = np.cumsum(sizes) - sizes
    words = np.zeros(len(block) - 7, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | block[k:len(block) - 7 + k]
    n = hi - lo + 1
    who = np.repeat(np.arange(len(doc)), n)
    j = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
    start, place, owner = lo[who] + j, begin[who] + j, doc[who]
    # Equal windows have equal group and offset of the anchor, so suffixes are sorted in these buckets.
    bucket = mix64(group[who] + (at[who] - start).astype(np.uint64))
    offs = _offsets(least)
    factor = np.zeros(len(who), np.int64)
    order = np.argsort(bucket, kind="stable")
    same = bucket[order][1:] == bucket[order][:-1]
    order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]  # a bucket of one suffix repeats nothing
    if len(order):
        position = np.lexsort((start[order], owner[order]))
        rank = np.empty(len(order), np.int64)
        moved = np.concatenate([[False], (np.diff(owner[order][position]) != 0) | (np.diff(start[order][position]) != 0)])
        rank[position] = np.cumsum(moved)  # copies of a repeated row are one position
        by = np.lexsort((rank, *[words[place[order] + o] for o in reversed(offs)], bucket[order]))
        order, rank = order[by], rank[by]
        new = np.concatenate([[True], (rank[1:] != rank[:-1]) | (bucket[order][1:] != bucket[order][:-1])])
        first = order[new]
        common = np.concatenate([[0], np.where(bucket[first][1:] == bucket[first][:-1], _common_bytes(words, place[first][:-1], place[first][1:], offs, least), 0)])
        factor[order] = previous_factors(rank[new], common)[np.cumsum(new) - 1]
    return who, start, factor, place, words


def removed_spans(docs: DataFrame, least: int = 100) -> DataFrame:
    """doc_id, spans: array of (lo, end), bytes; documents with something to remove only."""
    spark = docs.sparkSession
    if least < KGRAM + 8:
        raise ValueError(f"least must be {KGRAM + 8} at least")
    tasks = max(8, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (12 << 20)))
    spans = [materialize(spark.createDataFrame([], "doc long, lo long, end long"), "sfx-none")]

    def pre(batches):
        held, count = [], 0

        def flush():
            doc, at, lo, hi, kh, ch = _concat(held)
            order = np.lexsort((at, doc, ch, kh))
            doc, at, lo, hi, kh, ch = (x[order] for x in (doc, at, lo, hi, kh, ch))
            group = np.concatenate([[True], (kh[1:] != kh[:-1]) | (ch[1:] != ch[:-1])])
            head = np.maximum.accumulate(np.where(group, np.arange(len(doc)), 0))
            settled = (doc != doc[head]) | (at != at[head])
            d, s, e = merged(doc[settled], lo[settled], hi[settled] + least)
            first = np.flatnonzero(group)
            many, times = np.unique(kh[first], return_counts=True)
            many, times = many[times >= HOT_HERE], times[times >= HOT_HERE]
            zero, none = np.zeros(len(d), np.int64), np.zeros(len(many), np.int64)
            cols = ((d, doc[first], none), (s, at[first], times), (e, np.full(len(first), -1), none - 2), (zero, kh[first].astype(np.int64), many.astype(np.int64)), (zero, ch[first].astype(np.int64), none))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["doc", "lo", "end", "kh", "ch"])

        for b in batches:
            for x in row_chunks(b, "text", 1 << 20):
                ids = x.column("doc_id").to_numpy(zero_copy_only=False)
                row, at, lo, hi, kh, ch = anchor_runs(texts_of(x, "text"), least)
                held.append((ids[row], at, lo, hi, kh, ch))
                count += len(row)
                if count > 1_500_000:
                    yield from flush()
                    held, count = [], 0
        if held:
            yield from flush()

    anchors = materialize(docs.mapInArrow(pre, "doc long, lo long, end long, kh long, ch long"), "sfx-anchors")
    spans.append(anchors.where("end >= 0").select("doc", "lo", "end"))

    rows = anchors.count()
    often = anchors.where("end = -2").groupBy("kh").agg(F.sum("lo").alias("n")).where(F.col("n") > max(HOT_LEAST, min(HOT_MOST, rows // HOT_PARTS)))
    hot = materialize(often.select("kh", F.lit(True).alias("hot")), "sfx-hot")
    n_hot = hot.count()
    parts = 64 + rows // 1_000_000

    def settle(batches):
        held = [tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "lo", "kh", "ch", "hot")) for b in batches if b.num_rows]
        if not held:
            return
        doc, at, kh, ch, split = _concat(held)
        order = np.lexsort((at, doc, ch, kh))
        doc, at, kh, ch, split = doc[order], at[order], kh[order], ch[order], split[order].astype(bool)
        new_k = np.concatenate([[True], kh[1:] != kh[:-1]])
        new_c = new_k | np.concatenate([[True], ch[1:] != ch[:-1]])
        kgroup = np.cumsum(new_k) - 1
        several = (np.bincount(kgroup, new_c)[kgroup] > 1) | split
        head = np.maximum.accumulate(np.where(new_c, np.arange(len(doc)), 0))
        settled = (doc != doc[head]) | (at != at[head])
        out = settled | several
        # What becomes of it: 0 is settled, 1 to be sorted, 2 to be sorted in parts.
        yield pa.RecordBatch.from_arrays([pa.array(doc[out]), pa.array(at[out].astype(np.int32)), pa.array(np.where(settled, 0, 1 + split)[out].astype(np.int8))], names=["doc", "at", "fate"])

    first = anchors.where("end = -1").select("doc", "lo", "kh", "ch")
    first = first.join(F.broadcast(hot) if n_hot <= SENT_ROWS else hot, "kh", "left").withColumn("hot", F.coalesce("hot", F.lit(False))) if n_hot else first.withColumn("hot", F.lit(False))
    judged = first.repartition(tasks, "kh", F.when(F.col("hot"), F.pmod("ch", F.lit(parts)))).mapInArrow(settle, "doc long, at int, fate byte")
    by_doc = judged.groupBy("doc").agg(F.collect_set(F.struct("at", "fate")).alias("anchors"))  # a document's anchors at most
    fetched = docs.join(by_doc, F.col("doc_id") == F.col("doc")).select("doc_id", "text", "anchors.at", "anchors.fate")

    def fetch(batches):
        for b in batches:
            for x in row_chunks(b, "text", 1 << 20):
                texts = texts_of(x, "text")
                ids = x.column("doc_id").to_numpy(zero_copy_only=False)
                row, at, lo, hi, kh, ch = anchor_runs(texts, least)
                wide = int(max((len(t) for t in texts), default=0)) + 1
                lists = x.column("at"), x.column("fate")
                size = np.asarray(pc.list_value_length(lists[0]), np.int64)
                want = np.repeat(np.arange(len(texts)), size) * wide + pc.list_flatten(lists[0]).to_numpy(zero_copy_only=False)
                fate = pc.list_flatten(lists[1]).to_numpy(zero_copy_only=False)
                order = np.argsort(want, kind="stable")
                want, fate = want[order], fate[order]
                mine = row * wide + at
                place = np.minimum(np.searchsorted(want, mine), max(0, len(want) - 1))
                asked = want[place] == mine if len(want) else np.zeros(len(mine), bool)
                full = asked & (fate[place] == 0) if len(want) else asked
                d, s, e = merged(ids[row[full]], lo[full], hi[full] + least)
                k = np.flatnonzero(asked & ~full)
                part = np.where(fate[place[k]] == 2, 1 + (ch[k] % np.uint64(parts)).astype(np.int64), 0)
                ctx = [texts[r][a:b + least] for r, a, b in zip(row[k], lo[k], hi[k], strict=True)]
                zero = np.zeros(len(d), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([d, ids[row[k]]])), pa.array(np.concatenate([s, lo[k]])), pa.array(np.concatenate([e, hi[k]])), pa.array(np.concatenate([zero, at[k]])), pa.array(np.concatenate([zero, kh[k].astype(np.int64)])), pa.array(np.concatenate([zero, part])), pa.array([None] * len(d) + ctx, pa.binary())],
                    names=["doc", "lo", "end", "at", "kh", "part", "ctx"],
                )

    fetched = materialize(fetched.mapInArrow(fetch, "doc long, lo long, end long, at long, kh long, part long, ctx binary"), "sfx-contexts")
    spans.append(fetched.where("ctx is null").select("doc", "lo", "end"))

    def sort(batches):
        held, ctx = [], []
        for b in batches:
            if b.num_rows:
                held.append(tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "at", "lo", "end", "kh", "part")))
                ctx += b.column("ctx").to_pylist()
        if held:
            doc, at, lo, hi, kh, part = _concat(held)
            which = mix64(kh.astype(np.uint64) + part.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            who, start, factor, place, words = suffix_repeats(doc, at, lo, hi, which, ctx, least)
            gone = factor >= least
            d, s, e = merged(doc[who[gone]], start[gone], start[gone] + least)
            heads = np.flatnonzero(~gone & (part[who] > 0))  # of k-grams that are split
            h, who = window_hashes(words, place[heads], least), who[heads]
            zero = np.zeros(len(d), np.int64)
            cols = ((d, doc[who]), (s, start[heads]), (e, np.full(len(heads), -1)), (zero, kh[who]), (zero, h.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["doc", "lo", "end", "kh", "wh"])

    found = fetched.where("ctx is not null").repartition(tasks, "kh", "part").mapInArrow(sort, "doc long, lo long, end long, kh long, wh long")
    if n_hot:
        found = materialize(found, "sfx-sorted")

        def meet(batches):
            held = [tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "lo", "kh", "wh")) for b in batches if b.num_rows]
            if held:
                doc, lo, kh, wh = _concat(held)
                order = np.lexsort((lo, doc, wh, kh))
                doc, lo, kh, wh = doc[order], lo[order], kh[order], wh[order]
                new = np.concatenate([[True], (kh[1:] != kh[:-1]) | (wh[1:] != wh[:-1])])
                head = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
                later = (doc != doc[head]) | (lo != lo[head])
                d, s, e = merged(doc[later], lo[later], lo[later] + least)
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array(e)], names=["doc", "lo", "end"])

        spans.append(found.where("end < 0").select("doc", "lo", "kh", "wh").repartition(tasks, "kh", "wh").mapInArrow(meet, "doc long, lo long, end long"))
    spans.append(found.where("end >= 0").select("doc", "lo", "end"))
    every = spans[0]
    for s in spans[1:]:
        every = every.unionByName(s)
    return every.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("lo", "end")).alias("spans"))


def dedup(docs: DataFrame, least: int = 100) -> DataFrame:
    """doc_id, kept (bytes that stay), n_bytes, n_removed, n_spans for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    clash = docs.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("x"), F.max(F.xxhash64("text")).alias("y")).where("x <> y").select("doc_id")
    ordered = docs.where("doc_id is not null and octet_length(text) > 0")
    if clash.limit(1).count():
        ordered = ordered.join(clash, "doc_id", "left_anti")
    spans = removed_spans(ordered, least)

    def run(batches):
        for b in batches:
            for x in row_chunks(b, "text", 4 << 20):
                kept, removed, runs = [], [], []
                lists = x.column("spans").to_pylist()
                for t, s in zip(texts_of(x, "text"), lists, strict=True):
                    parts, at, n, m = [], 0, 0, 0
                    if s:
                        a = np.array([(y["lo"], y["end"]) for y in s], np.int64)
                        _, lo, end = merged(np.zeros(len(a), np.int64), a[:, 0], a[:, 1])
                        for p, q in zip(lo.tolist(), end.tolist(), strict=True):
                            parts.append(t[at:p])
                            at, n, m = q, n + q - p, m + 1
                    parts.append(t[at:])
                    kept.append(b"".join(parts))
                    removed.append(n)
                    runs.append(m)
                yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(kept, pa.binary()), pa.array([len(k) + r for k, r in zip(kept, removed, strict=True)], pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return docs.join(spans, "doc_id", "left").mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def digest(docs: DataFrame, least: int = 100) -> DataFrame:
    return dedup(docs, least).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
