"""Toxicity by the nearest labelled examples.

Examples are a sample of labelled rows, bounded in rows and bytes. Their texts and all others become TF-IDF vectors over every word of the
examples, with document frequencies counted over all documents; idf is raised by 1 + the log of a word's lift towards the
label in the sample, where that is positive. A text's other words meet no example: they would change its norm only, which
neither the order of neighbours nor the votes depend on. For each text the k nearest examples by exact cosine come from an
inverted index whose postings stand in blocks with their largest weight: blocks are visited by falling upper bound until
none can hold a nearer example. Votes are weighted by the squared cosine; an isotonic fit of leave-one-out votes over the
sample turns their share into a probability. In votes, fit and shares an example counts as often as its class and size were
sampled less, so scores mean the same whatever the sample. Words are told apart by a 64-bit hash.

Defined cases: null or empty text, and texts without any term, have no neighbours and get the sample's share of toxic
rows among such texts; null doc_id is not in a sample and not held out; a doc_id with several labels counts as toxic if one
is; null labels are left out; repeated rows are scored once each; with no usable label every score is 0; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_chunks, texts_of, word_hashes

BLOCK = 64
#: Terms whose postings are kept as dense columns (the most frequent of those in every 64th example), texts judged at once.
DENSE, AT_ONCE = 640, 64


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges one after another, and the size of each."""
    n = ends - starts
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum()), n


def _alike(rows: np.ndarray, terms: np.ndarray, values: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """An order in which alike vectors stand together: a few rounds of k-means over their terms hashed to 64."""
    n = len(ids)
    by_id = np.argsort(ids, kind="stable")
    at = (terms.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58)).astype(np.int64)
    hashed = np.bincount(rows * 64 + at, values, minlength=n * 64).reshape(n, 64)
    centers = hashed[by_id[:: 2 * BLOCK]]
    near = np.zeros(n, np.int64)
    for _ in range(4):
        near = np.argmax(hashed @ (centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)).T, axis=1)
        centers = np.zeros_like(centers)
        np.add.at(centers, near, hashed)
    return np.lexsort((ids, near))


class BlockMaxIndex:
    """Vectors as postings in blocks of BLOCK examples with their largest weights. They come dense (examples x terms) or as
    (row, term, weight) of what isn't 0 with the number of terms. counts: how many labelled rows an example stands for (1)."""

    def __init__(self, vectors: np.ndarray | tuple[np.ndarray, np.ndarray, np.ndarray, int], ids: np.ndarray, toxic: np.ndarray, counts: np.ndarray | None = None) -> None:
        rows, terms, values, width = (*np.nonzero(vectors), vectors[np.nonzero(vectors)], vectors.shape[1]) if isinstance(vectors, np.ndarray) else vectors
        n = len(ids)
        order = _alike(rows, terms, values, ids)
        self.ids, self.toxic = ids[order], toxic[order]
        self.counts = np.ones(n) if counts is None else counts[order]
        self.blocks = -(-n // BLOCK)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        place = place[rows]
        # Postings of frequent terms are dense columns, which a product adds up; the others stand in blocks.
        times = np.bincount(terms, minlength=width)
        often = np.argsort(-times, kind="stable")[:DENSE]
        often = often[times[often] > n // 64]
        self.column = np.full(width, -1, np.int32)
        self.column[often] = np.arange(len(often))
        at = self.column[terms]
        self.dense = np.zeros((len(often), self.blocks * BLOCK))
        self.dense[at[at >= 0], place[at >= 0]] = values[at >= 0]
        place, terms, values = place[at < 0], terms[at < 0], values[at < 0]
        by = np.lexsort((place, terms))
        place, terms = place[by], terms[by]
        self.place, self.weights = place, values[by]
        block = place // BLOCK
        new = np.flatnonzero(np.diff(terms * max(1, self.blocks) + block, prepend=-1))
        self.part = np.append(new, len(place))  # where the postings of a term in a block begin
        self.part_block = block[new]
        self.part_most = np.maximum.reduceat(self.weights, new) if len(new) else np.zeros(0)
        self.first = np.searchsorted(terms[new], np.arange(width + 1))

    def sums(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the frequent terms of each text (terms, weights) add to its product with each example."""
        q = np.zeros((len(texts), len(self.dense)))
        for r, (terms, weights) in zip(q, texts, strict=True):
            at = self.column[terms]
            r[at[at >= 0]] = weights[at >= 0]
        return q @ self.dense

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int | None = None, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest; ties to the smaller id; places with cosine 0 aren't neighbours, nor are
        examples of the id `skip`."""
        if sums is None:
            sums = self.sums([(terms, weights)])[0]
        parts, n = _ranges(self.first[terms], self.first[terms + 1])
        w, block = np.repeat(weights, n), self.part_block[parts]
        bound = np.bincount(block, w * self.part_most[parts], minlength=self.blocks) + sums.reshape(-1, BLOCK).max(axis=1)
        order = np.argsort(-bound, kind="stable")
        places, cosines = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, 4
        while at < self.blocks:
            # Some blocks are visited at a time, of those that can still hold a nearer example.
            least = cosines[-1] - 1e-11 if len(places) == k else 0.0
            now = order[at:at + step]
            now = now[(bound[now] >= least) & (bound[now] > 0)]
            if not len(now):
                break
            visited = np.zeros(self.blocks, bool)
            visited[now] = True
            own = visited[block]
            p, n = _ranges(self.part[parts[own]], self.part[parts[own] + 1])
            acc = sums + np.bincount(self.place[p], np.repeat(w[own], n) * self.weights[p], minlength=len(sums))
            hit = np.flatnonzero(np.repeat(visited, BLOCK) & (acc > 0) & (acc >= least))
            if skip is not None:
                hit = hit[self.ids[hit] != skip]
            places, cosines = np.concatenate([places, hit]), np.concatenate([cosines, np.round(acc[hit], 12)])
            best = np.lexsort((self.ids[places], -cosines))[:k]
            places, cosines = places[best], cosines[best]
            at, step = at + step, step * 16
        return places, cosines

    def vote(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int | None = None, sums: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
        places, cosines = self.nearest(terms, weights, k, skip, sums)
        if not len(places):
            return -1.0, places, cosines
        w = cosines**2 * self.counts[places]
        return float((w * self.toxic[places]).sum() / w.sum()), places, cosines


def isotonic(x: np.ndarray, y: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: thresholds and non-decreasing values, smoothed by one row of the overall share. A row
    counts `counts` times (1)."""
    counts = np.ones(len(x)) if counts is None else counts
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum, n, from
    for v, t, c in zip(x[order], y[order], counts[order], strict=True):
        if pools and pools[-1][2] == v:
            pools[-1][0] += t * c
            pools[-1][1] += c
        else:
            pools.append([float(t * c), float(c), float(v)])
    merged: list[list[float]] = []
    for p in pools:
        merged.append(p)
        while len(merged) > 1 and merged[-2][0] / merged[-2][1] >= merged[-1][0] / merged[-1][1]:
            s, n, _ = merged.pop()
            merged[-1][0] += s
            merged[-1][1] += n
    share = float((y * counts).sum() / counts.sum()) if len(y) else 0.0
    return np.array([p[2] for p in merged]), np.array([(p[0] + share) / (p[1] + 1) for p in merged])


def _weights(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1.0 + np.log(tf)) * idf
    return w / np.sqrt((w * w).sum())


@dataclass
class Examples:
    """The sample's texts as places of words and times, from which each Python process makes the index: a fifth of its size
    is sent and stored."""

    idf: np.ndarray
    sizes: np.ndarray
    terms: np.ndarray
    times: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    counts: np.ndarray

    def __getstate__(self):
        kept = {k: v for k, v in self.__dict__.items() if k != "index"} | {"terms": self.terms.astype(np.int32), "times": self.times.astype(np.int32)}
        return zlib.compress(pickle.dumps(kept, 5), 6)

    def __setstate__(self, state) -> None:
        self.__dict__.update(pickle.loads(zlib.decompress(state)))

    @cached_property
    def index(self) -> BlockMaxIndex:
        rows, terms = np.repeat(np.arange(len(self.ids)), self.sizes), self.terms.astype(np.int64)
        w = (1.0 + np.log(self.times)) * self.idf[terms]
        w /= np.sqrt(np.bincount(rows, w * w, minlength=len(self.ids)))[rows]
        return BlockMaxIndex((rows, terms, w, len(self.idf)), self.ids, self.toxic, self.counts)


def _bags(texts: list[bytes], vocabulary: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of the texts (of the sorted vocabulary: their places there), times, and distinct words a text."""
    h, n = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), n)
    if vocabulary is None:
        vocabulary, at = np.unique(h, return_inverse=True)
        named = vocabulary
    else:
        at = np.minimum(np.searchsorted(vocabulary, h), max(0, len(vocabulary) - 1))
        known = vocabulary[at] == h if len(vocabulary) else np.zeros(len(h), bool)
        doc, at, named = doc[known], at[known], np.arange(len(vocabulary))
    key, times = np.unique(doc * max(1, len(vocabulary)) + at, return_counts=True)
    return named[key % max(1, len(vocabulary))], times, np.bincount(key // max(1, len(vocabulary)), minlength=len(texts))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def score(docs: DataFrame, labels: DataFrame, *, folds: int = 3, fold: int = 1, k: int = 15, toxic_rows: int = 3000, clean_rows: int = 6000, row_bytes: int = 1 << 14, longest: int = 1 << 18,
          terms: int | None = None, least_lift: float | None = None, least_chi2: float | None = None, threshold: float = 0.7, evidence: int = 3) -> DataFrame:
    """doc_id, held_out, score, predicted, n_terms, neighbours (ids of the nearest examples). toxic_rows and clean_rows bound
    the sample's rows and row_bytes its size, to that many bytes a row (met in expectation, by a hash of the id): a text of more
    bytes is sampled less often in proportion, and counts for more. Texts beyond `longest` bytes are scored, but no examples, so
    none can exceed its share by more than longest / row_bytes. All words count unless terms (the most tied to the label by
    chi-square), least_lift or least_chi2 are given."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    remainder = lambda c: F.pmod(F.crc32(c.cast("string")), F.lit(folds))
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != fold)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    by_class = {r[0]: r[1] for r in usable.groupBy("toxic").count().collect()}
    part = {1: min(1.0, toxic_rows / max(1, by_class.get(1, 0))), 0: min(1.0, clean_rows / max(1, by_class.get(0, 0)))}
    u = F.pmod(F.xxhash64("doc_id", F.lit("examples")), F.lit(1 << 30)) / float(1 << 30)
    picked = usable.where(((F.col("toxic") == 1) & (u < part[1])) | ((F.col("toxic") == 0) & (u < part[0])))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    rate = F.when(F.col("toxic") == 1, part[1]).otherwise(part[0]) * F.least(F.lit(1.0), F.lit(float(row_bytes)) / F.greatest(size, F.lit(1)))
    sample = docs.join(F.broadcast(picked), "doc_id").withColumn("rate", rate)  # about toxic_rows + clean_rows rows of two numbers
    sample = sample.where((F.col("rate") > u) & (size <= longest))

    def words(batches):
        for b in batches:
            for x in row_chunks(b, "text"):
                h, times, n = _bags(texts_of(x, "text"))
                yield pa.RecordBatch.from_arrays([*[x.column(c) for c in ("doc_id", "toxic", "rate")], _lists(h.view(np.int64), n), _lists(times.astype(np.int32), n)], names=["doc_id", "toxic", "rate", "words", "tf"])

    rows = sample.mapInArrow(words, "doc_id long, toxic int, rate double, words array<long>, tf array<int>").groupBy("doc_id", "toxic", "words", "tf").agg(F.max("rate").alias("rate"))
    sampled = materialize(rows, "tox-sample")
    got = sampled.orderBy("doc_id", "words", "tf").toArrow().combine_chunks()  # the bounded sample
    example, toxic = got["doc_id"].to_numpy().astype(np.int64), got["toxic"].to_numpy().astype(float)
    sizes = np.array(got["words"].combine_chunks().value_lengths(), np.int64)
    row = np.repeat(np.arange(len(example)), sizes)
    vocabulary, term = np.unique(got["words"].combine_chunks().flatten().to_numpy().astype(np.int64).view(np.uint64), return_inverse=True)
    tf = got["tf"].combine_chunks().flatten().to_numpy().astype(float)
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    counts = 1 / got["rate"].to_numpy()
    usual = counts.mean() if len(counts) else 1.0
    counts /= usual
    share = float((toxic * counts).sum() / counts.sum()) if n1 + n0 else 0.0
    a, b = (np.bincount(term, y[row], minlength=len(vocabulary)) for y in (toxic, 1 - toxic))
    lift = ((a + 1) / (n1 + 2)) / ((b + 1) / (n0 + 2))
    if terms is not None or least_lift is not None or least_chi2 is not None:
        chi2 = (n1 + n0) * (a * (n0 - b) - b * (n1 - a)) ** 2 / ((a + b) * ((n1 + n0) - a - b + 1e-9) * max(1, n1) * max(1, n0))
        kept = np.flatnonzero((chi2 >= (least_chi2 or 0.0)) & (lift >= (least_lift or 0.0)))
        kept = np.sort(kept[np.argsort(-chi2[kept], kind="stable")][:terms])
        new = np.full(len(vocabulary), -1)
        new[kept] = np.arange(len(kept))
        here = new[term] >= 0
        row, tf, term, vocabulary, lift = row[here], tf[here], new[term[here]], vocabulary[kept], lift[kept]
    held = F.coalesce(remainder(F.col("doc_id")) == fold, F.lit(False)).alias("held_out")
    if not len(vocabulary):
        zero = F.lit(share)
        return docs.select("doc_id", held, zero.alias("score"), (zero >= threshold).cast("int").alias("predicted"), F.lit(0).alias("n_terms"), F.array().cast("array<long>").alias("neighbours"))
    sent_words = spark.sparkContext.broadcast(vocabulary)

    def frequencies(batches):
        vocabulary = sent_words.value
        df, total = np.zeros(len(vocabulary), np.int64), 0
        for b in batches:
            for x in row_chunks(b, "text"):
                df += np.bincount(_bags(texts_of(x, "text"), vocabulary)[0], minlength=len(df))
                total += x.num_rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(df[at], total))], names=["term", "n"])

    counted = docs.mapInArrow(frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # one row a word of the sample
    at, n = counted["term"].to_numpy(), counted["n"].to_numpy()
    df = np.zeros(len(vocabulary))
    df[at[at >= 0]] = n[at >= 0]
    idf = (np.log((n[at < 0].sum() + 1.0) / (df + 1.0)) + 1.0) * (1.0 + np.maximum(0.0, np.log(lift)))
    sizes = np.bincount(row, minlength=len(example))
    has = sizes > 0
    sent = spark.sparkContext.broadcast(Examples(idf, sizes[has], term, tf, example[has], toxic[has], counts[has]))

    def votes(batches):
        vocabulary, index, idf = sent_words.value, sent.value.index, sent.value.idf
        for b in batches:
            raw = []
            for d, h, f in zip(b.column("doc_id").to_pylist(), b.column("words"), b.column("tf"), strict=True):
                h, f = h.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), f.values.to_numpy(zero_copy_only=False).astype(float)
                t = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                known = vocabulary[t] == h
                raw.append(index.vote(t[known], _weights(f[known], idf[t[known]]), k, d)[0] if known.any() else -1.0)
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.float64()), b.column("toxic"), b.column("rate")], names=["raw", "toxic", "rate"])

    voted = [(r[0], r[1], 1 / r[2] / usual) for r in sampled.mapInArrow(votes, "raw double, toxic int, rate double").collect()]  # the bounded sample
    voted = [v for v in voted if v[0] >= 0]
    steps, values = isotonic(np.array([v[0] for v in voted]), np.array([float(v[1]) for v in voted]), np.array([v[2] for v in voted])) if voted else (np.zeros(1), np.zeros(1))
    without = float(((toxic * counts)[~has].sum() + 0.5 * share) / (counts[~has].sum() + 0.5))

    def judge(batches):
        vocabulary, index, idf = sent_words.value, sent.value.index, sent.value.idf
        empty = (b"", b"")
        kept: dict = {empty: (without, [])}
        for b in batches:
            for x in row_chunks(b, "text"):
                terms, times, sizes = _bags(texts_of(x, "text"), vocabulary)
                ends = np.cumsum(sizes)
                keys = [(terms[a:z].tobytes(), times[a:z].tobytes()) for a, z in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                if len(kept) > 2000:
                    kept = {empty: (without, [])}
                new = list(dict.fromkeys(key for key in keys if key not in kept))
                for i in range(0, len(new), AT_ONCE):
                    texts = [(t := np.frombuffer(h, np.int64), _weights(np.frombuffer(f, np.int64), idf[t])) for h, f in new[i:i + AT_ONCE]]
                    for key, (t, w), sums in zip(new[i:i + AT_ONCE], texts, index.sums(texts), strict=True):
                        raw, places, _ = index.vote(t, w, k, None, sums)
                        kept[key] = (float(values[max(0, np.searchsorted(steps, raw, side="right") - 1)]) if raw >= 0 else without, [int(i) for i in index.ids[places[:evidence]]])
                scores, near = [kept[key][0] for key in keys], [kept[key][1] for key in keys]
                yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(scores, pa.float64()), pa.array(sizes, pa.int32()), pa.array(near, pa.list_(pa.int64()))], names=["doc_id", "score", "n_terms", "neighbours"])

    out = docs.mapInArrow(judge, "doc_id long, score double, n_terms int, neighbours array<long>")
    return out.select("doc_id", held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_terms", "neighbours")
