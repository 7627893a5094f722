"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

Every token has a cell: the most frequent ones have one each, all others share hashed ones. Cells are dealt to classes, and

    P(token | h) = P(class | h) * P(cell | class, h) * P(token | cell).

The first two are softmaxes: the smoothed log count of the class (of the cell) plus weights of hashed features of the two
tokens before, whatever tokens they are: the bigram, and for classes the skip (second token back). The last is the token's smoothed
share of its cell, which has room for one unknown token, so probabilities add up to 1. Cells, classes and weights grow with
the vocabulary V: about V ** 0.4 cells, in as many classes as a class has cells, and rows of weights in proportion to
classes.

Training sees every training token once. Each of `rounds` distributed gradient updates is a Spark job over a slice of the
training texts: a task starts from the weights so far, runs over its texts by minibatches (steps scaled by the root of a
row's summed squares), and sends what it changed in blocks; blocks are averaged side by side, each row by the squares that
a task added to it. The number of tasks grows with the input, each with text enough for what it sends. Scoring gathers log
probabilities in sparse numpy batches.

Counts of tokens over the training texts are exact. The HEAD most frequent ones are broadcast (bounded); all others are
joined to the texts that have them by a shuffle, in which no token is hot, as those are in the head.

Defined cases: null text is empty (its end token only); rows with null doc_id are not held out; repeated rows are counted
and scored once each; tokens and texts of any length; an empty table gives no rows; with no training text all cells are
alike; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_chunks, texts_of

HEAD = 1 << 16
END = b"\n"  # no word holds white space
#: Tokens in a minibatch; blocks in which a table of weights is sent; least bytes of text for a training task.
BATCH, BLOCKS, TASK_BYTES = 1024, 64, 12 << 20
RATE = 0.5
CELL_FEATURES = 1
_U = np.uint64


def tokens(text: bytes) -> list[bytes]:
    """bytes.lower() and split() treat ASCII only, and split() at x09-x0D and x20, as the contract has it."""
    return [*text.lower().split(), END]


def held_out(doc_id: int | None, folds: int, fold: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % folds == fold if doc_id is not None else False


def _is_held(folds: int, fold: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == fold, F.lit(False))


def width_bits(vocabulary: int) -> int:
    """Bits of the number of classes, which is that of cells in a class: 16 of 16 for 9,000 tokens, 32 of 32 up to 10 million."""
    return max(4, int(np.log2(max(2, vocabulary)) / 5 + 1.35))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def features(last: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of bigram and skip features: 2 x tokens. Cells use the first CELL_FEATURES."""
    return np.stack([_mixed(last * _U(8) + _U(1)), _mixed(second * _U(8) + _U(2))])


def class_rows(h: np.ndarray, rows: int) -> np.ndarray:
    return (h >> _U(65 - rows.bit_length())).astype(np.int64)


def cell_rows(h: np.ndarray, classes: np.ndarray, rows: int) -> np.ndarray:
    return (_mixed(h + classes.astype(_U) * _U(0x165667B19E3779F9)) >> _U(65 - rows.bit_length())).astype(np.int64)


def logits(weights: np.ndarray, prior: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of weights and prior, between -80 and 80, where exp() is finite."""
    z = weights.take(rows[0], axis=0)
    for r in rows[1:]:
        z += weights.take(r, axis=0)
    z += prior
    return np.clip(z, -80, 80, out=z)


def softmax(z: np.ndarray) -> np.ndarray:
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[1], z.dtype))[:, None]
    return z


def log_of(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log of the softmax of each row of z at one place."""
    own = z[np.arange(len(z)), at]
    np.exp(z, out=z)
    return own - np.log(z @ np.ones(z.shape[1], z.dtype))


def descend(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, error: np.ndarray, rate: float) -> None:
    """One step against `error`, the gradient in the logits of each token, for all feature rows of the tokens."""
    size = np.einsum("ij,ij->i", error, error)
    np.add.at(squares, rows.ravel(), np.concatenate([size] * len(rows)))
    flat, place = weights.reshape(-1), np.arange(weights.shape[1])
    for r in rows:
        step = error * (-rate / np.sqrt(squares[r] + np.float32(1e-3)))[:, None]
        np.add.at(flat, (r[:, None] * len(place) + place).ravel(), step.ravel())


@dataclass
class Model:
    """head: token to place by frequency; logs: log10 of 1 + count by place, and of 1; cells: cell by place; the first `own`
    places have a cell each. room: log10 of 1 + tokens + distinct tokens of each cell (0 for cells of one token)."""

    head: dict[bytes, int]
    logs: np.ndarray
    cells: np.ndarray
    own: int
    room: np.ndarray
    class_prior: np.ndarray
    cell_prior: np.ndarray
    class_weights: np.ndarray
    cell_weights: np.ndarray
    total: int
    distinct: int
    least: int

    @property
    def classes(self) -> int:
        return len(self.class_prior)

    def read(self, texts: list[list[bytes]]) -> tuple[np.ndarray, ...]:
        """Places (-1 beyond the head), cells and the two contexts of all tokens of the texts, and tokens a text. Before a
        text stand two ends."""
        lengths = np.array([len(t) for t in texts], np.int64)
        flat = list(chain.from_iterable(texts))
        place = np.fromiter(map(self.head.get, flat, repeat(-1)), np.int64, len(flat))
        beyond = np.flatnonzero(place < 0)
        crc = np.fromiter((zlib.crc32(flat[i]) for i in beyond.tolist()), np.int64, len(beyond))
        cell = self.cells[place]
        shared = len(self.room) // 2
        cell[beyond] = shared + crc % shared
        name = place.astype(_U)
        name[beyond] = (crc + (1 << 32)).astype(_U)
        start = np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = np.arange(len(flat))
        end = _U(self.head[END]) if END in self.head else _U(zlib.crc32(END) + (1 << 32))
        before = lambda k: np.where(at - k >= start, name[np.maximum(at - k, 0)], end)
        return place, cell, before(1), before(2), lengths

    def log_cells(self, cell: np.ndarray, last: np.ndarray, second: np.ndarray) -> np.ndarray:
        """log10 P(cell | the two tokens before)."""
        out = np.empty(len(cell))
        for i in range(0, len(cell), BATCH):
            c = cell[i:i + BATCH]
            h, cls = features(last[i:i + BATCH], second[i:i + BATCH]), c % self.classes
            out[i:i + BATCH] = log_of(logits(self.class_weights, self.class_prior, class_rows(h, len(self.class_weights))), cls)
            out[i:i + BATCH] += log_of(logits(self.cell_weights, self.cell_prior[cls], cell_rows(h[:CELL_FEATURES], cls, len(self.cell_weights))), c // self.classes)
        return out / np.log(10)


def token_counts(train: DataFrame) -> DataFrame:
    """token, c over all training texts; tasks add up first."""

    def count(batches):
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["token", "c"])

        for b in batches:
            for x in row_chunks(b, "text"):
                for t in texts_of(x, "text"):
                    held.update(tokens(t))
                if len(held) > 300_000:
                    yield out()
                    held.clear()
        yield out()

    return train.mapInArrow(count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _log_share(n: np.ndarray) -> np.ndarray:
    return np.log(n / n.sum(axis=-1, keepdims=True)).astype(np.float32)


def untrained(counts: DataFrame) -> Model:
    """The model whose weights are all 0: classes and cells by their counts alone."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = [(bytes(r[0]), r[1]) for r in counts.orderBy(F.desc("c"), "token").limit(HEAD).collect()]
    bits = width_bits(distinct)
    classes, cells = 1 << bits, 1 << 2 * bits
    shared = cells // 2
    own = min(shared, len(head))
    n, v = np.zeros(cells), np.zeros(cells)
    for r in counts.groupBy(F.pmod(F.crc32("token"), F.lit(shared)).alias("cell")).agg(F.sum("c"), F.count("*")).collect():  # a row a cell
        n[shared + r[0]], v[shared + r[0]] = r[1], r[2]
    crc = np.array([zlib.crc32(t) for t, _ in head], np.int64)
    at = shared + crc % shared
    c = np.array([c for _, c in head], np.float64)
    np.subtract.at(n, at[:own], c[:own])
    np.subtract.at(v, at[:own], 1)
    n[:own], v[:own] = c[:own], 1
    at[:own] = np.arange(own)
    by_class = n.reshape(classes, classes).T  # of cell i, i % classes is the class
    room = np.where(np.arange(cells) < shared, 0.0, np.log10(n + v + 1))
    weights = (np.zeros((1 << bits + k, classes), np.float32) for k in (11, 12))
    return Model(dict(zip((t for t, _ in head), range(len(head)), strict=True)), np.log10(np.append(c, 0.0) + 1.0), np.append(at, -1), own, room, _log_share(by_class.sum(axis=1) + 1), _log_share(by_class + 1), *weights, int(total), int(distinct), int(head[-1][1]) if head else 0)


def train_batches(model: Model, cell: np.ndarray, last: np.ndarray, second: np.ndarray, squares: list[np.ndarray], rate: float = RATE) -> None:
    """Gradient steps over minibatches of tokens; weights change in place."""
    for i in range(0, len(cell), BATCH):
        c = cell[i:i + BATCH]
        h, cls, row = features(last[i:i + BATCH], second[i:i + BATCH]), c % model.classes, np.arange(len(c))
        for k, (weights, prior, rows, at) in enumerate((
            (model.class_weights, model.class_prior, class_rows(h, len(model.class_weights)), cls),
            (model.cell_weights, model.cell_prior[cls], cell_rows(h[:CELL_FEATURES], cls, len(model.cell_weights)), c // model.classes),
        )):
            error = softmax(logits(weights, prior, rows))
            error[row, at] -= 1
            descend(weights, squares[k], rows, error, np.float32(rate))


_MOVED = "which int, block int, moved binary, squares binary"


def _merged(batches):
    """For each block of rows, the mean of what tasks changed, each row weighted by the squares that a task added to it."""
    sums: dict = {}
    for b in batches:
        for i in range(b.num_rows):
            key = b.column("which")[i].as_py(), b.column("block")[i].as_py()
            added = np.frombuffer(b.column("squares")[i].as_buffer(), "<f4").astype(np.float64)
            moved = np.frombuffer(b.column("moved")[i].as_buffer(), "<f2").reshape(len(added), -1) * added[:, None]
            old = sums.get(key)
            sums[key] = (moved, added, added**2) if old is None else (old[0] + moved, old[1] + added, old[2] + added**2)
    for (which, block), (moved, added, twice) in sums.items():
        n = np.maximum(added, 1e-30)
        yield pa.RecordBatch.from_arrays([pa.array([which], pa.int32()), pa.array([block], pa.int32()), *[pa.array([x.astype("<f4").tobytes()], pa.binary()) for x in (moved / n[:, None], twice / n)]], names=["which", "block", "moved", "squares"])


def fit(train: DataFrame, model: Model, text_bytes: int, rounds: int = 2) -> None:
    """Trains the model's weights by distributed gradient updates, each over a slice of the texts (train: doc_id, text)."""
    spark = train.sparkSession
    tables = [model.class_weights, model.cell_weights]
    squares = [np.zeros(len(w), np.float32) for w in tables]
    model_bytes = sum(w.nbytes for w in tables)
    tasks = int(max(1, text_bytes // rounds // max(TASK_BYTES, model_bytes // 2)))
    for r in range(rounds):
        sent = spark.sparkContext.broadcast((model, squares))

        def part(batches, sent=sent):
            model, old = sent.value
            before = [model.class_weights, model.cell_weights]
            own = Model(**{**model.__dict__, "class_weights": before[0].copy(), "cell_weights": before[1].copy()})
            squares = [x.copy() for x in old]
            for b in batches:
                for x in row_chunks(b, "text"):
                    _, cell, last, second, _ = own.read([tokens(t) for t in texts_of(x, "text")])
                    train_batches(own, cell, last, second, squares)
            for k, (new, was) in enumerate(zip((own.class_weights, own.cell_weights), before, strict=True)):
                for block, at in enumerate(np.array_split(np.arange(len(new)), BLOCKS)):
                    i = slice(at[0], at[-1] + 1)
                    added = squares[k][i] - old[k][i]
                    if added.any():
                        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([block], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in ((new[i] - was[i]).astype("<f2"), added.astype("<f4"))]], names=["which", "block", "moved", "squares"])

        piece = train.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == r).select("text")
        moved = piece.coalesce(tasks).mapInArrow(part, _MOVED).repartition(BLOCKS, "which", "block").mapInArrow(_merged, _MOVED)
        for row in moved.toLocalIterator():  # 2 * BLOCKS rows: the size of the model, whatever the input
            k, i = row["which"], np.array_split(np.arange(len(tables[row["which"]])), BLOCKS)[row["block"]]
            tables[k][i] += np.frombuffer(row["moved"], "<f4").reshape(len(i), -1)
            squares[k][i] += np.frombuffer(row["squares"], "<f4")
        sent.destroy()


def train_model(docs: DataFrame, *, folds: int = 7, fold: int = 2, rounds: int = 2) -> tuple[Model, DataFrame]:
    """The model of all texts that are not held out, and their tokens' counts (token, c)."""
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(~_is_held(folds, fold))
    counts = materialize(token_counts(train.select("text")), "lm-counts")
    model = untrained(counts)
    text_bytes = counts.agg(F.coalesce(F.sum((F.octet_length("token") + 1) * F.col("c")), F.lit(0))).first()[0]
    if model.total:
        fit(train, model, text_bytes, rounds)
    return model, counts


def score_texts(docs: DataFrame, model: Model, counts: DataFrame, *, folds: int = 7, fold: int = 2) -> DataFrame:
    """One row a document; see the contract for the columns."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    all_known = model.distinct <= len(model.head)

    def read(batches):
        model = sent.value
        at, task = 0, TaskContext.get().partitionId()
        for b in batches:
            for x in row_chunks(b, "text"):
                texts = [tokens(t) for t in texts_of(x, "text")]
                place, cell, last, second, lengths = model.read(texts)
                known, ends = place >= 0, np.cumsum(lengths)
                begins = ends - lengths  # a text has one token at least
                log = model.logs[place]
                inner = np.where(known & (place < model.own), 0.0, log - model.room[cell])
                base, fitted = np.add.reduceat(log, begins), np.add.reduceat(model.log_cells(cell, last, second) + inner, begins)
                n_known = np.add.reduceat(known.astype(np.int64), begins)
                tail, times = [[] for _ in texts], [[] for _ in texts]
                if not all_known:
                    at_text = np.repeat(np.arange(len(texts)), lengths - n_known)
                    inside = (np.flatnonzero(~known) - begins[at_text]).tolist()
                    counted: list[Counter] = [Counter() for _ in texts]
                    for i, j in zip(at_text.tolist(), inside, strict=True):
                        counted[i][texts[i][j]] += 1
                    tail, times = [list(c) for c in counted], [list(c.values()) for c in counted]
                key = [(task << 40) + at + i for i in range(len(texts))]
                at += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [x.column("doc_id"), pa.array(key, pa.int64()), pa.array(lengths), pa.array(n_known), pa.array(base), pa.array(fitted), pa.array(tail, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))],
                    names=["doc_id", "key", "n_tokens", "known", "base", "fitted", "tail", "times"],
                )

    read_docs = materialize(docs.mapInArrow(read, "doc_id long, key long, n_tokens long, known long, base double, fitted double, tail array<binary>, times array<long>"), "lm-read")
    rare = read_docs.select("key", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("key", F.col("x.tail").alias("token"), F.col("x.times").alias("k"))
    # The head holds the most frequent tokens, so a token that is left has few rows.
    found = rare.join(counts.where(F.col("c") <= model.least), "token").groupBy("key").agg(F.sum("k").alias("more_known"), F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("more"))
    more = F.coalesce("more", F.lit(0.0))
    return read_docs.join(found, "key", "left").select(
        "doc_id", _is_held(folds, fold).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(float(np.log10(model.total + model.distinct + 1)))).alias("base_score"), (F.col("fitted") + more).alias("score"),
    )


def score(docs: DataFrame, *, folds: int = 7, fold: int = 2, rounds: int = 2) -> DataFrame:
    """Trains on the rows that are not held out and scores all."""
    model, counts = train_model(docs, folds=folds, fold=fold, rounds=rounds)
    return score_texts(docs, model, counts, folds=folds, fold=fold)
