"""Shared helpers: scratch tables in the shared folder, hashing of words, row chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.functions.lineage import clear_scratch, materialize, scratch_root  # noqa: F401

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Word characters: every code point but ASCII that is neither a digit nor a small letter (texts are lower-cased first).
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
#: Lower-cases A-Z and turns every byte outside words into a space.
WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _KEEP else 0x20 for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def words_column(c: Column) -> Column:
    """Array of the text's words; empty for null."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(c), F.lit(WORD_PATTERN), F.lit(0)), F.array().cast("array<string>"))


def row_chunks(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices a batch so that one text column holds about max_bytes at most, one row at least."""
    if not batch.num_rows:
        return
    texts = batch.column(column)
    sizes = np.array([0 if x is None else x for x in pc.binary_length(texts).to_pylist()], dtype=np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, 0x9E3779B97F4A7C15, np.uint64)]), dtype=np.uint64)
    return _POWERS[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, in order, and the number of words of each text."""
    joined = b" ".join(texts).translate(WORD_BYTES)
    raw = np.frombuffer(joined, dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    inside = raw != 0x20
    starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
    ends = np.flatnonzero(inside & np.concatenate([~inside[1:], [True]])) + 1
    bounds = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, bounds, side="left")]))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    at = np.flatnonzero(inside)
    lengths = ends - starts
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    within = np.arange(len(at)) - np.repeat(first, lengths)
    values = (raw[at].astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[within]
    return mix64(np.add.reduceat(values, first) + lengths.astype(np.uint64)), counts
