"""Mixture-controlled packing of token ids into sequences.

Deficit round-robin: every source of a lane is a queue of documents. For each window (one sequence) each source that
still has tokens earns its target share of the window and is served up to what it has earned; what is over or missing
stays in its deficit for the next window. Lanes are groups of documents, by a hash of id, text and input partition, of about
`lane_bytes` or one document; they are packed side by side. A lane starts with what its sources are owed by all earlier
lanes; that debt is paid back over its windows at a bounded rate.

Defined cases: null text is empty (only the end id); null doc_id stays null; null source is a queue of its own; repeated
rows are packed once each, and rows that share a doc_id, null ones too, are dealt to lanes by their texts, equal texts by
their input partitions; texts of any length and any run of white space have the file's ids; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("source", pa.string())])
# Fixed value: how byte-level files split text before their merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encoders: dict[str, "Encoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids as little-endian 32-bit bytes. The file defines them through its own library; where it is a byte-level BPE whose
    merges stand in the order of their ids, a rank-based encoder built from the same file gives the same ids faster and is
    used for all texts that hold none of the file's added tokens."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        self.added = [x["content"] for x in spec.get("added_tokens") or []]
        self.fast = _rank_encoder(spec, self.added)

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self.fast is None or any(x in text for x in self.added):
            return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        try:
            ids = self.fast.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # a run of white space beyond what its pattern can step back over
            ids = np.asarray(self.tok.encode(text, add_special_tokens=False).ids)
        return ids.astype("<u4", copy=False).tobytes()


def _rank_encoder(spec: dict, added: list[str]):
    """None unless ranks say all that the file says."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    if spec.get("normalizer") or model.get("type") != "BPE" or not plain or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    import tiktoken

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the files show as themselves
    letters = {chr(c): b for b, c in [*zip(shown, shown, strict=True), *((b, 256 + i) for i, b in enumerate(x for x in range(256) if x not in shown))]}
    vocab = {k: v for k, v in model["vocab"].items() if k not in added}
    merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
    singles = sum(len(k) == 1 for k in vocab)
    if singles != 256 or not all(c in letters for k in vocab for c in k) or [vocab.get(a + b) for a, b in merges] != list(range(256, 256 + len(merges))) or len(vocab) != 256 + len(merges):
        return None
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks={bytes(letters[c] for c in k): v for k, v in vocab.items()}, special_tokens={})


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def serve(supply: np.ndarray, share: np.ndarray, debt: np.ndarray, width: int, least: int, rate: float) -> list[list[tuple[int, int]]]:
    """For each window, (queue, tokens) in order of service. Windows are width long; the rest is cut into powers of two."""
    left, deficit, debt = supply.astype(np.int64).copy(), np.zeros(len(supply)), debt.astype(float).copy()
    total, out = int(left.sum()), []
    while total:
        room = width if total >= width else 1 << (total.bit_length() - 1)
        total -= room
        active = left > 0
        q = np.where(active, share, 0.0)
        q = q / q.sum() if q.sum() > 0 else active / active.sum()
        pay = np.clip(debt, -rate * room * q, rate * room * q)
        debt -= pay
        deficit = np.where(active, deficit, 0.0)
        earned = q * room + pay
        deficit += earned * (room / earned.sum()) - q * deficit.sum()  # what is earned is the window, so deficits add up to 0
        order = np.argsort(-np.where(active, deficit, -np.inf), kind="stable")[:np.count_nonzero(active)].tolist()
        stock, owed, served = left.tolist(), deficit.tolist(), []
        for full in (False, True):
            for i in order:
                if not room:
                    break
                n = min(stock[i], room, room if full else int(max(0.0, owed[i])))
                if n <= 0 or not full and n < min(least, stock[i]):
                    continue
                served.append((i, n))
                stock[i] -= n
                owed[i] -= n
                room -= n
        left, deficit = np.array(stock, np.int64), np.array(owed)
        out.append(served)
    return out


def pieces(names: list, queues: dict, plan: list[list[tuple[int, int]]], first_sequence: int) -> pa.Table:
    """What the plan serves of each queue, cut where documents end."""
    flat = np.array([(k, i, n) for k, served in enumerate(plan) for i, n in served], np.int64).reshape(-1, 3)
    window, queue, n = flat.T
    before = np.cumsum(n) - n
    opens = np.searchsorted(window, window)
    offset = before - before[opens]
    parts = []
    for i, name in enumerate(names):
        own = np.flatnonzero(queue == i)
        ends = np.cumsum(n[own])
        served_from = ends - n[own]
        ids = [b for _, b in queues[name]]
        sizes = np.array([len(b) // 4 for b in ids], np.int64)
        doc_from = np.cumsum(sizes) - sizes
        start = np.union1d(served_from, doc_from)
        stop = np.append(start[1:], sizes.sum())
        doc, turn = np.searchsorted(doc_from, start, "right") - 1, np.searchsorted(served_from, start, "right") - 1
        view = memoryview(b"".join(ids))
        crc = [zlib.crc32(view[4 * x:4 * y]) for x, y in zip(start.tolist(), stop.tolist(), strict=True)]
        doc_ids = pa.array([d for d, _ in queues[name]], pa.int64()).take(pa.array(doc))
        cols = (doc_ids, start - doc_from[doc], stop - start, crc, sizes[doc], first_sequence + window[own][turn], offset[own][turn] + start - served_from[turn], [name] * len(start))
        parts.append(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, _ARROW.types, strict=True)], schema=_ARROW))
    return pa.concat_tables(parts)


def _before(sums: DataFrame, column: str, by: list[str], block: int = 1024) -> DataFrame:
    """sums with `<column>_before`: the total of the column over all smaller lanes (with the same `by`). Blocks of lanes are
    added up first, so that no task orders all lanes."""
    sums = sums.withColumn("block", F.floor(F.col("lane") / block))
    inside = W.partitionBy("block", *by).orderBy("lane").rowsBetween(W.unboundedPreceding, -1)
    across = W.partitionBy(*by).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = sums.groupBy("block", *by).agg(F.sum(column).alias("x")).select(F.col("block").alias("k"), *[F.col(c).alias(f"k_{c}") for c in by], F.sum("x").over(across).alias("earlier"))
    met = F.col("block") == F.col("k")
    for c in by:
        met = met & F.col(c).eqNullSafe(F.col(f"k_{c}"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = sums.withColumn("here", F.sum(column).over(inside)).join(blocks, met)
    return out.select(*[c for c in sums.columns if c != "block"], (zero(F.col("here")) + zero(F.col("earlier"))).alias(f"{column}_before"))


def pack(docs: DataFrame, *, tokenizer_path: str | None = None, end_id: int = 0, width: int = 1024, target: Mapping[str, float] | None = None,
         lane_bytes: int = 16 << 20, least_piece: int = 32, pay_rate: float = 0.1) -> DataFrame:
    """Pieces of documents in sequences. target: source to share of tokens (default: the share of bytes that it has in
    docs); sources that it lacks get what is left once the others are empty. lane_bytes bounds what a task holds."""
    path = tokenizer_path or default_tokenizer()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("source").cast("string").alias("source"))
    size = F.octet_length("text") + F.lit(3)
    lanes = max(1, -(-(docs.agg(F.sum(size)).first()[0] or 0) // lane_bytes))
    # One id may stand in many rows, and one text too: the input partition (the same in both passes) splits those.
    docs = docs.withColumn("lane", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(lanes)))
    sums = materialize(docs.groupBy("lane", "source").agg(F.sum(size).alias("b")), "pack-sums")
    by_lane = sums.groupBy("lane").agg(F.sum("b").alias("t"))
    before = _before(by_lane, "t", []).select(F.col("lane").alias("l2"), F.col("t_before"))
    every = sums.groupBy(F.col("source").alias("s2")).agg(F.sum("b").alias("b_all"))
    total = sums.agg(F.sum("b")).first()[0] or 1
    if target is None:
        share = F.col("b_all") / F.lit(total)
    else:
        pairs = [F.lit(x) for kv in target.items() for x in kv]
        share = F.coalesce(F.element_at(F.create_map(*pairs), F.col("source")), F.lit(0.0)) if pairs else F.lit(0.0)
    owed = (
        _before(sums, "b", ["source"]).join(every, F.expr("source <=> s2")).join(before, F.expr("lane = l2"))
        .select(F.col("lane").alias("owed_lane"), F.col("source").alias("owed_source"), "b", share.cast("double").alias("share"), (F.col("t_before") * share - F.col("b_before")).cast("double").alias("owed"))
    )

    def run(key, left, right):
        if not left.num_rows:
            return _ARROW.empty_table()
        enc, lane = encoder(path), int(key[0].as_py())
        end = int(end_id).to_bytes(4, "little")
        queues: dict = {}
        for d, t, s in sorted(zip(left.column("doc_id").to_pylist(), left.column("text").to_pylist(), left.column("source").to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1])):
            queues.setdefault(s, []).append((d, enc.ids(t) + end))
        names = sorted(queues, key=lambda s: (s is None, s or ""))
        facts = {s: (sh, ow) for s, sh, ow in zip(right.column("owed_source").to_pylist(), right.column("share").to_pylist(), right.column("owed").to_pylist(), strict=True)}
        supply = np.array([sum(len(b) for _, b in queues[s]) // 4 for s in names])
        per_byte = supply.sum() / max(1, sum(right.column("b").to_pylist()))
        none = (0.0, 0.0)
        plan = serve(supply, np.array([facts.get(s, none)[0] for s in names]), np.array([facts.get(s, none)[1] * per_byte for s in names]), width, least_piece, pay_rate)
        return pieces(names, queues, plan, lane << 32)

    return docs.groupBy("lane").cogroup(owed.groupBy("owed_lane")).applyInArrow(run, SCHEMA)
