"""Byte-level BPE by prefix dynamic programming: encoding, decoding, exact appends and re-encoding near edits.

A text is cut by the pattern; merges never leave a piece. The encoding of every byte prefix of a piece ends in exactly one
token: the token that the prefix ends with and that may follow the last token of what is before it. The table of these last
tokens is the state of a text. Ids are read off it backwards; a longer text only adds entries; after an edit, entries are
computed anew until they agree with the old ones over the length of the longest token, and from there on they are the same.

Whether two tokens may be neighbours depends on them alone: a merge across their border must at no time have been the next
one. The tokens at the border, while both sides grow, lie on the right spine of the one and on the left spine of the other.

Defined cases: null text is empty (no ids); empty texts have no ids; null doc_id stays null and takes no edits; repeated rows
are encoded once each; texts are read in windows, so they and their pieces may have any length; a special token's string is
ordinary text; an empty table gives no rows; other columns are ignored. A file whose tokens don't come from merges in the
order of their ranks is an error.
"""

from __future__ import annotations

import base64
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_chunks, texts_of

# Fixed value: how byte-level files split text before their merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A piece is settled, whatever follows, if so many code points follow its start and its end: contractions have three, and
#: the end of a run is seen by one more.
FROM_START, FROM_END = 3, 1
WINDOW, NEAR = 1 << 20, 1 << 12
MOST_PIECES, MOST_PAIRS, SHORT = 250_000, 1 << 20, 64
#: Marks the first byte of a piece in a table of last tokens.
FIRST = np.uint32(1 << 31)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Vocabulary:
    """The tokens of a rank file, how each came to be, and the last tokens of prefixes."""

    def __init__(self, path: str, pattern: str = SPLIT) -> None:
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens: dict[int, bytes] = {r: b for b, r in self.ranks.items()}
        self.longest = max(map(len, self.ranks), default=1)
        self.split = regex.compile(pattern)
        #: Rank of the merge that makes a token; bytes are there from the start.
        self.born = {r: r if len(b) > 1 else -1 for r, b in self.tokens.items()}
        self.sizes = {r: len(b) for r, b in self.tokens.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.pairs: dict[int, bool] = {}
        self.known = _Pieces(self)
        self.suffixes = ahocorasick.Automaton()
        for r in sorted(self.tokens):
            b = self.tokens[r]
            self.suffixes.add_word(b.decode("latin-1"), (r, len(b)))
            if len(b) > 1:
                self.parts[r] = self._merged(r, b)
        self.suffixes.make_automaton()

    def _merged(self, r: int, b: bytes) -> tuple[int, int]:
        """The two tokens that are left when all merges before r are done in b."""
        for i in range(1, len(b)):
            x, y = self.ranks.get(b[:i], r), self.ranks.get(b[i:], r)
            if x < r and y < r and self._fit(x, y, r):
                return x, y
        raise ValueError(f"token {r} doesn't come from merges of lower rank")

    def _fit(self, x: int, y: int, before: float = math.inf) -> bool:
        """Whether no merge below `before` crosses the border of tokens x and y. Backwards in time: x and y are the tokens at
        the border, each until the merge that takes it up; of equal merges the left one comes first."""
        x_until = y_until = before
        ranks, tokens, born = self.ranks, self.tokens, self.born
        while True:
            since_x, since_y = born[x], born[y]
            m = ranks.get(tokens[x] + tokens[y])
            if m is not None and since_x < m and since_y < m < x_until and m <= y_until:
                return False
            if since_x > since_y:
                x_until, x = since_x, self.parts[x][1]
            elif since_y >= 0:
                y_until, y = since_y, self.parts[y][0]
            else:
                return True

    def fit(self, x: int, y: int) -> bool:
        key = x << 32 | y
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            ok = self.pairs[key] = self._fit(x, y)
        return ok

    def last_tokens(self, piece: bytes) -> list[int]:
        """The last token of every prefix of a piece. Tokens come by rising end, so prefixes before theirs are settled."""
        last, pairs = [-1] * len(piece), self.pairs
        for end, (t, size) in self.suffixes.iter(piece.decode("latin-1")):
            if last[end] < 0:
                before = end - size
                if before < 0:
                    last[end] = t
                    continue
                ok = pairs.get(last[before] << 32 | t)
                if self.fit(last[before], t) if ok is None else ok:
                    last[end] = t
        return last

    def more_tokens(self, piece: bytes, known: list[int], tail: np.ndarray | None) -> tuple[list[int], int]:
        """last_tokens() of a piece that an edit changed, and how many were computed. known: those of its first bytes. tail: last
        tokens, before the edit, of the bytes that end the piece now, as far as they were in one piece then; used once they
        agree with the new ones for as long as the longest token."""
        n, done = len(piece), len(known)
        last = [*known, *[-1] * (n - done)]
        low = max(0, done - self.longest)
        tail_from, agree, at = n - (0 if tail is None else len(tail)), 0, done
        for end, (t, size) in self.suffixes.iter(piece[low:].decode("latin-1")):
            end += low
            if end > at:  # the prefix up to `at` has its token
                if tail is not None and at >= tail_from:
                    agree = agree + 1 if last[at] == tail[at - tail_from] else 0
                    if agree >= self.longest:
                        last[at + 1 :] = tail[at + 1 - tail_from :].tolist()
                        return last, at + 1 - done
                at = end
            if end >= done and last[end] < 0 and (end < size or self.fit(last[end - size], t)):
                last[end] = t
        return last, n - done

    def ids(self, last: list[int]) -> list[int]:
        """Tokens of a piece, read backwards from its last prefix."""
        out, i, sizes = [], len(last) - 1, self.sizes
        while i >= 0:
            t = last[i]
            out.append(t)
            i -= sizes[t]
        out.reverse()
        return out

    def pieces(self, text: str, window: int = WINDOW) -> Iterator[list[str]]:
        """The matches of the pattern, list by list: a window's matches that are settled whatever comes after it."""
        start, size = 0, window
        while start < len(text):
            stop = min(len(text), start + size)
            found, end = self.split.findall(text, start, stop), stop
            while stop < len(text) and found and (end + FROM_END > stop or end - len(found[-1]) + FROM_START > stop):
                end -= len(found.pop())
            start, size = end if found else start, window if found else 2 * size
            yield found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        self.known.trim()
        return b"".join(b"".join(map(self.known.__getitem__, found)) for found in self.pieces(text))

    def table(self, text: str) -> bytes:
        """The state of a text: 32 bits a byte."""
        return b"".join(self._marked(self.last_tokens(p.encode())).tobytes() for found in self.pieces(text) for p in found)

    @staticmethod
    def _marked(last) -> np.ndarray:
        out = np.array(last, dtype="<u4")
        out[:1] |= FIRST
        return out

    def ids_of_table(self, last: np.ndarray) -> bytes:
        starts = [*np.flatnonzero(last & FIRST).tolist(), len(last)]
        plain = last & ~FIRST
        return np.array([t for a, b in zip(starts, starts[1:], strict=False) for t in self.ids(plain[a:b].tolist())], dtype="<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def revise(self, text: bytes, last: np.ndarray, at: int, removed: int, inserted: bytes) -> tuple[bytes, np.ndarray, int]:
        """A text and its table after `removed` bytes at `at` gave way to others, and the number of entries computed."""
        shift, old_tail = len(inserted) - removed, at + removed
        new = text[:at] + inserted + text[old_tail:]
        starts = np.flatnonzero(last & FIRST)
        ends = np.append(starts[1:], len(text))[: len(starts)]
        settled = int(((starts + 4 * FROM_START <= at) & (ends + 4 * FROM_END <= at)).sum())  # a code point has four bytes at most
        p = int(starts[settled]) if settled < len(starts) else len(text)
        out, computed = [last[:p]], 0
        for piece in (x.encode() for found in self.pieces(new[p:].decode(), NEAR) for x in found):
            back = p - shift
            if back >= old_tail and last[back] & FIRST:
                out.append(last[back:])
                break
            q = p + len(piece)
            known, tail = [], None
            i = int(np.searchsorted(starts, p))
            if p < at and i < len(starts) and starts[i] == p:
                known = (last[p : min(at, int(ends[i]), q)] & ~FIRST).tolist()
            if q - shift > old_tail:  # what follows the edit in this piece, if it was in one piece before
                low = max(old_tail, back)
                j = int(np.searchsorted(starts, low, "right"))
                if j == len(starts) or starts[j] >= q - shift:
                    tail = last[low : q - shift] & ~FIRST
            fresh, n = self.more_tokens(piece, known, tail)
            out.append(self._marked(fresh))
            computed, p = computed + n, q
        return new, np.concatenate(out), computed


class _Pieces(dict):
    """Ids of pieces; short ones are kept, as words come again and again. When it is full, what isn't used again goes."""

    def __init__(self, of: Vocabulary) -> None:
        super().__init__()
        self.of, self.old = of, {}

    def trim(self) -> None:
        if len(self) > MOST_PIECES:
            self.old = dict(self)
            self.clear()

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            b = piece.encode()
            whole = self.of.ranks.get(b)
            found = self.of.ids(self.of.last_tokens(b)) if whole is None else [whole]
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= SHORT:
            self[piece] = ids
        return ids


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def encode(docs: DataFrame, path: str | None = None, table: bool = False) -> DataFrame:
    """doc_id, ids (binary: little-endian 32 bits a token); with `table` also text and last (binary: the state of the text,
    32 bits a byte), which revise() takes."""
    path = path or default_ranks()
    schema = "doc_id long, ids binary" + (", text string, last binary" if table else "")

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            for part in row_chunks(batch, "text"):
                texts = [t.decode() for t in texts_of(part, "text")]
                cols = [part.column("doc_id"), pa.array([v.encode(t) for t in texts], pa.binary())]
                if table:
                    cols += [pa.array(texts, pa.string()), pa.array([v.table(t) for t in texts], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "text", "last"][: len(cols)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of encode() with `decoded`, the bytes of their ids."""
    path = path or default_ranks()

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            for part in row_chunks(batch, "ids"):
                yield part.append_column("decoded", pa.array([v.decode(x or b"") for x in part.column("ids").to_pylist()], pa.binary()))

    return encoded.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded binary")


def revise(tables: DataFrame, edits: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, text, last and computed (entries computed anew) of encode()'s rows with `table`, after their edits. edits:
    doc_id, seq, at, removed, inserted; at and removed in code points, a null `at` is the end of the text (an append), places
    beyond the text are its end. Edits of one document apply one after the other by seq; ties go by at, removed, inserted."""
    path = path or default_ranks()
    ordered = edits.where("doc_id is not null").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", F.col("at").cast("long").alias("at"), F.col("removed").cast("long").alias("removed"), F.col("inserted").cast("string").alias("inserted")))).alias("edits"))
    joined = tables.select("doc_id", "text", "last").join(ordered, "doc_id", "left").select("doc_id", "text", "last", F.transform("edits", lambda e: F.struct(e["at"].alias("at"), e["removed"].alias("removed"), e["inserted"].alias("inserted"))).alias("edits"))

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            for part in row_chunks(batch, "last"):
                rows = []
                for doc, text, last, todo in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "last", "edits")), strict=True):
                    b, state, computed = (text or "").encode(), np.frombuffer(last or b"", dtype="<u4"), 0
                    for e in todo or ():
                        now = b.decode()
                        at = len(now) if e["at"] is None else min(max(0, e["at"]), len(now))
                        low, high = (len(now[:i].encode()) for i in (at, at + max(0, e["removed"] or 0)))
                        b, state, n = v.revise(b, state, low, high - low, (e["inserted"] or "").encode())
                        computed += n
                    rows.append({"doc_id": doc, "ids": v.ids_of_table(state), "text": b.decode(), "last": state.tobytes(), "computed": computed})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("text", pa.string()), ("last", pa.binary()), ("computed", pa.int64())]))

    return joined.mapInArrow(run, "doc_id long, ids binary, text string, last binary, computed long")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the bytes that they decode to."""
    both = decode(encode(docs, path), path)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
