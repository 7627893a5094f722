"""Secret scan with linking of multipart credentials.

Base spans come from three fixed patterns. Linking then looks for the parts of one credential: identifiers (access ids
and named accounts), secrets (the base spans and bare strings of high entropy) and endpoints (addresses). Parts are joined
as intervals: two parts belong together if they stand in one scope (a block of text without an empty line) and no more
than `reach` code points apart. Parts are disjoint, so that no string completes itself: what overlaps a base span is no
other part, an endpoint overlaps no account, a bare string neither. Weak candidates (names of accounts, bare strings,
endpoints) are reported only when the parts that complete them stand there too; base spans always are:

    account     with a secret, and with an assigned or hex secret or an endpoint
    bare string with an identifier, and with an access id or an endpoint
    endpoint    with an identifier and a secret

Scopes lie inside documents, so a document's parts never leave its row: the join is a sorted sweep inside the row and
nothing is shuffled, whatever a document or source holds.

Defined cases: null text is empty; null doc_id stays; repeated rows are judged once each; texts and parts of any length; an
empty table gives no rows; scan() carries other columns along (one named `found` gives way to its own), the digest drops
them.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The base patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST = 8
KINDS = ("assign", "access", "hex", "account", "bare", "endpoint")

ACCOUNT = re.compile(r"""\b(?:user(?:_?name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.I | re.A)
BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])", re.A)
ADDRESS = re.compile(r"""://[^\s"'<>]{4,}""")
HOST = re.compile(r"""\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[a-z0-9][a-z0-9.-]+(?::\d+)?""", re.I | re.A)
SCOPE = re.compile(r"\n[\x20\t\r]*\n")

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def endpoints(text: str) -> list[Span]:
    """Addresses with a scheme, and named hosts; leftmost first, not overlapping."""
    out = [(m.start(), 5, m.end()) for m in HOST.finditer(text)]
    for m in ADDRESS.finditer(text):
        # The scheme is what stands before, back to the last character that can't be in one, from its first letter.
        at = m.start()
        while at and (text[at - 1] in "+.-" or text[at - 1].isascii() and text[at - 1].isalnum()):
            at -= 1
        while at < m.start() and not text[at].isalpha():
            at += 1
        if at < m.start():
            out.append((at, 5, m.end()))
    return _disjoint(sorted(out), [])


def _disjoint(spans: list[Span], taken: list[Span]) -> list[Span]:
    """The spans, in order, that overlap none of taken, nor one before them."""
    starts, ends, most = [], [], 0
    for s, _, e in sorted(taken):
        most = max(most, e)
        starts.append(s)
        ends.append(most)
    out, last = [], 0
    for x in spans:
        i = bisect_left(starts, x[2])
        if x[0] >= last and (i == 0 or ends[i - 1] <= x[0]):
            out.append(x)
            last = x[2]
    return out


def _entropy(s: str) -> float:
    n = len(s)
    return -sum((c := s.count(x)) / n * math.log2(c / n) for x in set(s))


def _bare(s: str) -> bool:
    return any(x.isdigit() for x in s) and any(x.isalpha() for x in s) and _entropy(s) >= 3.5


def linked_spans(text: str, base: list[Span], reach: int) -> list[Span]:
    """The weak candidates that complementary parts complete."""
    account = _disjoint([(m.start(), 3, m.end()) for m in ACCOUNT.finditer(text)], base)
    endpoint = _disjoint(endpoints(text), base + account)
    if not account and not endpoint and not any(k == 1 for _, k, _ in base):
        return []  # without an identifier or endpoint no bare string can be completed
    bare = _disjoint([(m.start(), 4, m.end()) for m in BARE.finditer(text) if _bare(m[0])], base + account + endpoint)
    cuts = [m.start() for m in SCOPE.finditer(text)]
    scope = lambda p: bisect_left(cuts, p)

    def index(spans: list[Span]) -> tuple[list[int], list[int]]:
        """Starts in order, and the largest end up to each."""
        ends, most = [], 0
        for s, _, e in sorted(spans):
            most = max(most, e)
            ends.append(most)
        return sorted(s for s, _, _ in spans), ends

    def near(x: Span, other: tuple[list[int], list[int]]) -> bool:
        """Whether a span of the other list in x's scope starts or ends within reach of x."""
        starts, ends = other
        lo = bisect_left(starts, x[0])
        after = lo < len(starts) and starts[lo] - x[2] <= reach and scope(starts[lo]) == scope(x[0])
        before = lo > 0 and x[0] - ends[lo - 1] <= reach and scope(starts[lo - 1]) == scope(x[0])
        return after or before

    strong_secret = [x for x in base if x[1] != 1]
    access = index([x for x in base if x[1] == 1])
    ids = index([x for x in base if x[1] == 1] + account)
    secrets = index(strong_secret + bare)
    strong = index(strong_secret)
    places = index(endpoint)
    out = [x for x in account if near(x, secrets) and (near(x, strong) or near(x, places))]
    out += [x for x in bare if near(x, ids) and (near(x, access) or near(x, places))]
    out += [x for x in endpoint if near(x, ids) and near(x, secrets)]
    return sorted(out)


def scan(docs: DataFrame, text: str = "text", reach: int = 400) -> DataFrame:
    """docs with a column `found`: array of (kind, start, end, linked), in order of start, then kind; code points, end exclusive."""
    if "found" in docs.columns:
        docs = docs.drop("found")
    found = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("linked", T.BooleanType())]))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("linked", pa.bool_())]))

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(b.schema.get_field_index(text)).to_pylist():
                base = base_spans(t or "")
                more = linked_spans(t or "", base, reach)
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "linked": k > 2} for s, k, e in sorted(base + more)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, kind)], names=[*b.schema.names, "found"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("found", found)]))


def digest(docs: DataFrame, reach: int = 400) -> DataFrame:
    """One row a document: counts of base spans and the digests of the contract."""
    found = scan(docs.select("doc_id", "text"), reach=reach).select("doc_id", "found")
    base = F.filter("found", lambda x: ~x["linked"])
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in ("assign", "access", "hex")], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), F.size(F.filter("found", lambda x: x["linked"])).cast("long").alias("n_linked"))


def redact(docs: DataFrame, mark: str = "[secret]", reach: int = 400) -> DataFrame:
    """docs with base and linked secrets (not endpoints) replaced in text; n_chars follows. Same columns."""
    cols, schema = docs.columns, docs.schema

    def run(batches):
        for b in batches:
            texts = []
            for t in b.column(b.schema.get_field_index("text")).to_pylist():
                if t:
                    base = base_spans(t)
                    at, parts = 0, []
                    for s, k, e in sorted(base + linked_spans(t, base, reach)):
                        if k == 5 or e <= at:
                            continue
                        parts += [t[at:max(at, s)], mark] if s >= at else []
                        at = e
                    t = "".join(parts) + t[at:] if parts else t
                texts.append(t)
            i = b.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays([pa.array(texts, b.schema.field(i).type) if j == i else c for j, c in enumerate(b.columns)], names=b.schema.names)

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)).select(*cols) if "n_chars" in cols else out


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()
