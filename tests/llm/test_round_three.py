"""Byte-level BPE, the conversation trie and whitening against brute force and other libraries."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollex.llm import bpe, queries, topk, trie, whiten
from recollex.operators import prefix

sha = lambda b: hashlib.sha256(b).hexdigest()
EMPTY = sha(b"")


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ids = lambda library, text: np.array(library.encode_ordinary(text), dtype="<u4").tobytes()
PARTS = ["a", "b", "e", "th", "ing", " ", "  ", "'", "'l", "'ll", "s", "\n", "1", "22", ".", "!?", "é", "ß", "漢字", "😀", "the", "ation", "\t", " ", "<|endoftext|>"]


def say(rng, n):
    return "".join(rng.choice(PARTS) for _ in range(n))


def test_bpe(spark, library):
    rng = random.Random(3)
    texts = [None, "", "x", " ", "<|endoftext|>", *(say(rng, n) for n in (3, 30, 300, 3000)), "abcdefghij" * 30_000, "\n" * 100_000, " word" * 1_000_000]
    rows = [(i, t, 1, 2) for i, t in enumerate(texts)] + [(7, texts[7], 1, 2), (None, "again", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long, decoded long")
    got = Counter(tuple(r) for r in bpe.digest(docs).collect())
    want = Counter()
    for d, t, _, _ in rows:
        x = ids(library, t or "")
        want[(d, len(x) // 4, sha(x), sha((t or "").encode()))] += 1
    assert got == want
    assert bpe.digest(docs.limit(0)).count() == 0


def test_bpe_windows_and_caches(library, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_PIECES", 50)
    monkeypatch.setattr(bpe, "MOST_PAIRS", 50)
    v, rng = bpe.Vocabulary(bpe.default_ranks()), random.Random(4)
    for _ in range(200):
        t = say(rng, 60)
        for window in (1, 2, 5, 17):
            assert [p for found in v.pieces(t, window) for p in found] == v.split.findall(t)
        assert v.encode(t) == ids(library, t) == v.ids_of_table(np.frombuffer(v.table(t), "<u4")) and v.decode(v.encode(t)) == t.encode()
    tokens = list(v.tokens)
    for x, y in ((rng.choice(tokens[:3000]), rng.choice(tokens)) for _ in range(20_000)):
        assert v.fit(x, y) == (library._core_bpe.encode_single_piece(v.tokens[x] + v.tokens[y]) == [x, y])


def test_bpe_prefixes_end_in_their_token(library):
    v, piece = bpe.vocabulary(bpe.default_ranks()), b"internationalisationandonandonantidisestablishment"
    for i, t in enumerate(v.last_tokens(piece)):
        assert library._core_bpe.encode_single_piece(piece[: i + 1])[-1] == t


def test_bpe_edits(spark, library):
    rng, rows, edits, want = random.Random(5), [], [], {}
    for d in range(120):
        t = say(rng, rng.choice([0, 3, 40, 200])) if d % 3 else "".join(rng.choice("abcdethin") for _ in range(rng.choice([50, 900])))
        rows.append((d, t))
        for seq in range(rng.choice([0, 1, 3])):
            at, gone, new = rng.choice([None, rng.randint(0, len(t))]), rng.choice([0, 0, 1, 5]), say(rng, rng.choice([0, 1, 3]))
            edits.append((d, seq, at, gone, new))
            i = len(t) if at is None else at
            t = t[:i] + new + t[i + gone :]
        want[d] = t
    rows += [(500, None), (None, "not edited")]
    edits += [(500, 0, 9, 4, "new"), (None, 0, 0, 1, "lost"), (501, 0, 0, 0, "no such row")]
    want |= {500: "new", None: "not edited"}
    out = bpe.revise(bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), table=True), spark.createDataFrame(edits, "doc_id long, seq int, at int, removed int, inserted string")).collect()
    v = bpe.vocabulary(bpe.default_ranks())
    assert {r["doc_id"]: r["text"] for r in out} == want and all(bytes(r["ids"]) == ids(library, r["text"]) and bytes(r["last"]) == v.table(r["text"]) for r in out)
    # An edit inside one huge piece computes a few entries, not all.
    big = "".join(rng.choice("abcdefghij") for _ in range(100_000))
    new, table, computed = v.revise(big.encode(), np.frombuffer(v.table(big), "<u4"), 50_000, 3, b"xyz")
    assert computed < 400 and table.tobytes() == v.table(new.decode())


def test_bpe_needs_merges_in_order(tmp_path):
    (tmp_path / "ranks").write_bytes(b"".join(base64.b64encode(b) + b" %d\n" % i for i, b in enumerate([b"a", b"b", b"abab", b"ab"])))
    with pytest.raises(ValueError, match="merges"):
        bpe.Vocabulary(str(tmp_path / "ranks"))


def test_running(spark, monkeypatch):
    rng = np.random.default_rng(6)
    key, order = rng.choice([1, 2, 3, 4, 5, -6], 3000, p=[0.7, 0.1, 0.1, 0.04, 0.03, 0.03]), rng.permutation(3000)
    v, w = rng.integers(-50, 50, 3000), rng.integers(-(1 << 62), 1 << 62, 3000)
    rows = [tuple(map(int, r)) for r in zip(key, order, v, w, strict=True)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    got = {(r["k"], r["o"]): (r["v_upto"], r["w_upto"]) for r in prefix.running(spark.createDataFrame(rows, "k long, o long, v long, w long"), "k", [F.desc("o")], ["v"], ["w"]).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, held = {}, {}
    for k, o, a, b in sorted(rows, key=lambda r: -r[1]):
        s, x = held.get(k, (0, 0))
        held[k] = want[k, o] = (s + a, x ^ b)
    assert got == want


def brute_trie(rows):
    """rows: (conv_id, turn, role, text) without equal turns."""
    convs = {}
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        convs.setdefault(c, []).append((r or "", x or ""))
    new = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        new[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    nodes = {}
    for c in sorted(new):
        for d in range(len(new[c]) + 1):
            nodes.setdefault(tuple(new[c][:d]), []).append(c)
    out = []
    for n, m in nodes.items():
        below = [x for x in nodes if x[: len(n)] == n]
        kids = lambda x: sum(len(y) == len(x) + 1 and y[: len(x)] == x for y in nodes)
        words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) if x else 0
        ends = ",".join(str(c) for c in m if len(new[c]) == len(n))
        out.append((min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), kids(n), sum(not kids(x) for x in below), sum((len(nodes[x]) - 1) * words(x) for x in below), sha(ends.encode()), ends.count(",") + bool(ends)))
    return Counter(out)


CONVS = "conv_id long, turn long, role string, text string, depth long, path long, words string"


def conversations():
    rng = random.Random(7)
    rows = []
    for c in [*range(45), 61, 62, 63, 64, 67, 81]:  # 60 and 80 are absent
        n = rng.choice([1, 2, 3, 5])
        rows += [(c, t if t else None, rng.choice(["user", None, "a"]) if t > 1 else "user", ["hi  there", "tell me more", None, "", f"turn {t}"][rng.randrange(5)] if t else "hello you") for t in range(n)]
    rows += [(50 + i, t, "user", f"word {t}") for i in range(3) for t in range(40 + 3 * i)]  # each goes on where the last ended
    rows += [(41, 100 + t, "user", "long " * t) for t in range(60)] + [(44, 200, "x", "y " * 300_000), (None, 1, "user", "lost")]
    return [(*r, 1, 2, "w") for r in rows]


def test_trie(spark, monkeypatch):
    rows = conversations()
    for name, small in (("CHUNK", 7), ("BLOCK", 60), ("HOT_LEAST", 2), ("HOT_PARTS", 200)):
        monkeypatch.setattr(trie, name, small)
    got = trie.build(spark.createDataFrame(rows, CONVS).repartition(3))
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "n_ends"]
    assert got.columns == cols
    assert Counter(tuple(r) for r in got.collect()) == brute_trie([r[:4] for r in rows])


def test_trie_cases(spark):
    one = spark.createDataFrame([(3, None, None, None, 1, 2, "w"), (3, None, None, None, 1, 2, "w")], CONVS)  # repeated rows are two turns
    assert sum(r["n_convs"] for r in trie.build(one).collect()) == len(trie.build(one).collect()) >= 1
    assert trie.build(one.limit(0)).count() == 0
    # 3 (h = 3) keeps nothing of its own two turns, and 0 is absent: it ends at the root.
    assert [(r["depth"], r["n_ends"], r["ends_sha256"]) for r in trie.build(one).collect()] == [(0, 1, sha(b"3"))] if zlib.crc32(b"3") % 4 > 1 else True


def test_whitening(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 20)) @ rng.normal(size=(20, 20)) / 9
    base[50:90] = base[3]  # a vector of many rows
    rows = [(int(i) if i != 7 else None, [float(x) for x in r], 1, 2) for i, r in enumerate(base)] + [(5, [float(x) for x in base[5]], 1, 2)]
    odd = [(900, None, 1, 2), (901, [1.0, None] * 10, 1, 2), (902, [float("inf")] * 20, 1, 2), (903, [float("nan")] * 20, 1, 2), (904, [1.0], 1, 2), (905, [], 1, 2), (906, [1e300] * 20, 1, 2)]
    schema = "vec_id long, embedding array<double>, component long, n long"
    got = whiten.whiten(spark.createDataFrame(rows + odd, schema).repartition(4)).toPandas()
    x = np.floor(64 * np.array([r[1] for r in rows])).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = (n * fit - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == 16 * len(rows) and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    for k in range(16):
        mine = got[got["component"] == k + 1]
        want = ((n * x - s) / n) @ u[:, k] / np.sqrt(e[k])
        by = {(r[0], d): w for r, d, w in zip(rows, ((n * x - s) ** 2).sum(axis=1).tolist(), want, strict=True)}
        pairs = [(w, by[None if np.isnan(i) else int(i), d]) for i, d, w in zip(mine["vec_id"], mine["deviation"], mine["whitened"], strict=True)]
        sign = np.sign(sum(a * b for a, b in pairs))
        assert max(abs(a * sign - b) for a, b in pairs) < 1e-8 and np.allclose(mine["explained"], e[k] / e.sum(), rtol=1e-9)


def test_whitening_cases(spark):
    of = lambda rows: whiten.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert of([]) == [] and of([(1, [1.0, 2.0])] * 3) == [] and of([(1, None)]) == []
    flat = of([(i, [float(i), 5.0]) for i in range(9)])  # one direction has no variance
    assert {r["component"] for r in flat} == {1} and len(flat) == 9 and flat[0]["explained"] == pytest.approx(1)
    far = of([(i, [float(i) * 2**33, 1.0 * (i % 2)]) for i in range(9)])
    assert any(r["deviation"] is None for r in far) and all(r["identity_error"] < 1e-4 for r in far)
    tie = of([(0, [1.0]), (1, [2.0]), (2, [1.0, 2.0]), (3, [2.0, 5.0])])  # of two equally frequent lengths the shorter
    assert {r["vec_id"] for r in tie} == {0, 1}


@pytest.mark.parametrize(("query_block", "candidate_block"), [(512, 4096), (2, 7)])
def test_topk_of_repeated_ids(spark, tmp_path, query_block, candidate_block):
    """Ids with several vectors, repeated rows, null ids: one list an id, each candidate once; against brute force and SQL."""
    import duckdb

    rng = np.random.default_rng(9)
    rows = [(int(i), [float(x) for x in rng.integers(-2, 3, 4)]) for i in rng.choice([0, 50, 100, 1, 2, 3, 4, 5, 6, 7], 60)]
    rows += rows[:9] + [(2, [9.0] * 4)] * 30 + [(None, [9.0] * 4), (8, None), (9, [None, 1.0, 1.0, 1.0]), (100, [float("nan")] * 4), (150, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1))
    df.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q in {i for i, _ in rows if i % 50 == 0}:
        score = {}
        for a, x in rows:
            for b, y in rows if a == q else ():
                if b != q:
                    score[b] = max(score.get(b, -(10**9)), int(x @ y))
        want |= {(q, r + 1, b, s) for r, (s, b) in enumerate(sorted(((s, b) for b, s in score.items()), key=lambda t: (-t[0], t[1]))[:5])}
    v = topk.quantized(df)
    got = topk.search(v.where("id % 50 = 0"), v, 5, query_block, candidate_block).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert {(r[0], r[1], r[2], r[3]) for r in con.sql(queries.OP9_SQL).fetchall()} == want
