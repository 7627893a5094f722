"""Every stage of the pipeline against a brute-force version on the stage's own input, and run() against all of them."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from recollex.llm import packing

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{8,})""", re.I | re.A)
words = lambda t: WORD.findall((t or "").translate(UP))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables, and rows that the stages must tell apart."""
    at = str(tmp_path_factory.mktemp("sf"))
    d, b = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "benchmark"))
    longest = sorted((r["text"] for r in d.collect() if r["text"]), key=len)[-3:]
    item = max((r["text"] for r in b.collect()), key=lambda t: len(words(t)))
    changed = longest[0].rsplit(" ", 1)[0] + " changed"
    odd = [None, "", "12 34 !!", longest[0], changed, longest[1] + " " + item, longest[2] + " api_key = abcdEFGH12345678 ", longest[1][: len(longest[1]) // 2]]
    rows = [(90_000 + i, t, "en", "odd" if i % 2 else None, len(t or "")) for i, t in enumerate(odd)] + [(90_003, longest[0], "en", "odd", len(longest[0])), (None, longest[2][:900], None, None, 900)]
    d.union(spark.createDataFrame(rows, d.schema)).write.parquet(f"{at}/documents.parquet")
    b.write.parquet(f"{at}/benchmark.parquet")
    return at


def plain(df):
    return Counter(tuple(r) for r in df.collect())


def without_copies(rows):
    """Rows (doc_id, text, ...) without those that chains of pairs of similarity 0.8 tie to a smaller doc_id; rows of one
    doc_id and text count once, and of one doc_id with other texts each for itself."""
    chosen, one = [r for r in rows if r[0] is None], {}
    for r in rows:
        if r[0] is not None:
            one[r[0], r[1]] = r
    ids, sets = sorted(one, key=lambda x: (x[0], x[1] or "")), {}
    for i in ids:
        w = words(one[i][1])
        sets[i] = {tuple(w[j:j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in ids}
    find = lambda a: a if root[a] == a else find(root[a])
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and 5 * (k := len(sets[i] & sets[j])) >= 4 * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)), key=lambda x: (x[0], x[1] or ""))
                root[b] = a
    return Counter(chosen + [one[i] for i in ids if find(i) == i])


def test_one_id_many_texts(spark, folder):
    """Different texts under one doc_id all stay; columns of clashing names are carried along."""
    say = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(1, say(1), "en", "s", 9), (1, say(2), "en", "s", 9), (1, say(2), "en", "s", 9), (2, say(2) + " more", "en", "s", 9), (3, None, None, None, None), (3, "", "en", "s", 0), (None, say(1), "en", "s", 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("row", "_th", "id", "th", "words", "found"):
        d = d.withColumn(name, F.lit("x"))
    near = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"]
    out = near(spark, d, folder)
    assert out.columns == d.columns
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter([(1, say(1)), (1, say(2)), (3, None), (3, ""), (None, say(1))])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d, folder).columns == d.columns, name


def test_stages(spark, folder):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{folder}/stage{i}"
        stage(spark, docs, folder).write.parquet(path)
        kept.append(docs)
        docs = spark.read.parquet(path)
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == kept[0].columns
    start, spoken, single, clean, masked = (x.collect() for x in kept)

    # Language ID: what has no letters goes, prose with a declared language stays.
    assert not Counter(map(tuple, spoken)) - Counter(map(tuple, start))
    left = {r["doc_id"] for r in spoken}
    assert not left & {90_000, 90_001, 90_002} and {90_003, 90_004, 90_005, 90_006} <= left
    prose = {r["doc_id"] for r in start if len(words(r["text"])) >= 50}
    assert len(prose & left) >= 0.98 * len(prose)

    assert Counter(map(tuple, single)) == without_copies([tuple(r) for r in spoken])

    windows = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[s:s + 10]) for s in range(max(1, len(w) - 9))} if w else set()
    widths = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[s:s + k]) in windows for k in widths for s in range(len(w) - k + 1))
    assert Counter(map(tuple, clean)) == Counter(tuple(r) for r in single if not hit(words(r["text"])))
    assert len(clean) < len(single)

    assert Counter((r["doc_id"], r["lang"], r["source"]) for r in masked) == Counter((r["doc_id"], r["lang"], r["source"]) for r in clean)
    before = {(r["doc_id"], r["source"]): r["text"] for r in clean}
    for r in masked:
        was = before[r["doc_id"], r["source"]]
        assert not any(m[1] in r["text"] for m in ASSIGN.finditer(was)) and r["n_chars"] == len(r["text"])
        if r["text"] == was:
            assert not ASSIGN.search(was)
        else:  # what is around the marks is the text that was
            assert re.fullmatch(".+".join(map(re.escape, r["text"].split("[secret]"))), was, re.S)

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    ids = {r["doc_id"]: np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4") for r in masked}
    pieces: dict = {}
    for r in docs.collect():
        assert zlib.crc32(ids[r["doc_id"]][r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    assert set(pieces) == set(ids)
    for d, p in pieces.items():
        assert sum(n for _, n in p) == len(ids[d]) and all(a + n == b for (a, n), (b, _) in zip(sorted(p), sorted(p)[1:], strict=False))

    assert plain(corpus_pipeline.run(spark, folder)) == plain(docs)


def test_empty(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
