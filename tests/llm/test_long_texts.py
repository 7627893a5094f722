"""Texts of a million words, ties, and columns of clashing names, for the operators on whole texts and each pipeline stage."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recollex.llm import decontam, lm, neardup, suffixdup, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
N = 1_000_000
CLASHES = ("row", "words", "cands", "closes", "th", "key", "diags", "rid", "bands", "rep", "fam", "copies", "blocks", "block", "sig", "toxic", "rate", "tf", "term", "n", "c", "token", "tail", "known", "base", "u", "d2", "t2", "hit")


@pytest.fixture(scope="module")
def long_words():
    rng = np.random.default_rng(8)
    vocab = np.array(sorted({"".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(4000)}))
    return rng.choice(vocab, N).tolist()


@pytest.fixture(scope="module")
def item(long_words):
    return [f"item{i}" for i in range(12)] + long_words[:3]


@pytest.fixture(scope="module")
def docs(spark, long_words, item):
    """1: long; 2: its near copy; 3: an item late in a long text; 4 and 5: null, empty; 6: short."""
    near = [*long_words[: N // 2], "QQQ", *long_words[N // 2 + 1:]]
    other = [*(w + "z" for w in long_words[:900_000]), *item, "token=abcdEFGH12345678"]
    rows = [(1, " ".join(long_words)), (2, " ".join(near)), (3, " ".join(other)), (4, None), (5, ""), (6, long_words[7])]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES]).repartition(3).cache()


def test_decontamination(spark, docs, long_words, item):
    once = long_words[7]  # an item of one word, which stands in the long texts hundreds of times
    bench = spark.createDataFrame([("a", " ".join(item), "x", 1), ("b", once, "x", 1), ("c", None, "x", 1)], "item_id string, text string, key string, tid int")
    got = {r["doc_id"]: r for r in decontam.digest(docs, bench).collect()}
    seen = long_words.count(once)
    assert seen > 100 and (got[1]["n_words"], got[1]["n_hit"], got[1]["n_items"]) == (N, seen, 1)
    assert got[2]["n_hit"] == seen and got[3]["n_hit"] == len(item) and got[3]["n_items"] == 1
    assert got[3]["near_items"] == "a" and [got[i]["n_hit"] for i in (4, 5, 6)] == [0, 0, 1]
    assert got[1]["items_sha256"] == hashlib.sha256(b"b").hexdigest()


def test_near_duplicates(docs):
    got = {r["doc_id"]: r for r in neardup.join(docs).collect()}
    assert [(got[i]["class_id"], got[i]["n_links"]) for i in (1, 2, 3, 4, 5, 6)] == [(1, 1), (1, 1), (3, 0), (4, 0), (5, 0), (6, 0)]


def test_suffix_dedup(docs):
    got = {r["doc_id"]: r for r in suffixdup.digest(docs).collect()}
    size = got[1]["n_bytes"]
    assert got[1]["n_removed"] == 0 and size == 6 * N - 1
    assert (got[2]["n_removed"], got[2]["n_spans"], got[2]["kept_sha256"]) == (got[2]["n_bytes"] - 3, 2, hashlib.sha256(b"QQQ").hexdigest())
    assert [got[i]["n_removed"] for i in (3, 4, 5, 6)] == [0, 0, 0, 0]


def test_lm(docs):
    rows = [(r["doc_id"], [*(r["text"] or "").lower().split(), "\n"]) for r in docs.select("doc_id", "text").collect()]
    c = Counter(w for d, ws in rows if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in lm.score(docs).collect()}
    for d, ws in rows:
        assert (got[d]["n_tokens"], got[d]["n_known"], got[d]["train_tokens"]) == (len(ws), sum(w in c for w in ws), n)
        assert got[d]["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9) and math.isfinite(got[d]["score"])


def test_toxicity_of_long_texts(spark, docs):
    """A long text is scored whole, and is no example; one beyond row_bytes is sampled less often and counts for more."""
    words = [f"w{i}" for i in range(50)]
    rng = np.random.default_rng(3)
    rows = [(100 + i, " ".join([*rng.choice(words, 8), *(["vile", "foul"] if i % 3 == 0 else [])])) for i in range(400)]
    long = " ".join(["w1 w2 w3"] * (N // 3)) + " vile foul"
    table = docs.select("doc_id", "text", *CLASHES).where("doc_id > 3").unionByName(spark.createDataFrame([*rows, (7, long), (8, long)], "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in CLASHES]))
    labels = spark.createDataFrame([(i, int((i - 100) % 3 == 0)) for i, _ in rows] + [(7, 1), (8, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(table, labels, evidence=15).collect()}
    assert len(got) == 405 and all(0 <= r["score"] <= 1 for r in got.values()) and not {7, 8} & {n for r in got.values() for n in r["neighbours"]}
    assert got[7]["n_terms"] == got[8]["n_terms"] == 5 and got[7]["score"] == got[8]["score"]
    # With a small row_bytes fewer rows are examples, and shares stay what they are.
    few = {r["doc_id"]: r for r in toxicity.score(table, labels, evidence=15, row_bytes=8).collect()}
    of = lambda got: {n for r in got.values() for n in r["neighbours"]}
    assert len(of(few)) < 0.6 * len(of(got))
    assert abs(np.mean([r["score"] for d, r in few.items() if d >= 100]) - 1 / 3) < 0.12


def test_neighbours_by_brute_force(spark):
    """Nearest examples of every text by all cosines; ties, which repeated texts make, go to the smaller id."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(60)]
    some = [" ".join(rng.choice(words, rng.integers(1, 12))) for _ in range(120)]
    rows = [(i, some[i % 120] if i < 240 else " ".join(rng.choice(words, 6))) for i in range(360)]
    label = {i: int(rng.random() < 0.3) for i in range(360)}
    d = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in CLASHES])
    got = {r["doc_id"]: r["neighbours"] for r in toxicity.score(d, spark.createDataFrame([*label.items()], "doc_id long, toxic int"), k=7, evidence=7).collect()}
    bags = {i: Counter(WORD.findall(t)) for i, t in rows}
    train = [i for i in bags if zlib.crc32(str(i).encode()) % 3 != 1]
    df = Counter(w for b in bags.values() for w in b)
    n1 = sum(label[i] for i in train)
    lift = {w: ((sum(label[i] for i in train if w in bags[i]) + 1) / (n1 + 2)) / ((sum(1 - label[i] for i in train if w in bags[i]) + 1) / (len(train) - n1 + 2)) for w in {w for i in train for w in bags[i]}}

    def vector(b):
        v = {w: (1 + math.log(c)) * (math.log((len(rows) + 1) / (df[w] + 1)) + 1) * (1 + max(0.0, math.log(lift[w]))) for w, c in b.items() if w in lift}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    vectors = {i: vector(b) for i, b in bags.items()}
    for i, v in vectors.items():
        cos = {j: round(sum(x * vectors[j].get(w, 0.0) for w, x in v.items()), 11) for j in train}
        want = sorted((-c, j) for j, c in cos.items() if c > 0)[:7]
        assert [round(-cos[j], 11) for j in got[i]] == [c for c, _ in want], i
        assert got[i] == [j for _, j in want], i


def test_stages(spark, docs, tmp_path, long_words, item):
    """Each stage on the same table: what goes, what stays, and the columns that are carried along."""
    spark.createDataFrame([("a", " ".join(item))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name: stages[name](spark, docs, str(tmp_path))
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    spoken = run("language_id")
    assert spoken.columns == docs.columns and {1, 2, 3} <= ids(spoken) and not {4, 5} & ids(spoken)
    assert ids(run("ngram_jaccard_join")) == {1, 3, 4, 5, 6} and ids(run("decontamination")) == {1, 2, 4, 5, 6}
    masked = {r["doc_id"]: r for r in run("secret_scan").select("doc_id", F.right("text", F.lit(20)).alias("end"), "n_chars").collect()}
    assert masked[3]["end"].endswith(f"{item[-1]} [secret]") and masked[1]["n_chars"] == 6 * N - 1 and masked.keys() == {1, 2, 3, 4, 5, 6}
    pieces = run("packing").groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("of")).collect()
    assert len(pieces) == 6 and all(r["n"] == r["of"] for r in pieces) and {r["of"] for r in pieces if r["doc_id"] in (4, 5)} == {1}
