"""Language identification: posteriors by brute force, many declared values, ties, repeated rows, long texts, names."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollex.llm import langid

COLS = "doc_id long, text string, lang string, source string"


def buckets(text):
    """Hashed trigrams of one text, one at a time."""
    raw = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in (text or "").encode().lower())
    out = []
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        if not (a == b == 32 or b == c == 32):
            h = (a * 0x9E3779B1 % 2**32) ^ (b * 0x85EBCA77 % 2**32) ^ (c * 0xC2B2AE3D % 2**32)
            out.append(h * 0x27D4EB2F % 2**32 >> 16)
    return out


def brute(rows, kappa=20.0, temper=0.3, least_share=0.001):
    """Posteriors of (text, declared, host, suffix) rows, each language fitted on all of its rows."""
    usable = [r for r in rows if r[1] is not None and langid_usable(r[0])]
    n = Counter(r[1] for r in usable)
    own = {v for v in n if n[v] >= least_share * len(usable)}
    langs = sorted(own - {"other"}) + (["other"] if "other" in own or set(n) - own else [])
    counts = defaultdict(Counter)
    for t, v, *_ in usable:
        counts[v if v in own else "other"].update(buckets(t))
    total = {v: sum(counts[v].values()) + 0.1 * 65536 for v in langs}
    ll = [[sum(math.log((counts[v][b] + 0.1) / total[v]) for b in buckets(r[0])) for v in langs] for r in rows]
    place = lambda v: v if v in own or v is None else "other" if "other" in langs else 0
    best = [langs[int(np.argmax(x))] if buckets(r[0]) else None for r, x in zip(rows, ll)]
    declared = [*langs, None, 0]
    pairs = Counter((place(r[1]), t) for r, t in zip(rows, best) if t)
    conf = {(d, t): pairs[d, t] + 0.5 for d in declared for t in langs}
    of = {t: sum(conf[d, t] for d in declared) for t in langs}
    overall = {t: of[t] / sum(of.values()) for t in langs}
    hosts, suffixes = Counter(), Counter()
    for r, t in zip(rows, best):
        if t:
            hosts[r[2], r[3], t] += 1
            suffixes[r[3], t] += 1
    out = []
    for r, x in zip(rows, ll):
        ns, nh = sum(suffixes[r[3], t] for t in langs), sum(hosts[r[2], r[3], t] for t in langs)
        prior = {t: (hosts[r[2], r[3], t] + kappa * (suffixes[r[3], t] + kappa * overall[t]) / (ns + kappa)) / (nh + kappa) for t in langs}
        if not nh:
            prior = overall
        logs = [temper * a + math.log(prior[t]) + math.log(conf[place(r[1]), t] / of[t]) for a, t in zip(x, langs)]
        top = max(logs)
        out.append((langs[logs.index(top)], 1 / sum(math.exp(v - top) for v in logs)))
    return out


def langid_usable(t):
    import re
    return t is not None and re.search(langid.USABLE, t) is not None


def say(rng, kind, n):
    return " ".join("".join(rng.choice(list(kind), rng.integers(2, 7))) for _ in range(n))


def mixed(rng, rows):
    kinds = {"aa": "abcdefg", "bb": "efghijk", "cc": "klmnopß"}
    out = []
    for i in range(rows):
        lang = list(kinds)[rng.integers(3)]
        declared = [lang, None, "zz", "aa"][rng.choice(4, p=[0.7, 0.1, 0.1, 0.1])]
        out.append((say(rng, kinds[lang], int(rng.integers(1, 12))), declared, [None, "a.x", "b.x", "c.y"][rng.integers(4)], ["x", "y", None][rng.integers(3)]))
    return [*out, (None, "aa", "a.x", "x"), ("", None, None, None), ("12 !", "qq", "new", "z"), ("ab", "bb", "new", "z"), *out[:5]]


@pytest.mark.parametrize("least_share", [0.001, 0.15])
def test_posteriors_by_brute_force(spark, least_share):
    rows = mixed(np.random.default_rng(3), 120)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, text string, declared string, host string, suffix string").repartition(5)
    got = {r["id"]: r for r in langid.identify(df, ["id"], declared="declared", host="host", suffix=F.col("suffix"), least_share=least_share).collect()}
    for i, (language, posterior) in enumerate(brute(rows, least_share=least_share)):
        assert got[i]["language"] == language and got[i]["posterior"] == pytest.approx(posterior, rel=1e-4), (i, rows[i])
    assert ("other" in {r["language"] for r in got.values()}) == (least_share > 0.1)


def test_queries_by_brute_force(spark):
    """documents and pages of the smallest fixture: 50 rows each."""
    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(50)
    want = brute([(r["text"], r["lang"], r["source"], None) for r in d.collect()])
    got = {r["doc_id"]: r for r in langid.identify_documents(d).collect()}
    for r, (language, posterior) in zip(d.collect(), want):
        assert got[r["doc_id"]]["language"] == language and got[r["doc_id"]]["posterior"] == pytest.approx(posterior, rel=1e-3)


def test_many_declared_values(spark):
    """3,000 junk values are one language; what is declared well keeps its own."""
    rng = np.random.default_rng(4)
    rows = [(i, say(rng, "abcdefg", 12), "aa", "h") for i in range(3000)] + [(10_000 + i, say(rng, "hijklmn", 12), "bb", "h") for i in range(60)]
    rows += [(20_000 + i, say(rng, "opqrstu", 12), f"junk{i}", "h") for i in range(3000)]
    df = spark.createDataFrame(rows, COLS).repartition(4)
    own, langs, table = langid.fit_text(df.select(F.struct("doc_id").alias("keys"), "text", F.col("lang").alias("declared")))
    assert own == ["aa", "bb"] and langs == ["aa", "bb", "other"] and table.shape[0] == 3
    got = {r["doc_id"]: r["language"] for r in langid.identify_documents(df).collect()}
    assert {got[i] for i in range(3000)} == {"aa"} and {got[10_000 + i] for i in range(60)} == {"bb"} and {got[20_000 + i] for i in range(3000)} == {"other"}


def test_language_cases(spark):
    """Equal languages (ties) go to the first name; repeated rows, a text of a million words, clashing names, no languages."""
    rng = np.random.default_rng(6)
    same = say(rng, "abcdefg", 30)
    long = " ".join([say(rng, "abcdefg", 1000)] * 1000)
    rows = [(1, same, "bb", "h"), (2, same, "aa", "h"), (3, long, None, "h"), (4, same, None, "h"), (4, same, None, "h"), (None, None, None, None)]
    df = spark.createDataFrame(rows, COLS).select("*", *[F.lit(1).alias(c) for c in ("keys", "near", "t", "d", "host", "declared", "language", "salt")])
    got = langid.identify_documents(df, ["doc_id", "near"])
    assert got.columns == ["doc_id", "near", "language", "posterior", "text_language", "n_trigrams", "accepted"] and got.count() == 6
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[1]["text_language"] == by[4]["text_language"] == "aa" and by[3]["n_trigrams"] > 3_000_000 and not by[None]["accepted"]
    want = brute([(long[:3000] if i == 3 else t, v, h, None) for i, t, v, h in rows])
    assert all((by[i]["language"], by[i]["posterior"]) == (want[at][0], pytest.approx(want[at][1], rel=1e-4)) for at, i in ((0, 1), (1, 2), (3, 4)))
    nothing = langid.identify_documents(df.withColumn("lang", F.lit(None).cast("string")))
    assert nothing.where("language is null and not accepted").count() == 6
