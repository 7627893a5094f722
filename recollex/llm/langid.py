"""Language identification by fusing evidence in Bayes' rule.

posterior(l) ~ prior(l | host) * P(declared | l) * P(text | l). The text's likelihood comes from hashed byte trigrams, one
multinomial for every language, fitted on a bounded sample of its rows. A declared value is a language if it has usable rows
and at least `least_share` of all of them, so there are at most 1 / least_share; the rows of all rarer values are together
the language "other" (declared_values() counts them). Host priors are smoothed along a hierarchy (all rows, address suffix,
host), and P(declared | l) is the declared markup's reliability; both come from grouped aggregation over all rows, from the
languages that the texts alone suggest.

Defined cases: null or empty text gives no text evidence and is rejected; null host, suffix or declared language is one
more value of that column; declared values that aren't languages count as "other", or as one more value without it; of equally good languages the first by name
counts ("other" is last); null and repeated doc_ids are judged row by row; with no declared row there is no language: the result has null
language and rejects all; an empty table gives no rows; keys may have any names, other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, row_chunks, texts_of

BUCKETS = 1 << 16
#: A language's sample is its even part of the sample, but no smaller than this.
LEAST_ROWS = 300
#: The language of all declared values that are too rare for one of their own.
OTHER = "other"
#: A host's smoothing and the reliability of its declared language can't make up for more nats than this in a table of up to
#: 10 ** 12 rows (three shares of at least 10 ** -11 and one of 10 ** -12), so languages further behind in the text are left out.
MARGIN = 140.0
#: Rows that a language can be fitted on have such a run of letters.
USABLE = r"[A-Za-z]{3}|[^\x00-\x7F]{2}"


def _trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of byte trigrams of lower-cased texts (runs of other ASCII are one space), and the number in each text."""
    joined = b"\x00\x00".join(t.lower().translate(_LETTERS) for t in texts) + b"\x00\x00"
    raw = np.frombuffer(joined, np.uint8).astype(np.uint32)
    starts = np.cumsum([0] + [len(t) + 2 for t in texts])
    a, b, c = raw[:-2], raw[1:-1], raw[2:]
    real = (a != 0) & (b != 0) & (c != 0) & ~((a == 32) & (b == 32)) & ~((b == 32) & (c == 32))
    h = (a * np.uint32(0x9E3779B1) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F)
    at = np.flatnonzero(real)
    return (h[at] >> np.uint32(16)).astype(np.int64), np.diff(np.searchsorted(at, starts))


#: Letters stay; other ASCII becomes a space.
_LETTERS = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def declared_values(docs: DataFrame, least_share: float = 0.001) -> DataFrame:
    """declared, n (usable rows), lowest (hash), own: whether the value is a language of its own, from docs with text,
    declared and _u."""
    usable = docs.where(F.col("declared").isNotNull() & F.col("text").rlike(USABLE))
    values = materialize(usable.groupBy("declared").agg(F.count("*").alias("n"), F.min("_u").alias("lowest")), "langid-values")
    total = values.agg(F.sum("n")).first()[0] or 0
    return values.withColumn("own", F.col("n") >= least_share * total)


def fit_text(docs: DataFrame, sample_rows: int = 6000, least_share: float = 0.001) -> tuple[list[str], list[str], np.ndarray]:
    """Declared values with a language of their own, all languages, and log P(bucket | language), from about sample_rows
    declared rows, as many of each language (LEAST_ROWS at least, if it has them), picked by a hash of their keys and text.
    The row that hashes lowest is always in. docs has keys, text and declared; at most 1 / least_share values come here."""
    docs = docs.withColumn("_u", F.pmod(F.xxhash64("text", "keys", F.lit("sample")), F.lit(1 << 30)))
    values = declared_values(docs, least_share)
    counts = {r["declared"]: (r["n"], r["lowest"]) for r in values.where("own").collect()}
    own = sorted(counts)
    pooled = values.where("not own").agg(F.sum("n"), F.min("lowest")).first()
    langs = [v for v in own if v != OTHER]
    if pooled[0] or OTHER in counts:
        n, lowest = counts.get(OTHER, (0, 1 << 30))
        counts[OTHER] = (n + (pooled[0] or 0), min(lowest, pooled[1] if pooled[0] else lowest))
        langs.append(OTHER)
    if not langs:
        return [], [], np.zeros((0, BUCKETS), np.float32)
    rows = max(LEAST_ROWS, sample_rows // len(langs))
    place = [(v, i, max(int(min(1.0, rows / counts[v][0]) * (1 << 30)), counts[v][1] + 1)) for i, v in enumerate(langs)]
    below = docs.sparkSession.createDataFrame(place, "declared string, _l int, _below long")
    usable = docs.where(F.col("declared").isNotNull() & F.col("text").rlike(USABLE))
    # Values that aren't here are pooled ones, which are in the last language.
    sample = usable.join(F.broadcast(below), "declared", "left").select("text", "_u", F.coalesce("_l", F.lit(place[-1][1])).alias("_l"), F.coalesce("_below", F.lit(place[-1][2])).alias("_below"))
    sample = sample.where("_u < _below").select("text", "_l", (F.col("_u") % 8).alias("_part"))

    def count(batches):
        now, sums = None, np.zeros(BUCKETS, np.int64)  # one language at a time

        def flush():
            at = np.flatnonzero(sums)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([sums[at].astype("<i8").tobytes()], pa.binary())], names=["l", "buckets", "n"])

        for b in batches:
            for x in row_chunks(b, "text"):
                h, n = _trigrams(texts_of(x, "text"))
                row = np.repeat(x.column("_l").to_numpy(), n)
                for i in np.unique(row).tolist():
                    if i != now:
                        if now is not None:
                            yield flush()
                        now, sums = i, np.zeros(BUCKETS, np.int64)
                    sums += np.bincount(h[row == i], minlength=BUCKETS)
        if now is not None:
            yield flush()

    table = np.full((len(langs), BUCKETS), 0.1, np.float32)
    counted = sample.repartition("_l", "_part").sortWithinPartitions("_l").mapInArrow(count, "l int, buckets binary, n binary")
    for r in counted.toLocalIterator():  # some rows a language
        table[r[0], np.frombuffer(r[1], "<i4")] += np.frombuffer(r[2], "<i8")
    table /= table.sum(axis=1, keepdims=True, dtype=np.float64)
    return own, langs, np.log(table)


def identify(rows: DataFrame, keys: list[str], *, text: str = "text", declared: str | None = None, host: str | None = None, suffix: Column | None = None,
             sample_rows: int = 6000, kappa: float = 20.0, temper: float = 0.3, least_posterior: float = 0.6, least_trigrams: int = 1, least_share: float = 0.001) -> DataFrame:
    """keys, language, posterior, text_language, n_trigrams, accepted for each row."""
    none = F.lit(None).cast("string")
    docs = rows.select(F.struct(*keys).alias("keys"), F.col(text).cast("string").alias("text"), (F.col(declared).cast("string") if declared else none).alias("declared"), (F.col(host).cast("string") if host else none).alias("host"), (suffix if suffix is not None else none).alias("suffix"))
    own, langs, table = fit_text(docs, sample_rows, least_share)
    n = len(langs)
    if not n:
        return docs.select("keys.*", none.alias("language"), F.lit(0.0).alias("posterior"), none.alias("text_language"), F.lit(0).cast("long").alias("n_trigrams"), F.lit(False).alias("accepted"))
    spark = docs.sparkSession
    kept = [f for f in docs.schema.fields if f.name != "text"]
    sent = spark.sparkContext.broadcast(np.ascontiguousarray(table.T))  # 256 KB a language, 256 MB at most as least_share is

    def score(batches):
        logp = sent.value
        for b in batches:
            for x in row_chunks(b, "text"):
                h, m = _trigrams(texts_of(x, "text"))
                ends = np.cumsum(m)
                sums = np.zeros((len(m), n))
                for j in range(n):
                    run = np.concatenate([[0.0], np.cumsum(logp[h, j], dtype=np.float64)])
                    sums[:, j] = run[ends] - run[ends - m]
                best = sums.argmax(axis=1)
                behind = temper * (sums - sums.max(axis=1, keepdims=True))
                near = behind >= -MARGIN
                offsets = pa.array(np.concatenate([[0], np.cumsum(near.sum(axis=1))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (np.nonzero(near)[1].astype(np.int32), behind[near])]
                yield pa.RecordBatch.from_arrays([*[x.column(f.name) for f in kept], pa.array(m, pa.int64()), pa.array(best.astype(np.int32), mask=m == 0), *lists], names=[*[f.name for f in kept], "n_trigrams", "t", "near", "behind"])

    added = T.StructType.fromDDL("n_trigrams long, t int, near array<int>, behind array<double>")
    seen = materialize(docs.mapInArrow(score, T.StructType([*kept, *added.fields])), "langid")
    # Places of declared values: languages, then null, then those without a language (none if there is "other").
    rest = n - 1 if langs[-1] == OTHER else n + 1
    places = spark.createDataFrame([(v, langs.index(v)) for v in own], "declared string, _d int")
    seen = seen.join(F.broadcast(places), "declared", "left").withColumn("d", F.coalesce("_d", F.when(F.col("declared").isNull(), n).otherwise(rest))).drop("_d", "declared")
    told = seen.where(F.col("t").isNotNull())
    confusion = np.full((n + 2, n), 0.5)
    counted = told.groupBy("d", "t").count().toArrow()  # pairs of languages
    confusion[counted["d"].to_numpy(), counted["t"].to_numpy()] += counted["count"].to_numpy()
    overall = confusion.sum(axis=0) / confusion.sum()
    reliable = np.log(confusion / confusion.sum(axis=0))
    by_language = told.groupBy("host", "suffix", "t").agg(F.count("*").cast("double").alias("c"))
    listed = lambda name: F.collect_list(F.struct("t", "c")).alias(name)  # noqa: E731, one entry a language
    by_suffix = by_language.groupBy("suffix", "t").agg(F.sum("c").alias("c")).groupBy(F.col("suffix").alias("s2")).agg(listed("of_suffix"))
    by_host = by_language.groupBy("host", "suffix").agg(listed("of_host"))
    salts = 16  # a host may hold a third of all rows
    priors = by_host.join(by_suffix, F.expr("suffix <=> s2")).select(
        F.col("host").alias("h2"), "s2", "of_host.t", "of_host.c", F.col("of_suffix.t").alias("ts"), F.col("of_suffix.c").alias("cs"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt2")
    ).withColumnsRenamed({"t": "th", "c": "ch"})
    seen = seen.withColumn("salt", F.pmod(F.xxhash64("behind", "n_trigrams"), F.lit(salts)).cast("int"))
    joined = seen.join(priors, F.expr("host <=> h2 and suffix <=> s2 and salt = salt2"), "left")
    models = spark.sparkContext.broadcast((langs, overall, reliable))

    def fuse(batches):
        langs, overall, reliable = models.value
        names = np.array(langs, object)

        def smoothed(languages, counts, share):
            c = np.zeros(len(share))
            c[languages] = counts
            return (c + kappa * share) / (c.sum() + kappa)

        for b in batches:
            for x in (b.slice(i, 512) for i in range(0, b.num_rows, 512)):
                col = {name: x.column(name) for name in x.schema.names}
                codes, shares = [], []
                at: dict = {}
                for i, key in enumerate(zip(col["host"].to_pylist(), col["suffix"].to_pylist(), col["th"].is_valid().to_pylist(), strict=True)):
                    if key not in at:
                        at[key] = len(shares)
                        of_suffix = smoothed(col["ts"][i].as_py(), col["cs"][i].as_py(), overall) if key[2] else overall
                        shares.append(smoothed(col["th"][i].as_py(), col["ch"][i].as_py(), of_suffix) if key[2] else overall)
                    codes.append(at[key])
                sizes = col["near"].value_lengths().to_numpy(zero_copy_only=False)
                near = col["near"].flatten().to_numpy()
                row, starts = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
                logs = col["behind"].flatten().to_numpy() + np.log(shares)[np.array(codes)[row], near] + reliable[col["d"].to_numpy()[row], near]
                top = np.maximum.reduceat(logs, starts)
                best = np.minimum.reduceat(np.where(logs == top[row], near, len(names)), starts)
                posterior = 1.0 / np.add.reduceat(np.exp(logs - top[row]), starts)
                t = col["t"].to_pylist()
                accepted = (col["n_trigrams"].to_numpy() >= least_trigrams) & (posterior >= least_posterior)
                yield pa.RecordBatch.from_arrays(
                    [col["keys"], pa.array(names[best], pa.string()), pa.array(posterior), pa.array([None if j is None else langs[j] for j in t], pa.string()), col["n_trigrams"], pa.array(accepted)],
                    names=["keys", "language", "posterior", "text_language", "n_trigrams", "accepted"])

    out = T.StructType([docs.schema["keys"], *T.StructType.fromDDL("language string, posterior double, text_language string, n_trigrams long, accepted boolean").fields])
    fused = joined.select("keys", "host", "suffix", "d", "t", "n_trigrams", "near", "behind", "th", "ch", "ts", "cs").mapInArrow(fuse, out)
    return fused.select("keys.*", "language", "posterior", "text_language", "n_trigrams", "accepted")


def identify_documents(docs: DataFrame, keys: list[str] | None = None, **more) -> DataFrame:
    """documents: lang is the declared language, source the host; they have no address, so no suffix."""
    return identify(docs, keys or ["doc_id"], declared="lang", host="source", **more)


def identify_pages(pages: DataFrame, **more) -> DataFrame:
    """pages: the html tag's lang is declared; host and its last label come from the url; the text is the html without tags."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>|&#?\w+;", " ")
    host = F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1))
    rows = pages.select("page_id", bare.alias("text"), F.nullif(F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([a-z]+)", 1), F.lit("")).alias("markup"), host.alias("host"))
    return identify(rows, ["page_id"], declared="markup", host="host", suffix=F.regexp_extract("host", r"([^.]*)$", 1), **more)
