"""Benchmark decontamination with a distributed positional inverted index.

The index holds the postings (term, document, position) of every term that the test items use, over whole training texts,
written to the shared folder. A phrase query takes the rarest terms of each window of item words: the postings of the
rarest give alignments (position less the term's place in the item), which are intersected with the offset-adjusted
postings of the second and third rarest. What is left is checked word by word against the document, where windows and
hit words are counted. Proximity queries cut items into segments; of a segment's rarest words so many are looked up that a near
span must hold three of them, in bins of the span's width; the document's words then decide.

Everything runs on DataFrame functions. Nothing is broadcast by hint: Spark does so where a side's size permits.

Defined cases: null text and null items have no words and match nothing; a null item_id is written as an empty string; a
null doc_id is a value like others; repeated rows (same doc_id and text) get the same result each; rows with one doc_id and
other texts are told apart by a hash of the text; repeated items count once by item_id; empty tables give no rows (docs) or
no hits (benchmark); other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, words_column

RAREST = 3


@dataclass(frozen=True)
class PositionalIndex:
    """terms: term, tid. postings: tid, doc_id, th (hash of the text), pos. counts: tid, n."""

    terms: DataFrame
    postings: DataFrame
    counts: DataFrame


def item_words(benchmark: DataFrame) -> DataFrame:
    """key, item_id (string), item (array of words) of the distinct items that have words."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words_column(F.col("text")).alias("item")).where(F.size("item") > 0).distinct()
    return materialize(items.withColumn("key", F.monotonically_increasing_id()), "decon-items")


def build_index(docs: DataFrame, items: DataFrame) -> PositionalIndex:
    terms = materialize(items.select(F.explode("item").alias("term")).distinct().withColumn("tid", F.monotonically_increasing_id()), "decon-terms")
    tokens = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(words_column(F.col("text"))).alias("pos", "term"))
    postings = materialize(tokens.join(terms, "term").select("tid", "doc_id", "th", "pos"), "decon-postings")
    counts = materialize(postings.groupBy("tid").agg(F.count("*").alias("n")), "decon-counts")
    return PositionalIndex(terms, postings, counts)


def anchors(index: PositionalIndex, items: DataFrame, width: int) -> DataFrame:
    """key, a: the rarest terms (off, tid) of each window of each item, rarest first; distinct; windows with a term that no
    document has are left out."""
    counted = index.terms.join(index.counts, "tid")
    windows = items.select("key", "item", F.explode(F.sequence(F.lit(0), F.greatest(F.size("item") - width, F.lit(0)))).alias("start"))
    cells = windows.select("key", "start", F.size("item").alias("len"), F.posexplode(F.slice("item", F.col("start") + 1, F.lit(width))).alias("i", "term"))
    found = cells.join(counted, "term").select("key", "start", "len", (F.col("start") + F.col("i")).alias("off"), "tid", "n")
    ranked = found.groupBy("key", "start", "len").agg(F.sort_array(F.collect_list(F.struct("n", "off", "tid"))).alias("a"))  # width entries at most
    whole = ranked.where(F.size("a") == F.least("len", F.lit(width)))
    return whole.select("key", F.transform(F.slice("a", 1, RAREST), lambda x: F.struct(x["off"].alias("off"), x["tid"].alias("tid"))).alias("a")).distinct()


def alignments(index: PositionalIndex, items: DataFrame, width: int) -> DataFrame:
    """doc_id, th, key, diags: where the rarest terms of a window stand as in the item, which then begins at words diags."""
    a = materialize(anchors(index, items, width), "decon-anchors")
    first = index.postings.join(a.withColumn("tid", F.col("a")[0]["tid"]), "tid")
    left = first.select("doc_id", "th", "key", "a", (F.col("pos") - F.col("a")[0]["off"]).alias("diag")).distinct()
    for r in range(1, RAREST):
        these = a.where(F.size("a") > r).select(F.col("a")[r]["tid"].alias("tid")).distinct()
        own = index.postings.join(these, "tid", "left_semi").select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), F.col("tid").alias("tid2"), F.col("pos").alias("p2")).distinct()
        term = F.get(F.col("a"), F.lit(r))
        wanted = left.where(F.size("a") > r).withColumn("tid2", term["tid"]).withColumn("p2", F.col("diag") + term["off"])
        met = wanted.join(own, (wanted["doc_id"].eqNullSafe(own["d2"])) & (wanted["th"] == own["t2"]) & (wanted["tid2"] == own["tid2"]) & (wanted["p2"] == own["p2"]), "left_semi").select("doc_id", "th", "key", "a", "diag")
        left = met.unionByName(left.where(F.size("a") <= r))
    return materialize(left.groupBy("doc_id", "th", "key").agg(F.collect_set("diag").alias("diags")), "decon-alignments")


@dataclass(frozen=True)
class Proximity:
    """A span of `slop` words is near a segment (`length` consecutive words of an item, a segment every length / 2 words) if it
    holds `percent` of its distinct words in any order, `least` at least; segments with fewer distinct words are left out."""

    length: int = 20
    slop: int = 30
    percent: int = 80
    least: int = 4


def segments(index: PositionalIndex, items: DataFrame, near: Proximity) -> DataFrame:
    """seg, item_id, words (distinct), need, terms: (n, tid) of the rarest words, of which a near span holds `held` at least.

    A near span lacks size - need of a segment's words at most. So it holds min(RAREST, need) of any size - need + RAREST."""
    last = F.greatest(F.size("item") - near.length, F.lit(0))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(max(1, near.length // 2))), F.array(last)))
    cut = items.select("item_id", "item", F.explode(starts).alias("start")).select("item_id", F.array_distinct(F.slice("item", F.col("start") + 1, F.lit(near.length))).alias("words"))
    need = F.greatest(F.lit(near.least), F.floor((F.size("words") * near.percent + 99) / 100).cast("int"))
    cut = cut.distinct().withColumn("need", need).where(F.size("words") >= F.col("need")).withColumn("seg", F.monotonically_increasing_id())
    cut = materialize(cut, "decon-segments")
    counted = cut.select("seg", F.explode("words").alias("term")).join(index.terms, "term").join(index.counts, "tid", "left").select("seg", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "tid").alias("t"))
    ranked = counted.groupBy("seg").agg(F.sort_array(F.collect_list("t")).alias("terms"))  # length entries at most
    held = F.least(F.lit(RAREST), F.col("need"))
    return cut.join(ranked, "seg").withColumn("held", held).withColumn("terms", F.slice("terms", F.lit(1), F.size("words") - F.col("need") + F.col("held")))


def near_candidates(index: PositionalIndex, items: DataFrame, near: Proximity) -> DataFrame:
    """doc_id, th, item_id, words, need, bins: where a span that begins in one of the bins of slop words may be near a segment."""
    seg = materialize(segments(index, items, near), "decon-rare")
    rare = seg.select("seg", "held", F.explode("terms").alias("t")).select("seg", "held", F.col("t")["tid"].alias("tid"))
    bins = F.floor(F.col("pos") / near.slop)
    met = index.postings.join(rare, "tid").select("doc_id", "th", "seg", "held", "tid", F.explode(F.array(bins - 1, bins)).alias("bin")).where("bin >= 0").distinct()
    found = met.groupBy("doc_id", "th", "seg", "bin").agg(F.count("*").alias("n"), F.first("held").alias("held")).where("n >= held")
    by_seg = found.groupBy("doc_id", "th", "seg").agg(F.collect_list("bin").alias("bins"))
    return materialize(by_seg.join(seg.select("seg", "item_id", "words", "need"), "seg").select("doc_id", "th", "item_id", "words", "need", "bins"), "decon-near")


def phrase_matches(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, items (sorted item ids), hits (places of the words in any occurring window), row (docs' columns)."""
    return matches(docs, benchmark, width, None).drop("near")


def proximity_matches(docs: DataFrame, benchmark: DataFrame, near: Proximity = Proximity()) -> DataFrame:
    """doc_id, near (sorted ids of items with a near span), row (docs' columns), for all documents."""
    return matches(docs, benchmark, 10, near).select("doc_id", "near", "row")


def matches(docs: DataFrame, benchmark: DataFrame, width: int, near: Proximity | None) -> DataFrame:
    """The columns of phrase_matches() and near, those of proximity_matches() (empty without Proximity), in one pass over texts."""
    items = item_words(benchmark)
    index = build_index(docs, items)
    found = alignments(index, items, width).join(items, "key")
    slop = near.slop if near else 1
    cand, close = "struct<item_id:string,item:array<string>,diags:array<int>>", "struct<item_id:string,words:array<string>,need:int,bins:array<bigint>>"
    found = found.select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), F.struct("item_id", "item", "diags").cast(cand).alias("cand"), F.lit(None).cast(close).alias("close"))
    if near:
        spans = near_candidates(index, items, near)
        found = found.unionByName(spans.select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), F.lit(None).cast(cand).alias("cand"), F.struct("item_id", "words", "need", "bins").cast(close).alias("close")))
    by_doc = found.groupBy("d2", "t2").agg(F.collect_list("cand").alias("cands"), F.collect_list("close").alias("closes"))  # each item and segment once a document
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th"), F.struct("*").alias("row"))
    # The generator keeps a filter on hits, which Spark pushes down, from splitting the text anew for every item word.
    joined = rows.join(by_doc, rows["doc_id"].eqNullSafe(by_doc["d2"]) & (rows["th"] == by_doc["t2"]), "left").select("doc_id", F.explode(F.array(words_column(F.col("text")))).alias("words"), "cands", "closes", "row")

    def matched(item, diag):
        """Places of the item, begun at word diag, whose word stands in the document."""
        return F.transform(item, lambda w, i: F.coalesce(F.get(F.col("words"), diag + i) == w, F.lit(False)))

    def begun(m):
        """For each place of the item where a window begins: whether all its words are matched."""
        n = F.size(m)
        return F.transform(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))), lambda s: F.forall(F.slice(m, s + 1, F.lit(width)), lambda x: x))

    def places(c):
        """Words of the document that the windows of a candidate hit."""
        def spans(d):
            at = F.filter(F.transform(d["begun"], lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
            return F.flatten(F.transform(at, lambda s: F.sequence(d["diag"] + s, d["diag"] + s + c["length"] - 1)))

        return F.array_distinct(F.flatten(F.transform(c["at"], spans)))

    def is_near(c):
        holds = lambda x: F.size(F.array_intersect(x, c["words"])) >= c["need"]

        def in_bin(b):
            part = F.slice("words", (b * slop + 1).cast("int"), F.lit(2 * slop))
            return holds(part) & F.exists(F.sequence(F.lit(1), F.lit(slop)), lambda i: holds(F.slice(part, i, F.lit(slop))))

        return F.exists(c["bins"], in_bin)

    def tried(c):
        at = F.transform(c["diags"], lambda d: F.struct(d.alias("diag"), begun(matched(c["item"], d)).alias("begun")))
        return F.struct(c["item_id"].alias("item_id"), F.least(F.size(c["item"]), F.lit(width)).alias("length"), F.filter(at, lambda d: F.exists(d["begun"], lambda x: x)).alias("at"))

    checked = joined.withColumn("cands", F.when(F.col("cands").isNotNull(), F.transform("cands", tried)))
    real = F.filter("cands", lambda c: F.size(c["at"]) > 0)
    ids = lambda found: F.coalesce(F.array_sort(F.array_distinct(F.transform(found, lambda c: c["item_id"]))), F.array().cast("array<string>"))
    return checked.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), ids(real).alias("items"),
        F.coalesce(F.array_distinct(F.flatten(F.transform(real, places))), F.array().cast("array<int>")).alias("hits"),
        ids(F.filter("closes", is_near)).alias("near"), "row",
    )


def digest(docs: DataFrame, benchmark: DataFrame, width: int = 10, near: Proximity = Proximity()) -> DataFrame:
    """The digest of phrase matches, and n_near and near_items (sorted, comma-joined) of proximity matches."""
    m = matches(docs.select("doc_id", "text"), benchmark, width, near)
    return m.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near"), F.array_join("near", ",").alias("near_items"),
    )
