"""URL filters: rules on hosts and paths, and trust that spreads over the graph of hosts.

Hosts are nodes, with all that stand above them down to the registered domain: the last two labels, but no suffix under
which strangers register (`suffixes`), so neighbours under one of those aren't tied together. A page's
links are edges from its host: absolute ones and those without a scheme (//host/...) lead to their host; relative ones
resolve to the page's own host and add nothing between hosts. A host and the host without its first label are joined both
ways, as a site and its subdomains. Personalised PageRank from trusted seeds (hosts of allowed pages) runs along the edges;
distrust starts at blocked seeds and runs against them, as what links to a bad host is suspect. Both run in the same rounds
until neither changes by more than `residual`. Both are measured in the shares of an average seed of their kind, which
don't depend on the size of the table; a host is blocked if its distrust exceeds `ratio` times its trust, and `least`.

What hosts without a way out hold returns to the seeds: that solution is the one without return, scaled to add up to 1
(the return is a multiple of the seeds, and ranks are linear in them), so it is scaled once at the end.

All of it is DataFrame operations over rows of hosts and edges. A host with many edges has a row for each chunk of them, so
no key holds more than a chunk. Ranks are written to the shared folder every few rounds.

Defined cases: null urls and those without :// have empty host and path, no rule, and are allowed; null html has no links;
null page_id stays; repeated rows are judged once each (their links count once); addresses of digits have no host above
them; an empty table gives no rows; other columns are ignored; texts of any length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

# Fixed values: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
# Some suffixes under which anybody registers or publishes.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk", "blogspot.com", "github.io", "wordpress.com")
LINK = r"""(?i)\bhref\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""
#: No chunk of a host's edges is larger than this part of all edges, nor than LEAST_CHUNK if that is more.
CHUNKS, LEAST_CHUNK = 1024, 256


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(rest), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null if none), and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def ancestors(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The hosts above a host, nearest first, down to two labels; none that is a suffix of strangers."""
    labels = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(2), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    above = F.filter(above, lambda h: ~h.isin(*suffixes)) if suffixes else above
    return F.when((F.size(labels) > 2) & ~host.rlike(r"^[0-9.:]+$"), above).otherwise(F.array().cast("array<string>"))


def host_edges(pages: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """src, dst of distinct hosts: links, and both ways between a host and the one above it."""
    links = pages.select("host", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("to")).select(F.col("host").alias("src"), host_of(F.concat(F.lit("x:"), F.regexp_extract("to", r"(?s)//.*", 0))).alias("dst"))
    links = links.where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst"))).distinct()
    hosts = pages.select("host").union(links.select("dst")).where("host != ''").distinct()
    chain = hosts.select(F.concat(F.array("host"), ancestors(F.col("host"), suffixes)).alias("c"))
    up = chain.select(F.explode(F.arrays_zip(F.slice("c", 1, F.size("c") - 1).alias("src"), F.slice("c", 2, F.size("c")).alias("dst"))).alias("e")).select("e.src", "e.dst").distinct()
    return links.union(up).union(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def propagate(nodes: DataFrame, edges: DataFrame, damping: float = 0.75, residual: float = 1e-3, most_rounds: int = 200, write_every: int = 5) -> DataFrame:
    """host, trust, distrust: personalised PageRank from the nodes' columns `good` along the edges and `bad` against them
    (weights that add up to 1, or all 0)."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ways = edges.withColumn("t", F.lit(1)).withColumn("d", F.lit(0)).union(back.withColumn("t", F.lit(0)).withColumn("d", F.lit(1))).groupBy("src", "dst").agg(F.max("t").alias("t"), F.max("d").alias("d"))
    ways = materialize(ways, "urls-ways")
    chunk = max(LEAST_CHUNK, ways.count() // CHUNKS)
    out = ways.groupBy("src").agg(F.sum("t").alias("nt"), F.sum("d").alias("nd"), F.count("*").alias("n"))
    keys = materialize(out.select(F.col("src").alias("host"), "nt", "nd", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")), "urls-degrees")
    # The chunk of an edge comes from its other end; a host's number of chunks reaches its edges through those chunks.
    spread = ways.withColumn("chunk", F.pmod(F.xxhash64("dst"), F.lit(1 << 20)))
    few, many = keys.where("chunks = 1"), keys.where("chunks > 1")  # many: CHUNKS rows at most
    split = spread.join(F.broadcast(many.select(F.col("host").alias("src"), "chunks")), "src", "left").withColumn("chunk", F.when(F.col("chunks").isNull(), 0).otherwise(F.pmod("chunk", F.col("chunks"))).cast("int")).drop("chunks")
    steps = materialize(split, "urls-steps")
    ranks = nodes.join(few.union(many), "host", "left").select("host", "good", "bad", F.col("good").alias("trust"), F.col("bad").alias("distrust"), F.coalesce("nt", F.lit(0)).alias("nt"), F.coalesce("nd", F.lit(0)).alias("nd"), F.coalesce("chunks", F.lit(1)).alias("chunks"))
    ranks = materialize(ranks, "urls-ranks")
    part = lambda r, n: F.when(F.col(n) > 0, F.col(r) / F.col(n)).otherwise(0.0).alias(r)
    for i in range(most_rounds):
        sent = ranks.where("trust > 0 or distrust > 0").select(F.col("host").alias("src"), part("trust", "nt"), part("distrust", "nd"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        got = steps.join(sent, ["src", "chunk"]).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("t") * F.col("trust")).alias("gt"), F.sum(F.col("d") * F.col("distrust")).alias("gd"))
        new = lambda seed, g: (1 - damping) * F.col(seed) + damping * F.coalesce(g, F.lit(0.0))
        last = (i + 1) % write_every == 0
        before = [F.col("trust").alias("t0"), F.col("distrust").alias("d0")] if last else []
        ranks = ranks.join(got, "host", "left").select("host", "good", "bad", new("good", "gt").alias("trust"), new("bad", "gd").alias("distrust"), "nt", "nd", "chunks", *before)
        if last:
            ranks = materialize(ranks, "urls-ranks")
            moved = ranks.agg(*[F.coalesce(F.sum(F.abs(F.col(a) - F.col(b))), F.lit(0.0)) for a, b in (("trust", "t0"), ("distrust", "d0"))]).first()
            ranks = ranks.drop("t0", "d0")
            if max(moved) <= residual:
                break
    else:
        raise RuntimeError(f"ranks had not settled after {most_rounds} rounds")
    sums = ranks.agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in ("trust", "distrust")]).first()
    return ranks.select("host", *[(F.col(c) / (v or 1.0)).alias(c) for c, v in zip(("trust", "distrust"), sums, strict=True)])


def by_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, by_rule (its verdict) and html."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.withColumn("rule", rule).withColumn("by_rule", verdict)


def judge(pages: DataFrame, *, rules=RULES, ratio: float = 1.0, least: float = 0.05, damping: float = 0.75, residual: float = 1e-3, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust (ranks times the number of seed hosts)."""
    rows = by_rules(pages, rules)
    edges = materialize(host_edges(rows.select("host", "html"), suffixes), "urls-edges")
    pages_of = rows.where("host != ''").groupBy("host").agg(F.sum((F.col("by_rule") == "allow").cast("long")).alias("good"), F.sum((F.col("by_rule") == "block").cast("long")).alias("bad"))
    known = pages_of.select("host").union(edges.select(F.col("dst").alias("host"))).distinct()
    nodes = materialize(known.join(pages_of, "host", "left").select("host", F.coalesce("good", F.lit(0)).cast("double").alias("good"), F.coalesce("bad", F.lit(0)).cast("double").alias("bad")), "urls-nodes")
    good, bad, goods, bads = nodes.agg(F.coalesce(F.sum("good"), F.lit(0.0)), F.coalesce(F.sum("bad"), F.lit(0.0)), F.count_if(F.col("good") > 0), F.count_if(F.col("bad") > 0)).first()
    nodes = nodes.select("host", (F.col("good") / max(1.0, good)).alias("good"), (F.col("bad") / max(1.0, bad)).alias("bad"))
    ranks = propagate(nodes, edges, damping, residual).select("host", (F.col("trust") * goods).alias("trust"), (F.col("distrust") * bads).alias("distrust"))
    salts = 16  # a host may hold a third of all pages
    scores = materialize(ranks.select(F.col("host").alias("h2"), "trust", "distrust", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt2")), "urls-scores")
    salted = rows.drop("html").withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(salts)).cast("int"))
    joined = salted.join(scores, F.expr("host = h2 and salt = salt2"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    by_method = F.when((zero(F.col("distrust")) > F.lit(ratio) * zero(F.col("trust"))) & (zero(F.col("distrust")) > least), F.lit("block")).otherwise(F.lit("allow"))
    return joined.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"), zero(F.col("trust")).alias("trust"), zero(F.col("distrust")).alias("distrust"))
