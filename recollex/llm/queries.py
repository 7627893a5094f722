"""The queries of this subpackage, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, langid, linkgraph, lm, neardup, packing, secrets, suffixdup, topk, toxicity, trie, whiten
from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.join(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdup.digest(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(table(spark, sf_dir, "documents"))


def op7_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_pages(table(spark, sf_dir, "pages"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.judge(table(spark, sf_dir, "pages"))


def op8_url_filters_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rules alone say; SQL can express this part."""
    return linkgraph.by_rules(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", F.col("by_rule").alias("verdict"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.quantized(table(spark, sf_dir, "embeddings"))
    return topk.search(rows.where(F.pmod("id", F.lit(50)) == 0), rows)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.build(table(spark, sf_dir, "conversations"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_secret_scan, op3_toxicity, op4_lm_scoring, op5_ngram_jaccard_join, op6_suffix_dedup, op7_language_id, op7_language_id_pages, op8_url_filters, op8_url_filters_rules, op9_exact_topk, op10_packing, op11_byte_bpe, op12_conversation_trie, op13_embedding_whitening)}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "coalesce(regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
i AS (SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item_id, {_WORDS.format('text')} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM i WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS win
       FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, dw.k, s, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.win = iw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + k - 1)) AS p FROM m) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id),
sg AS (SELECT item_id, words, greatest(4, (80 * len(words) + 99) // 100) AS need, row_number() OVER () AS seg
       FROM (SELECT DISTINCT item_id, list_sort(list_distinct(w[s + 1:s + 20])) AS words
             FROM (SELECT item_id, w, unnest(list_append(generate_series(0, greatest(len(w) - 20, 0), 10), greatest(len(w) - 20, 0))) AS s FROM i WHERE len(w) > 0))),
sw AS (SELECT seg, item_id, need, unnest(words) AS word FROM sg WHERE len(words) >= need),
dp AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d),
nw AS (SELECT doc_id, item_id, need, count(DISTINCT word) OVER (PARTITION BY doc_id, seg ORDER BY p RANGE BETWEEN CURRENT ROW AND 29 FOLLOWING) AS n FROM dp JOIN sw USING (word)),
ng AS (SELECT doc_id, count(*) AS n_near, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM nw WHERE n >= need) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(g.ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(n_near, 0)::BIGINT AS n_near, coalesce(ng.ids, '') AS near_items
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN ng USING (doc_id)
"""

OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, max(list_dot_product(a.q, b.q))::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

_CRC = "xor(list_reduce(flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: list_concat([ascii(ch)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]))), lambda crc, b: CASE WHEN b >= 0 THEN xor(crc, b) WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384) ELSE crc // 2 END, 4294967295::BIGINT), 4294967295)"
OP12_SQL = rf"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS ord, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, ord AS o, role, text FROM c JOIN t ON t.conv_id = c.base AND ord <= h UNION ALL SELECT conv_id, ord, role, text FROM t JOIN c USING (conv_id) WHERE ord > h),
p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY o) AS depth, role, text FROM r),
k AS (SELECT conv_id, depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, md5(string_agg(md5(role) || md5(text), '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING)) AS key FROM p
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS own FROM k GROUP BY ALL),
l AS (SELECT conv_id, max(depth) AS len FROM k GROUP BY 1),
e AS (SELECT depth, key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM k JOIN l USING (conv_id) WHERE depth = len GROUP BY ALL),
up AS (SELECT n.depth, n.key, m.key AS parent FROM n JOIN k m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1),
kids AS (SELECT depth - 1 AS depth, parent AS key, count(*) AS n_children FROM up GROUP BY ALL),
x AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (depth, key)),
s AS (SELECT k.depth, k.key, sum((x.n_children = 0)::INTEGER) AS n_leaves, sum(x.own) AS saved_tokens FROM x JOIN k ON k.conv_id = x.conv_id AND k.depth <= x.depth GROUP BY ALL)
SELECT x.conv_id, x.depth::BIGINT AS depth, pn.conv_id AS parent_conv_id, x.n_convs, x.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens,
       sha256(coalesce(e.ids, '')) AS ends_sha256, (CASE WHEN e.ids IS NULL THEN 0 ELSE len(string_split(e.ids, ',')) END)::BIGINT AS n_ends
FROM x JOIN s USING (depth, key) LEFT JOIN e USING (depth, key) LEFT JOIN up USING (depth, key) LEFT JOIN n pn ON pn.depth = x.depth - 1 AND pn.key = up.parent
"""

OP5_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE doc_id IS NOT NULL),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(w[s:s + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '' ORDER BY g)) AS id FROM sh GROUP BY 1),
r AS (SELECT id, min(doc_id) AS rep, count(*) AS copies, min(n) AS n FROM n GROUP BY 1),
rs AS (SELECT rep, g FROM r JOIN sh ON doc_id = rep),
common AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM rs a JOIN rs b ON a.g = b.g AND a.rep <> b.rep GROUP BY ALL),
links AS (SELECT a, b, y.copies FROM common JOIN r x ON x.rep = a JOIN r y ON y.rep = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
reach AS (SELECT rep AS v, rep AS to_v FROM r UNION SELECT v, b FROM reach JOIN links ON a = to_v),
cls AS (SELECT v AS rep, min(to_v) AS class_id FROM reach GROUP BY 1),
deg AS (SELECT a AS rep, sum(copies) AS links FROM links GROUP BY 1)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(copies - 1 + coalesce(links, 0), 0)::BIGINT AS n_links, coalesce(r.rep, d.doc_id) AS rep_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.id = n.id LEFT JOIN cls ON cls.rep = r.rep LEFT JOIN deg ON deg.rep = r.rep
"""

OP6_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, (len(h) // 2 - 99)::BIGINT)) AS s FROM d WHERE len(h) >= 200)),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM w) WHERE r > 1),
marks AS (SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 1 ELSE 0 END AS new FROM late),
runs AS (SELECT doc_id, min(s) AS low, max(s) + 100 AS high FROM (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM marks) GROUP BY doc_id, run),
cuts AS (SELECT doc_id, low, high, lag(high, 1, 0) OVER (PARTITION BY doc_id ORDER BY low) AS before FROM runs),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (low - before)), '' ORDER BY low) || substr(any_value(h), 2 * max(high) + 1) AS h, count(*) AS n_spans, sum(high - low) AS n_removed FROM cuts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP8_RULES_SQL = rf"""
WITH u AS (SELECT row_number() OVER () AS n, page_id, coalesce({_LOWER.format("regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')")}, '') AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) AS x(verdict, h, p))
SELECT page_id, host, path, max_by(h || p, len(h || p)) AS rule, max_by(verdict, len(h || p)) AS verdict
FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n, page_id, host, path
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op5_ngram_jaccard_join": OP5_SQL, "op6_suffix_dedup": OP6_SQL, "op8_url_filters_rules": OP8_RULES_SQL, "op9_exact_topk": OP9_SQL, "op12_conversation_trie": OP12_SQL}
