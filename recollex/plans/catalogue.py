"""Queries over the test tables, one an operator, and the same in SQL for an independent engine."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.functions.lineage import cut, materialize, shared_root
from recollex.functions.vectors import decayed, dot, modality_name, norm, normalize, pack_half, rounded
from recollex.operators import descent, expand, graph, index, maintain, metrics, prune, topk
from recollex.plans.config import BeamConfig, GraphConfig, RetrievalConfig
from recollex.plans.retrieve import DEMOS, ablation, demo_hit, retrieve
from recollex.sources import memories as src
from recollex.sources.reports import result_lines

RATE = 1e-6
NOVEL = 0.4
RING = GraphConfig(skips=False, hubs=False, rewire=False, bridges=False)
NO_NORM = {"normalize_query": False}
CFG = RetrievalConfig(time_decay=RATE, **NO_NORM)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return put


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    mem = src.memories(spark, d)
    return mem, src.queries(mem)


def _held(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """_both() with memories written once: a retrieval over a graph reads them some ten times, and each time would join all events."""
    mem = materialize(src.memories(spark, d), "memories")
    return mem, src.queries(mem)


def _out(df: DataFrame, *cols: str) -> DataFrame:
    """Scores to 6 digits."""
    return df.select(*[F.round(c, 6).alias(c) if c in ("score", "sim", "max_sim", "importance") else F.col(c) for c in cols])


MEM = """WITH mem AS (SELECT e.vec_id AS node_id, e.embedding::DOUBLE[] AS emb, (e.vec_id % 3)::INTEGER AS modality, epoch_us(v.ts) / 1e6 AS ts, e.label
 FROM embeddings e JOIN events v ON v.event_id = e.vec_id),
q AS (SELECT node_id AS query_id, emb AS q, (SELECT max(ts) FROM mem) AS query_ts FROM mem WHERE node_id % 20 = 0),
sims AS (SELECT query_id, node_id, modality, ts, query_ts, label, list_dot_product(emb, q) AS sim FROM mem, q)"""


def _final(rate: float) -> str:
    return f"sim * exp(-{rate!r} * greatest(0, query_ts - ts))"


def _top(source: str, score: str, k: int, where: str = "true", cols: str = "modality") -> str:
    return f"SELECT query_id, rank::INTEGER AS rank, node_id, score, {cols} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM (SELECT *, {score} AS score FROM {source} WHERE {where})) WHERE rank <= {k}"


def _rounded(inner: str, cols: str = "modality") -> str:
    return f"SELECT query_id, rank, node_id, round(score, 6) AS score, {cols} FROM ({inner})"


def _draw(tag: str, a: str, b: str, seed: int = 7) -> str:
    return f"('0x' || substr(md5(concat_ws(':', '{tag}', {a}, {b}, '{seed}')), 1, 8))::BIGINT"


def _graph_ctes(cfg: GraphConfig = GraphConfig()) -> str:
    """CTEs ring, skips, hubs, gone, new, bridges (a, b as indexes) and edges (src, dst as node ids)."""
    first = [t for on, t in ((cfg.ring, "ring"), (cfg.skips, "skips"), (cfg.hubs, "hubs")) if on]
    pair = "SELECT least(a, b) AS a, greatest(a, b) AS b FROM {} WHERE a <> b"
    base = " UNION ".join(pair.format(t) for t in first) or "SELECT 0 AS a, 0 AS b WHERE false"
    if cfg.rewire and cfg.ring:
        base = f"(({' UNION '.join(pair.format(t) for t in first)}) EXCEPT ({pair.format('gone')})) UNION ({pair.format('new')})"
    if cfg.bridges:
        base = f"({base}) UNION ({pair.format('bridges')})"
    h = max(1, cfg.k // 2)
    return f""",
idx AS (SELECT node_id, modality, row_number() OVER (ORDER BY node_id) - 1 AS i, (SELECT count(*) FROM mem) AS n FROM mem),
ring AS (SELECT i AS a, (i + j) % n AS b, j FROM idx, (SELECT unnest(generate_series(1, {h})) AS j)),
skips AS (SELECT i AS a, (i + step) % n AS b FROM (SELECT i, n, (1::BIGINT << l) AS step FROM (SELECT i, n, unnest(generate_series(1, greatest(1, floor(log2(n))::BIGINT)))::INTEGER AS l FROM idx)) WHERE i % step = 0),
hubs AS (SELECT i AS a, {_draw('hub', 'i', 'e', cfg.seed)} % n AS b FROM (SELECT i, n, unnest(generate_series(1, greatest(2, floor(log2(n))::BIGINT // 2))) AS e FROM idx WHERE i % floor(sqrt(n))::BIGINT = 0)),
coins AS (SELECT i AS a, j, n, (i + j) % n AS b FROM idx, (SELECT unnest(generate_series(1, {h})) AS j) WHERE {_draw('coin', 'i', 'j', cfg.seed)} / 4294967296.0 < {cfg.p!r}),
gone AS (SELECT a, b FROM coins),
new AS (SELECT a, {_draw('rewire', 'a', 'j', cfg.seed)} % n AS b FROM coins),
places AS (SELECT i, modality, row_number() OVER (PARTITION BY modality ORDER BY i) - 1 AS place FROM idx),
sizes AS (SELECT modality AS m, count(*) AS c FROM mem GROUP BY 1),
bridges AS (SELECT w.i AS a, p.i AS b FROM (SELECT i, m, {_draw('bridge', 'i', 'm', cfg.seed)} % c AS want FROM idx JOIN sizes ON m <> modality) w JOIN places p ON p.modality = w.m AND p.place = w.want),
pairs AS ({base}),
edges AS (SELECT x.node_id AS src, y.node_id AS dst FROM (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs) JOIN idx x ON x.i = a JOIN idx y ON y.i = b)"""


def _retrieve_sql(cfg: RetrievalConfig, g: GraphConfig | None, hops: int) -> str:
    own = _final(cfg.time_decay)
    if cfg.modality_filter is not None:
        own = f"CASE WHEN modality = {cfg.modality_filter} THEN {own} END"
    where = f"modality = {cfg.modality_filter}" if cfg.modality_filter is not None else "true"
    out = MEM + (_graph_ctes(g) if g else "") + f",\nfin AS (SELECT query_id, node_id, modality, {own} AS own FROM sims),\nv0 AS (SELECT query_id, node_id, score, modality, 0 AS hops FROM ({_top('fin', 'own', cfg.top_k, where)}))"
    for h in range(1, hops + 1):
        seen = " UNION ALL ".join(f"SELECT query_id, node_id FROM v{i}" for i in range(h))
        out += f""",
s{h} AS (SELECT query_id, dst AS node_id, max(score) AS parent FROM v{h - 1} JOIN edges ON src = node_id GROUP BY ALL),
v{h} AS (SELECT query_id, node_id, greatest(parent * {cfg.hop_decay!r}, {cfg.own_weight!r} * own) AS score, modality, {h} AS hops FROM s{h} JOIN fin USING (query_id, node_id) WHERE (query_id, node_id) NOT IN ({seen}))"""
    every = " UNION ALL ".join(f"SELECT * FROM v{i}" for i in range(hops + 1))
    where = where if cfg.modality_filter_scope == "results" else "true"
    return out + f",\nreached AS ({every})\n" + _rounded(_top("(SELECT query_id, node_id, score AS s, modality, hops FROM reached)", "s", cfg.top_k, where, "modality, hops"), "modality, hops")


# Scores ---------------------------------------------------------------------------------------------------------------

@query(MEM + " SELECT query_id, node_id, round(sim, 6) AS sim FROM sims")
def similarity_all(spark, d):
    return topk.similarity(*_held(spark, d)).select("query_id", "node_id", rounded(F.col("sim")).alias("sim"))


@query("SELECT vec_id AS node_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def l2_norms(spark, d):
    return src.read(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), F.round(norm("embedding"), 6).alias("norm"))


@query("SELECT vec_id AS node_id, i::INTEGER AS i, round(e[i + 1] / (sqrt(list_dot_product(e, e)) + 1e-8), 6) AS value FROM (SELECT vec_id, list_transform(embedding, lambda x: 3 * x::DOUBLE) AS e, unnest(generate_series(0, len(embedding) - 1)) AS i FROM embeddings)")
def normalize_vectors(spark, d):
    e = src.read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.lit(3.0) * x.cast("double")).alias("e"))
    return e.select(F.col("vec_id").alias("node_id"), F.posexplode(normalize("e")).alias("i", "value")).select("node_id", "i", F.round("value", 6).alias("value"))


@query(MEM + f" SELECT query_id, node_id, round({_final(RATE)}, 6) AS score FROM sims")
def temporal_decay(spark, d):
    mem, q = _held(spark, d)
    s = topk.similarity(mem, q, "ts", "query_ts")
    return s.select("query_id", "node_id", rounded(decayed(F.col("sim"), F.col("query_ts") - F.col("ts"), RATE)).alias("score"))


_STEP = "pow(2, greatest(floor(log2(abs(x))), -14) - 10)"
HALF = MEM.replace("list_dot_product(emb, q) AS sim", f"list_dot_product(list_transform(emb, lambda x: CASE WHEN x = 0 THEN 0 ELSE round_even(x / {_STEP}, 0) * {_STEP} END), q) AS sim")


@query(HALF + " SELECT query_id, rank, node_id, score FROM (" + _rounded(_top("sims", "sim", 10)) + ")")
def half_similarity(spark, d):
    mem, q = _both(spark, d)
    return _out(topk.topk(pack_half(mem), q, 10), "query_id", "rank", "node_id", "score")


@query("SELECT (vec_id % 3)::INTEGER AS modality, CASE vec_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'audio' ELSE 'image' END AS name, count(*) AS n FROM embeddings GROUP BY ALL")
def modality_names(spark, d):
    return src.read(spark, d, "embeddings").select((F.col("vec_id") % 3).cast("int").alias("modality")).groupBy("modality").agg(F.count("*").alias("n")).withColumn("name", modality_name("modality"))


# Top-k ----------------------------------------------------------------------------------------------------------------

TOP = ("query_id", "rank", "node_id", "score", "modality")


@query(MEM + _rounded(_top("sims", "sim", 10)).replace("SELECT", " SELECT", 1))
def topk_similarity(spark, d):
    return _out(topk.topk(*_both(spark, d), 10), *TOP)


@query(MEM + " " + _rounded(_top("sims", _final(RATE), 10)))
def topk_decayed(spark, d):
    return _out(topk.topk(*_both(spark, d), 10, rate=RATE), *TOP)


@query(MEM + " " + _rounded(_top("sims", _final(RATE), 10, "modality = 2")))
def modality_filtered_topk(spark, d):
    return _out(topk.topk(*_both(spark, d), 10, rate=RATE, where=F.col("modality") == 2), *TOP)


@query(MEM + " " + _rounded(_top("sims", _final(RATE), 10, "node_id % 11 <> 0")))
def tombstone_topk(spark, d):
    mem, q = _both(spark, d)
    return _out(retrieve(mem.withColumn("deleted", F.col("node_id") % 11 == 0), None, q, CFG), *TOP)


@query(MEM + " " + _rounded(_top("sims", f"{_final(RATE)} * (1.0 + (node_id % 5) * 0.5)", 10)))
def importance_topk(spark, d):
    mem, q = _both(spark, d)
    return _out(topk.topk(mem.withColumn("importance", 1.0 + (F.col("node_id") % 5) * 0.5), q, 10, rate=RATE, importance=True), *TOP)


@query(MEM + f", first AS ({_top('sims', 'sim', 50, cols='modality, ts, query_ts')}) " + _rounded(_top("(SELECT query_id, node_id, score AS sim, modality, ts, query_ts FROM first)", _final(RATE), 10)))
def overfetch_rerank(spark, d):
    return _out(topk.overfetch_rerank(*_both(spark, d), 10, 50, RATE), *TOP)


@query(MEM + " " + _rounded(_top("sims", "sim", 10, "query_ts - ts <= 86400")))
def recency_window_topk(spark, d):
    mem, q = _both(spark, d)
    last = mem.agg(F.max("ts").alias("last"))
    return _out(topk.topk(mem.join(F.broadcast(last)).where(F.col("last") - F.col("ts") <= 86400).drop("last"), q, 10), *TOP)


@query(MEM + " SELECT w::BIGINT AS start, modality, count(*) AS n FROM (SELECT modality, unnest([floor(ts / 3600) * 3600, floor(ts / 3600) * 3600 - 3600]) AS w FROM mem) GROUP BY ALL")
def sliding_window_corpus(spark, d):
    mem = src.memories(spark, d).withColumn("at", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))
    w = mem.groupBy(F.window("at", "2 hours", "1 hour").alias("w"), "modality").agg(F.count("*").alias("n"))
    return w.select(F.unix_timestamp("w.start").alias("start"), "modality", "n")


# Graph ----------------------------------------------------------------------------------------------------------------

def _ids(spark, d):
    ids = graph.ranked(src.memories(spark, d).select("node_id", "modality"), "node_id", "idx")
    return ids, ids.count()


for _name, _make in {
    "nsn_ring": lambda ids, n: graph.ring(ids, n, 6), "nsn_skips": graph.skips, "nsn_hubs": lambda ids, n: graph.hubs(ids, n, 7),
    "nsn_rewire": lambda ids, n: graph.rewired(ids, n, 6, 0.15, 7)[1], "nsn_bridges": lambda ids, n: graph.bridges(ids, 7),
}.items():
    _cte = "new" if _name == "nsn_rewire" else _name[4:]
    query(MEM + _graph_ctes() + f" SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM {_cte} WHERE a <> b", _name)(lambda spark, d, make=_make: graph.pairs(make(*_ids(spark, d))))


@query(MEM + _graph_ctes() + " SELECT src, dst FROM edges")
def nsn_edges(spark, d):
    return graph.build(src.memories(spark, d))


@query(MEM + _graph_ctes() + " SELECT src, array_to_string(list(dst ORDER BY dst), ',') AS neighbors FROM edges GROUP BY src")
def csr_rows(spark, d):
    return graph.rows(graph.build(src.memories(spark, d))).select("src", F.array_join(F.transform("neighbors", lambda x: x.cast("string")), ",").alias("neighbors"))


@query(MEM + _graph_ctes() + " SELECT max(c) AS max_degree, round(avg(c), 6) AS avg_degree, count(*) AS nodes FROM (SELECT src, count(*) AS c FROM edges GROUP BY src)")
def degree_stats(spark, d):
    return graph.degree_stats(graph.build(src.memories(spark, d))).select("max_degree", F.round("avg_degree", 6).alias("avg_degree"), "nodes")


@query(MEM + _graph_ctes() + " SELECT n, edges, 64 AS dim, round(2.0 * edges / n, 6) AS avg_degree, n_text, n_audio, n_image, (n * 264 + 4 * (n + 1 + 2 * edges))::BIGINT AS bytes FROM (SELECT count(*) AS n, count(*) FILTER (modality = 0) AS n_text, count(*) FILTER (modality = 1) AS n_audio, count(*) FILTER (modality = 2) AS n_image, (SELECT count(*) // 2 FROM edges) AS edges FROM mem)")
def corpus_summary(spark, d):
    mem = src.memories(spark, d)
    return graph.summary(mem, graph.build(mem), 64).withColumn("avg_degree", F.round("avg_degree", 6))


# Retrieval ------------------------------------------------------------------------------------------------------------

RES = ("query_id", "rank", "node_id", "score", "modality", "hops")


def _retrieval(name: str, cfg: RetrievalConfig, g: GraphConfig | None) -> None:
    def run(spark, d):
        mem, q = _held(spark, d)
        return _out(retrieve(mem, graph.build(mem, g) if g else None, q, cfg), *RES)

    query(_retrieve_sql(cfg, g, cfg.max_hops if g else 0), name)(run)


_retrieval("bfs_1hop", replace(CFG, max_hops=1), RING)
_retrieval("bfs_2hop", replace(CFG, max_hops=2, hop_decay=0.8), RING)
_retrieval("retrieve_full", CFG, GraphConfig())
_retrieval("retrieve_modality", replace(CFG, modality_filter=2), GraphConfig())
_retrieval("retrieve_modality_results", replace(CFG, modality_filter=2, modality_filter_scope="results"), GraphConfig())
for _name in ("flat", "ring_only", "no_bridges", "no_hubs", "no_rewire", "h0", "h1", "h3"):
    from recollex.plans.config import ABLATIONS

    _g, _h = ABLATIONS[_name]
    query(_retrieve_sql(CFG, _g if _h else None, _h), f"ablation_{_name}")(lambda spark, d, name=_name: _out(ablation(*_held(spark, d), name, CFG), *RES))
for _name, (_cfg, _) in DEMOS.items():
    _retrieval(f"demo_{_name}", replace(_cfg, **NO_NORM), GraphConfig())


@query(SQL["bfs_2hop"])
def bfs_2hop_stored(spark, d):
    """bfs_2hop over edges and memories in buckets, which hops read without a shuffle."""
    mem, q = _held(spark, d)
    name = f"g_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges, stored = graph.store(graph.build(mem, RING), mem, name, f"{shared_root(spark).rstrip('/')}/{name}", buckets)
    return _out(retrieve(stored, edges, q, replace(CFG, max_hops=2, hop_decay=0.8)), *RES)


@query("SELECT query_id, '{\"results\":[' || string_agg('{\"id\":' || node_id || ',\"score\":' || score || ',\"modality\":' || modality || ',\"hops\":' || hops || '}', ',' ORDER BY rank) || ']}' AS line FROM (" + _retrieve_sql(CFG, RING, 2) + ") GROUP BY query_id")
def answer_lines(spark, d):
    mem, q = _held(spark, d)
    return result_lines(retrieve(mem, graph.build(mem, RING), q, CFG))


# Index ----------------------------------------------------------------------------------------------------------------

KNN = ", knn AS (SELECT a.node_id, b.node_id AS dst, b.modality, a.modality AS own, list_dot_product(a.emb, b.emb) AS sim FROM mem a, mem b WHERE a.node_id <> b.node_id)"


@query(MEM + KNN + " SELECT node_id, rank::INTEGER AS rank, dst, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY sim DESC, dst) AS rank FROM knn) WHERE rank <= 8")
def knn_graph(spark, d):
    return _out(index.knn_graph(src.memories(spark, d), 8), "node_id", "rank", "dst", "sim")


@query(MEM + KNN + """ SELECT node_id, (rank - 1)::INTEGER AS slot, dst, 'near' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY sim DESC, dst) AS rank FROM knn) WHERE rank <= 6
UNION ALL SELECT node_id, (row_number() OVER (PARTITION BY node_id ORDER BY modality) + 5)::INTEGER, dst, 'bridge' FROM (SELECT *, row_number() OVER (PARTITION BY node_id, modality ORDER BY sim DESC, dst) AS r FROM knn WHERE modality <> own) WHERE r = 1""")
def knn_bridges(spark, d):
    return index.neighbors(src.memories(spark, d), 8, 2).select("node_id", F.col("slot").cast("int").alias("slot"), "dst", "kind")


@query()
def knn_descent(spark, d):
    """The k-NN graph by neighbour descent: approximate, so without SQL; its recall of knn_graph is tested."""
    return _out(descent.descend(src.memories(spark, d), 8)[0], "node_id", "rank", "dst", "sim")


@query(SQL["topk_decayed"])
def beam_exhaustive(spark, d):
    mem, q = _both(spark, d)
    n = mem.count()
    return _out(index.beam_search(mem, lambda: index.neighbors(mem, 16, 2), q, BeamConfig(beam=n, iterations=n, time_decay=RATE)), *TOP)


@query()
def beam_default(spark, d):
    mem, q = _held(spark, d)
    return _out(index.beam_search(mem, index.neighbors(mem, 16, 2), q, BeamConfig(time_decay=RATE)), *TOP)


# Novelty and maintenance ----------------------------------------------------------------------------------------------

NOV = MEM + ", cut AS (SELECT max(node_id) * 0.9 AS c FROM mem), nov AS (SELECT a.node_id AS candidate_id, max(list_dot_product(a.emb, b.emb)) AS max_sim FROM mem a, mem b, cut WHERE a.node_id > c AND b.node_id <= c GROUP BY 1)"


def _split(spark, d):
    """Memories, and the last tenth of the ids as candidates."""
    mem = src.memories(spark, d)
    c = mem.agg(F.max("node_id")).first()[0] * 0.9
    return mem.where(F.col("node_id") <= c), mem.where(F.col("node_id") > c).select(F.col("node_id").alias("candidate_id"), "embedding")


def _novelty(spark, d):
    return topk.novel(*_split(spark, d), NOVEL)


@query(NOV + " SELECT candidate_id, round(max_sim, 6) AS max_sim FROM nov")
def novelty_max_sim(spark, d):
    return _out(_novelty(spark, d), "candidate_id", "max_sim")


@query(NOV + f" SELECT candidate_id, max_sim <= {NOVEL} AS accepted FROM nov")
def novelty_gate(spark, d):
    return _novelty(spark, d).select("candidate_id", "accepted")


@query(SQL["novelty_max_sim"])
def novelty_max_sim_pruned(spark, d):
    """The same by cells, of which those are left out whose bound is below what was found."""
    return _out(prune.max_similarity(*_split(spark, d)), "candidate_id", "max_sim")


@query(SQL["novelty_gate"])
def novelty_gate_pruned(spark, d):
    return prune.novel(*_split(spark, d), NOVEL).select("candidate_id", "accepted")


@query(MEM + f", hit AS (SELECT DISTINCT node_id FROM ({_top('sims', _final(RATE), 10)})) SELECT mem.node_id, round(CASE WHEN hit.node_id IS NULL THEN w ELSE least(w + 0.1, 5.0) END, 6) AS importance FROM (SELECT node_id, (1.0 + (node_id % 5) * 0.5) * 0.999 AS w FROM mem) mem LEFT JOIN hit USING (node_id)")
def importance_update(spark, d):
    mem, q = _both(spark, d)
    return _out(maintain.importance_update(mem.select("node_id", (1.0 + (F.col("node_id") % 5) * 0.5).alias("importance")), topk.topk(mem, q, 10, rate=RATE)), "node_id", "importance")


_VIS = _retrieve_sql(replace(CFG, max_hops=2), GraphConfig(), 2)
_VIS = _VIS[:_VIS.rindex("\nSELECT query_id, rank")]
HITS = _VIS + ", used AS (SELECT e.src, e.dst, count(*) AS hits FROM reached c JOIN edges e ON e.src = c.node_id JOIN reached p ON p.query_id = c.query_id AND p.node_id = e.dst AND p.hops = c.hops - 1 GROUP BY ALL), counted AS (SELECT edges.src, edges.dst, coalesce(hits, 0) AS hits FROM edges LEFT JOIN used USING (src, dst))"


def _hits(spark, d):
    mem, q = _held(spark, d)
    edges = graph.build(mem)
    seeds = topk.topk(mem, q, 10, rate=RATE)
    return maintain.edge_hits(edges, cut(expand.expand(seeds, edges, mem, q, CFG)))


@query(HITS + " SELECT * FROM counted")
def edge_hits(spark, d):
    return _hits(spark, d)


@query(HITS + " SELECT count(*) AS n FROM counted WHERE hits <= 0")
def low_utility_edges(spark, d):
    return maintain.low_utility(_hits(spark, d), 0).agg(F.count("*").alias("n"))


@query("SELECT node_id, batch_id::INTEGER AS batch_id, value FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY batch_id DESC, seq DESC) AS r FROM (SELECT user_id AS node_id, (event_id % 7) AS batch_id, event_id AS seq, value FROM events)) WHERE r = 1")
def upsert_latest(spark, d):
    e = src.read(spark, d, "events").select(F.col("user_id").alias("node_id"), (F.col("event_id") % 7).cast("int").alias("batch_id"), F.col("event_id").alias("seq"), "value")
    return maintain.latest(e).select("node_id", "batch_id", "value")


@query("SELECT vec_id AS node_id, len(e) = 64 AS dim_ok FROM (SELECT vec_id, CASE WHEN vec_id % 13 = 0 THEN embedding[1:32] ELSE embedding END AS e FROM embeddings)")
def dim_validation(spark, d):
    e = src.read(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), F.when(F.col("vec_id") % 13 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("embedding"))
    return src.validate(e, 64).select("node_id", "dim_ok")


# Metrics --------------------------------------------------------------------------------------------------------------

def _answers(spark, d):
    """Top-10 by decayed similarity with times and labels."""
    mem, q = _both(spark, d)
    r = topk.topk(mem, q, 10, rate=RATE).join(mem.select("node_id", "ts", "label"), "node_id").join(q.select("query_id", "query_ts"), "query_id")
    return r, mem, q


ANS = MEM + f", ans AS ({_top('sims', _final(RATE), 10, cols='modality, ts, query_ts, label')})"


@query(MEM + f", ans AS ({_top('sims', _final(1e-4), 10)}), truth AS ({_top('sims', 'sim', 10)}) SELECT t.query_id, count(a.node_id) / 10.0 AS recall FROM truth t LEFT JOIN ans a USING (query_id, node_id) GROUP BY 1")
def recall_at_k(spark, d):
    mem, q = _both(spark, d)
    return metrics.recall_at_k(topk.topk(mem, q, 10, rate=1e-4), topk.topk(mem, q, 10), 10)


@query(ANS + " SELECT avg((m >= 2)::INTEGER::DOUBLE) AS rate FROM (SELECT query_id, count(DISTINCT modality) AS m FROM ans WHERE rank <= 5 GROUP BY 1)")
def cross_modal_rate(spark, d):
    return metrics.cross_modal_rate(_answers(spark, d)[0], 5)


@query(ANS + " SELECT query_id, round(avg((query_ts - ts <= 86400)::INTEGER), 6) AS precision FROM ans GROUP BY 1")
def temporal_precision(spark, d):
    return metrics.share(_answers(spark, d)[0], F.col("query_ts") - F.col("ts") <= 86400, "precision").select("query_id", F.round("precision", 6).alias("precision"))


@query(ANS + " SELECT query_id, round(avg((query_ts - ts > 86400)::INTEGER), 6) AS stale FROM ans GROUP BY 1")
def stale_rate(spark, d):
    return metrics.share(_answers(spark, d)[0], F.col("query_ts") - F.col("ts") > 86400, "stale").select("query_id", F.round("stale", 6).alias("stale"))


@query(ANS + " SELECT query_id, max((ans.label = mem.label AND ans.node_id <> query_id)::INTEGER) AS found FROM ans JOIN mem ON mem.node_id = query_id GROUP BY 1")
def object_recall(spark, d):
    r, mem, _ = _answers(spark, d)
    target = mem.select(F.col("node_id").alias("query_id"), F.col("label").alias("target"))
    return metrics.any_row(r.join(target, "query_id"), (F.col("label") == F.col("target")) & (F.col("node_id") != F.col("query_id")), "found")


@query(ANS + " SELECT query_id, max((query_ts - ts < 7200)::INTEGER) AS fresh FROM ans GROUP BY 1")
def freshness_rate(spark, d):
    return metrics.any_row(_answers(spark, d)[0], F.col("query_ts") - F.col("ts") < 7200, "fresh")


@query(ANS + " SELECT query_id, max((score > 0.3)::INTEGER) AS hit, sum((score > 0.3)::INTEGER)::BIGINT AS hits FROM ans WHERE node_id <> query_id GROUP BY 1")
def threshold_hits(spark, d):
    r = _answers(spark, d)[0].where("node_id <> query_id")
    return r.groupBy("query_id").agg(F.max((F.col("score") > 0.3).cast("int")).alias("hit"), F.sum((F.col("score") > 0.3).cast("long")).alias("hits"))


@query(ANS + " SELECT query_id, max((modality = 0 AND score > 0.2)::INTEGER) AS text_hit FROM ans GROUP BY 1")
def cross_modal_hits(spark, d):
    return metrics.any_row(_answers(spark, d)[0], (F.col("modality") == 0) & (F.col("score") > 0.2), "text_hit")


@query(MEM + " SELECT DISTINCT label FROM mem WHERE (SELECT max(ts) FROM mem) - ts < 7200")
def active_labels(spark, d):
    mem = src.memories(spark, d)
    return mem.join(F.broadcast(mem.agg(F.max("ts").alias("last")))).where(F.col("last") - F.col("ts") < 7200).select("label").distinct()


def _pct(index_of: str) -> str:
    cols = ", ".join(f"s[{index_of.format(p=p)} + 1] AS {n}" for n, p in metrics.PERCENTILES.items())
    return f"SELECT run, {cols} FROM (SELECT event_type AS run, list(value ORDER BY value) AS s, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY 1)"


def _samples(spark, d):
    return src.read(spark, d, "events").select(F.col("event_type").alias("run"), F.col("value").alias("ms"))


@query(_pct("floor({p}::DOUBLE * (n - 1))::BIGINT"))
def latency_percentiles(spark, d):
    return metrics.lower_percentiles(_samples(spark, d), "ms", "run")


@query(_pct("least(floor(n * {p}::DOUBLE)::BIGINT, n - 1)"))
def latency_percentiles_alt(spark, d):
    return metrics.lower_percentiles(_samples(spark, d), "ms", "run", rule="count")


@query("SELECT event_type AS run, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def latency_percentiles_linear(spark, d):
    return _samples(spark, d).groupBy("run").agg(F.round(F.percentile("ms", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("ms", F.lit(0.99)), 6).alias("p99"))


@query("SELECT event_type AS run, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS stddev, max(value) AS max FROM events GROUP BY 1")
def latency_stats(spark, d):
    return metrics.latency_stats(_samples(spark, d), "ms", "run").select("run", "n", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"), "max")


@query(f"SELECT run, n, misses, round(misses / n, 6) AS miss_rate, p99, p99 <= 150 AS within FROM ({_pct('floor({p}::DOUBLE * (n - 1))::BIGINT')}) JOIN (SELECT event_type AS run, count(value) AS n, count(*) FILTER (value > 150) AS misses FROM events GROUP BY 1) USING (run)")
def deadline_report(spark, d):
    return metrics.deadline_report(_samples(spark, d), "ms", "run", 150.0).select("run", "n", "misses", F.round("miss_rate", 6).alias("miss_rate"), "p99", "within")


@query("SELECT event_type AS run, round(avg(value), 6) AS mean_ms, round(1000 / avg(value), 6) AS qps FROM events GROUP BY 1")
def stage_throughput(spark, d):
    return metrics.throughput(_samples(spark, d), "ms", "run").select("run", F.round("mean_ms", 6).alias("mean_ms"), F.round("qps", 6).alias("qps"))


# Reports --------------------------------------------------------------------------------------------------------------

@query(f"""SELECT p.run, n, misses, round(misses / n, 6) AS miss_rate, p50, p90, p99, p999, p9999, round(mean, 6) AS mean, round(stddev, 6) AS stddev, max, p99 <= 150 AS within
FROM ({_pct('floor({p}::DOUBLE * (n - 1))::BIGINT')}) p JOIN (SELECT event_type AS run, count(value) AS n, count(*) FILTER (value > 150) AS misses, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS stddev, max(value) AS max FROM events GROUP BY 1) USING (run)""")
def benchmark_report(spark, d):
    r = metrics.benchmark_report(_samples(spark, d), "ms", "run", 150.0)
    return r.select(*[F.round(c, 6).alias(c) if c in ("miss_rate", "mean", "stddev") else c for c in r.columns])


_HITS = {"av": "rank = 1 AND score > {t}", "robot": "rank = 1 AND score > {t}", "ar": "score > {t}", "voice": "modality = 0 AND score > {t}"}
REPORT = "count(*) AS queries, coalesce(sum(c), 0)::BIGINT AS results, round(avg(coalesce(hit, 0)), 6) AS hit_rate, round(avg(first), 5) AS first_score, round(avg(coalesce(hop, 0)), 6) AS avg_hops"


def _answered(sql: str, hit: str) -> str:
    return f"(SELECT query_id, count(*) AS c, max(({hit})::INTEGER) AS hit, max(score) FILTER (rank = 1) AS first, max(hops) AS hop FROM ({sql}) GROUP BY 1)"


_ASKED = "(SELECT vec_id AS query_id FROM embeddings JOIN events ON event_id = vec_id WHERE vec_id % 20 = 0)"


def _report(r: DataFrame) -> DataFrame:
    return r.select(*[F.round(c, 5 if c == "first_score" else 6).alias(c) if c in ("hit_rate", "first_score", "avg_hops", "recall", "cross_modal", "avg_degree") else F.col(c) for c in r.columns])


@query(" UNION ALL ".join(f"SELECT '{n}' AS demo, {REPORT} FROM {_ASKED} q LEFT JOIN {_answered(_retrieve_sql(replace(c, **NO_NORM), GraphConfig(), c.max_hops), _HITS[n].format(t=t))} a USING (query_id)" for n, (c, t) in DEMOS.items()))
def demo_report(spark, d):
    """A row a demo: how its configuration answers the table's queries over one graph."""
    mem, q = _held(spark, d)
    edges, out = graph.build(mem), None
    for name, (cfg, threshold) in DEMOS.items():
        got = _out(retrieve(mem, edges, q, replace(cfg, **NO_NORM)), *RES)
        row = metrics.answer_report(got, q, demo_hit(name, threshold)).select(F.lit(name).alias("demo"), "*")
        out = row if out is None else out.unionByName(row)
    return _report(out)


_EXACT = MEM + f", truth AS ({_top('sims', _final(RATE), 10)}) SELECT query_id, node_id FROM truth"


@query(f"""SELECT g.*, r.*, m.recall, m.cross_modal FROM ({SQL['corpus_summary']}) g,
(SELECT {REPORT} FROM {_ASKED} q LEFT JOIN {_answered(SQL['retrieve_full'], 'hops > 0')} a USING (query_id)) r,
(SELECT round(avg(recall), 6) AS recall, round(avg((kinds >= 2)::INTEGER), 6) AS cross_modal FROM (SELECT t.query_id, count(a.node_id) / 10.0 AS recall FROM ({_EXACT}) t LEFT JOIN ({SQL['retrieve_full']}) a USING (query_id, node_id) GROUP BY 1)
 JOIN (SELECT query_id, count(DISTINCT modality) AS kinds FROM ({SQL['retrieve_full']}) WHERE rank <= 5 GROUP BY 1) USING (query_id)) m""")
def validation_report(spark, d):
    """One row: the corpus and its graph, how the full retrieval answers (a hit has a row that a hop brought), its recall of the
    exact decayed best, and the share of answers with two modalities or more among the first five."""
    mem, q = _held(spark, d)
    edges = graph.build(mem)
    exact = cut(topk.topk(mem, q, CFG.top_k, rate=CFG.time_decay))  # the seeds of the retrieval, too
    got = cut(_out(retrieve(mem, edges, q, CFG, exact), *RES))
    recall = metrics.recall_at_k(got, exact, 10).agg(F.avg("recall").alias("recall"))
    kinds = metrics.cross_modal_rate(got, 5).withColumnRenamed("rate", "cross_modal")
    return _report(graph.summary(mem, edges, 64).join(metrics.answer_report(got, q, F.col("hops") > 0)).join(recall).join(kinds))  # four tables of one row


# Streams --------------------------------------------------------------------------------------------------------------

@query("""WITH m AS (SELECT vec_id, list_transform(e, lambda x: (x / (sqrt(list_dot_product(e, e)) + 1e-8))::FLOAT::DOUBLE) AS v FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS node_id, list_dot_product(a.v, b.v) * exp(-1e-8 * greatest(0, a.vec_id - b.vec_id)) AS score FROM m a, m b WHERE a.vec_id % 20 = 0)
SELECT query_id, node_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS r FROM s) WHERE r = 1""")
def stream_insert_freshness(spark, d):
    """Streams the table into a store and asks it: each inserted query vector finds itself."""
    from recollex.store import MemoryStore
    from recollex.streaming.insert import insert_stream

    root = f"{shared_root(spark).rstrip('/')}/stream-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    store = MemoryStore(spark, f"{root}/log", 64)
    raw = spark.readStream.schema("vec_id long, embedding array<float>, label int").parquet(f"{d}/embeddings.parquet*")
    rows = raw.select(F.col("vec_id").alias("node_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), (F.col("vec_id") % 3).cast("int").alias("modality"), F.col("vec_id").cast("double").alias("ts"))
    insert_stream(rows, store, f"{root}/offsets").awaitTermination()
    mem = store.memories()
    q = mem.where(F.col("node_id") % src.QUERY_STEP == 0).select(F.col("node_id").alias("query_id"), F.col("embedding").alias("q"), F.col("ts").alias("query_ts"))
    return retrieve(mem, None, q, RetrievalConfig(top_k=1, max_hops=0)).select("query_id", "node_id", F.round("score", 4).alias("score"))
