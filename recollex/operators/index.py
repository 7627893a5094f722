"""The k-NN graph as an index: exact build by blocks, neighbour selection with bridges, and beam search."""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollex.functions.lineage import cut, forget, materialize, scratch_root
from recollex.functions.vectors import decayed, half, query_hash
from recollex.operators import exchange, topk
from recollex.operators.graph import ranked, store
from recollex.operators.topk import best
from recollex.plans.config import BeamConfig

#: Bytes of index and vectors that the driver may collect and send to every task; a larger index is searched by joins.
MOST_SENT = 64 << 20
#: Blocks of memories that are made to give all tasks work; more are made only where a block would be too large.
MOST_BLOCKS = 64


def knn(mem: DataFrame, k: int) -> DataFrame:
    """src, node_id, score, modality (of node_id): the k nearest others of every memory in each modality. Blocks of memories meet
    all memories of a modality in one task, which keeps their best (see exchange.py); so a memory is sent once for each block."""
    n, dims = mem.agg(F.count("*"), F.coalesce(F.mode(F.size("embedding")), F.lit(1))).first()
    kinds = [r[0] for r in mem.select("modality").distinct().orderBy("modality").collect()]  # one row a modality
    blocks = max(1, -(-n * max(1, dims) // topk.MOST_SENT), min(-(-exchange.tasks(mem) // max(1, len(kinds))), MOST_BLOCKS))
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, m in enumerate(kinds) for x in (m, i)]), F.col("modality")), F.lit(0)) if kinds else F.lit(0)
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    asked = topk.whole_queries(mem.select(F.col("node_id").alias("query_id"), F.col("embedding").alias("q"), F.lit(0.0).alias("query_ts")), dims)
    left = asked.withColumn("kind", F.explode(F.sequence(F.lit(0), F.lit(max(0, len(kinds) - 1))))).withColumn("slot", block * max(1, len(kinds)) + F.col("kind"))
    right = topk.whole_memories(mem.withColumn("ts", F.lit(0.0)), dims).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("slot", F.col("at").cast("long") * max(1, len(kinds)) + kind)
    met = exchange.meet(left, right, k + 1, parts=blocks * max(1, len(kinds)))  # one more, as each meets itself
    return met.where("query_id <> node_id").withColumnRenamed("query_id", "src")


def knn_graph(mem: DataFrame, k: int) -> DataFrame:
    """node_id, rank, dst, sim."""
    top = best(knn(mem, k), k, key="src")
    return top.select(F.col("src").alias("node_id"), "rank", F.col("node_id").alias("dst"), F.col("score").alias("sim"))


def neighbors(mem: DataFrame, degree: int = 64, cross: int = 4) -> DataFrame:
    """node_id, slot, dst, kind: degree - cross nearest, then the nearest of each other modality (at most cross)."""
    near = cut(knn(mem, max(1, degree - cross)))  # read twice
    plain = best(near, degree - cross, key="src").select("src", (F.col("rank") - 1).alias("slot"), F.col("node_id").alias("dst"), F.lit("near").alias("kind"))
    own = mem.select(F.col("node_id").alias("src"), F.col("modality").alias("own"))
    other = near.join(own, "src").where("modality <> own")
    one = other.withColumn("r", F.row_number().over(W.partitionBy("src", "modality").orderBy(F.desc("score"), "node_id"))).where("r = 1")
    slot = F.row_number().over(W.partitionBy("src").orderBy("modality")) + (degree - cross - 1)
    bridge = one.withColumn("slot", slot).where(F.col("slot") < degree).select("src", "slot", F.col("node_id").alias("dst"), F.lit("bridge").alias("kind"))
    return plain.union(bridge).withColumnRenamed("src", "node_id")


def seeds(q: np.ndarray, n: int, of: int) -> np.ndarray:
    """Places where the search for q starts, from the bits of its first two components as single-precision numbers."""
    bits = np.zeros(2, np.uint32)
    bits[: len(q)] = np.asarray(q[:2], np.float32).view(np.uint32)
    return (int(bits[0] ^ bits[1]) + np.arange(n) * 7919) % (1 << 32) % of


def beam_search(mem: DataFrame, index: DataFrame | Callable[[], DataFrame], queries: DataFrame, cfg: BeamConfig = BeamConfig()) -> DataFrame:
    """query_id, rank, node_id, score, modality: search of the neighbour lists, then decay, then the best.

    A search whose beam has room for all memories, with iterations to expand them all, is exhaustive: nothing leaves its beam,
    and where no open node is left it goes on at memories that no link leads to (8 of 10,256 random vectors have none). What it
    has seen in the end is every memory, whatever the links, so blocks of queries meet the memories instead. index may be a function that makes it: an
    exhaustive search builds none."""
    n, dim = mem.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if cfg.beam >= (n or 0) and cfg.iterations * cfg.parents >= (n or 0):
        if cfg.half:
            mem = mem.withColumn("embedding", half("embedding"))
        where = F.col("modality") == cfg.modality_filter if cfg.modality_filter is not None else None
        return topk.topk(mem, queries, cfg.top_k, rate=cfg.time_decay, where=where)
    index = materialize(index() if callable(index) else index, "index")  # read two times or more
    links = index.count()
    if (n or 0) * ((dim or 0) * 4 + 24) + links * 16 > MOST_SENT:
        return beam_joins(mem, index, queries, cfg)
    rows = mem.select("node_id", "embedding", "modality", "ts").orderBy("node_id").toArrow()
    edges = index.select("node_id", "slot", "dst").orderBy("node_id", "slot").toArrow()
    ids = rows["node_id"].to_numpy()
    emb = rows["embedding"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1).astype(np.float16 if cfg.half else np.float32) if len(ids) else np.zeros((0, 1), np.float32)
    start = np.searchsorted(edges["node_id"].to_numpy(), [*ids, np.iinfo(np.int64).max])
    sent = mem.sparkSession.sparkContext.broadcast((ids, emb, rows["modality"].to_numpy(), rows["ts"].to_numpy(), start, np.searchsorted(ids, edges["dst"].to_numpy())))

    def run(batches):
        ids, emb, mod, ts, start, dst = sent.value
        for b in batches:
            out = []
            for qid, q, at in zip(b["query_id"], b["q"], b["query_ts"], strict=True):
                if not len(ids):
                    continue
                q = np.asarray(q, np.float64)
                sim = lambda i: emb[i].astype(np.float64) @ q  # noqa: B023, E731
                first = np.unique(seeds(q, cfg.seeds, len(ids)))
                beam = sorted(((-s, i) for s, i in zip(np.atleast_1d(sim(first)), first.tolist(), strict=True)))[:cfg.beam]
                seen, done = set(first.tolist()), set()
                for _ in range(cfg.iterations):
                    todo = [i for _, i in beam if i not in done][:cfg.parents]
                    if not todo:
                        break
                    done.update(todo)
                    new = [i for i in dict.fromkeys(int(x) for t in todo for x in dst[start[t]:start[t + 1]]) if i not in seen]
                    seen.update(new)
                    if new:
                        beam = heapq.nsmallest(cfg.beam, [*beam, *((-s, i) for s, i in zip(np.atleast_1d(sim(np.array(new))), new, strict=True))])
                res = [(-s * np.exp(-cfg.time_decay * max(0.0, at - ts[i])), i) for s, i in beam if cfg.modality_filter is None or mod[i] == cfg.modality_filter]
                for r, (s, i) in enumerate(sorted(res, key=lambda x: (-x[0], ids[x[1]]))[:cfg.top_k]):
                    out.append((qid, r + 1, ids[i], s, mod[i]))
            yield pd.DataFrame(out, columns=["query_id", "rank", "node_id", "score", "modality"])

    return queries.select("query_id", "q", "query_ts").mapInPandas(run, "query_id long, rank int, node_id long, score double, modality int")


def beam_joins(mem: DataFrame, index: DataFrame, queries: DataFrame, cfg: BeamConfig = BeamConfig()) -> DataFrame:
    """The same search, with the same result, for indexes that fit no task: seeds, rounds and parents of each query as in
    beam_search(), by joins. A row of the state is a query with its beam, in order: what a full beam leaves out is worse than all
    that stays and never comes back, so it isn't kept. Links and vectors lie in buckets; a round shuffles the queries with the
    nodes they expand, the pairs these ask for, and the state, which replaces the one before. Nothing passes the driver. It ends
    when no query has an open node in its beam. Nodes without a score, or with NaN, take no part."""
    n, width = mem.agg(F.count("*"), F.max(F.size("embedding"))).first()
    parts = max(mem.sparkSession.sparkContext.defaultParallelism, -(-(n or 0) * max(1, width or 0) // topk.MOST_SENT))
    links = index.groupBy(F.col("node_id").alias("src")).agg(F.collect_list("dst").alias("dst"))
    vectors = mem.select("node_id", half("embedding").alias("embedding") if cfg.half else F.col("embedding"), "modality", "ts")
    name = f"beam_{uuid.uuid4().hex}"
    links, vectors = store(links.repartition(parts, "src"), vectors.repartition(parts, "node_id"), name, f"{scratch_root(mem.sparkSession)}/{name}", parts)
    none = F.array().cast("array<struct<minus:double,node_id:bigint,open:boolean>>")

    def found(pairs: DataFrame) -> DataFrame:
        """query_id and its new nodes, open, with their scores, negative for the order, of pairs query_id, q, node_id."""
        got = exchange.products(pairs.hint("merge").join(vectors.select("node_id", "embedding"), "node_id"), width or 0).where("sim IS NOT NULL AND NOT isnan(sim)")
        return got.groupBy("query_id").agg(F.collect_list(F.struct((F.lit(0.0) - F.col("sim")).alias("minus"), "node_id", F.lit(True).alias("open"))).alias("new"))

    def kept(state: DataFrame, new: DataFrame) -> DataFrame:
        """The state with new nodes, written, and the nodes that are next: the best open ones of each query. A node that was in the
        beam has the same score again, so its rows are neighbours, and an expanded one comes first."""
        state = state.hint("merge").join(new, "query_id", "left").withColumn("new", F.sort_array(F.concat("beam", F.coalesce("new", none))))
        once = F.filter("new", lambda b, i: (i == 0) | (F.get("new", i - 1)["node_id"] != b["node_id"]))
        state = state.select("query_id", "q", "query_ts", F.slice(once, 1, cfg.beam).alias("beam"))
        return materialize(state.withColumn("next", F.slice(F.filter("beam", lambda b: b["open"]), 1, cfg.parents)["node_id"]), "beam")

    q = materialize(queries.select("query_id", "q", "query_ts"), "beam-queries")
    place = F.transform(F.sequence(F.lit(0), F.lit(cfg.seeds - 1)), lambda i: ((F.col("h") + i * 7919) % (1 << 32) % max(1, n)).cast("long"))
    seeds = q.withColumn("h", query_hash(F.col("q"))).select("query_id", "q", F.explode(F.array_distinct(place)).alias("place"))
    first = ranked(mem.select("node_id"), "node_id", "place").join(seeds.hint("merge"), "place").select("query_id", "q", "node_id")
    state = kept(q.select("*", none.alias("beam")), found(first))
    for _ in range(cfg.iterations):
        asked = state.select("query_id", "q", F.explode("next").alias("src"))
        if asked.isEmpty():
            break
        pairs = asked.hint("merge").join(links, "src").select("query_id", "q", F.explode("dst").alias("node_id"))
        expanded = F.transform("beam", lambda b: F.struct(b["minus"].alias("minus"), b["node_id"].alias("node_id"), (b["open"] & ~F.array_contains("next", b["node_id"])).alias("open")))
        old, state = state, kept(state.select("query_id", "q", "query_ts", expanded.alias("beam")), found(pairs))
        forget(old)
    beam = state.select("query_id", "query_ts", F.explode("beam").alias("b")).select("query_id", "query_ts", "b.node_id", (F.lit(0.0) - F.col("b.minus")).alias("score"))
    beam = beam.hint("merge").join(vectors.select("node_id", "modality", "ts"), "node_id")
    if cfg.modality_filter is not None:
        beam = beam.where(F.col("modality") == cfg.modality_filter)
    return best(beam.withColumn("score", decayed(F.col("score"), F.col("query_ts") - F.col("ts"), cfg.time_decay)), cfg.top_k).select("query_id", "rank", "node_id", "score", "modality")
