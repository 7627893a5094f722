"""The prefix trie of conversations, with totals of every subtree by leaf-peeling message passing.

A node is a distinct sequence of first turns; its key is its depth and two 64-bit sums (exclusive or) over the hashes of
its turns with their places, so keys are running totals, which need no conversation as a whole in one task. Nodes are tied to
paths: the path of a node is that of its longest member. Along a path totals are running sums from its end, so messages only
go between paths: each holds a counter of the paths that hang on it; those with none left send their totals to the path that
they hang on, round by round, until only the root's is left. Paths keep rounds few: conversations of hundreds of turns that
only one conversation goes through are one step.

Defined cases: rows with null conv_id are left out; null turns come first, equal ones go by a hash of role and text; null role
and text are empty; repeated rows are turns of their own; texts and conversations of any length; an empty table has no rows,
not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollex.operators.prefix import running

from .common import materialize

#: Turns of one conversation that meet its row in one task.
CHUNK = 1000
#: A parent with more than this share of all nodes as children is sent to all tasks; there are fewer than HOT_PARTS.
HOT_PARTS, HOT_LEAST = 1024, 128
#: Characters of a block of ids on their way to the digest.
BLOCK = 1 << 16
SHARED, GROUP = 4, 20
NODE = ["depth", "xa", "xb"]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, ord (from 1), ta, tb (hashes of role and text), words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("ta"), F.xxhash64(F.lit(2), text, role).alias("tb"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), F.lit(1).cast("long").alias("ord"),
    )
    return running(rows, "conv_id", [F.asc_nulls_first("turn"), F.col("ta"), F.col("tb")], sums=["ord"]).select("conv_id", F.col("ord_upto").alias("ord"), "ta", "tb", "words")


def rebuilt(own: DataFrame) -> DataFrame:
    """conv_id, depth, a, b, words, len of turns() with each conversation's first turns taken from the first of its group of
    20, and a row of depth 0 for each conversation; a and b are hashes of the turn and its place."""
    c = own.groupBy("conv_id").agg(F.max("ord").alias("n")).withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED, "base": F.col("conv_id") - F.col("conv_id") % GROUP})
    of_base = c.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    c = c.join(of_base, "base", "left").withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0))))
    c = materialize(c.select("conv_id", "base", "n", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "trie-convs")
    root = c.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("ta"), F.lit(None).cast("long").alias("tb"), F.lit(0).cast("long").alias("words"), "len")
    heads = own.where((F.col("ord") < SHARED) & (F.col("conv_id") % GROUP == 0)).withColumnRenamed("conv_id", "base")
    first = c.where("k > 0").join(heads, "base").where("ord <= k").select("conv_id", F.col("ord").alias("depth"), "ta", "tb", "words", "len")
    # A conversation's row meets its turns chunk by chunk.
    by_chunk = c.where("n > h").select("conv_id", "h", "k", "len", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))).alias("chunk"))
    rest = own.withColumn("chunk", F.floor((F.col("ord") - 1) / CHUNK)).join(by_chunk, ["conv_id", "chunk"]).where("ord > h")
    rest = rest.select("conv_id", (F.col("ord") - F.col("h") + F.col("k")).alias("depth"), "ta", "tb", "words", "len")
    every = root.unionByName(first).unionByName(rest)
    none = F.lit(0).cast("long")
    return every.select("conv_id", "depth", F.when(F.col("depth") > 0, F.xxhash64("depth", "ta", "tb")).otherwise(none).alias("a"), F.when(F.col("depth") > 0, F.xxhash64("tb", "ta", "depth")).otherwise(none).alias("b"), "words", "len")


def _with_parents(nodes: DataFrame) -> DataFrame:
    """nodes with n_children, and conv_id and path of their parents."""
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("xa"), F.col("pb").alias("xb")).agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(kids, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-nodes")
    above = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("xa").alias("pa"), F.col("xb").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.col("path").alias("parent_path"), "n_children")
    hot = max(HOT_LEAST, nodes.count() // HOT_PARTS)
    hubs = above.where(F.col("n_children") > hot).drop("n_children").collect()
    on, below = ["depth", "pa", "pb"], nodes
    found = below.join(above.where(F.col("n_children") <= hot).drop("n_children"), on, "left")
    if hubs:
        sent = F.broadcast(nodes.sparkSession.createDataFrame(hubs, "depth long, pa long, pb long, parent_conv_id long, parent_path long"))
        found = below.join(sent, on, "left_anti").join(above.where(F.col("n_children") <= hot).drop("n_children"), on, "left").unionByName(below.join(sent, on))
    return materialize(found, "trie-nodes")


def peel(paths: DataFrame) -> DataFrame:
    """paths: path, parent_path (null for the root's), at (the depth where it hangs on its parent), remaining (paths that hang on
    it), leaves, saved of its own. Returns them with the totals of all that hangs on them."""
    waiting, done = materialize(paths, "trie-peel"), []
    while True:
        done.append(waiting.where("remaining = 0"))
        rest = waiting.where("remaining > 0")
        if rest.isEmpty():
            break
        sent = done[-1].where("parent_path is not null").groupBy(F.col("parent_path").alias("to")).agg(F.count("*").alias("n"), F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        zero = F.lit(0).cast("long")
        now = rest.join(sent, rest["path"] == sent["to"], "left").select(
            "path", "parent_path", "at", (F.col("remaining") - F.coalesce("n", zero)).alias("remaining"), (F.col("leaves") + F.coalesce("l", zero)).alias("leaves"), (F.col("saved") + F.coalesce("s", zero)).alias("saved"),
        )
        waiting = materialize(now, "trie-peel")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def ends_digest(ends: DataFrame) -> DataFrame:
    """depth, xa, xb, ends_sha256, n_ends of ends (depth, xa, xb, conv_id): SHA-256 of a node's ids in rising order. Ranges join
    their ids to blocks of text; the blocks of a node then run through one digest, as SHA-256 can only be made in order."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = materialize(ends, "trie-ends").repartitionByRange(parts, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    keys = [(n, pa.int64()) for n in NODE]
    blocks, digests = pa.schema([*keys, ("conv_id", pa.int64()), ("ids", pa.string()), ("n", pa.int64())]), pa.schema([*keys, ("ends_sha256", pa.string()), ("n_ends", pa.int64())])

    def join(batches):
        for b in batches:
            if not b.num_rows:
                continue
            at = [b.column(n).to_numpy(zero_copy_only=False) for n in NODE]
            ids = b.column("conv_id").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in at], axis=0)]))
            starts = [s for low, high in zip(cuts, [*cuts[1:], len(ids)], strict=True) for s in range(low, high, BLOCK // 20)]
            yield pa.RecordBatch.from_arrays([
                *[pa.array(x[starts]) for x in at], pa.array(ids[starts]),
                pa.array([",".join(map(str, ids[s:e].tolist())) for s, e in zip(starts, [*starts[1:], len(ids)], strict=True)]), pa.array(np.diff([*starts, len(ids)])),
            ], schema=blocks)

    def run(batches):
        held, sha, n = None, None, 0
        for b in batches:
            out = []
            for d, x, y, ids, m in zip(*(b.column(c).to_pylist() for c in (*NODE, "ids", "n")), strict=True):
                if held != (d, x, y):
                    if held is not None:
                        out.append((*held, sha.hexdigest(), n))
                    held, sha, n = (d, x, y), hashlib.sha256(ids.encode()), m
                else:
                    sha.update(b"," + ids.encode())
                    n += m
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema=digests) if out else pa.RecordBatch.from_pylist([], digests)
        if held is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(digests.names, (*held, sha.hexdigest(), n), strict=True))], digests)

    joined = ends.mapInArrow(join, "depth long, xa long, xb long, conv_id long, ids string, n long")
    return joined.repartition(parts, *NODE).sortWithinPartitions(*NODE, "conv_id").mapInArrow(run, "depth long, xa long, xb long, ends_sha256 string, n_ends long")


def build(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, n_ends. conv_id and depth name the turn that a node adds."""
    seen = running(rebuilt(turns(conversations)), "conv_id", ["depth"], xors=["a", "b"]).withColumnsRenamed({"a_upto": "xa", "b_upto": "xb"})
    longest = F.max(F.struct("len", (-F.col("conv_id")).alias("minus"))).alias("longest")
    nodes = seen.groupBy(*NODE).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), longest, F.min("words").alias("words"), F.min("a").alias("a"), F.min("b").alias("b"))
    own = ((F.col("n_convs") - 1) * F.col("words")).alias("saved")
    nodes = _with_parents(nodes.select(*NODE, F.col("xa").bitwiseXOR(F.col("a")).alias("pa"), F.col("xb").bitwiseXOR(F.col("b")).alias("pb"), "n_convs", "conv_id", (-F.col("longest.minus")).alias("path"), (F.col("longest.len") == F.col("depth")).alias("last"), own))
    tops = nodes.where(F.col("parent_path").isNull() | (F.col("parent_path") != F.col("path"))).select("path", "parent_path", (F.col("depth") - 1).alias("at"))
    hanging = tops.groupBy(F.col("parent_path").alias("path")).agg(F.count("*").alias("remaining"))
    paths = tops.join(nodes.groupBy("path").agg(F.sum("saved").alias("saved")), "path").join(hanging, "path", "left")
    done = peel(paths.select("path", "parent_path", "at", F.coalesce("remaining", F.lit(0).cast("long")).alias("remaining"), F.lit(1).cast("long").alias("leaves"), "saved"))
    arrived = done.where("parent_path is not null").groupBy(F.col("parent_path").alias("path"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    zero = F.lit(0).cast("long")
    with_own = nodes.join(arrived, ["path", "depth"], "left").select(
        *NODE, "path", "conv_id", "parent_conv_id", "n_convs", "n_children", (F.coalesce("l", zero) + F.col("last").cast("long")).alias("leaves"), (F.coalesce("s", zero) + F.col("saved")).alias("saved"),
    )
    totals = running(with_own, "path", [F.desc("depth")], sums=["leaves", "saved"])
    ends = ends_digest(seen.where("depth = len").select(*NODE, "conv_id"))
    return totals.join(ends, NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves_upto").alias("n_leaves"), F.col("saved_upto").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), F.coalesce("n_ends", zero).alias("n_ends"),
    )
