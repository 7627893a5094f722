"""Running totals of groups of any size: rows are dealt by ranges of (key, order), tasks add up inside their range, and what a
range starts with is the total of its first key in the ranges before it, one row a range."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollex.functions.lineage import materialize


def _within(values: np.ndarray, first: np.ndarray, group: np.ndarray, carry: int, xor: bool) -> np.ndarray:
    """Running totals that start anew at each index in `first`; carry belongs to the first group."""
    upto = np.bitwise_xor.accumulate(values) if xor else np.cumsum(values)
    before = np.concatenate([[np.int64(carry)], upto[first[1:] - 1]])[group]
    if xor:
        return upto ^ before
    before[group == 0] = -carry
    return upto - before


def running(df: DataFrame, key: str, order: Sequence[Column | str], sums: Sequence[str] = (), xors: Sequence[str] = ()) -> DataFrame:
    """df with `<c>_upto` for each column c of `sums` and `xors` (longs without nulls): the total over the key's rows up to and
    with this one. key is a number or string; order should tell its rows apart, else equal ones come in any order."""
    spark, cols = df.sparkSession, [*sums, *xors]
    df = materialize(df, "running")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order).withColumn("_part", F.spark_partition_id())

    def run(batches):
        last, totals, row = None, dict.fromkeys(cols, 0), 0
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(key)
            keys = np.array(keys.to_pylist(), dtype=object) if keys.null_count else keys.to_numpy(zero_copy_only=False)
            new = np.concatenate([[keys[0] != last], keys[1:] != keys[:-1]])
            if new[0]:
                totals = dict.fromkeys(cols, 0)
            new[0] = True
            first, group = np.flatnonzero(new), np.cumsum(new) - 1
            for c in cols:
                upto = _within(b.column(c).to_numpy(zero_copy_only=False), first, group, totals[c], c in xors)
                totals[c] = int(upto[-1])
                b = b.append_column(f"{c}_upto", pa.array(upto, pa.int64()))
            b = b.append_column("_row", pa.array(np.arange(row, row + b.num_rows), pa.int64()))
            last, row = keys[-1], row + b.num_rows
            yield b

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + "".join(f", `{c}_upto` long" for c in cols) + ", _row long"
    inside = materialize(dealt.mapInArrow(run, schema), "running")
    ends = inside.groupBy("_part").agg(F.min_by(key, "_row").alias("first"), F.max_by(F.struct(key, *[f"{c}_upto" for c in cols]), "_row").alias("last")).orderBy("_part").collect()  # one row a range
    starts, held = [], None
    for e in ends:
        total = {c: e["last"][f"{c}_upto"] for c in cols}
        if held and held[0] == e["first"]:
            starts.append((e["_part"], e["first"], *[held[1][c] for c in cols]))
            if e["last"][key] == e["first"]:
                total = {c: total[c] ^ held[1][c] if c in xors else total[c] + held[1][c] for c in cols}
        held = (e["last"][key], total)
    inside = inside.drop("_row")
    if starts:
        names = [f"_s{i}" for i in range(len(cols))]
        sent = F.broadcast(spark.createDataFrame(starts, f"_p int, _k {dict(df.dtypes)[key]}" + "".join(f", {n} long" for n in names)))
        inside = inside.join(sent, (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")), "left")
        for c, n in zip(cols, names, strict=True):
            start = F.coalesce(n, F.lit(0))
            inside = inside.withColumn(f"{c}_upto", F.col(f"{c}_upto").bitwiseXOR(start) if c in xors else F.col(f"{c}_upto") + start)
        inside = inside.drop("_p", "_k", *names)
    return inside.drop("_part")
