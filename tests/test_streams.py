"""State over streams, by value: each file of a folder is one micro-batch."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from recollex.operators.maintain import BOOST, FADE, MOST
from recollex.sources.reports import result_lines
from recollex.streaming import insert

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def run(spark, tmp_path, schema, batches, make, mode):
    """Rows that a streaming query gives for each of the batches, written one file after the other."""
    folder, out = str(tmp_path / "in"), []
    spark.createDataFrame([], schema).write.mode("append").parquet(folder)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    sink = lambda df, i: out.append([tuple(r) for r in df.collect()])
    query = make(rows).writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", str(tmp_path / "offsets")).start()
    try:
        for b in batches:
            spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(folder)
            query.processAllAvailable()
    finally:
        query.stop()
    return [r for rows in out for r in rows]


def test_importance(spark, tmp_path):
    got = run(spark, tmp_path, "node_id long, step long", [[(1, 0), (2, 0), (1, 0)], [(1, 3)], [(1, s) for s in range(4, 80)]], insert.importance_stream, "update")
    first = (1 - FADE) + BOOST
    ones = [w for n, w in got if n == 1]
    assert [w for n, w in got if n == 2] == pytest.approx([first])
    assert ones[:2] == pytest.approx([first, first * (1 - FADE) ** 3 + BOOST]) and ones[2] == MOST


def test_expiring(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    batches = [[(1, at(0)), (2, at(0))], [(2, at(20))], [(3, at(60))], [(3, at(61))]]
    got = run(spark, tmp_path, "node_id long, at timestamp", batches, lambda rows: insert.expiring(rows, 15_000), "append")
    zero = int(START.timestamp() * 1000)
    # Node 1 was last seen at 0 and node 2 at 20 seconds; node 3 is still there.
    assert sorted(got) == [(1, zero + 15_000), (2, zero + 35_000)]


def test_sessions_and_windows_with_late_rows(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    schema = "node_id long, modality int, at timestamp"
    batches = [[(1, 0, at(0)), (2, 0, at(6)), (3, 1, at(1))], [(4, 0, at(40))], [(5, 0, at(2)), (6, 0, at(100))], [(7, 0, at(101))]]
    keep = lambda df, w: df.select(F.unix_timestamp(f"{w}.start").alias("s"), F.unix_timestamp(f"{w}.end").alias("e"), "modality", "n")
    zero = int(START.timestamp())
    got = run(spark, tmp_path / "a", schema, batches, lambda rows: keep(insert.session_counts(rows), "session_window"), "append")
    # The row at 2 seconds comes when the watermark is at 30: it is late, and its session closed without it.
    assert sorted((s - zero, e - zero, m, n) for s, e, m, n in got) == [(0, 16, 0, 2), (1, 11, 1, 1), (40, 50, 0, 1)]
    got = run(spark, tmp_path / "b", schema, batches, lambda rows: keep(insert.sliding_counts(rows, "10 seconds", "10 seconds"), "window"), "append")
    assert sorted((s - zero, e - zero, m, n) for s, e, m, n in got) == [(0, 10, 0, 2), (0, 10, 1, 1), (40, 50, 0, 1)]


def test_answer_lines(spark):
    rows = spark.createDataFrame([(4, 2, 9, 0.25, 1, 1), (4, 1, 7, 0.5000004, 0, 0), (5, 1, 8, -1.0, 2, 0)], "query_id long, rank int, node_id long, score double, modality int, hops int")
    assert {r[0]: r[1] for r in result_lines(rows).collect()} == {
        4: '{"results":[{"id":7,"score":0.5,"modality":0,"hops":0},{"id":9,"score":0.25,"modality":1,"hops":1}]}',
        5: '{"results":[{"id":8,"score":-1.0,"modality":2,"hops":0}]}',
    }
