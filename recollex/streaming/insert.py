"""Memories from streams: insertion into a store, sliding windows, importance and expiry as running state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recollex.operators.maintain import BOOST, FADE, MOST
from recollex.store import MemoryStore


def insert_stream(rows: DataFrame, store: MemoryStore, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes each micro-batch to the store under the batch's id: a batch that runs again replaces itself, and the first
    query after a commit sees its rows. Late rows are insertions with an older time."""

    def put(batch: DataFrame, batch_id: int) -> None:
        store.add(batch, batch_id)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def sliding_counts(rows: DataFrame, length: str = "2 seconds", slide: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Rows a window and modality; at is a timestamp column."""
    return rows.withWatermark("at", late).groupBy(F.window("at", length, slide), "modality").agg(F.count("*").alias("n"), F.approx_count_distinct("node_id").alias("nodes"))


def session_counts(rows: DataFrame, gap: str = "10 seconds", late: str = "10 seconds") -> DataFrame:
    return rows.withWatermark("at", late).groupBy(F.session_window("at", gap), "modality").agg(F.count("*").alias("n"))


def importance_stream(hits: DataFrame) -> DataFrame:
    """node_id, importance after each micro-batch in which a node is retrieved. hits: node_id, step (a rising number of
    rounds); rounds without a hit fade it."""

    def update(key, batches, state):
        weight, step = state.get if state.exists else (1.0, -1)
        for b in batches:
            for s in sorted(set(b["step"])):
                rounds = int(s) - step if step >= 0 else 1
                weight, step = min(weight * (1 - FADE) ** rounds + BOOST, MOST), int(s)
        state.update((weight, step))
        yield pd.DataFrame({"node_id": [key[0]], "importance": [weight]})

    return hits.groupBy("node_id").applyInPandasWithState(update, "node_id long, importance double", "weight double, step long", "update", "NoTimeout")


def expiring(rows: DataFrame, ttl_ms: int, late: str = "10 seconds") -> DataFrame:
    """node_id, expired_at of nodes that weren't seen for ttl_ms of event time. rows: node_id, at."""

    def update(key, batches, state):
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"node_id": [key[0]], "expired_at": [last + ttl_ms]})
            return
        last = state.get[0] if state.exists else 0
        for b in batches:
            last = max(last, int(b["ms"].max()))
        state.update((last,))
        state.setTimeoutTimestamp(max(last + ttl_ms, state.getCurrentWatermarkMs() + 1))

    timed = rows.withWatermark("at", late).select("node_id", "at", F.unix_millis("at").alias("ms"))
    return timed.groupBy("node_id").applyInPandasWithState(update, "node_id long, expired_at long", "last long", "append", "EventTimeTimeout")
