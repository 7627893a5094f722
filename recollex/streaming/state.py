"""Running state of single nodes with transformWithState: values with time to live, timers, and a start from a store; and the
join of two streams. The session needs the RocksDB state store (see ROCKSDB)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from recollex.operators.maintain import BOOST, FADE, MOST

ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Importance(StatefulProcessor):
    """Fades with every round, gains with every round of a hit, up to a most. With a time to live, a node that isn't hit for so
    long starts anew."""

    def __init__(self, ttl_ms: int | None, first_step: int) -> None:
        self.ttl_ms, self.first_step = ttl_ms, first_step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("importance", "weight double, step long", ttlDurationMs=self.ttl_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        self.state.update((float(initialState["importance"].iloc[0]), self.first_step - 1))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        weight, step = self.state.get() if self.state.exists() else (1.0, self.first_step - 1)
        for s in sorted({int(s) for r in rows for s in r["step"]}):
            if s > step:  # a round counts once, however often a hit is sent
                weight, step = min(weight * (1 - FADE) ** (s - step) + BOOST, MOST), s
        self.state.update((weight, step))
        yield pd.DataFrame({"node_id": [key[0]], "step": [step], "importance": [weight]})

    def close(self) -> None:
        pass


def importance(hits: DataFrame, start: DataFrame | None = None, ttl_ms: int | None = None, first_step: int = 0) -> DataFrame:
    """node_id, step, importance after each micro-batch in which a node is hit, equal to maintain.importance_update() round by
    round. hits: node_id, step. start: node_id, importance (one row a node) before first_step; other nodes start at 1."""
    kept = start.groupBy("node_id") if start is not None else None
    return hits.groupBy("node_id").transformWithStateInPandas(Importance(ttl_ms, first_step), "node_id long, step long, importance double", "Update", "ProcessingTime" if ttl_ms else "None", initialState=kept)


class Expiry(StatefulProcessor):
    """A timer a node, moved on whenever the node is seen."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self.last.get()[0] if self.last.exists() else None
        last = max([int(r["ms"].max()) for r in rows if len(r)] + ([before] if before is not None else []))
        if last != before:
            if before is not None:
                self.handle.deleteTimer(before + self.ttl_ms)
            self.handle.registerTimer(last + self.ttl_ms)
            self.last.update((last,))
        yield pd.DataFrame({"node_id": pd.Series([], dtype="int64"), "expired_at": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        yield pd.DataFrame({"node_id": [key[0]], "expired_at": [expiredTimerInfo.getExpiryTimeInMs()]})

    def close(self) -> None:
        pass


def expiring(rows: DataFrame, ttl_ms: int, late: str = "10 seconds") -> DataFrame:
    """node_id, expired_at of nodes that weren't seen for ttl_ms of event time. rows: node_id, at."""
    timed = rows.withWatermark("at", late).select("node_id", "at", F.unix_millis("at").alias("ms"))
    return timed.groupBy("node_id").transformWithStateInPandas(Expiry(ttl_ms), "node_id long, expired_at long", "Append", "EventTime")


def matched(results: DataFrame, detections: DataFrame, within: str = "5 seconds", late: str = "10 seconds", how: str = "inner") -> DataFrame:
    """Results (query_id, node_id, at) with the detections (object_id, seen) of their node at most `within` apart; with how =
    "leftOuter" also results without one, once the watermark says that none can come. Later rows than the watermark are dropped."""
    left, right = results.withWatermark("at", late), detections.withWatermark("seen", late)
    bound = F.expr(f"node_id = object_id AND seen >= at - INTERVAL {within} AND seen <= at + INTERVAL {within}")
    return left.join(right, bound, how).select("query_id", "node_id", "at", "seen")
