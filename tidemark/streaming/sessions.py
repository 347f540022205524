"""Sessions of chat with all close rules, as one step function for batch and for Structured Streaming.

A window closes before the incoming message is added, by the first rule that holds: too long a gap (strictly), too many
messages, too long a duration, too many rounds, the limit without an encoder, or the drift flag that an earlier message
set. Drift is measured every fifth message from the twentieth on, against the centroid that includes the message, and
takes effect on the next one.

Streaming state per session is a counter, two times and a centroid; idle sessions close by an event-time timer and are
always emitted. Rows later than the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

#: Messages that go through the rules together, but for a longer stretch without a gap.
PART = 10_000
WINDOW = "session_id string, first_message long, last_message long, started timestamp, ended timestamp, messages long, close_reason string"


@dataclass(frozen=True)
class Rules:
    gap_s: float = 1800.0
    duration_s: float = 3600.0
    max_messages: int = 50
    rounds: int = 60
    no_encoder: int = 50
    drift: float = 0.6
    drift_from: int = 20
    drift_every: int = 5


@dataclass
class Window:
    count: int = 0
    first: int = 0
    last: int = 0
    started: float = 0.0
    ended: float = 0.0
    drifted: bool = False
    centroid: list[float] = field(default_factory=list)


def close_reason(w: Window, now: float, rules: Rules, has_vector: bool) -> str | None:
    if not w.count:
        return None
    if now - w.ended > rules.gap_s:
        return "gap"
    if w.count >= max(50, 2 * rules.max_messages):
        return "count"
    if now - w.started >= rules.duration_s:
        return "duration"
    if w.count >= 2 * rules.rounds:
        return "rounds"
    if not has_vector and w.count >= rules.no_encoder:
        return "no_encoder"
    return "drift" if w.drifted else None


def add(w: Window, message: int, now: float, vector, rules: Rules) -> None:
    if not w.count:
        w.first, w.started = message, now
    w.count, w.last, w.ended = w.count + 1, message, now
    if vector is None or not len(vector):
        return
    n = w.count
    w.centroid = [c + (x - c) / n for c, x in zip(w.centroid or [0.0] * len(vector), vector)]
    if n >= rules.drift_from and (n - rules.drift_from) % rules.drift_every == 0:
        dot = sum(a * b for a, b in zip(w.centroid, vector))
        norm = (sum(a * a for a in w.centroid) * sum(b * b for b in vector)) ** 0.5
        w.drifted = 1 - (dot / norm if norm else 0.0) > rules.drift


def step(w: Window, message: int, now: float, vector, rules: Rules) -> tuple[Window, tuple | None]:
    """The window after the message, and the window that closed before it."""
    reason = close_reason(w, now, rules, vector is not None)
    closed = None
    if reason:
        closed, w = told(w, reason), Window()
    add(w, message, now, vector, rules)
    return w, closed


def told(w: Window, reason: str) -> tuple:
    return w.first, w.last, w.started, w.ended, w.count, reason


def _frame(session: str, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["first_message", "last_message", "started", "ended", "messages", "close_reason"])
    for c in ("started", "ended"):
        out[c] = pd.to_datetime((out[c].astype(float) * 1e6).round().astype("int64"), unit="us")
    out.insert(0, "session_id", session)
    return out


def _seconds(ts) -> float:
    return pd.Timestamp(ts).timestamp()


def close_windows(messages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Batch: all windows of (session_id, message_id, ts, [embedding]).

    A gap that is too long closes a window whatever came before, so a session is cut at those first; whole stretches between
    gaps, some thousand messages, meet in one task, in time order, with ids, times and vectors only. One sort places them all.
    """
    columns = [c for c in ("session_id", "message_id", "ts", "embedding") if c in messages.columns]
    order = W.partitionBy("session_id").orderBy("ts", "message_id")
    gap = F.col("ts") - F.lag("ts").over(order) > F.expr(f"INTERVAL {rules.gap_s} SECONDS")
    placed = messages.select(*columns, F.row_number().over(order).alias("position"), F.coalesce(gap, F.lit(True)).alias("fresh"), F.lead("ts").over(order).isNull().alias("last"))
    first = F.max(F.when(F.col("fresh"), F.col("position"))).over(order.rowsBetween(W.unboundedPreceding, 0))
    cut = placed.withColumn("part", F.floor((first - 1) / PART)).drop("fresh")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        ids, vectors = table.column("message_id").to_pylist(), table.column("embedding").to_pylist() if "embedding" in table.column_names else [None] * len(table)
        stamps = table.column("ts").cast(pa.timestamp("us")).cast(pa.int64()).to_numpy()
        w, rows = Window(), []
        for message, now, vector in zip(ids, (stamps / 1e6).tolist(), vectors):
            w, closed = step(w, message, now, vector, rules)
            rows += [closed] if closed else []
        rows.append(told(w, "end" if table.column("last")[-1].as_py() else "gap"))
        first, last, started, ended, n, reason = zip(*rows)
        stamp = lambda x: pa.array(np.round(np.array(x) * 1e6).astype(np.int64)).cast(pa.timestamp("us"))
        session = pa.array([table.column("session_id")[0].as_py()] * len(rows), pa.string())
        return pa.table([session, pa.array(first, pa.int64()), pa.array(last, pa.int64()), stamp(started), stamp(ended), pa.array(n, pa.int64()), pa.array(reason)], names=[x.split()[0] for x in WINDOW.split(", ")])

    return cut.groupBy("session_id", "part").applyInArrow(run, WINDOW.replace("timestamp", "timestamp_ntz"))


class SessionProcessor(StatefulProcessor):
    """The same step per session on a stream."""

    def __init__(self, rules: Rules = Rules(), idle_s: float = 3600.0):
        self.rules, self.idle_ms = rules, int(idle_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "window", "count long, first long, last long, started double, ended double, drifted boolean, centroid array<double>"
        )

    def _get(self) -> Window:
        return Window(*self.state.get()) if self.state.exists() else Window()

    def _timer(self, w: Window) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(w.ended * 1000) + self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ts", "message_id"])
        vectors = pdf["embedding"] if "embedding" in pdf else [None] * len(pdf)
        w = self._get()
        if w.centroid is None:
            w.centroid = []
        out = []
        for message, ts, vector in zip(pdf["message_id"], pdf["ts"], vectors):
            w, closed = step(w, int(message), _seconds(ts), vector, self.rules)
            out += [closed] if closed else []
        self.state.update((w.count, w.first, w.last, w.started, w.ended, w.drifted, [float(x) for x in w.centroid]))
        self._timer(w)
        yield _frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        w = self._get()
        self.state.clear()
        yield _frame(key[0], [told(w, "idle")] if w.count else [])

    def close(self) -> None:
        pass


def stream_windows(messages: DataFrame, rules: Rules = Rules(), idle_s: float = 3600.0, late: str = "1 hour") -> DataFrame:
    """Streaming: windows of (session_id, message_id, ts timestamp, [embedding]) as they close."""
    return (
        messages.withWatermark("ts", late)
        .groupBy("session_id")
        .transformWithStateInPandas(SessionProcessor(rules, idle_s), WINDOW, "append", "EventTime")
    )


def flush(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The windows that a stopped stream of ``stream_windows`` left open, read from its state, closed with the reason ``end``."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "window").load()
    open_ = state.filter("value.count > 0")
    at = lambda c: F.timestamp_micros(F.round(F.col(f"value.{c}") * 1_000_000).cast("long")).alias(c)
    return open_.select(
        F.col("key.session_id"), F.col("value.first").alias("first_message"), F.col("value.last").alias("last_message"), at("started"), at("ended"),
        F.col("value.count").alias("messages"), F.lit("end").alias("close_reason"),
    )
