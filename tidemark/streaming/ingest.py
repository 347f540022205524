"""Messages on their way in, on a stream or in a table: identity, normalising, session and vector; and a state of mind per session."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

from tidemark.functions import text


def prepare(messages: DataFrame, bindings: DataFrame, encoder=None) -> DataFrame:
    """message_id, ts, session_id, uid, name, said, [embedding] of (message_id, ts, platform, physical_id, name, group_id, text).

    ``bindings`` (platform, physical_id, uid) is a table; a person without one goes by a name-based identifier of both
    until one is minted. The stream is joined with it batch by batch, so new bindings are seen when they are written.
    """
    known = bindings.select("platform", "physical_id", "uid")
    minted = text.name_uuid(F.concat_ws(":", "platform", "physical_id"))
    rows = messages.join(known, ["platform", "physical_id"], "left").select(
        "message_id", "ts", text.session_id(F.col("platform"), F.col("group_id"), F.col("physical_id")).alias("session_id"),
        F.coalesce("uid", minted).alias("uid"), text.normalize_name(F.col("name")).alias("name"), text.normalize_message(F.col("text")).alias("said"),
    )
    return rows if encoder is None else rows.withColumn("embedding", encoder(F.col("said")))


class SoulProcessor(StatefulProcessor):
    """Per session a number that decays with each turn, takes a push and bends into (-20, 20)."""

    def __init__(self, decay: float):
        self.keep = 1 - decay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("soul", "x double, turns long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        x, turns = self.state.get() if self.state.exists() else (0.0, 0)
        pdf = pd.concat(list(rows)).sort_values(["ts", "message_id"])
        for push in pdf["push"]:
            x, turns = 20 * math.tanh((x * self.keep + push) / 20), turns + 1
        self.state.update((x, turns))
        yield pd.DataFrame({"session_id": [key[0]], "state": [x], "turns": [turns]})

    def close(self) -> None:
        pass


def stream_soul(messages: DataFrame, decay: float = 0.1) -> DataFrame:
    """Streaming: session_id, state, turns after each batch of (session_id, message_id, ts, push)."""
    return messages.groupBy("session_id").transformWithStateInPandas(SoulProcessor(decay), "session_id string, state double, turns long", "update", "none")
