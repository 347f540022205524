"""When a speaker's traits are scored anew: after every ``x`` messages, from the last ``x`` of them; on a stream and in batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

FIRED = "uid string, first_message long, last_message long, context string"


class TraitProcessor(StatefulProcessor):
    """State of a speaker: the messages since the last score, 2 * ``x`` at most. None is kept once they have been told."""

    def __init__(self, x: int):
        self.x = x

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("messages", "message_id long, said string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ts", "message_id"])
        held, out = list(self.state.get()) if self.state.exists() else [], []
        for message, said in zip(pdf["message_id"].tolist(), pdf["said"].tolist()):
            held = [*held[1 - 2 * self.x :], (message, said or "")] if len(held) >= 2 * self.x else [*held, (message, said or "")]
            if len(held) >= self.x:
                last = held[-self.x :]
                out.append((key[0], last[0][0], last[-1][0], "\n".join(s for _, s in last)))
                held = []
        if held:
            self.state.put(held)
        else:
            self.state.clear()
        yield pd.DataFrame(out, columns=["uid", "first_message", "last_message", "context"])

    def close(self) -> None:
        pass


def stream_traits(messages: DataFrame, x: int) -> DataFrame:
    """uid, first_message, last_message, context (texts by line) of (uid, message_id, ts, said), each time ``x`` messages are there."""
    return messages.groupBy("uid").transformWithStateInPandas(TraitProcessor(x), FIRED, "append", "none")


def traits(messages: DataFrame, x: int) -> DataFrame:
    """The same over all messages at once; a speaker's last, incomplete ones tell nothing."""
    n = F.row_number().over(W.partitionBy("uid").orderBy("ts", "message_id"))
    told = messages.withColumn("n", n).groupBy("uid", F.floor((F.col("n") - 1) / x).alias("k")).agg(
        F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list(F.struct("n", "message_id", F.coalesce("said", F.lit("")).alias("said")))).alias("m")
    )
    full = told.filter(F.col("size") == x)
    ends = [F.get("m", F.lit(0))["message_id"].alias("first_message"), F.get("m", F.lit(x - 1))["message_id"].alias("last_message")]
    return full.select("uid", *ends, F.array_join(F.transform("m", lambda r: r["said"]), "\n").alias("context"))
