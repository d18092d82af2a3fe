"""Add rates in a stream: the previous count of every queue is its state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.streaming.keyed import with_state
from tidewire.streaming.runs import WATERMARK, on_disk

RATES = "queue string, time timestamp, messages_added bigint, messages_added_frequency double"


def added_per_window(messages: DataFrame, interval: str = "3 seconds", watermark: str = WATERMARK) -> DataFrame:
    """Messages added per queue and interval; one row per queue and interval that saw any.

    ``seen`` is the event time of the row, the last moment of its interval.
    """
    return (
        on_disk(messages)
        .withWatermark("ts", watermark)
        .groupBy("queue", F.window("ts", interval).alias("w"))
        .agg(F.count(F.lit(1)).alias("added"))
        .select("queue", F.col("w.end").alias("time"), "added", F.window_time("w").alias("seen"))
    )


def _rates(key: tuple, state, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    """Totals and rates of a queue's intervals, going on from its last; 0.0 for the first."""
    total, last = (0, None) if state is None else state
    totals = total + rows["added"].cumsum()
    before = rows["time"].shift()
    if last is not None:
        before.iloc[0] = last
    seconds = (rows["time"] - before).dt.total_seconds()
    rate = (rows["added"] / seconds.where(seconds != 0)).fillna(0.0)
    out = pd.DataFrame(
        {"queue": key[0], "time": rows["time"], "messages_added": totals, "messages_added_frequency": rate}
    )
    return (int(totals.iloc[-1]), rows["time"].iloc[-1].to_pydatetime()), out


def add_rates_stream(added: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """``added_per_window`` to ``queue, time, messages_added, messages_added_frequency``.

    The state of a queue is its total and the time of its last interval. With ``idle_ms`` the state of a
    queue without messages for that long ends; should it come back, it counts from zero.
    """
    return with_state(
        added, ["queue"], _rates, "total bigint, last timestamp", RATES, order=["time"], time="seen", idle_ms=idle_ms
    )
