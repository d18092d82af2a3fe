"""Functions with a state per key in a stream, kept in the state store and ended by timers.

``with_state`` runs a user function on the rows of each key as they come in. The state is one row per key. It
lasts until the watermark has passed the key's newest row by ``idle``; then a timer removes it. Python sees
the rows of a key in Arrow batches; what can be reduced before should be.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from tidewire.streaming.runs import on_disk

# key, state (None at first) and rows in order to the new state (None: no more) and output rows
Function = Callable[[tuple, Any, pd.DataFrame], tuple[Any, pd.DataFrame]]


# state to the event time, in milliseconds, at which to wake up; None: not at all
Alarm = Callable[[tuple], int | None]
# key and state to the new state and output rows
OnAlarm = Callable[[tuple, tuple], tuple[Any, pd.DataFrame]]


class KeyedFunction(StatefulProcessor):
    """Runs a function per key; see ``with_state``."""

    def __init__(self, function: Function, state: str, order, time, idle_ms, alarm, on_alarm) -> None:
        self.function, self.schema = function, state
        self.order, self.time, self.idle_ms = list(order), time, idle_ms
        self.alarm, self.on_alarm = alarm, on_alarm

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)
        if self.idle_ms is not None:
            self.ends = handle.getValueState("ends", "ms bigint")

    def keep(self, new, timerValues, newest: int | None) -> None:  # noqa: N803
        """Store the new state and set the timers that belong to it; the watermark is before them."""
        soon = timerValues.getCurrentWatermarkInMs() + 1 if self.timed() else 0
        wanted = set()
        if new is None:
            self.state.clear()
            if self.idle_ms is not None:
                self.ends.clear()
        else:
            self.state.update(tuple(new))
            if self.idle_ms is not None:
                ends = self.ends.get()[0] if self.ends.exists() else soon
                if newest is not None:
                    ends = max(ends, newest + self.idle_ms, soon)
                    self.ends.update((ends,))
                wanted.add(ends)
            wakes = self.alarm(tuple(new)) if self.alarm else None
            if wakes is not None:
                wanted.add(max(wakes, soon))
        if self.timed():
            pending = set(self.handle.listTimers())
            for timer in pending - wanted:
                self.handle.deleteTimer(timer)
            for timer in wanted - pending:
                self.handle.registerTimer(timer)

    def timed(self) -> bool:
        return self.idle_ms is not None or self.alarm is not None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows), ignore_index=True)
        if self.order:
            frame = frame.sort_values(self.order, kind="stable", ignore_index=True)
        old = tuple(self.state.get()) if self.state.exists() else None
        new, out = self.function(key, old, frame)
        newest = int(frame[self.time].max().timestamp() * 1000) if self.timed() else None
        self.keep(new, timerValues, newest)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.state.exists():
            return
        state, now = tuple(self.state.get()), expiredTimerInfo.getExpiryTimeInMs()
        wakes = self.alarm(state) if self.alarm else None
        if wakes is not None and wakes <= now:
            state, out = self.on_alarm(key, state)
            yield out
        if self.idle_ms is not None and self.ends.get()[0] <= now:
            state = None
        self.keep(state, timerValues, None)

    def close(self) -> None:
        pass


def with_state(
    df: DataFrame,
    keys: Sequence[str],
    function: Function,
    state: str,
    output: str,
    *,
    order: Sequence[str] = (),
    time: str = "ts",
    idle_ms: int | None = None,
    alarm: Alarm | None = None,
    on_alarm: OnAlarm | None = None,
    mode: str = "append",
) -> DataFrame:
    """The rows ``function`` gives out, in the schema ``output``.

    ``state`` is the schema of the state. Rows of one micro-batch are sorted by ``order`` within their key;
    micro-batches come in the order of the source. With ``idle_ms`` or ``alarm``, ``df`` must have a
    watermark on ``time``. With ``idle_ms``, rows of a key that come after its state has ended begin anew. When the
    watermark passes the time ``alarm`` gives for a state, ``on_alarm`` is called; it should change the
    state so that the alarm does not come again.
    """
    processor = KeyedFunction(function, state, order, time, idle_ms, alarm, on_alarm)
    return (
        on_disk(df)
        .groupBy(*keys)
        .transformWithStateInPandas(
            statefulProcessor=processor,
            outputStructType=output,
            outputMode=mode,
            timeMode="EventTime" if processor.timed() else "None",
        )
    )
