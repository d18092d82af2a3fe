"""Time expressions ``BODY|<path>|TIMESTAMP`` and ``BODY|<path>|<date pattern>``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.jsonpath import JsonBody, JsonPath, parse_path

# The format of a time expression and the word for epoch milliseconds.
TIME_FORMAT = re.compile(r"^BODY\|(.+)\|(.+)$")
EPOCH = "TIMESTAMP"


# The largest number of milliseconds whose microseconds a timestamp can hold.
LAST_MS = (2**63 - 1) // 1000


def from_epoch(text: Column) -> Column:
    """Epoch milliseconds, as a number or as text; null when it is neither, or beyond what a
    timestamp can hold."""
    ms = F.when(text.rlike(r"\A[+-]?\d+\z"), text.try_cast("bigint"))
    return F.timestamp_millis(F.when(ms.between(-LAST_MS, LAST_MS), ms))


def from_pattern(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern))


@dataclass(frozen=True)
class TimeRule:
    path: JsonPath
    pattern: str

    @classmethod
    def parse(cls, expression: str) -> "TimeRule":
        found = TIME_FORMAT.match(expression)
        if not found:
            raise ValueError(f"not a time expression: {expression}")
        return cls(parse_path(found[1]), found[2])

    def column(self, body: JsonBody) -> Column:
        text = body.value(self.path)
        return from_epoch(text) if self.pattern == EPOCH else from_pattern(text, self.pattern)


def millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def floor_div(value: Column, by: int) -> Column:
    """Whole division that rounds down, for negative values too, without going through doubles."""
    return F.call_function("div", value - F.pmod(value, F.lit(by)), F.lit(by))


def ceil_div(value: Column, by: int) -> Column:
    return floor_div(value + F.lit(by - 1), by)
