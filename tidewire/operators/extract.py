"""Messages to time-series points by declared rules."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.filters import MessageFilter
from tidewire.functions.jsonpath import JsonBody
from tidewire.functions.keyvalue import KeyValue, merge_maps, numeric_fields, text_fields
from tidewire.functions.text import Template, strip_backslashes
from tidewire.functions.times import TimeRule


@dataclass(frozen=True)
class PointRule:
    """What to extract from the messages that pass ``filter``.

    ``filter``: ``<address regex>|<json path>|AND or OR``; ``bucket`` and ``measurement``: templates;
    ``tags`` and ``fields``: key/value expressions; ``time``: a time expression, else the message time.
    """

    filter: str
    bucket: str
    measurement: str
    tags: Sequence[str] = ()
    fields: Sequence[str] = ()
    time: str | None = None

    @classmethod
    def from_config(cls, entry: dict) -> "PointRule":
        """Read the configuration keys ``filterExpression``, ``bucketExpression`` and so on."""
        return cls(
            filter=entry["filterExpression"],
            bucket=entry["bucketExpression"],
            measurement=entry["measurementExpression"],
            tags=tuple(entry.get("tagExpressions") or ()),
            fields=tuple(entry.get("fieldExpressions") or ()),
            time=entry.get("dateTimeExpression"),
        )


class _Compiled:
    """A rule parsed on the driver, with the paths it needs registered."""

    def __init__(self, number: int, rule: PointRule, body: JsonBody):
        self.number = number
        self.filter = MessageFilter.parse(rule.filter)
        self.bucket = Template.parse(rule.bucket)
        self.measurement = Template.parse(rule.measurement)
        self.tags = [KeyValue.parse(e) for e in rule.tags]
        self.fields = [KeyValue.parse(e) for e in rule.fields]
        self.time = TimeRule.parse(rule.time) if rule.time else None
        self.body = body
        paths = [self.filter.path, *self.bucket.paths(), *self.measurement.paths()]
        if self.time:
            paths.append(self.time.path)
        for path in paths:
            body.need(path)
        for kv in (*self.tags, *self.fields):
            kv.register(body)

    def _text_name(self, part: str, at: int) -> str:
        return f"__{part}_{self.number}_{at}"

    def address_texts(self, address: Column) -> dict[str, Column]:
        """Columns for what tags and fields read from the address, so that each is formed once."""
        return {
            self._text_name(part, at): kv.address_text(address)
            for part, kvs in (("tag", self.tags), ("field", self.fields))
            for at, kv in enumerate(kvs)
            if kv.kind == "address"
        }

    def _maps(self, part: str, kvs: list[KeyValue]) -> Column:
        return merge_maps(
            [
                kv.column(self.body, F.col(self._text_name(part, at)) if kv.kind == "address" else None)
                for at, kv in enumerate(kvs)
            ]
        )

    def point(self, address: Column, keep: Sequence[str]) -> Column:
        """The point as a struct; null when the message does not pass the filter."""
        return F.when(
            self.filter.column(address, self.body),
            F.struct(
                *[F.col(name) for name in keep],
                F.lit(self.number).alias("rule"),
                self.bucket.column(address, self.body).alias("bucket"),
                self.measurement.column(address, self.body).alias("measurement"),
                self._maps("tag", self.tags).alias("tags"),
                self._maps("field", self.fields).alias("fields"),
                (self.time.column(self.body) if self.time else F.col("ts")).alias("time"),
            ),
        )


def try_extract_points(
    messages: DataFrame, rules: Sequence[PointRule], keep: Sequence[str] = ("message_id",)
) -> DataFrame:
    """One row per message and rule whose filter passes, with ``error`` where a part failed.

    The input is read once and each body is parsed once, whatever the number of rules; messages that
    no rule can want by their address are dropped before parsing. A failure costs only its own point.
    """
    body = JsonBody()
    compiled = [_Compiled(number, rule, body) for number, rule in enumerate(rules)]
    address = F.col("__address")
    wanted = functools.reduce(lambda a, b: a | b, [rule.filter.possible(address) for rule in compiled])
    texts: dict[str, Column] = {}
    for rule in compiled:
        texts |= rule.address_texts(address)
    candidates = messages.withColumn("__address", strip_backslashes(F.col("address"))).filter(wanted)
    prepared = body.attach(candidates).withColumns(texts) if texts else body.attach(candidates)
    # the points are formed in a projection, which is compiled; the generator only lists them
    points = [rule.point(address, keep).alias(f"__point_{rule.number}") for rule in compiled]
    listed = F.array(*[F.col(f"__point_{rule.number}") for rule in compiled])
    made = (
        prepared.select(*points)
        .select(F.explode(listed).alias("point"))
        .filter(F.col("point").isNotNull())
        .select("point.*")
    )
    parts = ("bucket", "measurement", "tags", "fields", "time")
    error = F.coalesce(*[F.when(F.col(part).isNull(), F.lit(part)) for part in parts])
    return made.select(
        *keep,
        "rule",
        "bucket",
        "measurement",
        "tags",
        numeric_fields(F.col("fields")).alias("fields_num"),
        text_fields(F.col("fields")).alias("fields_str"),
        "time",
        error.alias("error"),
    )


def extract_points(
    messages: DataFrame, rules: Sequence[PointRule], keep: Sequence[str] = ("message_id",)
) -> DataFrame:
    """The points that could be extracted completely."""
    return try_extract_points(messages, rules, keep).filter(F.col("error").isNull()).drop("error")


def rejected_points(
    messages: DataFrame, rules: Sequence[PointRule], keep: Sequence[str] = ("message_id",)
) -> DataFrame:
    """Which part failed, per message and rule."""
    failed = try_extract_points(messages, rules, keep).filter(F.col("error").isNotNull())
    return failed.select(*keep, "rule", "error")
