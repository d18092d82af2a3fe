"""Key/value expressions that give tags and fields as ``map<string,string>``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.jsonpath import JsonBody, JsonPath, is_object, parse_path
from tidewire.functions.text import regex_transform

# The formats of key/value expressions.
FULL_FORMAT = re.compile(r"^BODY\|(.+)\|([^\|].*)\|(.*)$")
LITE_FORMAT = re.compile(r"^BODY\|(.+)\|(.+)$")
ADDRESS_FORMAT = re.compile(r"^ADDRESS\|(.+)\|(.+)")

MAP = "map<string,string>"


def empty_map() -> Column:
    return F.create_map().cast(MAP)


@dataclass(frozen=True)
class KeyValue:
    """One parsed expression; its column is a null map where the extraction fails."""

    kind: str
    key: str | JsonPath
    value: str | JsonPath | None = None

    @classmethod
    def parse(cls, expression: str) -> "KeyValue":
        if found := ADDRESS_FORMAT.match(expression):
            return cls("address", found[1], found[2])
        if found := FULL_FORMAT.match(expression):
            return cls("full", _side(found[1], found[2]), _side(found[1], found[3]))
        if found := LITE_FORMAT.match(expression):
            path = _side(found[1], found[2])
            if isinstance(path, str):
                raise ValueError(f"the last part must be a JSON path: {expression}")
            return cls("lite", path)
        raise ValueError(f"not a key/value expression: {expression}")

    def register(self, body: JsonBody) -> None:
        """Tell the body what this expression reads."""
        if self.kind == "address":
            return
        for side in (self.key, self.value):
            if isinstance(side, JsonPath):
                body.need_map(side) if self.kind == "lite" and side.definite else body.need(side)

    def address_text(self, address: Column) -> Column:
        """``key:value`` as read from an address; colons at the end do not count."""
        return F.rtrim(regex_transform(address, self.key, self.value), F.lit(":"))

    def column(self, body: JsonBody, address_text: Column | None = None) -> Column:
        if self.kind == "address":
            return split_pair(address_text)
        if self.kind == "lite":
            return _merged_objects(self.key, body)
        return _pairs(self.key, self.value, body)


def _side(context: str, text: str) -> str | JsonPath:
    if not text.startswith("$"):
        return text
    path = parse_path(text)
    return path if context == "$" else path.below(parse_path(context))


def split_pair(text: Column) -> Column:
    """``key:value`` as a map; null unless there is exactly one colon."""
    key, value = F.substring_index(text, ":", 1), F.substring_index(text, ":", -1)
    return F.when(text.rlike(r"\A[^:]*:[^:]*\z"), F.create_map(key, value))


def _no_nulls(values: Column) -> Column:
    return F.when(~F.exists(values, lambda v: v.isNull()), values)


def _pairs(key: str | JsonPath, value: str | JsonPath, body: JsonBody) -> Column:
    key_is_path, value_is_path = isinstance(key, JsonPath), isinstance(value, JsonPath)
    if not key_is_path and not value_is_path:
        return F.create_map(F.lit(key), F.lit(value))

    one_key = not key_is_path or key.definite
    one_value = not value_is_path or value.definite
    if one_key and one_value:
        k = body.value(key) if key_is_path else F.lit(key)
        v = body.value(value) if value_is_path else F.lit(value)
        return F.when(k.isNotNull() & v.isNotNull(), F.create_map(k, v))

    if not key_is_path:
        values = _no_nulls(body.values(value))
        return F.when(F.size(values) == 0, empty_map()).when(
            values.isNotNull(), F.create_map(F.lit(key), F.get(values, F.size(values) - 1))
        )
    if not value_is_path:
        keys = _no_nulls(body.values(key))
        return F.map_from_arrays(keys, F.transform(keys, lambda _: F.lit(value)))

    keys, values = _no_nulls(body.values(key)), _no_nulls(body.values(value))
    length = F.greatest(F.size(keys), F.size(values))
    return F.map_from_arrays(_padded(keys, length, key.text), _padded(values, length, value.text))


def _padded(items: Column, length: Column, expression: str) -> Column:
    """Bring a list to ``length``: a single item is repeated, else the expression text fills up."""
    fill = F.when(F.size(items) == 1, F.get(items, F.lit(0))).otherwise(F.lit(expression))
    return F.concat(items, F.array_repeat(fill, length - F.size(items)))


def _merged_objects(path: JsonPath, body: JsonBody) -> Column:
    """Entries of all objects found; whatever fails gives an empty map."""
    if path.definite:
        merged = body.text_map(path)
    else:
        objects = F.filter(body.values(path), lambda raw: F.coalesce(is_object(raw), F.lit(False)))
        merged = F.aggregate(
            objects, empty_map(), lambda all_, raw: F.map_concat(all_, F.from_json(raw, MAP))
        )
    complete = ~F.exists(F.map_values(merged), lambda v: v.isNull())
    return F.coalesce(F.when(complete, merged), empty_map())


def merge_maps(maps: list[Column]) -> Column:
    """Later maps overwrite earlier keys; one null map makes the result null."""
    if not maps:
        return empty_map()
    return maps[0] if len(maps) == 1 else F.map_concat(*maps)


# What reads as a number in Java. Testing first is much cheaper than a cast that fails.
NUMBER = (
    r"\A\s*[+-]?(?:NaN|Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?[fFdD]?"
    r"|0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?\d+[fFdD]?)\s*\z"
)


def is_number(text: Column) -> Column:
    return text.rlike(NUMBER)


def numeric_fields(fields: Column) -> Column:
    """The fields whose text is a number."""
    numbers = F.map_filter(fields, lambda _, v: is_number(v))
    return F.transform_values(numbers, lambda _, v: v.try_cast("double"))


def text_fields(fields: Column) -> Column:
    """The fields whose text is no number."""
    return F.map_filter(fields, lambda _, v: ~is_number(v))
