"""Group keys from a JSON body, an XML body or a property."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.jsonpath import is_object, parse_path, spark_path

# Where a group key may come from.
BODY_JSON, BODY_XML, PROPERTY = "BODY_JSON", "BODY_XML", "PROPERTY"
SOURCES = (BODY_JSON, BODY_XML, PROPERTY)


def json_value(body: Column, path: str) -> Column:
    """Text at a definite path; ``a.b`` is read as ``$.a.b``."""
    parsed = parse_path(path)
    if not parsed.definite:
        raise ValueError(f"a path to one value is needed: {path}")
    return F.get_json_object(body, spark_path(parsed.steps))


def object_text(raw: Column) -> Column:
    """An object as ``{key=value, …}``, other values as they are."""
    entries = F.map_entries(F.from_json(raw, "map<string,string>"))
    pairs = F.transform(
        entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))
    )
    as_map = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    return F.when(is_object(raw), F.coalesce(as_map, raw)).otherwise(raw)


def group_key_json(body: Column, path: str) -> Column:
    """Text of the value; an object is written as ``{key=value, …}``; null when there is none."""
    return object_text(json_value(body, path))


# Stands between the results of several paths; no XML document can hold it.
XML_SEPARATOR = "\x1f"


def group_keys_xml(body: Column, paths: Sequence[str]) -> list[Column]:
    """``group_key_xml`` of several paths with one look at the body for all of them."""
    texts = f", '{XML_SEPARATOR}', ".join(f"string({path})" for path in paths)
    found = group_key_xml(body, f"concat({texts}, '')") if len(paths) > 1 else group_key_xml(body, *paths)
    parts = F.split(found, XML_SEPARATOR, -1)
    return [F.get(parts, F.lit(i)) for i in range(len(paths))]


def group_key_xml(body: Column, path: str) -> Column:
    """XPath as text; an absent node gives ``''``, a body that is no XML gives null."""
    checked = F.from_xml(
        body,
        "_corrupt_record string",
        {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"},
    )
    well_formed = checked.isNotNull() & checked["_corrupt_record"].isNull()
    return F.when(well_formed, F.xpath_string(body, F.lit(path)))


def group_key_property(properties: Column, name: str) -> Column:
    return F.try_element_at(properties, F.lit(name))


def raw_group_key(source: str, expression: str) -> Column:
    """The key of a message by one configured accessor; ``object_text`` is still to come for JSON."""
    if source == BODY_JSON:
        return json_value(F.col("body"), expression)
    if source == BODY_XML:
        return group_key_xml(F.col("body"), expression)
    if source == PROPERTY:
        return group_key_property(F.col("properties"), expression)
    raise ValueError(f"unknown group key source: {source}")


def group_key(source: str, expression: str) -> Column:
    """The key of a message by one configured accessor."""
    raw = raw_group_key(source, expression)
    return object_text(raw) if source == BODY_JSON else raw
