"""Configuration: pipeline steps and group keys, given as JSON text or as a path to it."""

from __future__ import annotations

import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tidewire import schemas
from tidewire.functions.grouping import SOURCES

log = logging.getLogger(__name__)


def inline_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Driver-side rows as a table inside the plan.

    Spark knows its size, so it is broadcast exactly when it is below the session's threshold.
    """
    return spark.sql(
        f"SELECT inline(from_json(:rows, 'array<struct<{_struct(schema)}>>'))",
        args={"rows": json.dumps(rows)},
    )


def _struct(schema: str) -> str:
    columns = [c.strip().split(None, 1) for c in schema.split(",")]
    return ",".join(f"{name}:{kind.strip()}" for name, kind in columns)


def _accessor(entry: dict | None) -> tuple[str | None, str | None]:
    """Both spellings of the configuration are read; an absent accessor means no group."""
    if not entry:
        return None, None
    source, expression = str(entry["source"]).upper(), str(entry["expression"])
    if source not in SOURCES:
        raise ValueError(f"unknown group key source: {source}")
    return source, expression


def parse_steps(spec: str) -> list[dict]:
    """Rows of the steps table; anything wrong with the input gives an empty pipeline."""
    try:
        text = Path(spec).read_text() if spec.lower().endswith(".json") else spec
        rows = []
        for step, entry in json.loads(text).items():
            source, expression = _accessor(
                entry.get("groupingKeyAccessor") or entry.get("grouping_key_accessor")
            )
            stream = entry["inputStream"] if "inputStream" in entry else entry["input_stream"]
            rows.append(
                {"step": step, "input_stream": stream, "key_source": source, "key_expr": expression}
            )
        return rows
    except Exception:
        log.exception("cannot load the pipeline definition")
        return []


def load_pipeline(spark: SparkSession, spec: str) -> DataFrame:
    return inline_table(spark, parse_steps(spec), schemas.STEPS)


def parse_group_keys(path: str | None = None, inline: str | None = None) -> list[dict]:
    """Rows ``address, key_source, key_expr``; the file wins over inline text, errors give no rows."""
    if path is None and inline is None:
        log.error("neither a path nor inline text is given for the group keys")
        return []
    try:
        rows = []
        for address, entry in json.loads(Path(path).read_text() if path is not None else inline).items():
            source, expression = _accessor(entry)
            rows.append({"address": address, "key_source": source, "key_expr": expression})
        return rows
    except Exception:
        log.exception("cannot load the group keys")
        return []


def load_group_keys(spark: SparkSession, path: str | None = None, inline: str | None = None) -> DataFrame:
    return inline_table(spark, parse_group_keys(path, inline), schemas.GROUP_KEYS)
