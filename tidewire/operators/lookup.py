"""The stored message log: lookups in order of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import normalize_topic
from tidewire.operators.routing import conjunction

ARRIVAL = ("reception_date", "message_id")


def stored_log(messages: DataFrame) -> DataFrame:
    """Messages as log rows: time of reception, clean topic, application and correlation id."""
    return messages.select(
        "message_id",
        F.col("ts").alias("reception_date"),
        normalize_topic(F.col("address")).alias("topic"),
        "body",
        F.try_element_at("properties", F.lit("application")).alias("application_id"),
        F.try_element_at("properties", F.lit("correlation_id")).alias("correlation_id"),
    )


def log_lookup(
    log: DataFrame,
    application: str | None = None,
    topic: str | None = None,
    predicate: Column | None = None,
) -> DataFrame:
    """Rows that meet all given conditions."""
    return log.filter(
        conjunction(
            [
                F.col("application_id") == application if application is not None else None,
                F.col("topic") == topic if topic is not None else None,
                predicate,
            ]
        )
    )


def find_first(log: DataFrame, application=None, topic=None, predicate=None) -> DataFrame:
    """The earliest row that meets the conditions, if any."""
    return log_lookup(log, application, topic, predicate).orderBy(*ARRIVAL).limit(1)


def find_last(log: DataFrame, application=None, topic=None, predicate=None) -> DataFrame:
    """The latest row that meets the conditions, if any."""
    latest = [F.col(name).desc() for name in ARRIVAL]
    return log_lookup(log, application, topic, predicate).orderBy(*latest).limit(1)
