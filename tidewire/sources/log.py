"""A laid-out event log: by date in folders, by id in buckets.

Tables that are bucketed by the id of the message join, group and sort by it without a shuffle; a filter on the
date reads the folders of these days only. Layout is paid for once, when events are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.lifecycle import original_id

BUCKETS = 64
DATE, KEY = "event_date", "log_id"


def write_log(
    events: DataFrame, table: str, buckets: int = BUCKETS, *, key: str | None = None, path: str | None = None,
    mode: str = "append",
) -> None:
    """Write events as a table: partitioned by the date of ``ts``, bucketed and sorted by the key.

    The key is the original id of the message unless a column is named. All tables that meet in a join need
    the same number of buckets. Rows are dealt to their buckets first, so each date and bucket is one file.
    """
    column = original_id(events) if key is None else F.col(key)
    laid = events.withColumns({KEY: column, DATE: F.to_date("ts")})
    writer = laid.repartition(buckets, KEY).write.mode(mode).format("parquet")
    writer = writer.partitionBy(DATE).bucketBy(buckets, KEY).sortBy(KEY)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def read_log(spark: SparkSession, table: str, since=None, until=None) -> DataFrame:
    """A laid-out table, from ``since`` to ``until`` (dates, both included).

    Joins of such tables on the key and more columns go by the key's buckets; Spark wants all columns
    of a join in the layout unless told otherwise, so it is told here.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    log = spark.table(table)
    if since is not None:
        log = log.filter(F.col(DATE) >= F.lit(since))
    if until is not None:
        log = log.filter(F.col(DATE) <= F.lit(until))
    return log


def by_key(log: DataFrame, name: str = "message_id") -> DataFrame:
    """The log with its key under the name that operators know, and nothing of the layout left."""
    return log.drop(name, "original_message_id", DATE).withColumnRenamed(KEY, name)
