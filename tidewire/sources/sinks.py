"""Writing points and metrics, batch or streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def write_points(points: DataFrame, base: str, mode: str = "append") -> None:
    """One folder per bucket and measurement.

    The rebalance brings rows of one folder together so that not every task writes into every
    folder; adaptive execution splits a large folder over several tasks.
    """
    (
        points.hint("rebalance", "bucket", "measurement")
        .write.mode(mode)
        .partitionBy("bucket", "measurement")
        .parquet(base)
    )


def read_points(spark: SparkSession, base: str, points: StructType) -> DataFrame:
    """Points as they were written: ``points`` is the schema of what ``write_points`` got.

    Bucket and measurement stay text (``007`` is not 7). Folders cannot have an empty name, so an empty
    bucket or measurement comes back from the default folder; null ones are never points.
    """
    names = ("bucket", "measurement")
    found = spark.read.schema(points).parquet(base)
    return found.withColumns({n: F.coalesce(n, F.lit("")) for n in names}).select(*points.names)


def stream_points(
    points: DataFrame, base: str, checkpoint: str, interval: str | None = "1 second"
) -> StreamingQuery:
    """The same as a stream; without an interval it handles what is there and stops."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return (
        points.writeStream.trigger(**trigger)
        .option("checkpointLocation", checkpoint)
        .partitionBy("bucket", "measurement")
        .format("parquet")
        .start(base)
    )


def missing_buckets(points: DataFrame, known: DataFrame) -> DataFrame:
    """Buckets that points need and ``known`` lacks."""
    return points.select("bucket").distinct().join(known.select("bucket"), "bucket", "left_anti")


def encode_metrics(samples: DataFrame, prefix: str) -> DataFrame:
    """``name, value, timestamp`` to ``topic, payload``; the prefix is put before the name as it is."""
    payload = F.to_json(
        F.struct(
            F.col("value").cast("double").alias("metricValue"),
            F.lit(1).alias("level"),
            F.col("timestamp").cast("bigint").alias("timestamp"),
        )
    )
    return samples.select(F.concat(F.lit(prefix), F.col("name")).alias("topic"), payload.alias("payload"))


def decode_metrics(payloads: DataFrame) -> DataFrame:
    """``topic, payload`` back to metric columns."""
    parsed = F.from_json("payload", "metricValue double, level int, timestamp bigint")
    return payloads.select("topic", parsed.alias("p")).select(
        "topic",
        F.col("p.metricValue").alias("metric_value"),
        F.col("p.level").alias("level"),
        F.col("p.timestamp").alias("timestamp"),
    )
