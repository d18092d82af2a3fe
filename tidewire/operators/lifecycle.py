"""Publish, deliver and acknowledge: origin, correlation and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import match_address
from tidewire.functions.times import millis

PUBLISHED, DELIVERED, ACKNOWLEDGED = "Published", "Delivered", "Acknowledged"

# Fixed value: the last word of every metric name.
METRIC_SUFFIX = "SENSOR"


def monitored(df: DataFrame, pattern: str | None, column: str = "address", mode: str = "full") -> DataFrame:
    """Rows whose queue is monitored; no pattern means all of them."""
    return df if pattern is None else df.filter(match_address(F.col(column), pattern, mode))


def new_publishes(messages: DataFrame) -> DataFrame:
    """Without copies that another node has already stamped. Needs no shuffle."""
    return messages.filter(F.col("receiving_node").isNull() & F.col("original_message_id").isNull())


def stamp_origin(messages: DataFrame, node: str | Column) -> DataFrame:
    """Set the receiving node and the original id where they are not set."""
    node = F.lit(node) if isinstance(node, str) else node
    return messages.withColumns(
        {
            "receiving_node": F.coalesce("receiving_node", node),
            "original_message_id": F.coalesce("original_message_id", "message_id"),
        }
    )


def first_publish(messages: DataFrame) -> DataFrame:
    """One row per original message: the earliest seen on any node.

    Spark keeps the first row per id on each task before the shuffle, so many copies of one message
    do not meet in one task.
    """
    id_ = F.coalesce("original_message_id", "message_id")
    order = Window.partitionBy("__id").orderBy("ts", "receiving_node", "message_id")
    ranked = messages.withColumn("__id", id_).withColumn("__rank", F.row_number().over(order))
    return ranked.filter(F.col("__rank") == 1).drop("__id", "__rank")


def original_id(df: DataFrame) -> Column:
    """The id a message had on the node that received it first."""
    if "original_message_id" in df.columns:
        return F.coalesce("original_message_id", "message_id")
    return F.col("message_id")


def _received(delivered: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """Deliveries, each with the first acknowledgement between it and the next delivery.

    A message that was delivered again is acknowledged for its latest delivery so far.
    """
    acks = acknowledged.select(
        original_id(acknowledged).alias("message_id"), "queue", F.col("ts").alias("ack_ts")
    )
    received = delivered.select(
        original_id(delivered).alias("message_id"), "queue", "consumer", F.col("ts").alias("deliver_ts")
    )
    in_turn = Window.partitionBy("message_id", "queue").orderBy("deliver_ts", "consumer")
    turns = received.withColumns(
        {"__next": F.lead("deliver_ts").over(in_turn), "__turn": F.row_number().over(in_turn)}
    )
    between = F.expr("ack_ts >= deliver_ts AND (__next IS NULL OR ack_ts < __next)")
    keys = (F.col("d.message_id") == F.col("a.message_id")) & (F.col("d.queue") == F.col("a.queue"))
    joined = turns.alias("d").join(acks.alias("a"), keys & between, "left")
    return (
        joined.groupBy("d.message_id", "d.queue", "__turn", "consumer", "deliver_ts")
        .agg(F.min("ack_ts").alias("ack_ts"))
        .drop("__turn")
    )


def correlate_lifecycle(published: DataFrame, delivered: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """One row per delivered message and queue, with its publish fields and acknowledge time.

    ``published``: ``message_id, ts, queue, client_id, node, size``; ``delivered``:
    ``message_id, ts, queue, consumer``; ``acknowledged``: ``message_id, ts, queue``. All may have
    ``original_message_id``: events of any node are then correlated, and reported, by the original id,
    and a publish that carries one is a copy between nodes and no publish of its own.
    """
    if "original_message_id" in published.columns:
        published = published.filter("original_message_id IS NULL OR original_message_id = message_id")
    sent = published.select(
        "message_id",
        F.col("ts").alias("publish_ts"),
        F.col("queue").alias("publish_queue"),
        F.col("client_id").alias("publish_client_id"),
        F.col("node").alias("publish_node"),
        F.col("size").alias("message_size"),
    )
    return _received(delivered, acknowledged).join(sent, "message_id", "left")


def lifecycle_events(published: DataFrame, delivered: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """One row per publish, delivery and acknowledgement; the later two carry the publish fields."""
    return publish_events(published).unionByName(
        receive_events(correlate_lifecycle(published, delivered, acknowledged))
    )


def publish_events(published: DataFrame) -> DataFrame:
    return published.select(
        F.lit(PUBLISHED).alias("event_type"),
        "message_id",
        F.col("queue").alias("message_queue"),
        F.col("size").alias("message_size"),
        "ts",
        F.col("node").alias("publish_node"),
        F.col("queue").alias("publish_queue"),
        F.col("client_id").alias("publish_client_id"),
        F.col("ts").alias("publish_ts"),
        F.lit(None).cast("timestamp").alias("deliver_ts"),
    )


def receive_events(lifecycle: DataFrame) -> DataFrame:
    """The delivered and the acknowledged event of each correlated row; a narrow operation."""
    steps = F.array(
        F.struct(
            F.lit(DELIVERED).alias("event_type"),
            F.col("deliver_ts").alias("ts"),
            F.lit(None).cast("timestamp").alias("deliver_ts"),
        ),
        F.struct(
            F.lit(ACKNOWLEDGED).alias("event_type"),
            F.col("ack_ts").alias("ts"),
            F.col("deliver_ts").alias("deliver_ts"),
        ),
    )
    return (
        lifecycle.withColumn("event", F.explode(steps))
        .filter(F.col("event.ts").isNotNull())
        .select(
            "event.event_type",
            "message_id",
            F.col("queue").alias("message_queue"),
            "message_size",
            "event.ts",
            "publish_node",
            "publish_queue",
            "publish_client_id",
            "publish_ts",
            "event.deliver_ts",
        )
    )


def metric_prefix(queue: Column) -> Column:
    return F.translate(queue, ".", "_")


def lifecycle_metrics(events: DataFrame) -> DataFrame:
    """Events to ``message_id, name, value, timestamp``: the size of each, the latency of the later two."""
    later = F.col("event_type").isin(DELIVERED, ACKNOWLEDGED)
    latency = F.when(later, (millis(F.col("ts")) - millis(F.col("publish_ts"))).cast("double"))
    samples = F.array(
        F.struct(F.lit("Size").alias("metric"), F.col("message_size").cast("double").alias("value")),
        F.struct(F.lit("Latency").alias("metric"), latency.alias("value")),
    )
    name = F.concat_ws(
        "_",
        metric_prefix(F.col("message_queue")),
        F.concat(F.lit("Message"), F.col("event_type")),
        F.col("sample.metric"),
        F.lit(METRIC_SUFFIX),
    )
    return (
        events.withColumn("sample", F.explode(samples))
        .filter(F.col("sample.value").isNotNull())
        .select(
            "message_id",
            name.alias("name"),
            F.col("sample.value").alias("value"),
            millis(F.col("ts")).alias("timestamp"),
        )
    )
