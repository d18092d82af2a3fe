"""Reading messages, batch or streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire import schemas


def decode_body(body: Column, body_bytes: Column) -> Column:
    """The text body, else the bytes read as UTF-8."""
    return F.coalesce(body, F.decode(body_bytes, "UTF-8"))


def read_messages(
    spark: SparkSession,
    path: str,
    format: str = "parquet",
    streaming: bool = False,
    schema: str = schemas.MESSAGES,
    **options: str,
) -> DataFrame:
    """Messages from files. A ``body_bytes`` column in ``schema`` backs up a missing text body."""
    reader = spark.readStream if streaming else spark.read
    return with_text_body(reader.format(format).schema(schema).options(**options).load(path))


def with_text_body(df: DataFrame) -> DataFrame:
    if "body_bytes" not in df.columns:
        return df
    return df.withColumn("body", decode_body(F.col("body"), F.col("body_bytes"))).drop("body_bytes")


def read_kafka(spark: SparkSession, servers: str, topics: str, streaming: bool = True, **options: str) -> DataFrame:
    """Messages from Kafka: topic as address, headers as properties. Needs Spark's Kafka package."""
    reader = spark.readStream if streaming else spark.read
    raw = (
        reader.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topics)
        .option("includeHeaders", "true")
        .options(**options)
        .load()
    )
    return from_kafka_records(raw, [topic.strip() for topic in topics.split(",")])


def kafka_message_id(topics: Sequence[str]) -> Column:
    """One number per record: 10 bits for the topic's place in ``topics``, 14 for the partition and 39
    for the offset. A record that does not fit, or of another topic, is an error."""
    if len(topics) > 1 << 10:
        raise ValueError(f"more than {1 << 10} topics")
    topic = F.array_position(F.array(*[F.lit(t) for t in topics]), F.col("topic")).cast("bigint") - 1
    partition, offset = F.col("partition").cast("bigint"), F.col("offset").cast("bigint")
    fits = (topic >= 0) & (partition < 1 << 14) & (offset < 1 << 39)
    number = F.shiftleft(topic, 53) + F.shiftleft(partition, 39) + offset
    return F.when(fits, number).otherwise(F.raise_error(F.lit("no message id for this Kafka record")))


def from_kafka_records(raw: DataFrame, topics: Sequence[str]) -> DataFrame:
    """Kafka columns to the message layout; ``topics`` are those that were read, in a fixed order."""
    headers = F.map_from_entries(
        F.transform(
            F.coalesce("headers", F.array().cast("array<struct<key:string,value:binary>>")),
            lambda h: F.struct(h["key"], F.decode(h["value"], "UTF-8")),
        )
    )
    return raw.select(
        kafka_message_id(topics).cast("bigint").alias("message_id"),
        F.col("topic").alias("address"),
        F.decode("value", "UTF-8").alias("body"),
        headers.alias("properties"),
        F.col("timestamp").alias("ts"),
        F.octet_length("value").cast("bigint").alias("size"),
        F.lit(None).cast("string").alias("client_id"),
        F.lit(None).cast("string").alias("user"),
        F.lit(None).cast("string").alias("receiving_node"),
        F.lit(None).cast("bigint").alias("original_message_id"),
        F.decode("key", "UTF-8").alias("group_id"),
    )
