"""First publishes in a stream, however late a copy comes.

The ids seen are kept in a store by day, with a filter for each day: a bitmap over hashes of its ids. Ids of a
micro-batch are held against the filters first; only those that a filter knows are looked up, in the days in
question, in the ids themselves. So the stream has no state, the result is exact, and most of the index
is not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewire.operators import lifecycle
from tidewire.streaming import store
from tidewire.streaming.runs import for_each_batch

# A day's filter has 2^24 bits in rows of 2^15; a day of n ids lets about n / 2^24 of unknown ids through.
ROWS = 512
BITS = 1 << 15

IDS = "id bigint, day date"
FILTERS = "day date, row int, bits binary"


def _place(id_: Column) -> tuple[Column, Column]:
    """The row of the filter and the bit in it, by a hash of the id."""
    place = F.pmod(F.xxhash64(id_), F.lit(ROWS * BITS))
    return F.expr("0L") + F.floor(place / BITS), F.pmod(place, F.lit(BITS))


def filters_of(ids: DataFrame) -> DataFrame:
    row, bit = _place(F.col("id"))
    marks = ids.select("day", row.cast("int").alias("row"), bit.alias("bit"))
    return marks.groupBy("day", "row").agg(F.bitmap_construct_agg("bit").alias("bits"))


def merge_filters(filters: DataFrame) -> DataFrame:
    return filters.groupBy("day", "row").agg(F.bitmap_or_agg("bits").alias("bits"))


def _has_bit(bits: Column, bit: Column) -> Column:
    """Whether a bit of a bitmap is set."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1


def known_ids(ids: DataFrame, filters: DataFrame, stored: DataFrame) -> DataFrame:
    """Those of ``ids`` (one column, ``id``) that are stored."""
    row, bit = _place(F.col("id"))
    asked = ids.select("id", row.cast("int").alias("row"), bit.alias("bit"))
    maybe = asked.join(filters, "row").filter(_has_bit(F.col("bits"), F.col("bit"))).select("id", "day")
    days = [r["day"] for r in maybe.select("day").distinct().collect()]  # as many as days are kept
    if not days:
        return ids.limit(0)
    # only files of these days are read
    there = stored.filter(F.col("day").isin(days))
    return maybe.join(there, ["id", "day"], "left_semi").select("id").distinct()


def write_first(path: str, keep_days: int | None = None, every: int = store.MERGE_EVERY) -> Callable[[DataFrame, int], None]:
    """Per micro-batch the messages that are the first of their original id go to ``path/out``.

    The output is written before the index. A repeated batch finds its output complete, takes it as it is
    and only writes the index again; so what a batch gives out is never judged by its own entries.
    With ``keep_days``, ids that are older than the newest day by more are forgotten.
    """

    def recent(df: DataFrame) -> DataFrame:
        if keep_days is None:
            return df
        newest = df.agg(F.max("day").alias("newest"))
        return df.join(F.broadcast(newest), F.col("day") > F.date_sub("newest", keep_days)).drop("newest")

    def merge_ids(df: DataFrame) -> DataFrame:
        return recent(df.distinct()).repartition("day").sortWithinPartitions("day", "id")

    def merge_bits(df: DataFrame) -> DataFrame:
        return recent(merge_filters(df))

    keep_ids = store.write_merged(f"{path}/ids", lambda df: df, merge_ids, every)
    keep_bits = store.write_merged(f"{path}/filters", lambda df: df, merge_bits, every)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        out = f"{path}/out/batch={batch_id}"
        if batch_id not in store.folders(spark, f"{path}/out")["batch"]:
            first = lifecycle.first_publish(batch).withColumn("__id", lifecycle.original_id(batch))
            filters = store.read_store(spark, f"{path}/filters", merge_filters, FILTERS)
            stored = store.read_store(spark, f"{path}/ids", lambda df: df, IDS)
            old = known_ids(first.select(F.col("__id").alias("id")), filters, stored)
            fresh = first.join(old, F.col("__id") == F.col("id"), "left_anti").drop("__id")
            fresh.write.mode("overwrite").parquet(out)
        fresh = spark.read.schema(batch.schema).parquet(out)
        ids = fresh.select(lifecycle.original_id(fresh).alias("id"), F.to_date("ts").alias("day")).persist()
        keep_ids(ids, batch_id)
        keep_bits(filters_of(ids), batch_id)
        ids.unpersist()

    return write


def store_first_publishes(
    messages: DataFrame, path: str, checkpoint: str, keep_days: int | None = None, every: int = store.MERGE_EVERY,
    **kwargs,
) -> StreamingQuery:
    """``lifecycle.first_publish`` over a stream without a bound on how late a copy may come."""
    return for_each_batch(messages, write_first(path, keep_days, every), checkpoint, **kwargs)


def first_publishes(spark: SparkSession, path: str) -> DataFrame:
    """All messages given out so far."""
    return spark.read.parquet(f"{path}/out").drop("batch")
