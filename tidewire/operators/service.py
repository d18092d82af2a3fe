"""Service levels: wait and processing times, and checks of latency and queue length per step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.times import floor_div, millis
from tidewire.plans.running import running_total

LIMITS = "step string, metric string, quantile double, at_most bigint"
LATENCY, LENGTH = "latency", "length"

# Values per block of the running counts: how many different values of a group one task holds.
VALUES = 4096


def lifecycle_times(correlated: DataFrame) -> DataFrame:
    """How long each delivered message waited for its delivery, and was worked on until acknowledged.

    ``correlated`` is what ``lifecycle.correlate_lifecycle`` gives. A projection, for streams too.
    """
    deliver = millis(F.col("deliver_ts"))
    return correlated.select(
        "message_id", "queue", "consumer", "deliver_ts",
        (deliver - millis(F.col("publish_ts"))).alias("wait_ms"),
        (millis(F.col("ack_ts")) - deliver).alias("processing_ms"),
    )


def value_counts(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, value, n``: equal values of a group as one row. Rows of several parts are added up."""
    n = F.sum("n") if "n" in values.columns else F.count(F.lit(1))
    return values.filter("value is not null").groupBy(*keys, "value").agg(n.alias("n"))


def quantiles(counts: DataFrame, keys: Sequence[str], wanted: DataFrame) -> DataFrame:
    """The exact quantiles of groups: the smallest value that the share ``quantile`` of the group's values
    does not exceed. ``wanted`` has ``keys`` or some of them, and ``quantile``; its rows are repeated with
    ``measured`` for each group.

    Values are counted first, and counts are added up in blocks of values, so a group of any size is
    spread over many tasks.
    """
    keys = list(keys)
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("all"))
    sums = running_total(counts, keys, "value", floor_div(F.col("value"), VALUES), "n", "upto")
    shared = [k for k in keys if k in wanted.columns]
    ranks = totals.join(wanted, shared) if shared else totals.join(F.broadcast(wanted))
    # rows are counted from one; a tiny part less, so that 0.95 * 20 is the 19th
    rank = F.greatest(F.lit(1), F.ceil(F.col("quantile") * F.col("all") - F.lit(1e-9))).cast("bigint")
    ranks = ranks.withColumn("rank", rank)
    own = [c for c in ranks.columns if c not in keys]
    reached = sums.join(ranks, keys).filter("upto >= rank")
    return reached.groupBy(*keys, *own).agg(F.min("value").alias("measured")).drop("rank", "all")


def sketch_values(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, sketch``: a quantile summary of each group, of a size that does not grow with the group."""
    return values.filter("value is not null").groupBy(*keys).agg(
        F.kll_sketch_agg_bigint(F.col("value").cast("bigint")).alias("sketch")
    )


def merge_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summaries of several parts as one."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_bigint("sketch").alias("sketch"))


def sketched_quantiles(sketches: DataFrame, keys: Sequence[str], wanted: DataFrame) -> DataFrame:
    """``quantiles`` from merged summaries; the rank of a result is off by about 1.7 % of the group."""
    shared = [k for k in keys if k in wanted.columns]
    both = sketches.join(wanted, shared) if shared else sketches.join(F.broadcast(wanted))
    # Spark takes a quantile as a constant only; a table of limits has a few different ones
    measured = F.lit(None).cast("bigint")
    for row in wanted.select("quantile").distinct().collect():
        found = F.kll_sketch_get_quantile_bigint("sketch", F.lit(row["quantile"]))
        measured = F.when(F.col("quantile") == row["quantile"], found).otherwise(measured)
    return both.withColumn("measured", measured).drop("sketch")


def latencies(correlated: DataFrame, step: Column, interval_ms: int) -> DataFrame:
    """``step, tick, value``: milliseconds from publish to acknowledgement, at the tick of the latter."""
    done = millis(F.col("ack_ts"))
    return correlated.filter("ack_ts is not null and publish_ts is not null").select(
        step.alias("step"), floor_div(done, interval_ms).alias("tick"),
        (done - millis(F.col("publish_ts"))).alias("value"),
    )


def lengths(snapshots: DataFrame, step: Column, interval_ms: int) -> DataFrame:
    """``step, tick, value``: pending messages at each snapshot."""
    return snapshots.select(
        step.alias("step"), floor_div(millis(F.col("time")), interval_ms).alias("tick"),
        F.col("message_count").alias("value"),
    )


def check_levels(values: DataFrame, limits: DataFrame, metric: str, sketch: bool = False) -> DataFrame:
    """Per step and tick whether the metric keeps its limits.

    ``values``: ``step, tick, value``; ``limits``: ``step, metric, quantile, at_most``, where the quantile 1 is
    the maximum. Returns ``step, metric, tick, quantile, at_most, measured, kept``. ``sketch`` measures
    by summaries that can be stored and merged over batches.
    """
    keys = ["step", "tick"]
    own = limits.filter(F.col("metric") == metric)
    if sketch:
        found = sketched_quantiles(sketch_values(values, keys), keys, own)
    else:
        found = quantiles(value_counts(values, keys), keys, own)
    kept = F.col("measured") <= F.col("at_most")
    return found.select("step", "metric", "tick", "quantile", "at_most", "measured", kept.alias("kept"))
