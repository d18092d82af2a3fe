"""Queue snapshots: pending, oldest age, consumers, groups and adds at every tick.

Times are cut into ticks. A message published at ``p`` and acknowledged at ``a`` is pending at tick
``t`` when ``p <= t < a``. The work runs in two parts:

* ``queue_states`` reduces the messages to one row per queue, first tick seen and last tick pending.
  It reads the input once, combines on the map side, and its result can be added up across batches.
* ``snapshots_from_states`` works on that table only. No step brings all rows of a queue into one
  task: running values are formed per block of ticks (``plans.running``).

The oldest pending message needs no search. In order of publish time a message is the oldest pending
one exactly while it is not acknowledged but all earlier ones are. So only messages that outlast all
earlier ones count, their spans do not overlap, and every tick gets at most one of them.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import match_address
from tidewire.functions.times import ceil_div, floor_div, millis
from tidewire.operators.lifecycle import METRIC_SUFFIX, metric_prefix
from tidewire.plans.running import BEFORE, UP_TO_HERE, carried, with_previous
from tidewire.settings import materialize

# Ticks per block: how many ticks of one queue one task may hold at once.
BLOCK = 4096

# Last tick of a message that is never acknowledged.
NEVER = 2**62

# Names of the queue metrics and the columns they come from.
QUEUE_METRICS = {
    "ConsumersCount": "consumers_count",
    "GroupCount": "group_count",
    "MaxMessageAge": "max_message_age",
    "MessageCount": "message_count",
    "MessagesAdded": "messages_added",
    "MessagesAddedFrequency": "messages_added_frequency",
}

# Queues of the broker itself, and the metrics that the dashboard shows.
SYSTEM_QUEUE = "$sys"
SHOWN_METRICS = ("MessagesAddedFrequency", "MaxMessageAge", "MessageCount", "ConsumersCount")


def monitored_queues(df: DataFrame, pattern: str | None = None, mode: str = "full") -> DataFrame:
    """Without system queues; with a pattern only the queues that match it."""
    kept = df.filter(~F.col("queue").startswith(SYSTEM_QUEUE))
    return kept if pattern is None else kept.filter(match_address(F.col("queue"), pattern, mode))


def first_tick(ts: Column, interval_ms: int) -> Column:
    """Number of the first tick at or after ``ts``."""
    return ceil_div(F.unix_micros(ts), interval_ms * 1000)


def queue_states(messages: DataFrame, interval_ms: int) -> DataFrame:
    """``queue, seen, last, n, oldest`` from ``queue, publish_ts, ack_ts``.

    Messages that come and go between two ticks fall into one row per queue and tick.
    """
    seen = first_tick(F.col("publish_ts"), interval_ms)
    last = F.coalesce(first_tick(F.col("ack_ts"), interval_ms) - 1, F.lit(NEVER))
    return (
        messages.select(
            "queue",
            seen.alias("seen"),
            F.greatest(last, seen - 1).alias("last"),
            F.unix_micros("publish_ts").alias("published"),
        )
        .groupBy("queue", "seen", "last")
        .agg(F.count(F.lit(1)).alias("n"), F.min("published").alias("oldest"))
    )


def merge_states(states: DataFrame) -> DataFrame:
    """Add up states of several batches."""
    return states.groupBy("queue", "seen", "last").agg(
        F.sum("n").alias("n"), F.min("oldest").alias("oldest")
    )


def values_per_tick(messages: DataFrame, interval_ms: int) -> DataFrame:
    """``queue, tick, kind, value``: the consumers and groups each queue saw since the tick before, once each.

    Both are found in one pass: consumers at the time of delivery, groups at that of publishing. Rows of
    several batches are merged by ``distinct``.
    """
    def seen(kind: str, ts: str, value: str) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            first_tick(F.col(ts), interval_ms).alias("tick"),
            F.col(value).alias("value"),
        )

    both = F.array(seen("consumer", "deliver_ts", "consumer"), seen("group", "publish_ts", "group_id"))
    return (
        messages.select("queue", F.explode(both).alias("s"))
        .select("queue", "s.*")
        .filter(F.col("value").isNotNull() & F.col("tick").isNotNull())
        .distinct()
    )


def count_values(values: DataFrame) -> DataFrame:
    """``queue, tick, consumers, groups`` from what ``values_per_tick`` gives."""
    return values.groupBy("queue", "tick").agg(
        F.count_if(F.col("kind") == "consumer").alias("consumers"),
        F.count_if(F.col("kind") == "group").alias("groups"),
    )


def distinct_per_tick(messages: DataFrame, interval_ms: int) -> DataFrame:
    """``queue, tick, consumers, groups``: how many different ones each queue saw since the tick before."""
    return count_values(values_per_tick(messages, interval_ms))


SKETCH_BITS = 12  # the error of a count is about 1.04 / sqrt(2^bits): 1.6 %


def sketches_per_tick(messages: DataFrame, interval_ms: int) -> DataFrame:
    """``values_per_tick`` as one sketch per queue, tick and kind, for queues with very many groups."""
    values = values_per_tick(messages, interval_ms)
    return values.groupBy("queue", "tick", "kind").agg(F.hll_sketch_agg("value", SKETCH_BITS).alias("sketch"))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """Add up sketches of several batches."""
    return sketches.groupBy("queue", "tick", "kind").agg(F.hll_union_agg("sketch").alias("sketch"))


def count_sketches(sketches: DataFrame) -> DataFrame:
    """``queue, tick, consumers, groups``, estimated, from merged sketches."""
    n = F.hll_sketch_estimate("sketch")
    return sketches.groupBy("queue", "tick").agg(
        F.coalesce(F.max(F.when(F.col("kind") == "consumer", n)), F.lit(0)).alias("consumers"),
        F.coalesce(F.max(F.when(F.col("kind") == "group", n)), F.lit(0)).alias("groups"),
    )


def _block(tick: Column) -> Column:
    return floor_div(tick, BLOCK)


def _blocks(df: DataFrame, first: Column, last: Column) -> DataFrame:
    """One row per block with ticks from ``first`` to ``last``; ``start`` and ``end`` lie inside it."""
    spans = df.withColumns({"__first": first, "__last": last}).filter(F.col("__first") <= F.col("__last"))
    blocks = spans.withColumn(
        "block", F.explode(F.sequence(_block(F.col("__first")), _block(F.col("__last"))))
    )
    start = F.greatest(F.col("__first"), F.col("block") * BLOCK)
    end = F.least(F.col("__last"), F.col("block") * BLOCK + (BLOCK - 1))
    return blocks.withColumns({"start": start, "end": end}).drop("__first", "__last")


def _changes(states: DataFrame) -> DataFrame:
    """Per tick what the states add to the counters, at their first tick, and take away after their last."""
    moves = F.array(
        F.struct(F.col("seen").alias("tick"), F.col("n").alias("pending"), F.col("n").alias("added")),
        F.struct(
            (F.col("last") + 1).alias("tick"), (-F.col("n")).alias("pending"), F.lit(0).cast("bigint").alias("added")
        ),
    )
    return (
        states.select("queue", F.explode(moves).alias("m"))
        .select("queue", "m.*")
        .filter(F.col("tick") <= NEVER)
        .groupBy("queue", "tick")
        .agg(F.sum("pending").alias("pending"), F.sum("added").alias("added"))
    )


def _oldest_pending(states: DataFrame) -> DataFrame:
    """``queue, block, tick, oldest, holds``: from ``tick`` to ``holds`` the message is the oldest one.

    A span is cut at the borders of blocks, so that each block knows what it starts with. States first
    seen at an earlier tick are older, so they matter only by how long the longest of them lasts: one
    value per tick, carried on per block. States are ranked only among those first seen at one tick.
    """
    pending = states.filter(F.col("last") >= F.col("seen"))
    ticks = pending.groupBy("queue", "seen").agg(F.max("last").alias("peak"))
    ticks = ticks.withColumn("block", _block(F.col("seen")))
    peaks = ticks.groupBy("queue", "block").agg(F.max("peak").alias("peak"))
    before = carried(peaks, ["queue"], "block", {"outlasted": F.max("peak")})
    in_block = Window.partitionBy("queue", "block").orderBy("seen").rowsBetween(*BEFORE)
    earlier = ticks.join(before, ["queue", "block"]).select(
        "queue", "seen", F.greatest("outlasted", F.max("peak").over(in_block)).alias("outlasted")
    )
    outlasts = F.col("outlasted").isNull() | (F.col("last") > F.col("outlasted"))
    in_tick = Window.partitionBy("queue", "seen").orderBy("oldest", "last").rowsBetween(*BEFORE)
    leaders = (
        pending.join(earlier, ["queue", "seen"])
        .filter(outlasts)
        .withColumn("outlasted", F.greatest(F.col("outlasted"), F.max("last").over(in_tick)))
        .filter(outlasts)
    )
    first = F.greatest(F.col("seen"), F.col("outlasted") + 1)
    spans = _blocks(leaders, first, F.least(F.col("last"), F.col("until")))
    return spans.select("queue", "block", F.col("start").alias("tick"), "oldest", F.col("end").alias("holds"))


def snapshots_from_states(
    states: DataFrame,
    interval_ms: int,
    distinct: DataFrame | None = None,
    until: int | None = None,
) -> DataFrame:
    """One row per queue and tick, from the first tick that sees the queue to the last tick of all.

    ``states`` is used several times and should be a table or materialized. ``distinct``
    comes from ``distinct_per_tick``. ``until`` is the last tick, else that of the last change.
    """
    if until is None:
        last_change = F.max(F.when(F.col("last") < NEVER, F.col("last") + 1))
        end = states.select(F.greatest(F.max("seen"), last_change)).scalar()
    else:
        end = F.lit(until).cast("bigint")
    states = states.withColumn("until", end)

    changes = _changes(states)
    spans = states.groupBy("queue").agg(F.min("seen").alias("seen"), F.max("until").alias("until"))
    blocks = _blocks(spans, F.col("seen"), F.col("until"))
    # blocks are dealt out before they unfold, so that few queues still use many tasks
    grid = blocks.repartition("queue", "block").withColumn(
        "tick", F.explode(F.sequence(F.col("start"), F.col("end")))
    )
    mark = F.when(F.col("tick") == F.col("seen"), FIRST_TICK).otherwise(LATER_TICK)
    parts = [grid.withColumn("mark", mark), changes, _oldest_pending(states)]
    if distinct is not None:
        parts.append(distinct)
    rows = functools.reduce(DataFrame.unionByName, [_aligned(part) for part in parts])
    # each part has a tick once; one shuffle by block serves the grouping, the join and the window
    per_tick = (
        rows.repartition("queue", "block")
        .groupBy("queue", "block", "tick")
        .agg(*[F.max(c).alias(c) for c in TICK_VALUES])
        .filter(F.col("mark").isNotNull())
    )
    before = _before_blocks(changes, blocks)
    return _snapshot_columns(per_tick.join(before, ["queue", "block"]), interval_ms)


# What the grid says about a tick of a queue; the larger wins when rows of a tick are put together.
LATER_TICK, FIRST_TICK = 1, 2


TICK_VALUES = ("mark", "pending", "added", "oldest", "holds", "consumers", "groups")


def _aligned(part: DataFrame) -> DataFrame:
    """The columns that all rows of a tick are put together from."""
    block = F.col("block") if "block" in part.columns else _block(F.col("tick"))
    values = [
        (F.col(c) if c in part.columns else F.lit(None)).cast("bigint").alias(c) for c in TICK_VALUES
    ]
    return part.select("queue", block.alias("block"), "tick", *values)


def _before_blocks(changes: DataFrame, blocks: DataFrame) -> DataFrame:
    """What each block of a queue starts from; blocks without changes are there too."""
    nothing = F.lit(0).cast("bigint")
    per_block = (
        changes.select("queue", _block(F.col("tick")).alias("block"), "pending", "added")
        .unionByName(blocks.select("queue", "block", nothing.alias("pending"), nothing.alias("added")))
        .groupBy("queue", "block")
        .agg(F.sum("pending").alias("pending"), F.sum("added").alias("added"))
    )
    sums = {"pending_before": F.sum("pending"), "added_before": F.sum("added")}
    return carried(per_block, ["queue"], "block", sums)


def _snapshot_columns(ticks: DataFrame, interval_ms: int) -> DataFrame:
    inside = Window.partitionBy("queue", "block").orderBy("tick").rowsBetween(*UP_TO_HERE)

    def running(name: str) -> Column:
        here = F.sum(F.coalesce(F.col(name), F.lit(0))).over(inside)
        return F.coalesce(F.col(f"{name}_before"), F.lit(0)) + here

    def latest(name: str) -> Column:
        return F.last(name, ignorenulls=True).over(inside)

    tick_ms = F.col("tick") * interval_ms
    age = F.when(latest("holds") >= F.col("tick"), tick_ms - floor_div(latest("oldest"), 1000))
    added = F.coalesce(F.col("added"), F.lit(0))
    rate = F.when(F.col("mark") == FIRST_TICK, 0.0).otherwise(added / (interval_ms / 1000.0))
    return ticks.select(
        "queue",
        F.timestamp_millis(tick_ms).alias("time"),
        running("pending").alias("message_count"),
        F.coalesce(age, F.lit(0)).alias("max_message_age"),
        F.coalesce("consumers", F.lit(0)).alias("consumers_count"),
        F.coalesce("groups", F.lit(0)).alias("group_count"),
        rate.alias("messages_added_frequency"),
        running("added").alias("messages_added"),
    )


def queue_snapshots(
    messages: DataFrame,
    interval_ms: int = 3000,
    pattern: str | None = None,
    mode: str = "full",
    until: int | None = None,
) -> DataFrame:
    """Snapshots from ``queue, publish_ts, deliver_ts, ack_ts, consumer, group_id``."""
    kept = monitored_queues(messages, pattern, mode)
    return snapshots_from_states(
        materialize(queue_states(kept, interval_ms), "queue-states"),
        interval_ms,
        distinct_per_tick(kept, interval_ms),
        until,
    )


def add_rate(snapshots: DataFrame) -> DataFrame:
    """Messages added per second since the row before, for snapshots at any times.

    0.0 for the first row of a queue and for two rows of the same time.
    """
    day = F.date_trunc("day", F.col("time"))
    joined = with_previous(snapshots, ["queue"], "time", day, ["time", "messages_added"])
    seconds = (millis(F.col("time")) - millis(F.col("previous_time"))) / 1000.0
    rate = F.try_divide(F.col("messages_added") - F.col("previous_messages_added"), seconds)
    return joined.withColumn("messages_added_frequency", F.coalesce(rate, F.lit(0.0))).drop(
        "previous_time", "previous_messages_added"
    )


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """The newest row of every queue."""
    newest = F.max_by(F.struct(*snapshots.columns), F.col("time")).alias("s")
    return snapshots.groupBy("queue").agg(newest).select("s.*")


def queue_metrics(snapshots: DataFrame) -> DataFrame:
    """Snapshots to ``name, value, timestamp``, six rows each."""
    samples = F.array(
        *[
            F.struct(F.lit(metric).alias("metric"), F.col(column).cast("double").alias("value"))
            for metric, column in QUEUE_METRICS.items()
        ]
    )
    name = F.concat_ws("_", metric_prefix(F.col("queue")), F.col("s.metric"), F.lit(METRIC_SUFFIX))
    return snapshots.select("queue", "time", F.explode(samples).alias("s")).select(
        name.alias("name"), F.col("s.value").alias("value"), millis(F.col("time")).alias("timestamp")
    )


# How the dashboard reads step and metric from a topic.
STEP_IN_TOPIC = r".*_(.*)_input_.*"
METRIC_IN_TOPIC = r".*_(\w+)_SENSOR"


def metric_series(samples: DataFrame) -> DataFrame:
    """Samples ``topic, metric_value, timestamp`` as series per step and shown metric, in time order."""
    topic = F.col("topic")
    return (
        samples.filter(topic.rlike(STEP_IN_TOPIC) & topic.rlike(METRIC_IN_TOPIC))
        .select(
            F.regexp_extract(topic, STEP_IN_TOPIC, 1).alias("step"),
            F.regexp_extract(topic, METRIC_IN_TOPIC, 1).alias("metric"),
            "timestamp",
            "metric_value",
        )
        .filter(F.col("metric").isin(*SHOWN_METRICS))
        .orderBy("step", "metric", "timestamp")
    )


def rescale(value: Column, low: float, high: float, to_low: float, to_high: float) -> Column:
    return (value - low) / (high - low) * (to_high - to_low) + to_low


def backpressure(depth: Column) -> Column:
    """Seconds to wait for a queue of the given depth: 0 … 10 messages give 0 … 2 seconds."""
    return rescale(F.least(depth, F.lit(10)).cast("double"), 0, 10, 0, 2)
