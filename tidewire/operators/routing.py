"""Messages along the steps of a pipeline, and their group keys."""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.grouping import BODY_JSON, object_text, raw_group_key
from tidewire.settings import materialize
from tidewire.sources.config import inline_table
from tidewire import schemas

# The address forms of a pipeline and the addresses of broker management traffic.
PREFIX = "iotdpp."
MANAGEMENT = ("activemq.management", "activemq.notifications")


def output_address(stream: Column) -> Column:
    return F.concat(F.lit(PREFIX), stream, F.lit(".output"))


def input_address(step: Column, stream: Column) -> Column:
    return F.concat(F.lit(PREFIX), step, F.lit(".input."), stream)


def step_addresses(steps: DataFrame) -> DataFrame:
    """Every address the steps read from or write to, once."""
    step, stream = F.col("step"), F.col("input_stream")
    forms = F.array(output_address(stream), input_address(step, stream), output_address(step))
    return steps.select(F.explode(forms).alias("address")).distinct()


def drop_management(messages: DataFrame) -> DataFrame:
    return messages.filter(~F.col("address").isin(*MANAGEMENT))


def route_steps(messages: DataFrame, steps: DataFrame) -> DataFrame:
    """A copy of each message for every step that reads the address it was sent to."""
    read = steps.select(
        "step",
        "input_stream",
        "key_source",
        "key_expr",
        output_address(F.col("input_stream")).alias("address"),
    )
    return (
        drop_management(messages)
        .join(read, "address")
        .withColumn("address", input_address(F.col("step"), F.col("input_stream")))
    )


def _with_group(df: DataFrame, accessors: Sequence[tuple[str, str]], override: bool) -> DataFrame:
    """Set the group by the accessor that ``key_source`` and ``key_expr`` of the row name.

    Each accessor is a literal in the plan. An existing group stays unless ``override``; a missing
    key changes nothing.
    """
    cases = [
        F.when(
            (F.col("key_source") == source) & (F.col("key_expr") == expression),
            raw_group_key(source, expression),
        )
        for source, expression in accessors
    ]
    # the value is read in a projection of its own, so that each body is parsed once
    raw = F.coalesce(*cases) if cases else F.lit(None).cast("string")
    found = F.col("__key")
    key = F.when(F.col("key_source") == BODY_JSON, object_text(found)).otherwise(found)
    existing = F.col("group_id")
    chosen = F.coalesce(key, existing) if override else F.coalesce(existing, key)
    return df.withColumn("__key", raw).withColumn("group_id", chosen).drop("__key", "key_source", "key_expr")


def _accessors(rows: Sequence[Mapping]) -> list[tuple[str, str]]:
    pairs = {(r["key_source"], r["key_expr"]) for r in rows if r["key_source"]}
    return sorted(pairs)


def annotate_group(messages: DataFrame, keys: Sequence[Mapping], override: bool = False) -> DataFrame:
    """Set ``group_id`` on messages to configured addresses.

    ``keys`` are rows ``address, key_source, key_expr`` as ``parse_group_keys`` gives them.
    """
    if not keys:
        return messages
    table = inline_table(messages.sparkSession, list(keys), schemas.GROUP_KEYS)
    joined = messages.join(table, "address", "left")
    return _with_group(joined, _accessors(keys), override).select(*messages.columns)


def route_and_annotate(messages: DataFrame, steps: Sequence[Mapping]) -> DataFrame:
    """Routing that also sets the group of each copy by the accessor of its step."""
    table = inline_table(messages.sparkSession, list(steps), schemas.STEPS)
    return _with_group(route_steps(messages, table), _accessors(steps), True)


def group_affinity(receptions: DataFrame) -> DataFrame:
    """Per step and group, how many workers received its messages; more than one breaks affinity."""
    workers = receptions.groupBy("step", "group_id").agg(
        F.countDistinct("worker").alias("workers"), F.count(F.lit(1)).alias("messages")
    )
    return workers.withColumn("split", F.col("workers") > 1)


def group_exclusive(messages: DataFrame, partitions: int | None = None) -> DataFrame:
    """Messages in order within each group, and each group in one task: for functions with a state.

    This is what one exclusive worker per group means, so a group is never split; where only the order
    matters, ``group_ordered`` does without. Messages without a group are spread by their id.
    """
    home = F.when(F.col("group_id").isNull(), F.xxhash64("message_id")).otherwise(F.xxhash64("group_id"))
    spread = messages.repartition(partitions, home) if partitions else messages.repartition(home)
    return spread.sortWithinPartitions("group_id", "ts", "message_id")


def group_ordered(messages: DataFrame, partitions: int | None = None) -> DataFrame:
    """Messages in order within each group, for step functions that need the order.

    Ranges of (group, time, id) keep the order and still split a large group over many tasks.
    Messages without a group sort by time alone.
    """
    order = ["group_id", "ts", "message_id"]
    spread = (
        messages.repartitionByRange(partitions, *order)
        if partitions
        else messages.repartitionByRange(*order)
    )
    return spread.sortWithinPartitions(*order)


StepFunction = Callable[[DataFrame], DataFrame]


def step_order(steps: Sequence[Mapping]) -> list[Mapping]:
    """Steps so that each comes after the one it reads from; a cycle is an error."""
    waiting = {row["step"]: row for row in steps}
    ordered: list[Mapping] = []
    while waiting:
        ready = [n for n, row in waiting.items() if row["input_stream"] not in waiting]
        if not ready:
            raise ValueError(f"the steps form a cycle: {sorted(waiting)}")
        ordered += [waiting.pop(name) for name in ready]
    return ordered


def received_by(messages: DataFrame, step: Mapping) -> DataFrame:
    """What one step gets, with the groups its accessor gives. The step is known when the plan is made,
    so this is a filter and a projection; ``route_and_annotate`` does the same for many steps at once."""
    read = messages.filter(F.col("address") == f"{PREFIX}{step['input_stream']}.output")
    address = F.lit(f"{PREFIX}{step['step']}.input.{step['input_stream']}")
    sent = read.withColumn("address", address)
    if not step["key_source"]:
        return sent
    source, expression = step["key_source"], step["key_expr"]
    found = F.col("__key")
    key = object_text(found) if source == BODY_JSON else found
    keyed = sent.withColumn("__key", raw_group_key(source, expression))
    return keyed.withColumn("group_id", F.coalesce(key, "group_id")).drop("__key")


def run_step(messages: DataFrame, step: Mapping, function: StepFunction | None) -> DataFrame:
    """The output of one step: its function on what it receives, sent to its output address."""
    received = received_by(messages, step)
    output = received if function is None else function(received)
    return output.withColumn("address", F.lit(f"{PREFIX}{step['step']}.output"))


def run_steps(
    messages: DataFrame, steps: Sequence[Mapping], functions: Mapping[str, StepFunction]
) -> dict[str, DataFrame]:
    """Chain the user's step functions: what one step gives out feeds the steps that read it.

    A function gets the messages of its step with their ``group_id`` and returns messages; the
    result holds the output of every step, sent to the step's output address. In batch, an output
    that several steps read is written once; in a stream each output is a sink of its own.
    """
    outputs: dict[str, DataFrame] = {}
    readers = Counter(row["input_stream"] for row in steps)
    for row in step_order(steps):
        source = outputs.get(row["input_stream"], messages)
        output = run_step(source, row, functions.get(row["step"]))
        if readers[row["step"]] > 1 and not output.isStreaming:
            output = materialize(output, f"output-{row['step']}")
        outputs[row["step"]] = output
    return outputs


def conjunction(conditions: Sequence[Column | None]) -> Column:
    """All given conditions; an absent one is no constraint."""
    given = [c for c in conditions if c is not None]
    return functools.reduce(lambda a, b: a & b, given, F.lit(True))
