"""Jobs that pass the steps of a pipeline: state, status and latencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.times import millis

# Fixed value: where the step stands in an output topic.
STEP_IN_TOPIC = r".*/(.*)/output"
SOURCE = "src"

DONE = "completion_timestamp"
STEP_FIELDS = ("duration", "worker_id", DONE)


def parse_outputs(outputs: DataFrame, steps: Sequence[str], fields: Sequence[str] = STEP_FIELDS) -> DataFrame:
    """``topic, body, ts`` to ``message_id, step, ts`` and one object per step, from one parse.

    State and latency need the field ``DONE`` only; reading the others costs as much again.
    """
    step_object = ",".join(f"{field}:string" for field in fields)
    objects = ",".join(f"{step}:struct<{step_object}>" for step in steps)
    schema = f"struct<message_id:bigint,{SOURCE}:struct<{DONE}:string>,{objects}>"
    step = F.regexp_extract("topic", STEP_IN_TOPIC, 1)
    return outputs.select(
        F.from_json("body", schema).alias("p"), F.when(step != "", step).alias("step"), "ts"
    ).select("p.*", "step", "ts")


def merge_step_outputs(parsed: DataFrame, steps: Sequence[str]) -> DataFrame:
    """Per message the newest object of each step.

    A message on the output topic of a step renews the object of that step only; what the first
    message held stays until then.
    """
    newest = [
        F.coalesce(
            F.max_by(F.col(step), F.when(F.col("step") == step, F.col("ts"))),
            F.min_by(F.col(step), F.col("ts")),
        ).alias(step)
        for step in steps
    ]
    return parsed.groupBy("message_id").agg(F.min_by(SOURCE, "ts").alias(SOURCE), *newest)


def completed_at(obj: str) -> Column:
    return F.try_to_timestamp(F.col(f"{obj}.{DONE}"))


def completions(parsed: DataFrame, steps: Sequence[str]) -> DataFrame:
    """``merge_step_outputs`` for the completion times alone, in milliseconds.

    The values have a fixed width, so this is a hash aggregation without sorting.
    """
    times = parsed.select(
        "message_id",
        "step",
        millis(F.col("ts")).alias("at"),
        *[millis(completed_at(name)).alias(name) for name in (SOURCE, *steps)],
    )
    newest = [
        F.coalesce(
            F.max_by(F.col(step), F.when(F.col("step") == step, F.col("at"))),
            F.min_by(F.col(step), F.col("at")),
        ).alias(step)
        for step in steps
    ]
    return times.groupBy("message_id").agg(F.min_by(SOURCE, "at").alias(SOURCE), *newest)


def partial_completions(parsed: DataFrame, steps: Sequence[str]) -> DataFrame:
    """``completions`` of a part of the outputs, in a form that ``merge_completions`` can add up.

    Per step the newest output of its own and the first output of any, each with its time.
    """
    timed = parsed.select(
        "message_id", "step", millis(F.col("ts")).alias("at"),
        *[millis(completed_at(name)).alias(name) for name in (SOURCE, *steps)],
    )

    def seen(name: str) -> Column:
        return F.struct(F.col("at").alias("at"), F.col(name).alias("done"))

    own = [F.max(F.when(F.col("step") == name, seen(name))).alias(f"own_{name}") for name in steps]
    first = [F.min(seen(name)).alias(f"first_{name}") for name in (SOURCE, *steps)]
    return timed.groupBy("message_id").agg(*own, *first)


def merge_completions(partial: DataFrame) -> DataFrame:
    """One row per message from those of several parts."""
    columns = [c for c in partial.columns if c != "message_id"]
    merged = [(F.max(c) if c.startswith("own_") else F.min(c)).alias(c) for c in columns]
    return partial.groupBy("message_id").agg(*merged)


def merged_job_state(partial: DataFrame, steps: Sequence[str]) -> DataFrame:
    """``job_state`` from merged parts."""
    done = [F.coalesce(F.col(f"own_{s}.done"), F.col(f"first_{s}.done")).alias(s) for s in steps]
    rows = partial.select("message_id", F.col(f"first_{SOURCE}.done").alias(SOURCE), *done)
    return rows.withColumn("status", job_status(steps))


def job_status(steps: Sequence[str]) -> Column:
    """PENDING until the first step is done, COMPLETED when all are, ONGOING in between."""
    missing = F.lit(False)
    for step in steps:
        missing = missing | F.col(step).isNull()
    return F.when(F.col(steps[0]).isNull(), "PENDING").when(missing, "ONGOING").otherwise("COMPLETED")


def job_state(parsed: DataFrame, steps: Sequence[str]) -> DataFrame:
    """Completion times per message, with the status of the job."""
    return completions(parsed, steps).withColumn("status", job_status(steps))


def step_latency(done: DataFrame, inputs: dict[str, str]) -> DataFrame:
    """Latency of every completed step against its input step and against the source.

    ``done`` has one column of milliseconds per step; ``inputs`` names the input of each step. Whole
    seconds are cut off as the workers report them, fractions are what the dashboard shows.
    """
    rows = F.array(
        *[
            F.struct(
                F.lit(step).alias("step"),
                F.col(step).alias("done"),
                F.col(before).alias("input"),
                F.col(SOURCE).alias("source"),
            )
            for step, before in inputs.items()
        ]
    )
    long = done.select("message_id", F.explode(rows).alias("s")).select("message_id", "s.*")
    own, total = F.col("done") - F.col("input"), F.col("done") - F.col("source")

    def whole(ms: Column) -> Column:
        # towards zero
        return F.call_function("div", ms, F.lit(1000))

    return long.filter(F.col("done").isNotNull()).select(
        "message_id",
        "step",
        whole(own).alias("step_latency"),
        whole(total).alias("accumulated_latency"),
        (own / 1000.0).alias("step_seconds"),
        (total / 1000.0).alias("accumulated_seconds"),
    )
