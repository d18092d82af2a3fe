"""Registered streaming queries: the stream runs over all there is and must equal the batch result."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.times import millis
from tidewire.operators import bridging, extract, jobs, lifecycle, lookup, routing, snapshots
from tidewire.plans import inputs
from tidewire.plans.catalog import LIFECYCLE, MESSAGES, ORACLES, SNAPSHOTS, query, with_
from tidewire.plans.inputs import HOUR_MS, JOB_STEPS, STEPS_SPEC
from tidewire.plans.queries_batch import (
    EXTRACT_SQL, FIRST_SQL, GROUP_SQL, LIFECYCLE_SQL, METRICS_SQL, QUEUE_METRICS, ROUTE_SQL, RULES,
    STEP_FUNCTIONS, STEP_NAMES, count_step_outputs, lifecycle_rows, log_rows, per_bucket, point_rows,
)
from tidewire.settings import scratch_path
from tidewire.sources import config, sinks
from tidewire.streaming import keyed, rates, runs

# Far after all data: passes every watermark, so that the last windows and open joins come out.
CLOSING_ID = -1


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream. The source wants a folder or a glob, so a single file is named by a glob."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return runs.stream_files(spark, f"{sf_dir}/{name}.parque[t]", schema)


def closed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream and, from a second source, one late row that closes what is open."""
    events = stream_table(spark, sf_dir, "events")
    path = scratch_path(spark, "closing")
    closing = spark.range(1).select(
        F.lit(CLOSING_ID).cast("bigint").alias("event_id"),
        F.lit("2100-01-01 00:00:00").cast("timestamp_ntz").alias("ts"),
        F.lit(CLOSING_ID).cast("bigint").alias("user_id"),
        F.lit("closing").alias("event_type"),
        F.lit(0.0).alias("value"),
        F.lit('{"k": 0}').alias("props"),
    )
    closing.write.parquet(path)
    return events.unionByName(runs.stream_files(spark, path, events.schema))


@query("route_steps_stream", ROUTE_SQL)
def _route_steps_stream(spark, sf_dir):
    sent = inputs.step_messages_of(stream_table(spark, sf_dir, "events"))
    routed = routing.route_steps(sent, config.load_pipeline(spark, STEPS_SPEC))
    return runs.run_to_table(routed.select("message_id", "step", "address"), "route-steps")


@query("annotate_group_stream", GROUP_SQL)
def _annotate_group_stream(spark, sf_dir):
    sent = inputs.step_messages_of(stream_table(spark, sf_dir, "events"))
    routed = routing.route_and_annotate(sent, config.parse_steps(STEPS_SPEC))
    return runs.run_to_table(routed.select("message_id", "step", "group_id"), "annotate-group")


@query("extract_points_stream", EXTRACT_SQL)
def _extract_points_stream(spark, sf_dir):
    sent = inputs.messages_of(stream_table(spark, sf_dir, "events"))
    return point_rows(runs.run_to_table(extract.extract_points(sent, RULES), "points"))


@query("points_streamed", ORACLES["points_by_bucket"])
def _points_streamed(spark, sf_dir):
    """Points written to the point store as a stream and read back."""
    path = scratch_path(spark, "point-stream")
    points = extract.extract_points(inputs.messages_of(stream_table(spark, sf_dir, "events")), RULES)
    sinks.stream_points(points, f"{path}/store", f"{path}/checkpoint", interval=None).awaitTermination()
    return per_bucket(sinks.read_points(spark, f"{path}/store", points.schema))


@query("first_publish_stream", FIRST_SQL)
def _first_publish_stream(spark, sf_dir):
    log = inputs.two_node_log_of(stream_table(spark, sf_dir, "events"))
    fresh = runs.first_publish_stream(log).select(F.col("original_message_id").alias("original_id"), "address")
    return runs.run_to_table(fresh, "first-publish")


def _correlated_stream(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    events = closed_events(spark, sf_dir)
    published = inputs.published_of(events)
    acknowledged = inputs.acknowledged_of(events)
    return published, runs.correlate_lifecycle_stream(published, inputs.delivered_of(events), acknowledged, within="1 hour")


@query("lifecycle_joined_stream", LIFECYCLE_SQL)
def _lifecycle_joined_stream(spark, sf_dir):
    _, correlated = _correlated_stream(spark, sf_dir)
    rows = runs.run_to_table(lifecycle_rows(correlated), "lifecycle")
    return rows.filter(F.col("message_id") != CLOSING_ID)


@query("lifecycle_metrics_stream", METRICS_SQL)
def _lifecycle_metrics_stream(spark, sf_dir):
    published, correlated = _correlated_stream(spark, sf_dir)
    events = runs.events_from_stream(published, correlated)
    rows = runs.run_to_table(lifecycle.lifecycle_metrics(events), "lifecycle-metrics")
    return rows.filter(F.col("message_id") != CLOSING_ID)


@query("lifecycle_two_nodes_stream", ORACLES["lifecycle_two_nodes"])
def _lifecycle_two_nodes_stream(spark, sf_dir):
    """Redelivered messages and messages of a second node, correlated as they come in."""
    events = inputs.two_node_lifecycle_of(closed_events(spark, sf_dir))
    correlated = runs.correlate_lifecycle_stream(*events, within="1 hour")
    rows = runs.run_to_table(lifecycle_rows(correlated), "two-nodes")
    return rows.filter(F.col("message_id") != CLOSING_ID)


@query(
    "queue_metrics_stream",
    with_(SNAPSHOTS, QUEUE_METRICS, select="""
SELECT prefix || '_' || m || '_SENSOR' AS name, v AS value, time_ms AS timestamp FROM queue_metrics"""),
)
def _queue_metrics_stream(spark, sf_dir):
    """States, consumers and groups kept per micro-batch, snapshots formed from all of them."""
    path = scratch_path(spark, "queue-metrics")
    timed = inputs.queue_messages_of(stream_table(spark, sf_dir, "events"))
    runs.store_states(timed, HOUR_MS, f"{path}/states", f"{path}/checkpoint").awaitTermination()
    return snapshots.queue_metrics(runs.snapshots_from_store(spark, f"{path}/states", HOUR_MS))


@query("first_match_stream", ORACLES["find_first"])
def _first_match_stream(spark, sf_dir):
    """A stream that ends with the first message of an application that has a high key."""
    log = lookup.stored_log(inputs.messages_of(stream_table(spark, sf_dir, "events")))
    high = F.get_json_object("body", "$.props.k").cast("bigint") > 50
    checkpoint = scratch_path(spark, "first-match")
    row = runs.first_match(log, checkpoint, application="app-3", predicate=high, interval=None)
    return log_rows(spark.createDataFrame([row] if row else [], log.schema))


@query("job_state_stream", ORACLES["job_state"])
def _job_state_stream(spark, sf_dir):
    path = scratch_path(spark, "jobs")
    parsed = jobs.parse_outputs(inputs.job_outputs_of(stream_table(spark, sf_dir, "orders")), JOB_STEPS, [jobs.DONE])
    runs.store_job_state(parsed, JOB_STEPS, f"{path}/jobs", f"{path}/checkpoint").awaitTermination()
    return runs.jobs_from_store(spark, f"{path}/jobs", JOB_STEPS)


@query("step_functions_stream", ORACLES["step_functions"])
def _step_functions_stream(spark, sf_dir):
    """The steps of a pipeline as streams of their own, each reading what the one before wrote."""
    path = scratch_path(spark, "steps")
    source = inputs.messages_of(stream_table(spark, sf_dir, "events"))
    source = source.withColumn("address", F.lit("iotdpp.src.output"))
    runs.run_steps_stream(source, config.parse_steps(STEPS_SPEC), STEP_FUNCTIONS, path)
    return count_step_outputs({step: runs.step_output(spark, path, step) for step in STEP_NAMES})


@query(
    "stateful_step_stream",
    with_(MESSAGES, select="""
SELECT message_id, 'g-' || k AS group_id, row_number() OVER w AS place, CAST(sum(cents) OVER w AS BIGINT) AS total
FROM messages WINDOW w AS (PARTITION BY k ORDER BY us, message_id)"""),
)
def _stateful_step_stream(spark, sf_dir):
    """A step with a state: it numbers the messages of each group and adds up their values."""
    sent = inputs.messages_of(stream_table(spark, sf_dir, "events")).select(
        "message_id", "ts",
        F.concat(F.lit("g-"), F.get_json_object("body", "$.props.k")).alias("group_id"),
        F.get_json_object("body", "$.cents").cast("bigint").alias("cents"),
    )
    counted = keyed.with_state(
        sent, ["group_id"], running_count, "n bigint, total bigint",
        "message_id bigint, group_id string, place bigint, total bigint", order=["ts", "message_id"],
    )
    return runs.run_to_table(counted, "stateful-step")


def running_count(key, state, rows):
    """Place and running total of the messages of a group; the state is how far both have come."""
    n, total = state or (0, 0)
    places, totals = n + pd.RangeIndex(1, len(rows) + 1), total + rows["cents"].cumsum()
    out = pd.DataFrame({"message_id": rows["message_id"], "group_id": key[0], "place": places, "total": totals})
    return (int(places[-1]), int(totals.iloc[-1])), out


@query(
    "add_rate_stream",
    with_(MESSAGES, select="""
, windows AS (SELECT event_type AS queue, (us // 3600000000 + 1) * 3600000 AS time_ms, count(*) AS n FROM messages GROUP BY 1, 2),
totals AS (SELECT queue, time_ms, n, CAST(sum(n) OVER (PARTITION BY queue ORDER BY time_ms) AS BIGINT) AS messages_added FROM windows)
SELECT queue, time_ms, messages_added,
       coalesce(n / ((time_ms - lag(time_ms) OVER (PARTITION BY queue ORDER BY time_ms)) / 1000e0), 0e0) AS messages_added_frequency
FROM totals"""),
)
def _add_rate_stream(spark, sf_dir):
    """Totals and rates per queue and hour; the previous count of a queue is its state."""
    sent = inputs.published_of(closed_events(spark, sf_dir)).withColumn(
        "queue", F.substring_index("queue", ".", -1)
    )
    added = rates.added_per_window(sent, "1 hour")
    stored = runs.run_to_table(rates.add_rates_stream(added), "rates").filter(F.col("queue") != "closing")
    return stored.withColumn("time_ms", millis(F.col("time"))).drop("time")


@query("app_registry_stream", ORACLES["app_registry"])
def _app_registry_stream(spark, sf_dir):
    path = scratch_path(spark, "registry")
    sent = inputs.definitions_of(stream_table(spark, sf_dir, "events"))
    definitions = bridging.app_definitions(sent, "cluster.define", ["BRIDGE_SECRET"])
    runs.store_registry(definitions, f"{path}/apps", f"{path}/checkpoint").awaitTermination()
    return runs.registry_from_store(spark, f"{path}/apps").select(
        "application_id", "message_id", millis(F.col("ts")).alias("ts_ms")
    )


@query("request_reply_stream", ORACLES["request_reply"])
def _request_reply_stream(spark, sf_dir):
    events = closed_events(spark, sf_dir)
    # the closing row counts as a request, so that the watermark passes all others
    asked = events.withColumn(
        "event_type", F.when(F.col("event_id") == CLOSING_ID, "purchase").otherwise(F.col("event_type"))
    )
    matched = runs.request_reply_stream(inputs.requests_of(asked), replies_and_closing(asked), within="1 hour")
    rows = runs.run_to_table(matched, "request-reply").filter(F.col("request_id") != CLOSING_ID)
    return rows.select(
        "request_id",
        "correlation_id",
        "application_id",
        "reply_id",
        "subject",
        (millis(F.col("reply_ts")) - millis(F.col("request_ts"))).alias("waited_ms"),
    )


def replies_and_closing(events: DataFrame) -> DataFrame:
    closing = inputs.requests_of(events.filter(F.col("event_id") == CLOSING_ID))
    return inputs.replies_of(events).unionByName(closing.withColumn("correlation_id", F.lit("closing")))
