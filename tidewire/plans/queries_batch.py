"""Registered queries for the table operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import filters, text
from tidewire.functions.attributes import unwrap
from tidewire.functions.times import millis
from tidewire.operators import access, bridging, extract, jobs, lifecycle, lookup, routing, snapshots
from tidewire.plans import inputs
from tidewire.plans.catalog import JOBS, LIFECYCLE, MESSAGES, SNAPSHOTS, STEPS, query, with_
from tidewire.plans.inputs import HOUR_MS, JOB_INPUTS, JOB_STEPS, STEPS_SPEC, messages, step_messages, table
from tidewire.settings import scratch_path
from tidewire.sources import config, sinks
from tidewire.sources.messages import read_messages
from tidewire.sources.roles import read_roles

# ---------------------------------------------------------------- messages and filters


@query(
    "messages_scan",
    with_(MESSAGES, select="""
SELECT event_type AS tail, count(*) AS messages, min(ms) AS first_ms, max(ms) AS last_ms,
       CAST(sum(length(body)) AS BIGINT) AS size
FROM messages GROUP BY 1"""),
)
def _messages_scan(spark, sf_dir):
    return messages(spark, sf_dir).groupBy(F.substring_index("address", ".", -1).alias("tail")).agg(
        F.count(F.lit(1)).alias("messages"),
        millis(F.min("ts")).alias("first_ms"),
        millis(F.max("ts")).alias("last_ms"),
        F.sum("size").alias("size"),
    )


@query(
    "addr_filter",
    with_(MESSAGES, select=r"""
SELECT message_id, address, user_id < 10 AND event_type = 'click' AS whole
FROM messages WHERE regexp_matches(address, 'users\.\d\.')"""),
)
def _addr_filter(spark, sf_dir):
    return (
        messages(spark, sf_dir)
        .filter(text.match_address(F.col("address"), r"users\.\d\.", mode="find"))
        .select(
            "message_id",
            "address",
            text.match_address(F.col("address"), r"data\.users\.\d\.click").alias("whole"),
        )
    )


@query(
    "messages_read",
    with_(MESSAGES, select="""
SELECT message_id, address, body, application, 'c' || message_id AS correlation_id, ms, length(body) AS size FROM messages"""),
)
def _messages_read(spark, sf_dir):
    """Messages stored as a log and read back in the message layout."""
    path = scratch_path(spark, "messages")
    messages(spark, sf_dir).write.parquet(path)
    return read_messages(spark, path).select(
        "message_id",
        "address",
        "body",
        bridging.prop("application").alias("application"),
        bridging.prop("correlation_id").alias("correlation_id"),
        millis(F.col("ts")).alias("ms"),
        "size",
    )


def _filtered(name: str, expression: str, where: str) -> None:
    sql = with_(MESSAGES, select=f" SELECT message_id, address FROM messages WHERE {where}")

    @query(name, sql)
    def run(spark, sf_dir):
        return filters.filter_messages(messages(spark, sf_dir), expression).select("message_id", "address")


_filtered("msg_filter_and", r".*\.(click|view)|$.props.k|AND", "event_type IN ('click', 'view') AND k IS NOT NULL")
_filtered("msg_filter_or", r".*\.click|$.props.none|OR", "event_type = 'click'")
_filtered("msg_filter_predicate", r"nothing|$.props[?(@.k<50)]|OR", "k < 50")
_filtered("msg_filter_type", r".*|$[?(@.type=='error')]|AND", "event_type = 'error'")

# ---------------------------------------------------------------- points

RULES = (
    extract.PointRule(
        filter=r"data\.users\..*\.(click|view|purchase)|$|AND",
        bucket=r"events_{ADDRESS|.*\.([^.]*)$|$1}",
        measurement="usage-{BODY|$.type}",
        tags=(r"ADDRESS|data\.users\.(\d+)\..*|uid:$1", "BODY|$|kind|$.type"),
        fields=("BODY|$|cents|$.cents", "BODY|$|label|$.type", "BODY|$|$.props"),
        time="BODY|$.date|TIMESTAMP",
    ),
    extract.PointRule(
        filter=r".*|$.props.k|AND",
        bucket="keys",
        measurement="k{BODY|$.props.k}",
        # only clicks have this form of address, the others are rejected
        tags=(r"ADDRESS|data\.users\.(\d+)\.click|uid:$1",),
        fields=("BODY|$.props|k|$.k",),
    ),
)

POINTS = """
points AS (
  SELECT message_id, 0 AS rule, 'events_' || event_type AS bucket, 'usage-' || event_type AS measurement, ms, user_id, event_type, cents, k
  FROM messages WHERE event_type IN ('click', 'view', 'purchase')
  UNION ALL
  SELECT message_id, 1, 'keys', 'k' || k, ms, user_id, NULL, NULL, k FROM messages WHERE event_type = 'click')
"""


def point_rows(points: DataFrame) -> DataFrame:
    """Points as one row per tag and field, in one pass."""

    def rows(kind: str, column: str, number: str | None = None, text_: str | None = None):
        def row(e):
            return F.struct(
                F.lit(kind).alias("kind"),
                e["key"].alias("key"),
                (e[number] if number else F.lit(None)).cast("bigint").alias("number"),
                (e[text_] if text_ else F.lit(None)).cast("string").alias("text"),
            )

        return F.transform(F.map_entries(column), row)

    entries = F.concat(
        rows("tag", "tags", text_="value"),
        rows("num", "fields_num", number="value"),
        rows("str", "fields_str", text_="value"),
    )
    columns = ("message_id", "rule", "bucket", "measurement", "time_ms")
    listed = points.withColumns({"time_ms": millis(F.col("time")), "entries": entries})
    rows = listed.select(*columns, F.explode_outer("entries").alias("e")).filter("e IS NOT NULL")
    return rows.select(*columns, "e.*")


EXTRACT_SQL = with_(MESSAGES, POINTS, select="""
, base AS (SELECT message_id, rule, bucket, measurement, ms AS time_ms, user_id, event_type, cents, k FROM points)
SELECT message_id, rule, bucket, measurement, time_ms, 'tag' AS kind, 'uid' AS key, CAST(NULL AS BIGINT) AS number, CAST(user_id AS VARCHAR) AS text FROM base
UNION ALL SELECT message_id, rule, bucket, measurement, time_ms, 'tag', 'kind', NULL, event_type FROM base WHERE rule = 0
UNION ALL SELECT message_id, rule, bucket, measurement, time_ms, 'num', 'cents', cents, NULL FROM base WHERE rule = 0
UNION ALL SELECT message_id, rule, bucket, measurement, time_ms, 'num', 'k', k, NULL FROM base
UNION ALL SELECT message_id, rule, bucket, measurement, time_ms, 'str', 'label', NULL, event_type FROM base WHERE rule = 0""")


@query("extract_points", EXTRACT_SQL)
def _extract_points(spark, sf_dir):
    return point_rows(extract.extract_points(messages(spark, sf_dir), RULES))


@query(
    "rejected_points",
    with_(MESSAGES, select=" SELECT message_id, 1 AS rule, 'tags' AS error FROM messages WHERE event_type <> 'click'"),
)
def _rejected_points(spark, sf_dir):
    return extract.rejected_points(messages(spark, sf_dir), RULES)


@query(
    "points_by_bucket",
    with_(MESSAGES, POINTS, select="""
SELECT bucket, measurement, count(*) AS points, CAST(sum(k) AS BIGINT) AS k_sum, min(ms) AS first_ms, max(ms) AS last_ms
FROM points GROUP BY 1, 2"""),
)
def points_by_bucket(spark, sf_dir):
    return per_bucket(extract.extract_points(messages(spark, sf_dir), RULES))


def per_bucket(points: DataFrame) -> DataFrame:
    return points.groupBy("bucket", "measurement").agg(
        F.count(F.lit(1)).alias("points"),
        F.sum(F.try_element_at("fields_num", F.lit("k"))).cast("bigint").alias("k_sum"),
        millis(F.min("time")).alias("first_ms"),
        millis(F.max("time")).alias("last_ms"),
    )


@query(
    "points_written",
    with_(MESSAGES, POINTS, select="""
SELECT bucket, measurement, count(*) AS points, CAST(sum(k) AS BIGINT) AS k_sum, min(ms) AS first_ms, max(ms) AS last_ms
FROM (SELECT * REPLACE (CASE WHEN rule = 1 AND k % 10 = 7 THEN '007' WHEN rule = 1 AND k % 10 = 8 THEN '' ELSE bucket END AS bucket) FROM points)
GROUP BY 1, 2"""),
)
def _points_written(spark, sf_dir):
    """All points written to the point store and read back; some buckets look like numbers or are empty."""
    path = scratch_path(spark, "points")
    points = extract.extract_points(messages(spark, sf_dir), RULES)
    last = F.when(F.col("rule") == 1, F.try_element_at("fields_num", F.lit("k")) % 10)
    bucket = F.when(last == 7, "007").when(last == 8, "").otherwise(F.col("bucket"))
    points = points.withColumn("bucket", bucket)
    sinks.write_points(points, path)
    return per_bucket(sinks.read_points(spark, path, points.schema))


@query(
    "missing_buckets",
    with_(MESSAGES, POINTS, select=" SELECT DISTINCT bucket FROM points WHERE bucket NOT IN ('keys', 'events_view')"),
)
def _missing_buckets(spark, sf_dir):
    known = config.inline_table(spark, [{"bucket": "keys"}, {"bucket": "events_view"}], "bucket string")
    return sinks.missing_buckets(extract.extract_points(messages(spark, sf_dir), RULES), known)


# ---------------------------------------------------------------- steps and groups


@query(
    "step_table",
    with_(MESSAGES, STEPS, select="""
SELECT step, input_stream, CASE step WHEN 'stepA' THEN 'BODY_JSON' WHEN 'stepB' THEN 'BODY_JSON' WHEN 'stepC' THEN 'PROPERTY' END AS key_source,
       CASE step WHEN 'stepA' THEN 'props.k' WHEN 'stepB' THEN '$.type' WHEN 'stepC' THEN 'application' END AS key_expr, count(*) AS messages
FROM steps JOIN stepped ON stream = input_stream GROUP BY 1, 2"""),
)
def _step_table(spark, sf_dir):
    """The steps with the messages each one gets."""
    routed = routing.route_steps(step_messages(spark, sf_dir), config.load_pipeline(spark, STEPS_SPEC))
    return routed.groupBy("step", "input_stream", "key_source", "key_expr").agg(F.count(F.lit(1)).alias("messages"))


@query(
    "step_addresses",
    with_(MESSAGES, STEPS, select="""
, forms AS (SELECT 'iotdpp.' || input_stream || '.output' AS address FROM steps
            UNION SELECT 'iotdpp.' || step || '.input.' || input_stream FROM steps
            UNION SELECT 'iotdpp.' || step || '.output' FROM steps),
sent AS (SELECT 'iotdpp.' || stream || '.output' AS address FROM stepped
         UNION ALL SELECT 'iotdpp.' || step || '.input.' || input_stream FROM steps JOIN stepped ON stream = input_stream)
SELECT forms.address, count(sent.address) AS messages FROM forms LEFT JOIN sent ON sent.address = forms.address GROUP BY 1"""),
)
def _step_addresses(spark, sf_dir):
    """Every address of the steps with the messages sent or copied to it."""
    steps = config.load_pipeline(spark, STEPS_SPEC)
    sent = step_messages(spark, sf_dir)
    copies = routing.route_steps(sent, steps).select("address")
    traffic = sent.select("address").unionByName(copies).groupBy("address").agg(F.count(F.lit(1)).alias("messages"))
    return routing.step_addresses(steps).join(traffic, "address", "left").fillna(0, "messages")


ROUTE_SQL = with_(MESSAGES, STEPS, select="""
SELECT message_id, step, 'iotdpp.' || step || '.input.' || input_stream AS address
FROM steps JOIN stepped ON stream = input_stream""")


@query("route_steps", ROUTE_SQL)
def _route_steps(spark, sf_dir):
    steps = config.load_pipeline(spark, STEPS_SPEC)
    return routing.route_steps(step_messages(spark, sf_dir), steps).select("message_id", "step", "address")


GROUP_SQL = with_(MESSAGES, STEPS, select="""
SELECT message_id, step, CASE step WHEN 'stepA' THEN CAST(k AS VARCHAR) WHEN 'stepB' THEN event_type WHEN 'stepC' THEN application END AS group_id
FROM steps JOIN stepped ON stream = input_stream""")


@query("annotate_group", GROUP_SQL)
def _annotate_group(spark, sf_dir):
    """Groups set as messages are copied to the steps."""
    routed = routing.route_and_annotate(step_messages(spark, sf_dir), config.parse_steps(STEPS_SPEC))
    return routed.select("message_id", "step", "group_id")


GROUP_KEYS = """{"iotdpp.src.output": {"source": "BODY_JSON", "expression": "props.k"},
                 "iotdpp.stepA.output": {"source": "PROPERTY", "expression": "application"}}"""


@query(
    "annotate_group_kept",
    with_(MESSAGES, STEPS, select="""
SELECT message_id, CASE WHEN message_id % 4 = 0 THEN 'given' WHEN stream = 'src' THEN CAST(k AS VARCHAR)
                        WHEN stream = 'stepA' THEN application END AS group_id FROM stepped"""),
)
def _annotate_group_kept(spark, sf_dir):
    """Groups set by address before a message is stored; a given group is kept."""
    given = F.when(F.col("message_id") % 4 == 0, "given")
    sent = step_messages(spark, sf_dir).withColumn("group_id", given)
    keys = config.parse_group_keys(inline=GROUP_KEYS)
    return routing.annotate_group(sent, keys).select("message_id", "group_id")


@query(
    "group_affinity",
    with_(MESSAGES, STEPS, select="""
, receptions AS (SELECT step, CASE step WHEN 'stepA' THEN CAST(k AS VARCHAR) WHEN 'stepB' THEN event_type WHEN 'stepC' THEN application END AS group_id,
                        CASE step WHEN 'stepA' THEN 'w-' || (k % 4) ELSE 'w-' || (message_id % 4) END AS worker
                 FROM steps JOIN stepped ON stream = input_stream)
SELECT step, group_id, count(DISTINCT worker) AS workers, count(*) AS messages, count(DISTINCT worker) > 1 AS split
FROM receptions GROUP BY 1, 2"""),
)
def _group_affinity(spark, sf_dir):
    """Step A keeps a group on one worker, the others spread by message."""
    routed = routing.route_and_annotate(step_messages(spark, sf_dir), config.parse_steps(STEPS_SPEC))
    k = F.get_json_object("body", "$.props.k").cast("bigint")
    by = F.when(F.col("step") == "stepA", k).otherwise(F.col("message_id")) % 4
    return routing.group_affinity(routed.select("step", "group_id", F.concat(F.lit("w-"), by).alias("worker")))


@query(
    "group_ordered",
    with_(MESSAGES, select="""
SELECT message_id, CAST(k AS VARCHAR) AS group_id, row_number() OVER (PARTITION BY k ORDER BY us, message_id) AS position,
       true AS one_task
FROM messages"""),
)
def _group_ordered(spark, sf_dir):
    """The place of each message in its group as a task meets it, and whether one task has the group."""
    keyed = messages(spark, sf_dir).select(
        "message_id", "ts", F.get_json_object("body", "$.props.k").alias("group_id")
    )
    met = routing.group_exclusive(keyed).select(
        "message_id", "group_id",
        F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("met"),
    )
    group = Window.partitionBy("group_id")
    one_task = F.min("task").over(group) == F.max("task").over(group)
    position = F.row_number().over(group.orderBy("met"))
    return met.select("message_id", "group_id", position.cast("bigint").alias("position"), one_task.alias("one_task"))


@query(
    "group_ranges",
    with_(MESSAGES, select="""
SELECT message_id, CAST(k AS VARCHAR) AS group_id, row_number() OVER (PARTITION BY k ORDER BY us, message_id) AS position
FROM messages"""),
)
def _group_ranges(spark, sf_dir):
    """The place of each message in its group as tasks meet it that share the groups by ranges."""
    keyed = messages(spark, sf_dir).select(
        "message_id", "ts", F.get_json_object("body", "$.props.k").alias("group_id")
    )
    met = routing.group_ordered(keyed).select("message_id", "group_id", F.monotonically_increasing_id().alias("met"))
    position = F.row_number().over(Window.partitionBy("group_id").orderBy("met"))
    return met.select("message_id", "group_id", position.cast("bigint").alias("position"))


@query(
    "drop_management",
    with_(MESSAGES, select="""
SELECT address, count(*) AS messages FROM messages WHERE message_id % 7 > 1 GROUP BY 1"""),
)
def _drop_management(spark, sf_dir):
    """Messages to the broker's own addresses (here two of seven) are dropped."""
    number = F.col("message_id") % 7
    own = F.when(number == 0, routing.MANAGEMENT[0]).when(number == 1, routing.MANAGEMENT[1]).otherwise(F.col("address"))
    kept = routing.drop_management(messages(spark, sf_dir).withColumn("address", own))
    return kept.groupBy("address").agg(F.count(F.lit(1)).alias("messages"))


@query(
    "monitored_queues",
    with_(MESSAGES, select="""
SELECT 'data.' || event_type AS queue, count(*) AS messages FROM messages
WHERE message_id % 5 <> 0 AND event_type IN ('click', 'view') GROUP BY 1"""),
)
def _monitored_queues(spark, sf_dir):
    """Queues of the broker itself (here every fifth message) and those that no pattern names are left out."""
    kind = F.substring_index("address", ".", -1)
    queue = F.when(F.col("message_id") % 5 == 0, F.concat(F.lit("$sys.data."), kind)).otherwise(F.concat(F.lit("data."), kind))
    kept = snapshots.monitored_queues(messages(spark, sf_dir).withColumn("queue", queue), r"data\.(click|view)")
    return kept.groupBy("queue").agg(F.count(F.lit(1)).alias("messages"))


@query(
    "strip_backslashes",
    with_(MESSAGES, select=" SELECT message_id, address FROM messages"),
)
def _strip_backslashes(spark, sf_dir):
    escaped = messages(spark, sf_dir).withColumn("address", F.replace("address", F.lit("."), F.lit("\\.")))
    return escaped.select("message_id", text.strip_backslashes(F.col("address")).alias("address"))


@query(
    "step_functions",
    with_(MESSAGES, select="""
, a AS (SELECT * FROM messages WHERE k % 2 = 0), d AS (SELECT * FROM a WHERE event_type <> 'view')
SELECT 'stepA' AS step, 'iotdpp.stepA.output' AS address, application, count(*) AS messages FROM a GROUP BY 1, 2, 3
UNION ALL SELECT 'stepB', 'iotdpp.stepB.output', application, count(*) FROM a GROUP BY 1, 2, 3
UNION ALL SELECT 'stepC', 'iotdpp.stepC.output', application, count(*) FROM a GROUP BY 1, 2, 3
UNION ALL SELECT 'stepD', 'iotdpp.stepD.output', application, count(*) FROM d GROUP BY 1, 2, 3"""),
)
def _step_functions(spark, sf_dir):
    """User functions on the steps: A keeps even keys, D drops views."""
    source = messages(spark, sf_dir).withColumn("address", F.lit("iotdpp.src.output"))
    return count_step_outputs(routing.run_steps(source, config.parse_steps(STEPS_SPEC), STEP_FUNCTIONS))


STEP_NAMES = ("stepA", "stepB", "stepC", "stepD")
STEP_FUNCTIONS = {
    "stepA": lambda df: df.filter(F.col("group_id").cast("bigint") % 2 == 0),
    "stepD": lambda df: df.filter(F.get_json_object("body", "$.type") != "view"),
}


def count_step_outputs(outputs):
    counted = [
        out.groupBy(F.lit(step).alias("step"), "address", bridging.prop("application").alias("application")).agg(
            F.count(F.lit(1)).alias("messages")
        )
        for step, out in outputs.items()
    ]
    result = counted[0]
    for part in counted[1:]:
        result = result.unionByName(part)
    return result


# ---------------------------------------------------------------- origin and lifecycle


@query(
    "new_publishes",
    with_(MESSAGES, select=" SELECT event_type, count(*) AS messages FROM messages GROUP BY 1"),
)
def _new_publishes(spark, sf_dir):
    fresh = lifecycle.new_publishes(inputs.two_node_log(spark, sf_dir))
    return fresh.groupBy(F.substring_index("address", ".", -1).alias("event_type")).agg(
        F.count(F.lit(1)).alias("messages")
    )


FIRST_SQL = with_(MESSAGES, select=" SELECT event_id AS original_id, address FROM messages")


@query("first_publish", with_(MESSAGES, select=" SELECT event_id AS original_id, message_id, ms AS ts_ms, address FROM messages"))
def _first_publish(spark, sf_dir):
    return lifecycle.first_publish(inputs.two_node_log(spark, sf_dir)).select(
        F.coalesce("original_message_id", "message_id").alias("original_id"),
        "message_id",
        millis(F.col("ts")).alias("ts_ms"),
        "address",
    )


@query(
    "stamp_origin",
    with_(MESSAGES, select="""
SELECT message_id, 'node-b' AS receiving_node, message_id AS original_message_id FROM messages
UNION ALL SELECT message_id + 1000000000, 'node-a', message_id FROM messages WHERE message_id % 3 = 0"""),
)
def _stamp_origin(spark, sf_dir):
    return lifecycle.stamp_origin(inputs.two_node_log(spark, sf_dir), "node-b").select(
        "message_id", "receiving_node", "original_message_id"
    )


def _lifecycle_inputs(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return inputs.published_of(events), inputs.delivered_of(events), inputs.acknowledged_of(events)


def lifecycle_rows(correlated: DataFrame) -> DataFrame:
    return correlated.select(
        "message_id", "queue", "consumer", "publish_queue", "publish_client_id", "message_size",
        millis(F.col("publish_ts")).alias("publish_ms"),
        millis(F.col("deliver_ts")).alias("deliver_ms"),
        millis(F.col("ack_ts")).alias("ack_ms"),
    )


LIFECYCLE_SQL = with_(LIFECYCLE, select="""
SELECT event_id AS message_id, queue, 'w-' || (k % 4) AS consumer, 'data.' || event_type AS publish_queue,
       'client-' || user_id AS publish_client_id, size AS message_size,
       publish_us // 1000 AS publish_ms, deliver_us // 1000 AS deliver_ms, ack_us // 1000 AS ack_ms
FROM received""")


@query("lifecycle_joined", LIFECYCLE_SQL)
def _lifecycle_joined(spark, sf_dir):
    return lifecycle_rows(lifecycle.correlate_lifecycle(*_lifecycle_inputs(spark, sf_dir)))


@query(
    "lifecycle_two_nodes",
    with_(LIFECYCLE, select="""
, d AS (SELECT event_id, queue, 'w-' || (k % 4) AS consumer, deliver_us FROM received
        UNION ALL SELECT event_id, queue, 'w-again', deliver_us + 10000000 FROM received WHERE event_id % 7 = 0),
a AS (SELECT event_id, queue, ack_us FROM received WHERE ack_us IS NOT NULL
      UNION ALL SELECT event_id, queue, deliver_us + 12000000 FROM received WHERE event_id % 7 = 0),
-- the latest delivery not after an acknowledgement gets it
latest AS (SELECT a.event_id, a.queue, a.ack_us, max(d.deliver_us) AS deliver_us
           FROM a JOIN d ON d.event_id = a.event_id AND d.queue = a.queue AND d.deliver_us <= a.ack_us GROUP BY ALL),
acked AS (SELECT event_id, queue, deliver_us, min(ack_us) AS ack_us FROM latest GROUP BY ALL),
p AS (SELECT DISTINCT event_id, event_type, user_id, size, publish_us FROM received)
SELECT d.event_id AS message_id, d.queue, d.consumer, 'data.' || event_type AS publish_queue,
       'client-' || user_id AS publish_client_id, size AS message_size,
       publish_us // 1000 AS publish_ms, d.deliver_us // 1000 AS deliver_ms, acked.ack_us // 1000 AS ack_ms
FROM d JOIN p ON p.event_id = d.event_id
LEFT JOIN acked ON acked.event_id = d.event_id AND acked.queue = d.queue AND acked.deliver_us = d.deliver_us"""),
)
def _lifecycle_two_nodes(spark, sf_dir):
    """Redelivered messages and messages handled by a second node under another id."""
    return lifecycle_rows(
        lifecycle.correlate_lifecycle(*inputs.two_node_lifecycle_of(table(spark, sf_dir, "events")))
    )


METRICS = """
metrics AS (
  SELECT DISTINCT event_id AS message_id, 'data_' || event_type || '_MessagePublished_Size_SENSOR' AS name, size AS value, publish_us // 1000 AS timestamp FROM received
  UNION ALL SELECT event_id, replace(queue, '.', '_') || '_MessageDelivered_Size_SENSOR', size, deliver_us // 1000 FROM received
  UNION ALL SELECT event_id, replace(queue, '.', '_') || '_MessageAcknowledged_Size_SENSOR', size, ack_us // 1000 FROM received WHERE ack_us IS NOT NULL
  UNION ALL SELECT event_id, replace(queue, '.', '_') || '_MessageDelivered_Latency_SENSOR', deliver_us // 1000 - publish_us // 1000, deliver_us // 1000 FROM received
  UNION ALL SELECT event_id, replace(queue, '.', '_') || '_MessageAcknowledged_Latency_SENSOR', ack_us // 1000 - publish_us // 1000, ack_us // 1000 FROM received WHERE ack_us IS NOT NULL)
"""

METRICS_SQL = with_(LIFECYCLE, METRICS, select=" SELECT message_id, name, CAST(value AS DOUBLE) AS value, timestamp FROM metrics")


@query("lifecycle_metrics", METRICS_SQL)
def _lifecycle_metrics(spark, sf_dir):
    return lifecycle.lifecycle_metrics(lifecycle.lifecycle_events(*_lifecycle_inputs(spark, sf_dir)))


@query(
    "lifecycle_events",
    with_(LIFECYCLE, select="""
, events_ AS (
  SELECT DISTINCT 'Published' AS event_type, 'data.' || event_type AS queue, publish_us AS us, publish_us, NULL::BIGINT AS deliver_us, event_id FROM received
  UNION ALL SELECT 'Delivered', queue, deliver_us, publish_us, NULL, event_id FROM received
  UNION ALL SELECT 'Acknowledged', queue, ack_us, publish_us, deliver_us, event_id FROM received WHERE ack_us IS NOT NULL)
SELECT event_type, event_id AS message_id, queue AS message_queue, us // 1000 AS ms, publish_us // 1000 AS publish_ms, deliver_us // 1000 AS deliver_ms
FROM events_"""),
)
def _lifecycle_events(spark, sf_dir):
    events = lifecycle.monitored(
        lifecycle.lifecycle_events(*_lifecycle_inputs(spark, sf_dir)), r"data\..*", "message_queue"
    )
    return events.select(
        "event_type",
        "message_id",
        "message_queue",
        millis(F.col("ts")).alias("ms"),
        millis(F.col("publish_ts")).alias("publish_ms"),
        millis(F.col("deliver_ts")).alias("deliver_ms"),
    )


@query(
    "metric_payloads",
    with_(LIFECYCLE, METRICS, select="""
SELECT 'monitoring.' || name AS topic, '{"metricValue":' || value || '.0,"level":1,"timestamp":' || timestamp || '}' AS payload
FROM metrics"""),
)
def _metric_payloads(spark, sf_dir):
    return sinks.encode_metrics(_lifecycle_metrics(spark, sf_dir), "monitoring.")


# ---------------------------------------------------------------- jobs


def _completion_times(spark, sf_dir) -> DataFrame:
    return jobs.parse_outputs(inputs.job_outputs(spark, sf_dir), JOB_STEPS, [jobs.DONE])


@query(
    "job_state",
    with_(JOBS, select="""
SELECT *, CASE WHEN "stepA" IS NULL THEN 'PENDING'
               WHEN "stepB" IS NOT NULL AND "stepC" IS NOT NULL AND "stepD" IS NOT NULL THEN 'COMPLETED' ELSE 'ONGOING' END AS status
FROM jobs"""),
)
def _job_state(spark, sf_dir):
    return jobs.job_state(_completion_times(spark, sf_dir), JOB_STEPS)


@query(
    "merged_step_outputs",
    with_(JOBS, select="""
, long AS (SELECT message_id, 'stepA' AS step, "stepA" AS done FROM jobs UNION ALL SELECT message_id, 'stepB', "stepB" FROM jobs
           UNION ALL SELECT message_id, 'stepC', "stepC" FROM jobs UNION ALL SELECT message_id, 'stepD', "stepD" FROM jobs)
SELECT message_id, step, '1' AS duration, CASE WHEN done IS NOT NULL THEN 'w-' || (message_id % 4) END AS worker_id, done AS done_ms FROM long"""),
)
def _merged_step_outputs(spark, sf_dir):
    merged = jobs.merge_step_outputs(jobs.parse_outputs(inputs.job_outputs(spark, sf_dir), JOB_STEPS), JOB_STEPS)
    rows = F.array(*[F.struct(F.lit(s).alias("step"), F.col(s).alias("o")) for s in JOB_STEPS])
    return merged.select("message_id", F.explode(rows).alias("r")).select(
        "message_id",
        "r.step",
        "r.o.duration",
        "r.o.worker_id",
        millis(F.try_to_timestamp("r.o.completion_timestamp")).alias("done_ms"),
    )


@query(
    "step_latency",
    with_(JOBS, select="""
, long AS (SELECT message_id, 'stepA' AS step, "stepA" AS done, src AS input, src FROM jobs
           UNION ALL SELECT message_id, 'stepB', "stepB", "stepA", src FROM jobs
           UNION ALL SELECT message_id, 'stepC', "stepC", "stepB", src FROM jobs
           UNION ALL SELECT message_id, 'stepD', "stepD", "stepA", src FROM jobs)
SELECT message_id, step, CAST(trunc((done - input) / 1000e0) AS BIGINT) AS step_latency, CAST(trunc((done - src) / 1000e0) AS BIGINT) AS accumulated_latency,
       (done - input) / 1000e0 AS step_seconds, (done - src) / 1000e0 AS accumulated_seconds
FROM long WHERE done IS NOT NULL"""),
)
def _step_latency(spark, sf_dir):
    done = jobs.completions(_completion_times(spark, sf_dir), JOB_STEPS)
    return jobs.step_latency(done, JOB_INPUTS)


# ---------------------------------------------------------------- bridging and requests


def _bridge_log(spark, sf_dir) -> DataFrame:
    """Messages to topics of an application, some already bridged; every sixth user is a bridge user."""
    sent = messages(spark, sf_dir)
    bridged = F.when(
        F.col("message_id") % 7 == 0, F.map_concat("properties", F.create_map(F.lit("NEB_BRIDGED"), F.lit("true")))
    ).otherwise(F.col("properties"))
    user_id = F.regexp_extract("user", r"(\d+)", 1).cast("bigint")
    kind = F.when(user_id % 6 == 0, F.concat(F.lit("bridge-app-"), user_id % 10)).when(
        user_id % 6 == 1, F.concat(F.lit("bridgeapp-"), user_id % 5)
    ).otherwise(F.col("user"))
    scheme = F.when(F.col("message_id") % 2 == 0, "topic://").otherwise("")
    topic = F.concat(scheme, F.lit("data."), F.substring_index("address", ".", -1))
    return sent.withColumns({"properties": bridged, "user": kind, "address": topic})


@query(
    "bridge_messages",
    with_(MESSAGES, select="""
SELECT message_id, application, 'true' AS bridged FROM messages WHERE application = 'app-1' AND message_id % 7 <> 0"""),
)
def _bridge_messages(spark, sf_dir):
    return bridging.bridge_messages(_bridge_log(spark, sf_dir), "app-1").select(
        "message_id",
        bridging.prop("application").alias("application"),
        bridging.prop(bridging.BRIDGED).alias("bridged"),
    )


@query(
    "bridge_allowlist",
    with_(MESSAGES, select=" SELECT message_id, 'data.' || event_type AS topic FROM messages WHERE event_type IN ('click', 'error')"),
)
def _bridge_allowlist(spark, sf_dir):
    topics = config.inline_table(spark, [{"topic": "data.click"}, {"topic": "data.error"}], "topic string")
    allowed = bridging.allowed_topics(_bridge_log(spark, sf_dir), topics)
    return allowed.select("message_id", text.normalize_topic(F.col("address")).alias("topic"))


@query(
    "sender_audit",
    with_(MESSAGES, select="""
SELECT message_id, CASE user_id % 6 WHEN 0 THEN 'app-' || (user_id % 10) = application WHEN 1 THEN false ELSE true END AS accepted
FROM messages"""),
)
def _sender_audit(spark, sf_dir):
    return bridging.audit_senders(_bridge_log(spark, sf_dir)).select("message_id", "accepted")


@query(
    "sender_rejections",
    with_(MESSAGES, select="""
SELECT application, count(*) AS rejected FROM messages
WHERE user_id % 6 = 1 OR (user_id % 6 = 0 AND 'app-' || (user_id % 10) <> application) GROUP BY 1"""),
)
def _sender_rejections(spark, sf_dir):
    _, rejected = bridging.authorize_senders(_bridge_log(spark, sf_dir))
    return rejected.groupBy(bridging.prop("application").alias("application")).agg(
        F.count(F.lit(1)).alias("rejected")
    )


DEFINITIONS = """
definitions AS (
  SELECT event_id AS message_id, 'app-' || user_id AS application_id, epoch_us(ts) // 1000 AS ms, epoch_us(ts) AS us
  FROM events WHERE event_type = 'signup' AND event_id % 3 <> 0)
"""

REGISTRY = """
registry AS (SELECT application_id, min_by(message_id, us) AS message_id, min(ms) AS ts_ms FROM definitions GROUP BY 1)
"""

REQUESTS = """
requests AS (
  SELECT event_id AS message_id, 'app-' || user_id AS application_id,
         CASE WHEN event_id % 11 <> 0 THEN 'c' || event_id END AS correlation_id, epoch_us(ts) // 1000 AS ms
  FROM events WHERE event_type = 'purchase')
"""


def _definitions(spark, sf_dir) -> DataFrame:
    return bridging.app_definitions(
        inputs.definitions_of(table(spark, sf_dir, "events")), "cluster.define", ["BRIDGE_SECRET"]
    )


def _requests(spark, sf_dir) -> DataFrame:
    return inputs.requests_of(table(spark, sf_dir, "events"))


@query("app_definitions", with_(DEFINITIONS, select=" SELECT message_id, application_id, ms AS ts_ms FROM definitions"))
def _app_definitions(spark, sf_dir):
    return _definitions(spark, sf_dir).select("message_id", "application_id", millis(F.col("ts")).alias("ts_ms"))


@query("app_registry", with_(DEFINITIONS, REGISTRY, select=" SELECT * FROM registry"))
def _app_registry(spark, sf_dir):
    return bridging.app_registry(_definitions(spark, sf_dir)).select(
        "application_id", "message_id", millis(F.col("ts")).alias("ts_ms")
    )


@query(
    "registered_requests",
    with_(DEFINITIONS, REGISTRY, REQUESTS, select="""
SELECT message_id, application_id FROM requests WHERE application_id IN (SELECT application_id FROM registry)"""),
)
def _registered_requests(spark, sf_dir):
    registry = bridging.app_registry(_definitions(spark, sf_dir))
    return bridging.registered_requests(_requests(spark, sf_dir), registry).select("message_id", "application_id")


@query(
    "unanswered_requests",
    with_(DEFINITIONS, REGISTRY, REQUESTS, select="""
SELECT message_id, application_id, 'app_' || application_id || '_bucket' AS bucket FROM requests
WHERE application_id NOT IN (SELECT application_id FROM registry
                             WHERE application_id IN (SELECT 'app-' || user_id FROM events
                                                      WHERE event_type = 'error' AND user_id % 4 <> 0))"""),
)
def _unanswered_requests(spark, sf_dir):
    """Registered applications whose bridge has reported (here: raised an error event, which every fourth
    application does not) are bridged."""
    reported = table(spark, sf_dir, "events").filter((F.col("event_type") == "error") & (F.col("user_id") % 4 != 0))
    reported = reported.select(F.concat(F.lit("app-"), F.col("user_id")).alias("application_id"))
    bridged = bridging.app_registry(_definitions(spark, sf_dir)).join(reported, "application_id", "left_semi")
    return bridging.unanswered_requests(_requests(spark, sf_dir), bridged).select(
        "message_id", "application_id", "bucket"
    )


@query(
    "request_reply",
    with_(REQUESTS, select="""
SELECT message_id AS request_id, correlation_id, application_id,
       CASE WHEN message_id % 2 = 0 AND correlation_id IS NOT NULL THEN message_id + 1000000000 END AS reply_id,
       CASE WHEN message_id % 2 = 0 AND correlation_id IS NOT NULL THEN application_id END AS subject,
       CASE WHEN message_id % 2 = 0 AND correlation_id IS NOT NULL THEN CAST(1500 AS BIGINT) END AS waited_ms
FROM requests"""),
)
def _request_reply(spark, sf_dir):
    replies = inputs.replies_of(table(spark, sf_dir, "events"))
    return bridging.request_reply(_requests(spark, sf_dir), replies).select(
        "request_id",
        "correlation_id",
        "application_id",
        "reply_id",
        "subject",
        (millis(F.col("reply_ts")) - millis(F.col("request_ts"))).alias("waited_ms"),
    )


# ---------------------------------------------------------------- patterns, roles, policies

PATTERNS = {
    "everything": ">",
    "clicks": "data.users.*.click",
    "user7": "data.users.7.>",
    "any7": "data.*.7.*",
    "views": "#.view",
    "exact": "data.users.11.error",
    "inner": "data.>.7.>",
    "short": "data.users.*",
    "data": "data.#",
    "other": "logs.>",
}
PATTERN_VALUES = ", ".join(f"('{name}', '{pattern}')" for name, pattern in PATTERNS.items())


@query(
    "subscription_match",
    with_(MESSAGES, select=rf"""
, subs(subscription, pattern) AS (VALUES {PATTERN_VALUES}),
regexes AS (SELECT *, replace(replace(replace(replace(replace('.' || pattern, '#', '>'), '.>', '@'), '.*', '%'), '.', '\.'), '%', '\.[^.]+') AS r FROM subs),
traffic AS (SELECT address, count(*) AS messages FROM messages GROUP BY 1)
SELECT subscription, pattern, address, messages
FROM traffic JOIN regexes ON regexp_full_match('.' || address, replace(r, '@', '(\.[^.]+)*'))"""),
)
def _subscription_match(spark, sf_dir):
    rows = [{"subscription": name, "pattern": pattern} for name, pattern in PATTERNS.items()]
    subscriptions = config.inline_table(spark, rows, "subscription string, pattern string")
    return access.subscription_match(messages(spark, sf_dir), subscriptions)


POLICY_SQL = """
policies AS (
  SELECT 'role-' || n_nationkey AS name, n_nationkey % 3 <> 0 AS write,
         CASE n_nationkey % 4 WHEN 0 THEN 'data.users.*.click' WHEN 1 THEN 'data.users.' || n_nationkey || '.>'
                              WHEN 2 THEN '>.view' ELSE 'data.*.' || n_nationkey || '.error' END AS match
  FROM nation),
user_roles AS (SELECT DISTINCT 'user-' || (c_custkey % 200) AS "user", 'role-' || c_nationkey AS role FROM customer),
granting AS (SELECT name, '^' || replace(replace(replace(match, '.', '\\.'), '*', '[^.]+'), '\\.>', '(\\..*)?') || '$' AS r FROM policies WHERE write)
""".replace("\\\\", "\\")


@query(
    "access_audit",
    with_(MESSAGES, POLICY_SQL, select=r"""
, sends AS (SELECT 'user-' || user_id AS "user", address, event_type, user_id, count(*) AS messages FROM messages GROUP BY ALL),
ok AS (SELECT DISTINCT s."user", s.address FROM sends s JOIN user_roles u ON u."user" = s."user" JOIN policies p ON p.name = u.role AND p.write
       WHERE CASE WHEN p.match = 'data.users.*.click' THEN s.event_type = 'click'
                  WHEN p.match = '>.view' THEN s.event_type = 'view'
                  WHEN p.match LIKE 'data.users.%.>' THEN s.address LIKE replace(p.match, '.>', '.%')
                  ELSE s.address = replace(p.match, '*', 'users') END)
SELECT sends."user", sends.address, messages, ok.address IS NOT NULL AS allowed
FROM sends LEFT JOIN ok ON ok."user" = sends."user" AND ok.address = sends.address"""),
)
def _access_audit(spark, sf_dir):
    n = F.col("n_nationkey")
    match = (
        F.when(n % 4 == 0, F.lit("data.users.*.click"))
        .when(n % 4 == 1, F.concat(F.lit("data.users."), n, F.lit(".>")))
        .when(n % 4 == 2, F.lit(">.view"))
        .otherwise(F.concat(F.lit("data.*."), n, F.lit(".error")))
    )
    policies = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("role-"), n).alias("name"), match.alias("match"), (n % 3 != 0).alias("write")
    )
    user_roles = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("user-"), F.col("c_custkey") % 200).alias("user"),
        F.concat(F.lit("role-"), F.col("c_nationkey")).alias("role"),
    )
    return access.access_audit(messages(spark, sf_dir), user_roles, policies)


ELIGIBLE = """
eligible AS (
  SELECT 'r-' || c_custkey AS id, 'role-' || (c_custkey % 40) AS name, 'data.' || c_nationkey || '.>' AS match,
         c_custkey % 2 = 0 AS read, c_custkey % 3 = 0 AS write, c_custkey % 5 = 0 AS send, c_custkey AS k
  FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 4 <> 0 AND c_custkey % 7 <> 0)
"""


def _eligible(spark, sf_dir) -> DataFrame:
    return access.eligible_roles(inputs.role_export(spark, sf_dir), "is_managed")


@query(
    "roles_read",
    """
SELECT 'r-' || c_custkey AS id, 'role-' || (c_custkey % 40) AS name,
       CASE WHEN c_custkey % 11 <> 0 THEN CASE WHEN c_custkey % 7 = 0 THEN '[ ]' ELSE '[data.' || c_nationkey || '.>]' END END AS match,
       CASE WHEN c_custkey % 11 <> 0 THEN CASE WHEN c_custkey % 2 = 0 THEN '[Yes]' ELSE '[false]' END END AS read
FROM customer""",
)
def _roles_read(spark, sf_dir):
    """Roles exported as JSON, with attributes as lists, and read back."""
    path = scratch_path(spark, "roles")
    as_list = F.transform_values("attributes", lambda _, v: F.array(unwrap(v)))
    exported = inputs.role_export(spark, sf_dir).select("id", "name", as_list.alias("attributes"))
    exported.write.json(path)
    found = F.col("attributes")
    return read_roles(spark, path, lines=True).select(
        "id",
        "name",
        F.try_element_at(found, F.lit("match")).alias("match"),
        F.try_element_at(found, F.lit("read")).alias("read"),
    )


@query("eligible_roles", with_(ELIGIBLE, select=" SELECT id, name, match FROM eligible"))
def _eligible_roles(spark, sf_dir):
    return _eligible(spark, sf_dir).select("id", "name", "match")


@query(
    "role_flags",
    with_(ELIGIBLE, select="""
SELECT id, name, match, read, write, send, false AS consume, true AS "createAddress", false AS "deleteAddress",
       false AS "createDurableQueue", false AS "deleteDurableQueue", false AS "createNonDurableQueue",
       false AS "deleteNonDurableQueue", false AS manage, false AS browse, false AS view, false AS edit
FROM eligible"""),
)
def _role_flags(spark, sf_dir):
    return access.role_flags(_eligible(spark, sf_dir))


@query(
    "roles_by_match",
    with_(ELIGIBLE, select="""
SELECT match, count(DISTINCT name || read || write || send) AS roles FROM eligible GROUP BY 1"""),
)
def _roles_by_match(spark, sf_dir):
    sets = access.roles_by_match(access.role_flags(_eligible(spark, sf_dir)))
    return sets.groupBy("match").agg(F.count(F.lit(1)).alias("roles"))


@query(
    "policy_reconcile",
    with_(ELIGIBLE, select="""
, incoming AS (SELECT match, name, bool_or(write) AS write FROM eligible GROUP BY 1, 2),
current AS (SELECT DISTINCT CASE WHEN c_nationkey % 2 = 0 THEN 'data.' || c_nationkey || '.>' ELSE 'old.' || c_nationkey END AS match,
                   'role-' || (c_custkey % 45) AS name FROM customer),
kept AS (SELECT c.match, c.name, i.write FROM current c JOIN incoming i ON i.match = c.match AND i.name = c.name)
SELECT * FROM kept
UNION ALL SELECT DISTINCT match, NULL, NULL::BOOLEAN FROM current WHERE match NOT IN (SELECT match FROM kept)
UNION ALL SELECT match, name, write FROM incoming WHERE match NOT IN (SELECT match FROM current)"""),
)
def _policy_reconcile(spark, sf_dir):
    """The matches held are those of even nations; those of odd ones are only incoming, or only old."""
    flags = access.role_flags(_eligible(spark, sf_dir))
    incoming = flags.groupBy("match", "name").agg(F.bool_or("write").alias("write"))
    nation = F.col("c_nationkey")
    current = table(spark, sf_dir, "customer").select(
        F.when(nation % 2 == 0, F.concat(F.lit("data."), nation, F.lit(".>")))
        .otherwise(F.concat(F.lit("old."), nation))
        .alias("match"),
        F.concat(F.lit("role-"), F.col("c_custkey") % 45).alias("name"),
    )
    return access.reconcile(current, incoming, "match", "name")


# ---------------------------------------------------------------- the stored log


def _log(spark, sf_dir) -> DataFrame:
    return lookup.stored_log(messages(spark, sf_dir))


def log_rows(log: DataFrame) -> DataFrame:
    return log.select("message_id", "topic", "application_id", "correlation_id", millis(F.col("reception_date")).alias("ms"))


LOG_COLUMNS = "message_id, address AS topic, application AS application_id, 'c' || message_id AS correlation_id, ms"


@query(
    "log_lookup",
    with_(MESSAGES, select=f" SELECT {LOG_COLUMNS} FROM messages WHERE application = 'app-2' AND cents > 500"),
)
def _log_lookup(spark, sf_dir):
    costly = F.get_json_object("body", "$.cents").cast("bigint") > 500
    return log_rows(lookup.log_lookup(_log(spark, sf_dir), application="app-2", predicate=costly))


@query(
    "find_first",
    with_(MESSAGES, select=f" SELECT {LOG_COLUMNS} FROM messages WHERE application = 'app-3' AND k > 50 ORDER BY us, message_id LIMIT 1"),
)
def _find_first(spark, sf_dir):
    high = F.get_json_object("body", "$.props.k").cast("bigint") > 50
    return log_rows(lookup.find_first(_log(spark, sf_dir), application="app-3", predicate=high))


@query(
    "find_last",
    with_(MESSAGES, select=f" SELECT {LOG_COLUMNS} FROM messages WHERE address = 'data.users.8.error' ORDER BY us DESC, message_id DESC LIMIT 1"),
)
def _find_last(spark, sf_dir):
    return log_rows(lookup.find_last(_log(spark, sf_dir), topic="data.users.8.error"))


# ---------------------------------------------------------------- snapshots


def hourly(spark, sf_dir) -> DataFrame:
    return snapshots.queue_snapshots(inputs.queue_messages(spark, sf_dir), HOUR_MS, pattern=r"all\.iotdpp\..*")


def snapshot_rows(df: DataFrame) -> DataFrame:
    return df.withColumn("time_ms", millis(F.col("time"))).drop("time")


SNAPSHOT_SQL = with_(SNAPSHOTS, select=" SELECT * FROM snapshots")


@query("queue_snapshot", SNAPSHOT_SQL)
def _queue_snapshot(spark, sf_dir):
    return snapshot_rows(hourly(spark, sf_dir))


@query(
    "add_rate",
    with_(MESSAGES, select="""
, days AS (SELECT event_type AS queue, us // 86400000000 AS day, max(us) // 1000 AS time_ms, count(*) AS n FROM messages
           GROUP BY 1, 2),
totals AS (SELECT queue, time_ms, CAST(sum(n) OVER (PARTITION BY queue ORDER BY day) AS BIGINT) AS messages_added FROM days)
SELECT queue, time_ms, messages_added,
       coalesce((messages_added - lag(messages_added) OVER w) / ((time_ms - lag(time_ms) OVER w) / 1000e0), 0e0) AS messages_added_frequency
FROM totals WINDOW w AS (PARTITION BY queue ORDER BY time_ms)"""),
)
def _add_rate(spark, sf_dir):
    """Snapshots at irregular times: the last message of every day."""
    from tidewire.plans.running import running_total

    days = messages(spark, sf_dir).groupBy(F.substring_index("address", ".", -1).alias("queue"), F.date_trunc("day", "ts").alias("day")).agg(
        F.timestamp_millis(millis(F.max("ts"))).alias("time"), F.count(F.lit(1)).alias("n")
    )
    totals = running_total(days, ["queue"], "day", F.date_trunc("month", "day"), "n", "messages_added")
    return snapshot_rows(snapshots.add_rate(totals.select("queue", "time", "messages_added")))


@query("latest_snapshot", with_(SNAPSHOTS, select=" SELECT * FROM snapshots QUALIFY row_number() OVER (PARTITION BY queue ORDER BY time_ms DESC) = 1"))
def _latest_snapshot(spark, sf_dir):
    return snapshot_rows(snapshots.latest_snapshot(hourly(spark, sf_dir)))


QUEUE_METRICS = """
queue_metrics AS (
  SELECT replace(queue, '.', '_') AS prefix, time_ms, m, v FROM (
    SELECT queue, time_ms, 'ConsumersCount' AS m, CAST(consumers_count AS DOUBLE) AS v FROM snapshots
    UNION ALL SELECT queue, time_ms, 'GroupCount', group_count FROM snapshots
    UNION ALL SELECT queue, time_ms, 'MaxMessageAge', max_message_age FROM snapshots
    UNION ALL SELECT queue, time_ms, 'MessageCount', message_count FROM snapshots
    UNION ALL SELECT queue, time_ms, 'MessagesAdded', messages_added FROM snapshots
    UNION ALL SELECT queue, time_ms, 'MessagesAddedFrequency', messages_added_frequency FROM snapshots))
"""


@query(
    "queue_metrics",
    with_(SNAPSHOTS, QUEUE_METRICS, select=" SELECT prefix || '_' || m || '_SENSOR' AS name, v AS value, time_ms AS timestamp FROM queue_metrics"),
)
def _queue_metrics(spark, sf_dir):
    return snapshots.queue_metrics(hourly(spark, sf_dir))


@query(
    "metric_series",
    with_(SNAPSHOTS, QUEUE_METRICS, select="""
SELECT split_part(prefix, '_', 3) AS step, m AS metric, time_ms AS timestamp, v AS metric_value FROM queue_metrics
WHERE m IN ('MessagesAddedFrequency', 'MaxMessageAge', 'MessageCount', 'ConsumersCount')"""),
)
def _metric_series(spark, sf_dir):
    payloads = sinks.encode_metrics(snapshots.queue_metrics(hourly(spark, sf_dir)), "monitoring.")
    return snapshots.metric_series(sinks.decode_metrics(payloads).select("topic", "metric_value", "timestamp"))


@query(
    "backpressure",
    with_(SNAPSHOTS, select=" SELECT queue, time_ms, least(message_count, 10) / 10e0 * 2e0 AS wait_seconds FROM snapshots"),
)
def _backpressure(spark, sf_dir):
    return hourly(spark, sf_dir).select(
        "queue", millis(F.col("time")).alias("time_ms"), snapshots.backpressure(F.col("message_count")).alias("wait_seconds")
    )
