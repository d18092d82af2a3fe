"""Registered queries: service levels, readings of vehicles, the laid-out log, late copies."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.times import millis
from tidewire.operators import bridging, lifecycle, readings, service, snapshots
from tidewire.plans import inputs
from tidewire.plans.catalog import LIFECYCLE, MESSAGES, ORACLES, SNAPSHOTS, query, with_
from tidewire.plans.inputs import HOUR_MS, table
from tidewire.plans.queries_batch import FIRST_SQL, LIFECYCLE_SQL, lifecycle_rows
from tidewire.plans.queries_streaming import CLOSING_ID, closed_events, stream_table
from tidewire.settings import scratch_path
from tidewire.sources import log
from tidewire.streaming import keyed, known, runs

DAY_MS = 24 * HOUR_MS


def _correlated(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events")
    parts = inputs.published_of(events), inputs.delivered_of(events), inputs.acknowledged_of(events)
    return lifecycle.correlate_lifecycle(*parts)


@query(
    "lifecycle_times",
    with_(LIFECYCLE, select="""
SELECT event_id AS message_id, queue, deliver_us // 1000 - publish_us // 1000 AS wait_ms,
       ack_us // 1000 - deliver_us // 1000 AS processing_ms
FROM received"""),
)
def _lifecycle_times(spark, sf_dir):
    times = service.lifecycle_times(_correlated(spark, sf_dir))
    return times.select("message_id", "queue", "wait_ms", "processing_ms")


LIMITS = [
    (f"data.{kind}", service.LATENCY, quantile, at_most)
    for kind in ("click", "view", "purchase", "signup", "audit")
    for quantile, at_most in ((0.5, 4000), (0.95, 6500), (1.0, 7800))
]
LIMITS_SQL = "limits(step, metric, quantile, at_most) AS (VALUES " + ", ".join(
    f"('{step}', '{metric}', {quantile}::DOUBLE, {at_most}::BIGINT)" for step, metric, quantile, at_most in LIMITS
) + ")"


@query(
    "slo_latency",
    with_(LIFECYCLE, LIMITS_SQL, select=f"""
, v AS (SELECT queue AS step, (ack_us // 1000) // {DAY_MS} AS tick, ack_us // 1000 - publish_us // 1000 AS value
        FROM received WHERE ack_us IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY step, tick ORDER BY value) AS place, count(*) OVER (PARTITION BY step, tick) AS n
      FROM v),
m AS (SELECT r.step, tick, metric, quantile, at_most, min(value) AS measured
      FROM r JOIN limits ON limits.step = r.step AND place >= greatest(1, ceil(quantile * n - 1e-9)) GROUP BY ALL)
SELECT step, metric, tick, quantile, at_most, measured, measured <= at_most AS kept FROM m"""),
)
def _slo_latency(spark, sf_dir):
    """Median, 95 % and maximum of the latency of every queue and day against their limits."""
    values = service.latencies(_correlated(spark, sf_dir), F.col("queue"), DAY_MS)
    limits = spark.createDataFrame(LIMITS, service.LIMITS)
    return service.check_levels(values, limits, service.LATENCY)


@query(
    "slo_length",
    with_(SNAPSHOTS, select=f"""
, v AS (SELECT queue AS step, time_ms // {DAY_MS} AS tick, message_count AS value FROM snapshots)
SELECT step, 'length' AS metric, tick, 1.0::DOUBLE AS quantile, 100::BIGINT AS at_most, max(value) AS measured,
       max(value) <= 100 AS kept
FROM v GROUP BY step, tick"""),
)
def _slo_length(spark, sf_dir):
    """The longest that every queue was on each day against a limit."""
    taken = snapshots.queue_snapshots(inputs.queue_messages(spark, sf_dir), HOUR_MS)
    values = service.lengths(taken, F.col("queue"), DAY_MS)
    limits = spark.createDataFrame([(service.LENGTH, 1.0, 100)], "metric string, quantile double, at_most bigint")
    return service.check_levels(values, limits, service.LENGTH)


def _readings(events: DataFrame) -> DataFrame:
    """Events as readings of vehicles: a value, and a place that jumps about."""
    return inputs.with_event_time(events).select(
        F.col("user_id").alias("vehicle"), "ts", F.col("event_id").alias("message_id"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        F.concat(F.lit("z"), F.col("user_id") % 3).alias("zone"),
        (F.col("event_id") * 7919 % 1000).alias("x"), (F.col("event_id") * 104729 % 1000).alias("y"),
    )


@query(
    "outlier_flags",
    with_(MESSAGES, select="""
, f AS (SELECT user_id AS vehicle, message_id, cents, count(*) OVER w AS seen, coalesce(sum(cents::HUGEINT) OVER w, 0) AS s,
               coalesce(sum(cents::HUGEINT * cents) OVER w, 0) AS ss
        FROM messages WINDOW w AS (PARTITION BY user_id ORDER BY us, message_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT vehicle, message_id, seen,
       seen >= 5 AND (seen * cents - s) * (seen * cents - s) > 9 * (seen * ss - s * s) AS outlier
FROM f"""),
)
def _outlier_flags(spark, sf_dir):
    """Values more than three deviations from the mean of the vehicle's last ten."""
    rows = _readings(table(spark, sf_dir, "events"))
    flagged = readings.flag_outliers(
        rows, ["vehicle"], ["ts", "message_id"], "cents", F.date_trunc("day", F.col("ts"))
    )
    return flagged.select("vehicle", "message_id", "seen", "outlier")


# Corners of the zones, in order.
ZONES = {
    "z0": [(100, 100), (900, 100), (900, 900), (100, 900)],
    "z1": [(0, 0), (999, 250), (400, 500), (999, 999), (0, 800)],
    "z2": [(500, 0), (1000, 500), (500, 1000), (0, 500)],
}
AWAY_MS = 6 * HOUR_MS


def _zones(spark) -> DataFrame:
    return spark.createDataFrame(list(ZONES.items()), "zone string, corners array<struct<x:bigint,y:bigint>>")


EDGES_SQL = "edges(zone, x1, y1, x2, y2) AS (VALUES " + ", ".join(
    f"('{zone}', {a[0]}, {a[1]}, {b[0]}, {b[1]})"
    for zone, corners in ZONES.items()
    for a, b in zip(corners, corners[1:] + corners[:1], strict=True)
) + ")"

STAYS_SQL = with_(MESSAGES, EDGES_SQL, select="""
, r AS (SELECT user_id AS vehicle, us, message_id, 'z' || (user_id % 3) AS zone, message_id * 7919 % 1000 AS x,
               message_id * 104729 % 1000 AS y FROM messages),
p AS (SELECT r.*, (SELECT count(*) % 2 = 1 FROM edges e
                   WHERE e.zone = r.zone AND (e.y1 > r.y) <> (e.y2 > r.y)
                     AND CASE WHEN e.y2 > e.y1 THEN (r.x - e.x1) * (e.y2 - e.y1) < (e.x2 - e.x1) * (r.y - e.y1)
                              ELSE (r.x - e.x1) * (e.y2 - e.y1) > (e.x2 - e.x1) * (r.y - e.y1) END) AS inside FROM r),
s AS (SELECT *, sum(inside::BIGINT) OVER (PARTITION BY vehicle ORDER BY us, message_id) AS stay FROM p),
g AS (SELECT vehicle, zone, stay, min(us) FILTER (NOT inside) AS left_us, max(us) FILTER (NOT inside) AS last_us,
             min(us) FILTER (inside) AS came_us, count(*) FILTER (NOT inside) AS n FROM s GROUP BY ALL),
stays AS (SELECT g.vehicle, g.zone, g.left_us // 1000 AS left_ms, b.came_us // 1000 AS returned_ms,
                 coalesce(b.came_us, g.last_us) // 1000 - g.left_us // 1000 AS outside_ms, g.n AS readings
          FROM g LEFT JOIN g b ON b.vehicle = g.vehicle AND b.stay = g.stay + 1 WHERE g.stay > 0 AND g.n > 0)""")


@query("geofence_exits", STAYS_SQL + f" SELECT * FROM stays WHERE outside_ms >= {AWAY_MS}")
def _geofence_exits(spark, sf_dir):
    """Vehicles that stayed outside their zone for six hours or more."""
    placed = readings.in_zone(_readings(table(spark, sf_dir, "events")), _zones(spark))
    stays = readings.exits(
        placed, ["vehicle", "zone"], F.date_trunc("day", F.col("ts")), AWAY_MS, order=("ts", "message_id")
    )
    return stays.select(
        "vehicle", "zone", millis(F.col("left_at")).alias("left_ms"), millis(F.col("returned_at")).alias("returned_ms"),
        "outside_ms", "readings",
    )


@query(
    "geofence_alarms_stream",
    STAYS_SQL + f" SELECT vehicle, zone, left_ms FROM stays WHERE returned_ms IS NULL OR outside_ms >= {AWAY_MS}",
)
def _geofence_alarms_stream(spark, sf_dir):
    """An alarm for each vehicle that has been outside for six hours: by its next reading, or by a timer."""
    placed = _readings(closed_events(spark, sf_dir))
    corners = F.lit(None)
    for zone, points in ZONES.items():
        at = F.array(*[F.struct(F.lit(x).cast("long").alias("x"), F.lit(y).cast("long").alias("y")) for x, y in points])
        corners = F.when(F.col("zone") == zone, at).otherwise(corners)
    placed = placed.withColumn("inside", F.coalesce(readings.inside(F.col("x"), F.col("y"), corners), F.lit(False)))
    alarms = keyed.with_state(
        placed.select("vehicle", "zone", "ts", "message_id", "inside").withWatermark("ts", runs.WATERMARK),
        ["vehicle", "zone"], away_alarms(AWAY_MS), "was_inside boolean, left_ms bigint, told boolean",
        "vehicle bigint, zone string, left_ms bigint", order=["ts", "message_id"],
        alarm=lambda state: state[1] + AWAY_MS if state[1] is not None and not state[2] else None,
        on_alarm=tell_away,
    )
    return runs.run_to_table(alarms, "alarms").filter(F.col("vehicle") != CLOSING_ID)


def away_alarms(period_ms: int):
    """A function with a state that tells of stays outside which lasted the period by the rows at hand."""

    def run(key, state, rows):
        was_inside, left, told = state or (False, None, False)
        out = []
        for ts, inside in zip(rows["ts"], rows["inside"], strict=True):
            now = int(ts.timestamp() * 1000)
            if left is not None and not told and now - left >= period_ms:
                out.append(left)
                told = True
            if inside:
                was_inside, left, told = True, None, False
            elif was_inside:
                was_inside, left = False, now
        frame = pd.DataFrame({"vehicle": key[0], "zone": key[1], "left_ms": out})
        return (was_inside, left, told), frame

    return run


def tell_away(key, state):
    """The period is over and no reading has come."""
    return (state[0], state[1], True), pd.DataFrame({"vehicle": [key[0]], "zone": [key[1]], "left_ms": [state[1]]})


def _laid_out(spark, parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Events written as laid-out tables and read again."""
    run = uuid.uuid4().hex[:12]
    found = {}
    for name, events in parts.items():
        name = f"log_{name}_{run}"
        log.write_log(events, name, 8, path=scratch_path(spark, name))
        found[name] = log.by_key(log.read_log(spark, name))
    return found


@query("lifecycle_from_log", LIFECYCLE_SQL)
def _lifecycle_from_log(spark, sf_dir):
    """Publish, deliver and acknowledge events from a laid-out log, correlated without a shuffle."""
    events = table(spark, sf_dir, "events")
    parts = {"p": inputs.published_of(events), "d": inputs.delivered_of(events), "a": inputs.acknowledged_of(events)}
    return lifecycle_rows(lifecycle.correlate_lifecycle(*_laid_out(spark, parts).values()))


@query("request_reply_from_log", ORACLES["request_reply"])
def _request_reply_from_log(spark, sf_dir):
    """Requests and replies from a log that is laid out by the correlation id."""
    events = table(spark, sf_dir, "events")
    asked, answers = inputs.requests_of(events), inputs.replies_of(events)
    run, found = uuid.uuid4().hex[:12], []
    for name, part in (("requests", asked), ("replies", answers)):
        name = f"log_{name}_{run}"
        log.write_log(part, name, 8, key="correlation_id", path=scratch_path(spark, name))
        found.append(log.read_log(spark, name).drop("correlation_id", log.DATE).withColumnRenamed(log.KEY, "correlation_id"))
    return bridging.request_reply(*found, laid_out=True).select(
        "request_id", "correlation_id", "application_id", "reply_id", "subject",
        (millis(F.col("reply_ts")) - millis(F.col("request_ts"))).alias("waited_ms"),
    )


@query("first_publish_known_stream", FIRST_SQL)
def _first_publish_known_stream(spark, sf_dir):
    """Copies are dropped however late they come: each is held against the stored ids."""
    path = scratch_path(spark, "known")
    events = inputs.two_node_log_of(stream_table(spark, sf_dir, "events"))
    late = events.withColumn(
        "ts", F.when(F.col("receiving_node").isNotNull(), inputs.after(F.col("ts"), F.lit(3 * DAY_MS).cast("bigint"))).otherwise(F.col("ts"))
    )
    log_rows = late.select("message_id", "original_message_id", "receiving_node", "ts", "address")
    known.store_first_publishes(log_rows, path, f"{path}/checkpoint").awaitTermination()
    return known.first_publishes(spark, path).select(
        F.coalesce("original_message_id", "message_id").alias("original_id"), "address"
    )
