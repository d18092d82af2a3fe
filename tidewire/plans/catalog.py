"""The registered queries: every operator over the whole tables, with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with the SQL that gives the same rows."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# The SQL forms of the inputs in ``plans.inputs``.
MESSAGES = """
messages AS (
  SELECT event_id AS message_id,
         'data.users.' || user_id || '.' || event_type AS address,
         '{"id":' || event_id || ',"date":' || (epoch_us(ts) // 1000) || ',"type":"' || event_type
           || '","cents":' || CAST(round(value * 100) AS BIGINT) || ',"props":' || props || '}' AS body,
         'app-' || (user_id % 5) AS application,
         epoch_us(ts) AS us, epoch_us(ts) // 1000 AS ms,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         user_id, event_type, event_id, CAST(round(value * 100) AS BIGINT) AS cents, props
  FROM events)
"""

STEPS = """
steps(step, input_stream) AS (VALUES ('stepA', 'src'), ('stepB', 'stepA'), ('stepC', 'stepB'), ('stepD', 'stepA')),
stepped AS (
  SELECT *, CASE message_id % 3 WHEN 0 THEN 'src' WHEN 1 THEN 'stepA' ELSE 'stepB' END AS stream
  FROM messages)
"""

LIFECYCLE = """
received AS (
  SELECT event_id, event_type, user_id, k, epoch_us(ts) AS publish_us, queue,
         epoch_us(ts) + event_id * 7919 % 5000 * 1000 AS deliver_us,
         CASE WHEN event_id % 10 <> 0
              THEN epoch_us(ts) + (event_id * 7919 % 5000 + event_id * 104729 % 3000) * 1000 END AS ack_us,
         size
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
               length('{"id":' || event_id || ',"date":' || (epoch_us(ts) // 1000) || ',"type":"' || event_type
                 || '","cents":' || CAST(round(value * 100) AS BIGINT) || ',"props":' || props || '}') AS size,
               unnest(CASE WHEN event_id % 5 = 0 THEN ['data.' || event_type, 'data.audit']
                           ELSE ['data.' || event_type] END) AS queue
        FROM events))
"""

# Snapshots by brute force: every message against every tick.
HOUR_US = 3_600_000_000
SNAPSHOTS = f"""
q AS (
  SELECT 'all.iotdpp.' || event_type || '.input.src' AS queue, epoch_us(ts) AS publish_us,
         epoch_us(ts) + event_id * 7919 % 5000 * 1000 AS deliver_us,
         CASE WHEN event_id % 10 <> 0
              THEN epoch_us(ts) + (event_id * 7919 % 5000 + event_id * 104729 % 3000) * 1000 END AS ack_us,
         'w-' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 4) AS consumer,
         'g-' || CAST(json_extract_string(props, '$.k') AS BIGINT) AS group_id
  FROM events),
t AS (SELECT *, (publish_us + {HOUR_US - 1}) // {HOUR_US} AS p,
             (deliver_us + {HOUR_US - 1}) // {HOUR_US} AS d, (ack_us + {HOUR_US - 1}) // {HOUR_US} AS a FROM q),
spans AS (SELECT queue, min(p) AS first, (SELECT greatest(max(p), max(a)) FROM t) AS last FROM t GROUP BY queue),
grid AS (SELECT queue, first, unnest(range(first, last + 1)) AS tick FROM spans),
pend AS (
  SELECT g.queue, g.tick, count(*) AS n, min(t.publish_us) AS oldest
  FROM grid g JOIN t ON t.queue = g.queue AND t.publish_us <= g.tick * {HOUR_US}
       AND (t.ack_us IS NULL OR t.ack_us > g.tick * {HOUR_US})
  GROUP BY 1, 2),
adds AS (SELECT queue, p AS tick, count(*) AS n, count(DISTINCT group_id) AS gs FROM t GROUP BY 1, 2),
cons AS (SELECT queue, d AS tick, count(DISTINCT consumer) AS cs FROM t GROUP BY 1, 2),
totals AS (
  SELECT g.queue, g.first, g.tick, coalesce(pend.n, 0) AS message_count,
         CASE WHEN pend.n > 0 THEN g.tick * {HOUR_US // 1000} - pend.oldest // 1000 ELSE 0 END AS max_message_age,
         coalesce(cons.cs, 0) AS consumers_count, coalesce(adds.gs, 0) AS group_count,
         CAST(sum(coalesce(adds.n, 0)) OVER (PARTITION BY g.queue ORDER BY g.tick) AS BIGINT) AS messages_added
  FROM grid g LEFT JOIN pend ON pend.queue = g.queue AND pend.tick = g.tick
       LEFT JOIN adds ON adds.queue = g.queue AND adds.tick = g.tick
       LEFT JOIN cons ON cons.queue = g.queue AND cons.tick = g.tick),
snapshots AS (
  SELECT queue, tick * {HOUR_US // 1000} AS time_ms, message_count, max_message_age, consumers_count, group_count,
         coalesce((messages_added - lag(messages_added) OVER (PARTITION BY queue ORDER BY tick)) / 3600.0e0, 0.0e0)
           AS messages_added_frequency,
         messages_added
  FROM totals)
"""

JOBS = """
j0 AS (SELECT o_orderkey AS k, epoch_us(o_orderdate) // 1000 AS src FROM orders),
j1 AS (SELECT k, src, CASE WHEN k % 10 <> 0 THEN src + k % 7000 + 500 END AS a FROM j0),
j2 AS (SELECT k, src, a, CASE WHEN k % 4 <> 0 THEN a + k % 3000 + 250 END AS b,
              CASE WHEN k % 5 <> 0 THEN a + k % 11000 END AS d FROM j1),
jobs AS (SELECT k AS message_id, src,
                CASE WHEN k % 6 = 1 THEN a + 60000 ELSE a END AS "stepA", b AS "stepB",
                CASE WHEN k % 3 <> 0 THEN b + k % 900 END AS "stepC", d AS "stepD" FROM j2)
"""


def with_(*parts: str, select: str) -> str:
    return "WITH " + ",".join(parts) + select


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All registered queries and their SQL."""
    from tidewire.plans import queries_batch, queries_functions, queries_service, queries_streaming  # noqa: F401

    return dict(QUERIES), dict(ORACLES)
