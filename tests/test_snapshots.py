"""Snapshots and running values against brute force."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import snapshots
from tidewire.plans.running import running_total, with_previous
from tidewire.settings import materialize

UTC = datetime.timezone.utc
START = datetime.datetime(2024, 1, 1, tzinfo=UTC)
INTERVAL = 3000

SCHEMA = "queue string, publish_ts timestamp, deliver_ts timestamp, ack_ts timestamp, consumer string, group_id string"


def random_messages(seed, n, queues, spread_s, hold_s, never=0.1):
    """Times fall on whole and half ticks often, so that the borders are met."""
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        queue = "hot" if rnd.random() < 0.5 else rnd.choice(queues)
        publish = START + datetime.timedelta(milliseconds=500 * rnd.randrange(spread_s * 2))
        publish += datetime.timedelta(microseconds=rnd.choice([0, 0, 1, 999]))
        deliver = publish + datetime.timedelta(milliseconds=500 * rnd.randrange(4))
        hold = datetime.timedelta(milliseconds=500 * int(rnd.expovariate(1 / (2 * hold_s))))
        ack = None if rnd.random() < never else deliver + hold
        rows.append((queue, publish, deliver, ack, f"w{rnd.randrange(3)}", rnd.choice([None, "a", "b", "c"])))
    return rows


def brute_force(rows, interval_ms):
    us = lambda t: round((t - datetime.datetime(1970, 1, 1, tzinfo=UTC)) / datetime.timedelta(microseconds=1))
    step = interval_ms * 1000
    tick = lambda t: -(-us(t) // step)
    end = max([tick(r[1]) for r in rows] + [tick(r[3]) for r in rows if r[3]])
    out = {}
    for queue in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == queue]
        first = min(tick(r[1]) for r in mine)
        before = None
        for t in range(first, end + 1):
            now = t * step
            pending = [us(r[1]) for r in mine if us(r[1]) <= now and (r[3] is None or us(r[3]) > now)]
            added = sum(us(r[1]) <= now for r in mine)
            out[queue, now // 1000] = (
                len(pending),
                now // 1000 - min(pending) // 1000 if pending else 0,
                len({r[4] for r in mine if tick(r[2]) == t}),
                len({r[5] for r in mine if tick(r[1]) == t and r[5]}),
                0.0 if before is None else (added - before) / (interval_ms / 1000),
                added,
            )
            before = added
    return out


def as_dict(df):
    return {
        (r["queue"], round(r["ms"])): tuple(
            r[c]
            for c in (
                "message_count", "max_message_age", "consumers_count", "group_count",
                "messages_added_frequency", "messages_added",
            )
        )
        for r in df.withColumn("ms", F.unix_millis("time")).collect()
    }


@pytest.mark.parametrize("seed, hold_s, block", [(1, 1, 4096), (2, 20, 4096), (3, 60, 8), (4, 5, 3), (5, 300, 16)])
def test_snapshots_equal_brute_force(spark, monkeypatch, seed, hold_s, block):
    monkeypatch.setattr(snapshots, "BLOCK", block)
    rows = random_messages(seed, 300, ["q1", "q2", "late"], 240, hold_s)
    df = spark.createDataFrame(rows, SCHEMA)
    assert as_dict(snapshots.queue_snapshots(df, INTERVAL)) == brute_force(rows, INTERVAL)


def test_snapshots_until_a_tick(spark):
    rows = random_messages(7, 100, ["q1"], 60, 10)
    df = spark.createDataFrame(rows, SCHEMA)
    until = round(START.timestamp()) // 3 + 10
    got = as_dict(snapshots.queue_snapshots(df, INTERVAL, until=until))
    assert got == {k: v for k, v in brute_force(rows, INTERVAL).items() if k[1] <= until * INTERVAL}


def test_states_of_batches_add_up(spark):
    rows = random_messages(8, 300, ["q1", "q2"], 120, 20)
    parts = [snapshots.queue_states(spark.createDataFrame(rows[i::3], SCHEMA), INTERVAL) for i in range(3)]
    merged = materialize(snapshots.merge_states(parts[0].union(parts[1]).union(parts[2])), "test")
    whole = materialize(snapshots.queue_states(spark.createDataFrame(rows, SCHEMA), INTERVAL), "test")
    a, b = (snapshots.snapshots_from_states(s, INTERVAL) for s in (merged, whole))
    assert as_dict(a) == as_dict(b)


def test_twenty_messages_without_consumer_then_acknowledged(spark):
    at = lambda s: START + datetime.timedelta(seconds=s)
    rows = [("t", at(i), None, at(100), None, None) for i in range(20)]
    got = sorted(as_dict(snapshots.queue_snapshots(spark.createDataFrame(rows, SCHEMA), INTERVAL)).items())
    before = [v for (_, ms), v in got if ms < round(at(100).timestamp() * 1000)]
    assert [v[1] for v in before] == sorted({v[1] for v in before})
    counts = [v[0] for v in before]
    assert counts == sorted(counts) and counts[-1] == 20
    assert got[-1][1][0] == 0 and got[-1][1][1] == 0


def test_system_and_unmonitored_queues_are_left_out(spark):
    rows = [(q, START, None, None, None, None) for q in ("$sys.a", "all.x", "other")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.queue for r in snapshots.queue_snapshots(df, INTERVAL).collect()} == {"all.x", "other"}
    assert {r.queue for r in snapshots.queue_snapshots(df, INTERVAL, r"all\..*").collect()} == {"all.x"}


def test_add_rate(spark):
    at = lambda s: START + datetime.timedelta(seconds=s)
    # across midnight, and two rows of one time
    rows = [("q", at(0), 5), ("q", at(10), 25), ("q", at(86410), 25), ("q", at(86400 * 3), 26), ("p", at(1), 7), ("p", at(1), 7)]
    df = snapshots.add_rate(spark.createDataFrame(rows, "queue string, time timestamp, messages_added bigint"))
    got = sorted((r.queue, r.time.replace(tzinfo=UTC) if r.time.tzinfo is None else r.time, r.messages_added_frequency) for r in df.collect())
    assert [r[2] for r in got] == [0.0, 0.0, 0.0, 2.0, 0.0, 1 / (86400 * 3 - 86410)]


def test_running_helpers_equal_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("aab"), i, rnd.randrange(10)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    block = F.floor(F.col("o") / 7)
    totals = {(r.k, r.o): r.t for r in running_total(df, ["k"], "o", block, "v", "t").collect()}
    previous = {(r.k, r.o): r.previous_v for r in with_previous(df, ["k"], "o", block, ["v"]).collect()}
    for k in "ab":
        total, last = 0, None
        for _, o, v in [r for r in rows if r[0] == k]:
            total += v
            assert totals[k, o] == total
            assert previous[k, o] == last
            last = v


def test_latest_and_metrics(spark):
    rows = random_messages(9, 50, ["a.b"], 30, 5)
    snaps = snapshots.queue_snapshots(spark.createDataFrame(rows, SCHEMA), INTERVAL)
    newest = snapshots.latest_snapshot(snaps).collect()
    assert len(newest) == len({r[0] for r in rows}) and len({r.time for r in newest}) == 1
    names = {r.name for r in snapshots.queue_metrics(snaps.filter("queue = 'a.b'")).collect()}
    assert "a_b_MessageCount_SENSOR" in names and len(names) == 6


def test_metric_series_and_backpressure(spark):
    rows = [
        ("monitoring.all_iotdpp_stepA_input_src_MessageCount_SENSOR", 2.0, 5),
        ("monitoring.all_iotdpp_stepA_input_src_GroupCount_SENSOR", 2.0, 5),
        ("monitoring.data_x_MessageCount_SENSOR", 2.0, 5),
    ]
    df = spark.createDataFrame(rows, "topic string, metric_value double, timestamp bigint")
    got = [tuple(r) for r in snapshots.metric_series(df).collect()]
    assert got == [("stepA", "MessageCount", 5, 2.0)]
    waits = spark.createDataFrame([(0,), (5,), (10,), (99,)], "d int").select(snapshots.backpressure(F.col("d")))
    assert [r[0] for r in waits.collect()] == [0.0, 1.0, 2.0, 2.0]
