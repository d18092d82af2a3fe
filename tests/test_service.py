"""Service levels, readings, the laid-out log and late copies against brute force."""

import datetime
import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tidewire.functions.times import floor_div, millis
from tidewire.operators import bridging, lifecycle, readings, service
from tidewire.plans import queries_service, running
from tidewire.sources import log
from tidewire.streaming import keyed, known, runs, store

START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def ts_block():
    return F.date_trunc("minute", F.col("ts"))


# ---------------------------------------------------------------- frames and outliers


@pytest.mark.parametrize("piece", [7, 4096])
def test_frames_reach_over_blocks_and_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(running, "PIECE_ROWS", piece)
    rng = random.Random(piece)
    rows = [(rng.choice(["hot", "hot", "a", None]), at(rng.randint(0, 900)), i, rng.randint(-50, 50)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, id bigint, v bigint")
    got = running.over_last_rows(
        df, ["k"], ["ts", "id"], ts_block(), 5, {"n": F.count("v"), "s": F.sum("v")}
    ).collect()
    assert len(got) == len(rows)
    groups = {}
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        groups.setdefault(row[0], []).append(row)
    expected = {}
    for group in groups.values():
        for i, row in enumerate(group):
            before = [r[3] for r in group[max(0, i - 5) : i]]
            expected[row[2]] = (len(before), sum(before) if before else None)
    assert {r.id: (r.n, r.s) for r in got} == expected


def test_outliers_by_hand(spark):
    rng = random.Random(1)
    rows = [("x", at(i), i, 10**12 + rng.randint(0, 9)) for i in range(30)]
    rows[20] = ("x", at(20), 20, 2 * 10**12)
    rows += [("still", at(i), 100 + i, 5 if i < 8 else 6) for i in range(9)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, id bigint, v bigint")
    got = readings.flag_outliers(df, ["k"], ["ts", "id"], "v", ts_block(), last=6, least=4).collect()
    for k in ("x", "still"):
        mine = sorted((r for r in got if r.k == k), key=lambda r: r.ts)
        for i, r in enumerate(mine):
            last = [m.v for m in mine[max(0, i - 6) : i]]
            n, s, ss = len(last), sum(last), sum(v * v for v in last)
            assert r.seen == n and r.outlier == (n >= 4 and (n * r.v - s) ** 2 > 9 * (n * ss - s * s))
    assert sum(r.outlier for r in got) == 2 and set(got[0].asDict()) == {"k", "ts", "id", "v", "seen", "outlier"}


# ---------------------------------------------------------------- zones


def ray(x, y, corners):
    odd = False
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):
        if (ay > y) != (by > y):
            side = (x - ax) * (by - ay) - (bx - ax) * (y - ay)
            odd ^= side < 0 if by > ay else side > 0
    return odd


@pytest.mark.parametrize("grid", [1, 3, 16, 100])
def test_cells_decide_as_the_polygon_does(spark, grid):
    rng = random.Random(grid)
    zones = {f"z{k}": [(rng.randint(-60, 60), rng.randint(-60, 60)) for _ in range(k + 3)] for k in range(4)}
    points = [(i, rng.choice([*zones, "unknown"]), rng.randint(-70, 70), rng.randint(-70, 70)) for i in range(900)]
    points += [(1000 + i, z, *corner) for z, corners in zones.items() for i, corner in enumerate(corners)]
    df = spark.createDataFrame(points, "id bigint, zone string, x bigint, y bigint")
    table = spark.createDataFrame(list(zones.items()), "zone string, corners array<struct<x:bigint,y:bigint>>")
    got = [(r.id, r.zone, r.x, r.y, r.inside) for r in readings.in_zone(df, table, grid).collect()]
    assert sorted(got) == sorted((*p, p[1] in zones and ray(p[2], p[3], zones[p[1]])) for p in points)


def stays(rows, least_ms):
    """Rows (vehicle, second, inside) to (vehicle, left, returned, ms, readings)."""
    out, groups = set(), {}
    for v, s, inside in sorted(rows):
        groups.setdefault(v, []).append((s, inside))
    for v, mine in groups.items():
        was, left, n = False, None, 0
        for s, inside in [*mine, (None, True)]:
            if inside and left is not None:
                ms = 1000 * ((mine[-1][0] if s is None else s) - left)
                if ms >= least_ms:
                    out.add((v, at(left), None if s is None else at(s), ms, n))
            if inside:
                was, left, n = True, None, 0
            else:
                left = s if was else left
                n, was = n + 1, False
                n = n if left is not None else 0
    return out


@pytest.mark.parametrize("seed", range(3))
def test_exits_over_blocks(spark, seed):
    rng = random.Random(seed)
    rows, inside = [], False
    for v in "ab":
        for s in sorted(rng.sample(range(2000), 150)):
            inside = inside if rng.random() < 0.8 else not inside
            rows.append((v, s, inside))
    df = spark.createDataFrame([(v, at(s), i) for v, s, i in rows], "v string, ts timestamp, inside boolean")
    got = {tuple(r) for r in readings.exits(df, ["v"], ts_block(), 60_000).collect()}
    assert got == stays(rows, 60_000) and got


def test_alarms_come_by_timer_and_once(spark, tmp_path):
    """A vehicle that falls silent outside is told of when the watermark has passed the period."""
    schema = "vehicle bigint, zone string, ts timestamp, inside boolean"
    batches = [
        [(1, "z", at(0), True), (1, "z", at(10), False), (2, "z", at(0), True), (2, "z", at(5), False), (3, "z", at(0), False)],
        [(2, "z", at(100), True), (9, "z", at(900), True)],
        [(1, "z", at(2000), False), (2, "z", at(2000), False), (2, "z", at(2700), True)],
        [(9, "z", at(9000), True)],
    ]
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    told = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = runs.stream_files(spark, source, spark.createDataFrame([], schema).schema).withWatermark("ts", "1 second")
        alarms = keyed.with_state(
            stream, ["vehicle", "zone"], queries_service.away_alarms(600_000),
            "was_inside boolean, left_ms bigint, told boolean", "vehicle bigint, zone string, left_ms bigint",
            order=["ts"], alarm=lambda s: s[1] + 600_000 if s[1] is not None and not s[2] else None,
            on_alarm=queries_service.tell_away,
        )
        runs.to_files(alarms, out, checkpoint).awaitTermination()
        rows = spark.read.schema("vehicle bigint, left_ms bigint").parquet(out).collect()
        told.append(sorted((r.vehicle, r.left_ms // 1000 - int(START.replace(tzinfo=datetime.timezone.utc).timestamp())) for r in rows))
    assert told == [[], [(1, 10)], [(1, 10), (2, 2000)], [(1, 10), (2, 2000)]]


# ---------------------------------------------------------------- levels


@pytest.mark.parametrize("block", [3, 4096])
def test_quantiles_by_sorting(spark, monkeypatch, block):
    monkeypatch.setattr(service, "VALUES", block)
    rng = random.Random(block)
    rows = [(rng.choice("aab"), rng.randint(0, 2), rng.choice([rng.randint(-20, 40), None])) for _ in range(400)]
    rows += [("one", 0, 7)]
    values = spark.createDataFrame(rows, "step string, tick bigint, value bigint")
    wanted = [0.0, 0.05, 0.5, 0.95, 1.0]
    limits = spark.createDataFrame([(s, "latency", q, 10) for s in ("a", "b", "one", "none") for q in wanted], service.LIMITS)
    got = {(r.step, r.tick, r.quantile): (r.measured, r.kept) for r in service.check_levels(values, limits, "latency").collect()}
    expected = {}
    for key in {r[:2] for r in rows}:
        mine = sorted(r[2] for r in rows if r[:2] == key and r[2] is not None)
        for q in wanted:
            value = mine[max(1, math.ceil(q * len(mine) - 1e-9)) - 1]
            expected[(*key, q)] = (value, value <= 10)
    assert got == expected


def test_sketched_quantiles_are_near(spark):
    values = spark.range(200_000).select(F.lit("a").alias("step"), F.lit(0).alias("tick"), (F.col("id") * 7919 % 200_000).alias("value"))
    limits = spark.createDataFrame([("a", "latency", q, 1) for q in (0.1, 0.5, 0.99)], service.LIMITS)
    keys = ["step", "tick"]
    parts = [service.sketch_values(values.filter(F.col("value") % 3 == k), keys) for k in range(3)]
    merged = service.merge_sketches(parts[0].unionByName(parts[1]).unionByName(parts[2]), keys)
    for r in service.sketched_quantiles(merged, keys, limits).collect():
        assert abs(r.measured / 200_000 - r.quantile) < 0.02
    whole = service.check_levels(values, limits, "latency", sketch=True).collect()
    assert len(whole) == 3 and not any(r.kept for r in whole)


def test_lifecycle_times(spark):
    rows = [(1, "q", "w", at(3), at(5), at(1)), (2, "q", "w", at(3), None, None)]
    df = spark.createDataFrame(rows, "message_id bigint, queue string, consumer string, deliver_ts timestamp, ack_ts timestamp, publish_ts timestamp")
    got = {r.message_id: (r.wait_ms, r.processing_ms) for r in service.lifecycle_times(df).collect()}
    assert got == {1: (2000, 2000), 2: (None, None)}


# ---------------------------------------------------------------- late copies


def test_a_copy_of_any_age_is_dropped(spark, tmp_path):
    path = str(tmp_path / "known")
    schema = "message_id bigint, original_message_id bigint, receiving_node string, ts timestamp"
    write = known.write_first(path, every=2)
    day = 86_400
    batches = [
        [(i, None, None, at(i)) for i in range(50)],
        [(1000 + i, i, "n", at(5 * day)) for i in range(0, 60, 2)],
        [(2000, 3, "n", at(20 * day)), (2001, 99, "n", at(20 * day + 1)), (2002, 99, "n", at(20 * day)), (51, None, None, at(20 * day))],
        [(52, None, None, at(30 * day)), (3000, 99, "n", at(30 * day)), (3001, 58, "n", at(30 * day))],
    ]
    for number, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema)
        write(df, number)
        write(df, number)  # as after a restart: its own ids are stored already
    got = sorted(r.message_id for r in known.first_publishes(spark, path).collect())
    assert got == sorted([*range(50), *range(1050, 1060, 2), 2002, 51])
    assert len(store.folders(spark, f"{path}/ids")["batch"]) <= 4


def test_ids_are_forgotten_after_days(spark, tmp_path):
    path = str(tmp_path / "known")
    schema = "message_id bigint, original_message_id bigint, receiving_node string, ts timestamp"
    write = known.write_first(path, keep_days=10, every=1)
    for number, (message, second) in enumerate([(1, 0), (2, 86_400 * 20), (1, 86_400 * 20 + 5), (2, 86_400 * 21)]):
        write(spark.createDataFrame([(message, None, None, at(second))], schema), number)
    assert sorted(r.message_id for r in known.first_publishes(spark, path).collect()) == [1, 1, 2]
    assert {str(r.day) for r in store.read_store(spark, f"{path}/ids", lambda df: df).collect()} == {"2024-01-21"}


# ---------------------------------------------------------------- the laid-out log


@pytest.fixture()
def laid_out(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, i]), at(3600 * i), f"q{i % 3}", f"w{i % 2}", "c", "n", 1) for i in range(200)]
    schema = "message_id bigint, original_message_id bigint, ts timestamp, queue string, consumer string, client_id string, node string, size bigint"
    df = spark.createDataFrame(rows, schema)
    run, names = uuid.uuid4().hex[:8], []
    for name in "pda":
        names.append(f"{name}_{run}")
        log.write_log(df, names[-1], 4, path=str(tmp_path / name))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield df, names
    for k, v in before.items():
        spark.conf.set(k, v)
    for name in names:
        spark.sql(f"DROP TABLE {name}")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_correlation_on_the_log_needs_no_shuffle(spark, laid_out):
    df, names = laid_out
    parts = [log.by_key(log.read_log(spark, name)) for name in names]
    joined = lifecycle.correlate_lifecycle(*parts)
    assert "Exchange" not in plan_of(joined)
    columns = ["message_id", "queue", "consumer", "deliver_ts", "ack_ts", "publish_ts"]
    expected = lifecycle.correlate_lifecycle(df, df, df).select(*columns).collect()
    assert sorted(map(str, joined.select(*columns).collect())) == sorted(map(str, expected))


def test_dates_prune(spark, laid_out):
    df, names = laid_out
    some = log.read_log(spark, names[0], since=datetime.date(2024, 1, 3), until=datetime.date(2024, 1, 4))
    assert "PartitionFilters: [isnotnull(event_date" in plan_of(some)
    assert sorted(r.message_id for r in some.collect()) == list(range(48, 96))


def test_requests_on_the_log_need_no_shuffle(spark, tmp_path, laid_out):
    run = uuid.uuid4().hex[:8]
    rows = [(i, f"c{i}" if i % 5 else None, "app", at(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "message_id bigint, correlation_id string, application_id string, ts timestamp")
    parts = []
    for name in ("asked", "answers"):
        log.write_log(df, f"{name}_{run}", 4, key="correlation_id", path=str(tmp_path / name))
        table = log.read_log(spark, f"{name}_{run}")
        parts.append(table.drop("correlation_id", log.DATE).withColumnRenamed(log.KEY, "correlation_id"))
    got = bridging.request_reply(*parts, laid_out=True)
    assert "Exchange" not in plan_of(got)
    assert sorted(map(str, got.collect())) == sorted(map(str, bridging.request_reply(df, df).collect()))
    for name in ("asked", "answers"):
        spark.sql(f"DROP TABLE {name}_{run}")
