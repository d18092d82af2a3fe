"""Streams over several micro-batches and restarts equal the batch results."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewire.operators import extract, jobs, lifecycle, routing, snapshots
from tidewire.sources import config, sinks
from tidewire.streaming import keyed, rates, runs, store

from test_snapshots import INTERVAL, SCHEMA, as_dict, random_messages

START = datetime.datetime(2024, 1, 1)


def add_files(df, path, n):
    """Write ``df`` as ``n`` files, so that a stream of one file per trigger has ``n`` batches."""
    df.repartition(n).write.mode("append").parquet(path)


def test_states_over_batches_and_a_restart(spark, tmp_path):
    rows = random_messages(21, 300, ["q1", "q2"], 120, 20)
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    schema = spark.createDataFrame([], SCHEMA).schema

    def run(part):
        add_files(spark.createDataFrame(part, SCHEMA), source, 2)
        stream = runs.stream_files(spark, source, schema, per_trigger=1)
        runs.store_states(stream, INTERVAL, out, checkpoint).awaitTermination()

    run(rows[:150])
    run(rows[150:])
    stored = runs.snapshots_from_store(spark, out, INTERVAL)
    assert as_dict(stored) == as_dict(snapshots.queue_snapshots(spark.createDataFrame(rows, SCHEMA), INTERVAL))


def test_rates_go_on_after_a_restart(spark, tmp_path):
    rnd = random.Random(5)
    schema = "queue string, ts timestamp"
    rows = [(rnd.choice("ab"), START + datetime.timedelta(seconds=3 * i)) for i in range(400)]
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    struct = spark.createDataFrame([], schema).schema

    def run(part):
        add_files(spark.createDataFrame(part, schema), source, 1)
        stream = runs.stream_files(spark, source, struct, per_trigger=1)
        added = rates.added_per_window(stream, "30 seconds", "1 minute")
        runs.to_files(rates.add_rates_stream(added), out, checkpoint).awaitTermination()

    run(rows[:100])
    run(rows[100:250])
    run(rows[250:])
    run([(q, START + datetime.timedelta(days=9)) for q in "ab"])
    got = {(r.queue, r.time): (r.messages_added, r.messages_added_frequency) for r in spark.read.parquet(out).collect()}
    counts = {}
    for q, ts in rows:
        end = START + datetime.timedelta(seconds=30 * (int((ts - START).total_seconds()) // 30 + 1))
        counts[q, end] = counts.get((q, end), 0) + 1
    expected = {}
    for q in "ab":
        total, before = 0, None
        for end in sorted(e for k, e in counts if k == q):
            total += counts[q, end]
            rate = counts[q, end] / (end - before).total_seconds() if before else 0.0
            expected[q, end] = (total, rate)
            before = end
    got = {k: v for k, v in got.items() if k[1].day < 5}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in expected.items()}
    assert {k: v[1] for k, v in got.items()} == pytest.approx({k: v[1] for k, v in expected.items()})


def test_copies_in_other_batches_are_dropped(spark, tmp_path):
    schema = "message_id bigint, original_message_id bigint, ts timestamp"
    source = str(tmp_path / "in")
    first = [(i, None, START + datetime.timedelta(seconds=i)) for i in range(20)]
    copies = [(100 + i, i, START + datetime.timedelta(seconds=i + 1)) for i in range(0, 20, 2)]
    for part in (first, copies):
        add_files(spark.createDataFrame(part, schema), source, 1)
    stream = runs.stream_files(spark, source, spark.createDataFrame([], schema).schema, per_trigger=1)
    out = runs.run_to_table(runs.first_publish_stream(stream), "test")
    assert sorted(r.original_message_id for r in out.collect()) == list(range(20))


def test_point_stream_and_user_sink(spark, tmp_path):
    rule = extract.PointRule(".*|$|AND", "{BODY|$.b}", "m", fields=["BODY|$|v|$.v"])
    rows = [(i, "x", f'{{"b":"b{i % 2}","v":{i}}}', START) for i in range(10)]
    schema = "message_id bigint, address string, body string, ts timestamp"
    source = str(tmp_path / "in")
    add_files(spark.createDataFrame(rows, schema), source, 2)
    struct = spark.createDataFrame([], schema).schema
    points = extract.extract_points(runs.stream_files(spark, source, struct), [rule])
    sinks.stream_points(points, str(tmp_path / "store"), str(tmp_path / "c1"), interval=None).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "store"))
    assert {(r.bucket, r["count"]) for r in stored.groupBy("bucket").count().collect()} == {("b0", 5), ("b1", 5)}

    seen = []
    points = extract.extract_points(runs.stream_files(spark, source, struct, per_trigger=1), [rule])
    runs.for_each_batch(points, lambda df, n: seen.append((n, df.count())), str(tmp_path / "c2")).awaitTermination()
    assert len(seen) == 2 and sum(n for _, n in seen) == 10


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    write = runs.write_batch(str(tmp_path))
    for _ in range(2):
        write(spark.range(3), 0)
    write(spark.range(3, 5), 1)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path)).collect()) == [0, 1, 2, 3, 4]


def test_open_deliveries_come_out_without_acknowledgement(spark, tmp_path):
    at = lambda s: START + datetime.timedelta(seconds=s)
    late = START + datetime.timedelta(days=30)
    tables = {
        "p": ("message_id bigint, ts timestamp, queue string, client_id string, node string, size bigint",
              [(1, at(0), "q", "c", "n", 1), (2, at(1), "q", "c", "n", 1), (9, late, "q", "c", "n", 1)]),
        "d": ("message_id bigint, ts timestamp, queue string, consumer string",
              [(1, at(2), "q", "w"), (2, at(3), "q", "w"), (3, at(3), "q", "w"), (9, late, "q", "w")]),
        "a": ("message_id bigint, ts timestamp, queue string", [(1, at(4), "q"), (9, late, "q")]),
    }
    streams = []
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
        struct = spark.createDataFrame([], schema).schema
        streams.append(runs.stream_files(spark, str(tmp_path / name), struct))
    out = runs.run_to_table(runs.correlate_lifecycle_stream(*streams, within="1 hour"), "test").filter("message_id < 9")
    got = {(r.message_id, r.publish_ts is not None, r.ack_ts is not None) for r in out.collect()}
    assert got == {(1, True, True), (2, True, False), (3, False, False)}


def test_step_functions_run_on_streams(spark, tmp_path):
    schema = "message_id bigint, address string, body string, properties map<string,string>, ts timestamp, group_id string"
    rows = [(i, "iotdpp.src.output", f'{{"a":{i % 3}}}', None, START, None) for i in range(9)]
    source = str(tmp_path / "in")
    add_files(spark.createDataFrame(rows, schema), source, 2)
    stream = runs.stream_files(spark, source, spark.createDataFrame([], schema).schema)
    steps = config.parse_steps(
        '{"one": {"inputStream": "src", "groupingKeyAccessor": {"source": "BODY_JSON", "expression": "a"}},'
        ' "two": {"inputStream": "one"}}'
    )
    outputs = routing.run_steps(stream, steps, {"one": lambda df: df.filter("group_id <> '0'")})
    got = runs.run_to_table(outputs["two"], "test").collect()
    assert sorted(r.message_id for r in got) == [1, 2, 4, 5, 7, 8]
    assert {r.address for r in got} == {"iotdpp.two.output"}


def test_registry_keeps_the_first_definition_over_batches(spark, tmp_path):
    schema = "application_id string, message_id bigint, ts timestamp"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ([("a", 2, START), ("b", 1, START)], [("a", 9, START + datetime.timedelta(1)), ("c", 5, START)]):
        add_files(spark.createDataFrame(part, schema), source, 1)
    stream = runs.stream_files(spark, source, spark.createDataFrame([], schema).schema, per_trigger=1)
    runs.store_registry(stream, out, str(tmp_path / "c")).awaitTermination()
    got = {(r.application_id, r.message_id) for r in runs.registry_from_store(spark, out).collect()}
    assert got == {("a", 2), ("b", 1), ("c", 5)}


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


CLOSING = START + datetime.timedelta(days=30)
LIFECYCLE = {
    "p": "message_id bigint, original_message_id bigint, ts timestamp, queue string, client_id string, node string, size bigint",
    "d": "message_id bigint, original_message_id bigint, ts timestamp, queue string, consumer string",
    "a": "message_id bigint, original_message_id bigint, ts timestamp, queue string",
}


def correlated_over_batches(spark, folder, batches, within="1 hour"):
    """Runs batches of {"p": rows, "d": rows, "a": rows}, one micro-batch each, then a closing one."""
    close = {"p": [(-1, None, CLOSING, "q", "c", "n", 1)], "d": [], "a": []}
    for batch in [*batches, close]:
        for name, schema in LIFECYCLE.items():
            spark.createDataFrame(batch.get(name, []), schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
        streams = [
            runs.stream_files(spark, f"{folder}/{name}", spark.createDataFrame([], schema).schema)
            for name, schema in LIFECYCLE.items()
        ]
        out = runs.correlate_lifecycle_stream(*streams, within=within)
        runs.to_files(out, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_acknowledgements_belong_to_the_latest_delivery_over_batches(spark, tmp_path):
    """Events of one message come in any order, on two nodes, with restarts in between."""
    batches = [
        {"a": [(1, None, at(9), "q")], "d": [(101, 1, at(7), "q", "w2")]},
        {"p": [(1, None, at(0), "q", "c", "n1", 5), (101, 1, at(1), "q", "c", "n2", 5)], "d": [(1, None, at(2), "q", "w1"), (1, None, at(3), "r", "w1")]},
        {"a": [(101, 1, at(8), "q"), (1, None, at(4), "r"), (1, None, at(1), "r")], "d": [(2, None, at(5), "q", "w3")]},
    ]
    got = {
        (r.message_id, r.queue, r.consumer, r.deliver_ts, r.ack_ts, r.publish_node)
        for r in correlated_over_batches(spark, str(tmp_path), batches).collect()
    }
    assert got == {
        (1, "q", "w1", at(2), None, "n1"), (1, "q", "w2", at(7), at(8), "n1"), (1, "r", "w1", at(3), at(4), "n1"),
        (2, "q", "w3", at(5), None, None),
    }


def test_correlation_over_batches_equals_batch(spark, tmp_path):
    rnd = random.Random(3)
    events = {"p": [], "d": [], "a": []}
    for i in range(60):
        copy, original = (1000 + i, i) if i % 3 == 0 else (i, None)
        events["p"].append((i, None, at(i), "q", "c", "n1", i))
        for _ in range(rnd.randint(0, 3)):
            events["d"].append((copy, original, at(i + rnd.randint(1, 20)), rnd.choice("qr"), rnd.choice("vw")))
        for _ in range(rnd.randint(0, 3)):
            events["a"].append((copy, original, at(i + rnd.randint(1, 30)), rnd.choice("qr")))
    shuffled = {name: rnd.sample(rows, len(rows)) for name, rows in events.items()}
    parts = [{name: rows[k::3] for name, rows in shuffled.items()} for k in range(3)]
    columns = ["message_id", "queue", "consumer", "deliver_ts", "ack_ts", "publish_ts", "publish_node", "message_size"]
    got = correlated_over_batches(spark, str(tmp_path), parts).select(*columns).collect()
    whole = lifecycle.correlate_lifecycle(*[spark.createDataFrame(events[n], LIFECYCLE[n]) for n in "pda"])
    assert sorted(map(str, got)) == sorted(map(str, whole.select(*columns).collect()))


def test_sketches_count_within_their_error(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    rows = [("q", START, START, None, f"w{i % 40}", f"g{i}") for i in range(5000)]
    add_files(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "in"), 3)
    stream = runs.stream_files(spark, str(tmp_path / "in"), schema, per_trigger=1)
    out = str(tmp_path / "out")
    runs.store_states(stream, INTERVAL, out, str(tmp_path / "c"), sketch=True).awaitTermination()
    row = runs.snapshots_from_store(spark, out, INTERVAL, sketch=True).collect()[0]
    assert row.message_count == 5000 and row.consumers_count == 40
    assert abs(row.group_count - 5000) <= 4 * 1.04 / 2**6 * 5000


def test_state_goes_on_and_ends(spark, tmp_path):
    """A key that is idle loses its state; the number of states does not grow with the keys ever seen."""
    schema = "k string, ts timestamp"
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    struct = spark.createDataFrame([], schema).schema
    states = []

    def counting(key, state, rows):
        n = (state[0] if state else 0) + len(rows)
        return (n,), pd.DataFrame({"k": [key[0]], "n": [n]})

    for hour in range(5):
        rows = [(f"only in {hour}", at(3600 * hour)), ("always", at(3600 * hour)), ("always", at(3600 * hour + 5))]
        rows += [("sometimes", at(3600 * hour))] if hour in (0, 4) else []
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = runs.stream_files(spark, source, struct).withWatermark("ts", "1 minute")
        counted = keyed.with_state(stream, ["k"], counting, "n bigint", "k string, n bigint", order=["ts"], idle_ms=5400_000)
        query = runs.to_files(counted, out, checkpoint)
        query.awaitTermination()
        states.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = sorted((r.k, r.n) for r in spark.read.parquet(out).collect())
    assert got == sorted(
        [("always", 2 * n) for n in range(1, 6)] + [(f"only in {h}", 1) for h in range(5)] + [("sometimes", 1)] * 2
    )
    assert max(states[2:]) <= states[1] + 4


def test_folders_stay_few_and_survive_a_crash(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    total = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    write = store.write_merged(path, total, total, every=4)
    most = 0
    for batch in range(100):
        df = spark.createDataFrame([(f"k{batch % 3}", 1), ("k0", 1)], "k string, n bigint").coalesce(1)
        if batch == 50:  # the batch is written, then the merge before it is lost half way
            spark.createDataFrame([("broken", 1)], "k string, n bigint").coalesce(1).write.parquet(f"{path}/upto=50")
            (tmp_path / "store" / "upto=50" / "_SUCCESS").unlink()
        write(df, batch)
        if batch in (7, 30):  # repeated after a restart
            write(df, batch)
        found = store.folders(spark, path)
        most = max(most, len(found["batch"]) + len(found["upto"]))
    got = {r.k: r.n for r in store.read_store(spark, path, total).collect()}
    assert got == {"k0": 134, "k1": 33, "k2": 33}
    assert most <= 2 * 4 + 2
    with pytest.raises(ValueError, match="nothing is stored"):
        store.read_store(spark, str(tmp_path / "none"), total)


def test_job_states_add_up_over_batches(spark, tmp_path):
    rnd = random.Random(8)
    steps = ["a", "b", "c"]
    schema = "message_id bigint, src struct<completion_timestamp:string>, " + ", ".join(
        f"{s} struct<completion_timestamp:string>" for s in steps
    ) + ", step string, ts timestamp"

    def done():
        return (rnd.choice([None, f"2024-01-0{rnd.randint(1, 9)}T00:00:00Z"]),)

    rows = [(rnd.randint(1, 20), done(), done(), done(), done(), rnd.choice([None, "src", *steps]), at(i)) for i in range(200)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame(rows, schema)
    add_files(df, source, 7)
    stream = runs.stream_files(spark, source, df.schema, per_trigger=1)
    runs.store_job_state(stream, steps, out, str(tmp_path / "c"), every=2).awaitTermination()
    got = runs.jobs_from_store(spark, out, steps).collect()
    assert sorted(map(str, got)) == sorted(map(str, jobs.job_state(df, steps).select(*got[0].asDict()).collect()))


def test_steps_run_as_streams_of_their_own(spark, tmp_path):
    """Each step goes on where it stopped; an output with two readers is written once; a step has a state."""
    schema = "message_id bigint, address string, body string, properties map<string,string>, ts timestamp, group_id string"
    source, path = str(tmp_path / "in"), str(tmp_path / "steps")
    struct = spark.createDataFrame([], schema).schema
    steps = config.parse_steps(
        '{"one": {"inputStream": "src", "groupingKeyAccessor": {"source": "BODY_JSON", "expression": "a"}},'
        ' "two": {"inputStream": "one"}, "three": {"inputStream": "one"}}'
    )

    def numbered(key, state, rows):
        n = state[0] if state else 0
        rows = rows.assign(body=[str(n + i + 1) for i in range(len(rows))])
        return (n + len(rows),), rows[["message_id", "address", "body", "ts", "group_id"]]

    layout = "message_id bigint, address string, body string, ts timestamp, group_id string"
    functions = {
        "one": lambda df: df.filter("group_id <> '0'").drop("properties"),
        "three": lambda df: keyed.with_state(df, ["group_id"], numbered, "n bigint", layout, order=["message_id"]),
    }
    for part in (range(9), range(9, 15)):
        rows = [(i, "iotdpp.src.output", f'{{"a":{i % 3}}}', None, START, None) for i in part]
        add_files(spark.createDataFrame(rows, schema), source, 2)
        runs.run_steps_stream(runs.stream_files(spark, source, struct), steps, functions, path)
    kept = [i for i in range(15) if i % 3]
    assert sorted(r.message_id for r in runs.step_output(spark, path, "two").collect()) == kept
    three = {(r.message_id, r.group_id, r.body, r.address) for r in runs.step_output(spark, path, "three").collect()}
    assert three == {(i, str(i % 3), str(i // 3 + 1), "iotdpp.three.output") for i in kept}


def test_a_stream_ends_with_the_first_match(spark, tmp_path):
    schema = "message_id bigint, reception_date timestamp, topic string, body string, application_id string, correlation_id string"
    struct = spark.createDataFrame([], schema).schema
    source = str(tmp_path / "in")
    rows = [(i, at(100 - i), "t", "x", f"app-{i % 2}", None) for i in range(10)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    look = lambda name, **options: runs.first_match(runs.stream_files(spark, source, struct), str(tmp_path / name), **options)
    assert look("a", application="app-1").message_id == 9
    assert look("b", topic="none", interval=None) is None
    assert look("c", topic="late", timeout=3) is None
    spark.createDataFrame([(77, at(5), "late", "x", None, None)], schema).coalesce(1).write.mode("append").parquet(source)
    assert look("c", topic="late", timeout=60).message_id == 77  # goes on where it stopped
    assert not [q for q in spark.streams.active if q.isActive]
