"""Table operators on small tables."""

import datetime
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewire import schemas
from tidewire.operators import access, bridging, extract, jobs, lifecycle, lookup, routing
from tidewire.plans import inputs
from tidewire.sources import config, messages, roles, sinks

# Configuration keys, addresses and results of the conformance vectors in this file.

START = datetime.datetime(2024, 1, 1)

MESSAGE = "message_id bigint, address string, body string, properties map<string,string>, ts timestamp, user string, group_id string"


def log(spark, rows):
    """Rows ``id, address, body, properties, user, group``."""
    made = [
        (i, address, body, props, START + datetime.timedelta(seconds=i), user, group)
        for i, address, body, props, user, group in rows
    ]
    return spark.createDataFrame(made, MESSAGE)


# ------------------------------------------------------------------ points


def test_vehicle_points(spark):
    rule = extract.PointRule.from_config(
        {
            "filterExpression": r".*\.vehicles\..*\.location$|$|AND",
            "bucketExpression": "vehicle_locations",
            "measurementExpression": "locationv2",
            "fieldExpressions": ["BODY|$|latitude|$.lat", "BODY|$|longitude|$.lon"],
            "tagExpressions": [r"ADDRESS|.*\.vehicles\.(.*)\.location$|vid:$1"],
        }
    )
    dated = extract.PointRule(rule.filter, rule.bucket, rule.measurement, rule.tags, rule.fields, "BODY|$.date|TIMESTAMP")
    df = log(
        spark,
        [
            (1, "data.vehicles.LX23.location", '{"lat":10.0,"lon":2.0}', None, "u", None),
            (2, "data\\.vehicles.LX24.location", '{"lat":"n/a","lon":2,"date":1000}', None, "u", None),
            (3, "data.vehicles.LX25.location", "broken", None, "u", None),
            (4, "data.ships.S1.location", '{"lat":1,"lon":2}', None, "u", None),
        ],
    )
    points = extract.extract_points(df, [rule, dated]).orderBy("message_id", "rule").collect()
    assert [(p.message_id, p.rule) for p in points] == [(1, 0), (2, 0), (2, 1)]
    first, second, third = points
    assert first.tags == {"vid": "LX23"}
    assert first.fields_num == {"latitude": 10.0, "longitude": 2.0} and first.fields_str == {}
    assert first.time.second == 1
    assert second.fields_str == {"latitude": "n/a"} and second.fields_num == {"longitude": 2.0}
    assert third.time == datetime.datetime(1970, 1, 1, 0, 0, 1)
    rejected = [tuple(r) for r in extract.rejected_points(df, [rule, dated]).collect()]
    assert rejected == [(1, 1, "time")]


def test_later_tags_overwrite_earlier_ones(spark):
    rule = extract.PointRule(".*|$|AND", "b", "m", tags=["BODY|$|k|$.a", "BODY|$|k|$.b"], fields=["BODY|$|$.f[*]"])
    df = log(spark, [(1, "x", '{"a":1,"b":2,"f":[{"u":1},{"u":5},3]}', None, "u", None)])
    point = extract.extract_points(df, [rule]).first()
    assert point.tags == {"k": "2"} and point.fields_num == {"u": 5.0}


def test_one_scan_and_one_parse_for_all_rules(spark):
    df = inputs.messages(spark, "/root/testdata/sf0.001")
    from tidewire.plans.queries_batch import RULES

    plan = extract.extract_points(df, RULES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert plan.count("from_json(StructField(") == 1


def test_points_and_buckets_written(spark, tmp_path):
    rule = extract.PointRule(".*|$|AND", "{BODY|$.b}", "m", fields=["BODY|$|v|$.v"])
    df = log(spark, [(i, "x", json.dumps({"b": f"b{i % 3}", "v": i}), None, "u", None) for i in range(9)])
    points = extract.extract_points(df, [rule])
    sinks.write_points(points, str(tmp_path / "store"))
    back = spark.read.parquet(str(tmp_path / "store"))
    assert {(r.bucket, r["count"]) for r in back.groupBy("bucket").count().collect()} == {("b0", 3), ("b1", 3), ("b2", 3)}
    known = spark.createDataFrame([("b0",)], "bucket string")
    assert {r.bucket for r in sinks.missing_buckets(points, known).collect()} == {"b1", "b2"}


# ------------------------------------------------------------------ configuration, routing, groups


def test_steps_from_text_and_file(spark, tmp_path):
    spec = {"stepA": {"inputStream": "src", "groupingKeyAccessor": {"source": "BODY_JSON", "expression": "fieldA"}}}
    file = tmp_path / "p.JSON"
    file.write_text(json.dumps(spec))
    for given in (json.dumps(spec), str(file)):
        assert [tuple(r) for r in config.load_pipeline(spark, given).collect()] == [("stepA", "src", "BODY_JSON", "fieldA")]
    for bad in ("no json", "/none/such.json", '{"a": {}}', '{"a": {"inputStream": "s", "groupingKeyAccessor": {"source": "X", "expression": "y"}}}'):
        assert config.load_pipeline(spark, bad).count() == 0


def test_group_keys_from_file_win(spark, tmp_path):
    entry = lambda e: {"source": "BODY_JSON", "expression": e}
    file = tmp_path / "k.json"
    file.write_text(json.dumps({"a1": entry("x"), "a2": entry("y")}))
    rows = config.parse_group_keys(str(file), json.dumps({"other": entry("z")}))
    assert {r["address"] for r in rows} == {"a1", "a2"}
    assert config.parse_group_keys("/none/such.json") == []
    assert config.parse_group_keys() == []
    assert [tuple(r) for r in config.load_group_keys(spark, inline=json.dumps({"a": entry("x")})).collect()] == [("a", "BODY_JSON", "x")]


STEPS = json.dumps(
    {
        "stepA": {"inputStream": "src", "groupingKeyAccessor": {"source": "BODY_JSON", "expression": "fieldA"}},
        "stepB": {"inputStream": "stepA", "groupingKeyAccessor": {"source": "BODY_JSON", "expression": "fieldB"}},
    }
)


def test_pipeline_of_sixty_messages(spark):
    steps = config.parse_steps(STEPS)
    df = log(
        spark,
        [
            (i, "iotdpp.src.output", json.dumps({"id": i, "fieldA": i % 9 + 1, "fieldB": i % 7 + 1}), None, "u", None)
            for i in range(60)
        ]
        + [(99, "activemq.management", "{}", None, "u", None)],
    )
    assert {r.address for r in routing.step_addresses(config.load_pipeline(spark, STEPS)).filter("address LIKE '%stepA%' OR address LIKE '%src%'").collect()} == {
        "iotdpp.src.output", "iotdpp.stepA.input.src", "iotdpp.stepA.output", "iotdpp.stepB.input.stepA",
    }
    routed = routing.route_and_annotate(df, steps)
    assert {(r.step, r["count"]) for r in routed.groupBy("step").count().collect()} == {("stepA", 60)}
    outputs = routing.run_steps(df, steps, {})
    assert outputs["stepB"].count() == 60
    assert {r.group_id for r in outputs["stepB"].collect()} == {str(i) for i in range(1, 8)}


def test_steps_need_no_join_and_read_the_source_once(spark, capsys):
    rows = [
        {"step": "a", "input_stream": "src", "key_source": "BODY_JSON", "key_expr": "$.k"},
        {"step": "b", "input_stream": "a", "key_source": None, "key_expr": None},
        {"step": "c", "input_stream": "a", "key_source": "PROPERTY", "key_expr": "p"},
    ]
    df = log(spark, [(i, "iotdpp.src.output", f'{{"k":{i % 3}}}', {"p": "x"}, "u", None) for i in range(9)])
    outputs = routing.run_steps(df, rows, {})
    assert {r.group_id for r in outputs["b"].collect()} == {"0", "1", "2"}
    assert {(r.group_id, r.address) for r in outputs["c"].collect()} == {("x", "iotdpp.c.output")}
    outputs["b"].unionByName(outputs["c"]).explain()
    plan = capsys.readouterr().out
    assert "Join" not in plan and "Scan ExistingRDD" not in plan


def test_exclusive_groups_are_in_one_task_in_order(spark):
    rows = [(i, "x", "{}", None, "u", str(i % 5) if i % 10 else None) for i in range(200)]
    met = routing.group_exclusive(log(spark, rows).orderBy(F.rand(5)), partitions=7)
    placed = met.select("message_id", "group_id", F.spark_partition_id().alias("task")).collect()
    tasks, order = {}, {}
    for r in placed:
        tasks.setdefault(r.group_id, set()).add(r.task)
        order.setdefault((r.group_id, r.task), []).append(r.message_id)
    assert all(len(t) == 1 for g, t in tasks.items() if g is not None) and len(tasks[None]) > 1
    assert all(ids == sorted(ids) for ids in order.values())


def test_an_acknowledgement_belongs_to_the_latest_delivery(spark):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    published = spark.createDataFrame(
        [(1, None, at(0), "q", "c", "n", 5), (9, 1, at(1), "q", "c", "m", 5)],
        "message_id long, original_message_id long, ts timestamp, queue string, client_id string, node string, size long",
    )
    delivered = spark.createDataFrame(
        [(1, None, at(1), "q", "w1"), (9, 1, at(10), "q", "w2"), (1, None, at(20), "q", "w3")],
        "message_id long, original_message_id long, ts timestamp, queue string, consumer string",
    )
    acked = spark.createDataFrame(
        [(1, None, at(5), "q"), (1, None, at(7), "q"), (9, 1, at(10), "q")],
        "message_id long, original_message_id long, ts timestamp, queue string",
    )
    rows = lifecycle.correlate_lifecycle(published, delivered, acked).collect()
    assert {(r.consumer, r.message_id, r.publish_node, r.ack_ts) for r in rows} == {
        ("w1", 1, "n", at(5)), ("w2", 1, "n", at(10)), ("w3", 1, "n", None),
    }
    assert len(rows) == 3


def test_step_order_refuses_cycles():
    rows = [{"step": "a", "input_stream": "b"}, {"step": "b", "input_stream": "a"}]
    with pytest.raises(ValueError):
        routing.step_order(rows)


def test_annotation_keeps_or_overrides(spark):
    keys = config.parse_group_keys(inline='{"x": {"source": "PROPERTY", "expression": "p"}}')
    df = log(
        spark,
        [
            (1, "x", "{}", {"p": "new"}, "u", "old"),
            (2, "x", "{}", {"p": "new"}, "u", None),
            (3, "x", "{}", None, "u", "old"),
            (4, "y", "{}", {"p": "new"}, "u", None),
        ],
    )
    def groups(override):
        rows = routing.annotate_group(df, keys, override).orderBy("message_id").collect()
        return [r.group_id for r in rows]

    assert groups(False) == ["old", "new", "old", None]
    assert groups(True) == ["new", "new", "old", None]


def test_groups_stay_in_order_and_are_split(spark):
    rows = [(i, "x", "{}", None, "u", "hot" if i % 3 else None) for i in range(300)]
    ordered = routing.group_ordered(log(spark, rows).orderBy(F.rand(5)), partitions=6)
    parts = ordered.withColumn("part", F.spark_partition_id()).collect()
    assert len(parts) == 300
    hot = [(r.part, r.message_id) for r in parts if r.group_id == "hot"]
    assert len({p for p, _ in hot}) > 1
    assert [m for _, m in hot] == sorted(m for _, m in hot)


# ------------------------------------------------------------------ lifecycle


def test_three_events_of_one_message(spark):
    at = lambda s: START + datetime.timedelta(seconds=s)
    published = spark.createDataFrame([(1, at(0), "atopic", "c", "n1", 7)], "message_id bigint, ts timestamp, queue string, client_id string, node string, size bigint")
    delivered = spark.createDataFrame([(1, at(2), "atopic", "w")], "message_id bigint, ts timestamp, queue string, consumer string")
    acked = spark.createDataFrame([(1, at(5), "atopic")], "message_id bigint, ts timestamp, queue string")
    events = {e.event_type: e for e in lifecycle.lifecycle_events(published, delivered, acked).collect()}
    assert len(events) == 3
    assert {e.message_id for e in events.values()} == {1}
    assert {e.publish_node for e in events.values()} == {"n1"}
    assert events["Acknowledged"].deliver_ts == events["Delivered"].ts
    assert events["Acknowledged"].publish_ts == events["Published"].ts
    metrics = {r.name: r.value for r in lifecycle.lifecycle_metrics(lifecycle.lifecycle_events(published, delivered, acked)).collect()}
    assert metrics == {
        "atopic_MessagePublished_Size_SENSOR": 7.0, "atopic_MessageDelivered_Size_SENSOR": 7.0,
        "atopic_MessageDelivered_Latency_SENSOR": 2000.0, "atopic_MessageAcknowledged_Size_SENSOR": 7.0,
        "atopic_MessageAcknowledged_Latency_SENSOR": 5000.0,
    }


def test_metric_payload(spark):
    df = spark.createDataFrame([("n", 2.5, 7)], "name string, value double, timestamp bigint")
    encoded = sinks.encode_metrics(df, "monitoring.")
    row = encoded.first()
    assert row.topic == "monitoring.n"
    assert json.loads(row.payload) == {"metricValue": 2.5, "level": 1, "timestamp": 7}
    assert tuple(sinks.decode_metrics(encoded).first()) == ("monitoring.n", 2.5, 1, 7)


# ------------------------------------------------------------------ jobs


def test_job_status_and_renewed_steps(spark):
    def out(step, second, **done):
        body = {"message_id": 1, "src": {"completion_timestamp": "2024-01-01T00:00:00Z"}}
        for name in ("stepA", "stepB"):
            body[name] = {"duration": "1"} | ({"completion_timestamp": done[name]} if name in done else {})
        return (f"iotdpp/{step}/output", json.dumps(body), START + datetime.timedelta(seconds=second))

    rows = [
        out("src", 0),
        out("stepA", 1, stepA="2024-01-01T00:00:01Z"),
        # B's message still carries an old A, which must not win
        out("stepB", 3, stepA="2024-01-01T00:00:01Z", stepB="2024-01-01T00:00:03.5Z"),
        out("stepA", 2, stepA="2024-01-01T00:00:02Z"),
    ]
    steps = ["stepA", "stepB"]

    def state(n):
        df = spark.createDataFrame(rows[:n], "topic string, body string, ts timestamp")
        return jobs.job_state(jobs.parse_outputs(df, steps), steps)

    assert [state(n).first().status for n in (1, 2, 4)] == ["PENDING", "ONGOING", "COMPLETED"]
    latencies = {r.step: r for r in jobs.step_latency(state(4), {"stepA": "src", "stepB": "stepA"}).collect()}
    assert (latencies["stepA"].step_latency, latencies["stepB"].step_latency) == (2, 1)
    assert (latencies["stepB"].accumulated_latency, latencies["stepB"].accumulated_seconds) == (3, 3.5)


# ------------------------------------------------------------------ bridging


def test_bridged_messages_do_not_come_back(spark):
    df = log(
        spark,
        [
            (1, "t", "{}", {"application": "X"}, "u", None),
            (2, "t", "{}", {"application": "XB"}, "u", None),
            (3, "t", "{}", None, "u", None),
        ],
    )
    there = bridging.bridge_messages(df, "X")
    assert [r.message_id for r in there.collect()] == [1]
    assert bridging.bridge_messages(there, "X").count() == 0


def test_senders(spark):
    cases = [
        ("bridge-a", "a", True), ("bridge-a", "b", False), ("bridge-a", None, False), ("user", "b", True),
        ("bridgefoo", "bridgefoo", True), ("bridgefoo", "foo", False), (None, "a", True),
        ("bridge-bridge-a", "bridge-a", True),
    ]
    df = log(spark, [(i, "t", "{}", {"application": app} if app else None, user, None) for i, (user, app, _) in enumerate(cases)])
    got = [r.accepted for r in bridging.audit_senders(df).orderBy("message_id").collect()]
    assert got == [accepted for *_, accepted in cases]


def test_definitions_need_all_keys_and_hide_them(spark):
    body = lambda v: json.dumps({"env-var": v})
    full = {"APPLICATION_ID": "a", "SECRET": "s"}
    df = log(
        spark,
        [
            (1, "topic://define", body(full), None, "u", None),
            (2, "define", body({"APPLICATION_ID": "b"}), None, "u", None),
            (3, "define", body(full), None, "u", None),
            (4, "define", "broken", None, "u", None),
            (5, "other", body(full), None, "u", None),
        ],
    )
    definitions = bridging.app_definitions(df, "define", ["SECRET"])
    assert definitions.columns == ["message_id", "ts", "application_id"]
    assert {r.message_id for r in definitions.collect()} == {1, 3}
    assert [(r.application_id, r.message_id) for r in bridging.app_registry(definitions).collect()] == [("a", 1)]


# ------------------------------------------------------------------ patterns and roles


def python_regex(pattern):
    parts = [r"(?:\.[^.]+)*" if w in ">#" else r"\.[^.]+" if w == "*" else re.escape("." + w) for w in pattern.split(".")]
    return re.compile("".join(parts))


def test_pattern_matching_equals_brute_force(spark):
    rnd = random.Random(11)
    words = ["a", "b", "c+", "d"]
    addresses = sorted({".".join(rnd.choice(words) for _ in range(rnd.randrange(1, 6))) for _ in range(150)})
    signs = words[:3] + ["*", ">", "#"]
    patterns = sorted({".".join(rnd.choice(signs) for _ in range(rnd.randrange(1, 6))) for _ in range(200)})
    got = access.match_patterns(
        spark.createDataFrame([(a,) for a in addresses], "address string"),
        spark.createDataFrame([(p,) for p in patterns], "pattern string"),
    )
    expected = {(a, p) for p in patterns for a in addresses if python_regex(p).fullmatch("." + a)}
    rows = [(r.address, r.pattern) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected


def test_pattern_matching_is_a_hash_join(spark):
    got = access.match_patterns(
        spark.createDataFrame([("a.b",)], "address string"), spark.createDataFrame([("a.*",)], "pattern string")
    )
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_role_export(spark, tmp_path):
    export = [
        {"id": "1", "name": "r1", "attributes": {"managed": ["true"], "match": ["a.>"], "read": ["Yes"], "write": ["no"]}},
        {"id": "2", "name": "r2", "attributes": {"managed": ["true"], "match": [" "]}},
        {"id": "3", "name": "r3", "attributes": {"match": ["b"]}},
        {"id": "4", "name": "r4"},
    ]
    file = tmp_path / "roles.json"
    file.write_text(json.dumps(export))
    eligible = access.eligible_roles(roles.read_roles(spark, str(file)), "managed")
    flags = access.role_flags(eligible).collect()
    assert [(r.id, r.match, r.read, r.write, r.edit) for r in flags] == [("1", "a.>", True, False, False)]


def test_reconcile(spark):
    schema = "match string, name string, write boolean"
    current = spark.createDataFrame([("m1", "a", False), ("m1", "b", False), ("m2", "c", True)], schema)
    incoming = spark.createDataFrame([("m1", "a", True), ("m1", "new", True), ("m3", "d", True)], schema)
    got = {tuple(r) for r in access.reconcile(current, incoming, "match", "name").collect()}
    assert got == {("m1", "a", True), ("m2", None, None), ("m3", "d", True)}


def test_write_needs_a_role(spark):
    df = log(spark, [(1, "topic.a", "", None, "ann", None), (2, "topic.a", "", None, "bob", None), (3, "topic.b", "", None, "ann", None)])
    user_roles = spark.createDataFrame([("ann", "writer"), ("bob", "reader")], "user string, role string")
    policies = spark.createDataFrame([("topic.a", "writer", True), ("topic.>", "reader", False)], "match string, name string, write boolean")
    got = {(r.user, r.address): r.allowed for r in access.access_audit(df, user_roles, policies).collect()}
    assert got == {("ann", "topic.a"): True, ("bob", "topic.a"): False, ("ann", "topic.b"): False}


# ------------------------------------------------------------------ log and sources


def test_log_lookups(spark):
    df = log(spark, [(i, "topic://t", "{}", {"application": f"a{i % 2}"}, "u", None) for i in range(6)])
    stored = lookup.stored_log(df)
    assert lookup.find_first(stored, application="a1").first().message_id == 1
    assert lookup.find_last(stored, application="a0", topic="t").first().message_id == 4
    assert lookup.log_lookup(stored, predicate=F.col("message_id") > 3).count() == 2
    assert lookup.find_first(stored, topic="none").count() == 0


def test_read_messages(spark, tmp_path):
    path = str(tmp_path / "m")
    df = log(spark, [(1, "x", None, None, "u", None)]).withColumn("body_bytes", F.encode(F.lit("né"), "UTF-8"))
    df.write.parquet(path)
    schema = schemas.MESSAGES + ", body_bytes binary"
    assert messages.read_messages(spark, path, schema=schema).first().body == "né"
    assert messages.read_messages(spark, path, streaming=True).isStreaming


def test_kafka_records(spark):
    raw = spark.sql(
        "SELECT encode('g', 'UTF-8') AS key, encode('{\"a\":1}', 'UTF-8') AS value, 'top.ic' AS topic, 2 AS partition, "
        "7L AS offset, timestamp'2024-01-01 00:00:00' AS timestamp, "
        "array(named_struct('key', 'application', 'value', encode('x', 'UTF-8'))) AS headers"
    )
    row = messages.from_kafka_records(raw, ["top.ic"]).first()
    assert (row.address, row.body, row.group_id, row.properties) == ("top.ic", '{"a":1}', "g", {"application": "x"})
    assert row.message_id == (2 << 39) + 7 and row.size == 7


def test_kafka_ids_are_unique(spark):
    places = [("a", 0, 5), ("b", 0, 5), ("a", 1, 5), ("a", 0, 6), ("b", 16383, (1 << 39) - 1)]
    raw = spark.createDataFrame(places, "topic string, partition int, offset long")
    ids = [r[0] for r in raw.select(messages.kafka_message_id(["a", "b"])).collect()]
    assert len(set(ids)) == 5 and min(ids) >= 0
    with pytest.raises(Exception, match="no message id"):
        raw.select(messages.kafka_message_id(["a"])).collect()


def test_points_keep_their_types(spark, tmp_path):
    rows = [("007", "1", 1.5), ("", "m", 2.0), ("b", "", 3.0)]
    points = spark.createDataFrame(rows, "bucket string, measurement string, value double")
    sinks.write_points(points, str(tmp_path / "points"))
    back = sinks.read_points(spark, str(tmp_path / "points"), points.schema)
    assert back.dtypes == points.dtypes and sorted(map(tuple, back.collect())) == sorted(rows)
