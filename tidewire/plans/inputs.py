"""The tables at hand read as message logs, job logs and role exports.

The registered queries and the bench start from these. All of them are projections of the given
tables, so a query prunes what it does not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MINUTE_MS = 60_000
HOUR_MS = 60 * MINUTE_MS

STEPS_SPEC = """{
  "stepA": {"inputStream": "src", "groupingKeyAccessor": {"source": "BODY_JSON", "expression": "props.k"}},
  "stepB": {"inputStream": "stepA", "groupingKeyAccessor": {"source": "BODY_JSON", "expression": "$.type"}},
  "stepC": {"input_stream": "stepB", "grouping_key_accessor": {"source": "property", "expression": "application"}},
  "stepD": {"inputStream": "stepA"}
}"""

JOB_STEPS = ("stepA", "stepB", "stepC", "stepD")
JOB_INPUTS = {"stepA": "src", "stepB": "stepA", "stepC": "stepB", "stepD": "stepA"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def after(ts: Column, ms: Column) -> Column:
    """``ts`` moved by milliseconds, to the microsecond."""
    return F.timestamp_micros(F.unix_micros(ts) + ms * 1000)


def with_event_time(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def json_body() -> Column:
    return F.concat(
        F.lit('{"id":'), F.col("event_id"),
        F.lit(',"date":'), F.unix_millis("ts"),
        F.lit(',"type":"'), F.col("event_type"),
        F.lit('","cents":'), F.round(F.col("value") * 100).cast("bigint"),
        F.lit(',"props":'), F.col("props"), F.lit("}"),
    )


def key() -> Column:
    """The number in ``props``."""
    return F.get_json_object("props", "$.k").cast("bigint")


def application() -> Column:
    return F.concat(F.lit("app-"), F.col("user_id") % 5)


def messages_of(events: DataFrame) -> DataFrame:
    """Events as messages to ``data.users.<user>.<type>`` with a JSON body. Batch or streaming."""
    return (
        with_event_time(events)
        .select(
            F.col("event_id").alias("message_id"),
            F.concat(F.lit("data.users."), F.col("user_id"), F.lit("."), F.col("event_type")).alias("address"),
            json_body().alias("body"),
            F.create_map(
                F.lit("application"), application(),
                F.lit("correlation_id"), F.concat(F.lit("c"), F.col("event_id")),
            ).alias("properties"),
            "ts",
            F.concat(F.lit("client-"), F.col("user_id")).alias("client_id"),
            F.concat(F.lit("user-"), F.col("user_id")).alias("user"),
            F.lit(None).cast("string").alias("receiving_node"),
            F.lit(None).cast("bigint").alias("original_message_id"),
            F.lit(None).cast("string").alias("group_id"),
        )
        .withColumn("size", F.length("body").cast("bigint"))
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_of(table(spark, sf_dir, "events"))


def step_messages_of(events: DataFrame) -> DataFrame:
    """Messages on the outputs of the source and of two steps."""
    number = F.col("message_id") % 3
    stream = F.when(number == 0, "src").when(number == 1, "stepA").otherwise("stepB")
    return messages_of(events).withColumn("address", F.concat(F.lit("iotdpp."), stream, F.lit(".output")))


def step_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return step_messages_of(table(spark, sf_dir, "events"))


def two_node_log_of(events: DataFrame) -> DataFrame:
    """Messages, a third of them seen again on a second node a little later."""
    log = messages_of(events)
    copies = log.filter(F.col("message_id") % 3 == 0).withColumns(
        {
            "original_message_id": F.col("message_id"),
            "message_id": F.col("message_id") + 1_000_000_000,
            "receiving_node": F.lit("node-a"),
            "ts": after(F.col("ts"), F.lit(5)),
        }
    )
    return log.unionByName(copies)


def two_node_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_node_log_of(table(spark, sf_dir, "events"))


def _deliver_ms() -> Column:
    return F.col("event_id") * 7919 % 5000


def _ack_ms() -> Column:
    return F.col("event_id") * 104729 % 3000


def published_of(events: DataFrame) -> DataFrame:
    return with_event_time(events).select(
        F.col("event_id").alias("message_id"),
        "ts",
        F.concat(F.lit("data."), F.col("event_type")).alias("queue"),
        F.concat(F.lit("client-"), F.col("user_id")).alias("client_id"),
        F.lit("node-a").alias("node"),
        F.length(json_body()).cast("bigint").alias("size"),
    )


def _received(events: DataFrame, ms: Column) -> DataFrame:
    """Every message on its own queue, each fifth on the audit queue as well."""
    own = F.concat(F.lit("data."), F.col("event_type"))
    queues = F.when(F.col("event_id") % 5 == 0, F.array(own, F.lit("data.audit"))).otherwise(F.array(own))
    return with_event_time(events).select(
        F.col("event_id").alias("message_id"),
        after(F.col("ts"), ms).alias("ts"),
        F.explode(queues).alias("queue"),
        F.concat(F.lit("w-"), key() % 4).alias("consumer"),
    )


def delivered_of(events: DataFrame) -> DataFrame:
    return _received(events, _deliver_ms())


def acknowledged_of(events: DataFrame) -> DataFrame:
    """Nine of ten messages are acknowledged."""
    return _received(events.filter(F.col("event_id") % 10 != 0), _deliver_ms() + _ack_ms()).drop("consumer")


COPY = 1_000_000_000  # added to the ids of copies on the second node


def two_node_lifecycle_of(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Publish, deliver and acknowledge events on two nodes.

    A third of the messages goes on to a second node, which publishes a copy under an id of its own and
    delivers and acknowledges that. Every seventh message is delivered again after 10 seconds, and then
    acknowledged 2 seconds later.
    """
    from_first = F.lit(None).cast("bigint").alias("original_message_id")

    def on_nodes(df: DataFrame, ms: int) -> tuple[DataFrame, DataFrame]:
        away = df.filter(F.col("message_id") % 3 == 0).withColumns(
            {
                "original_message_id": F.col("message_id"),
                "message_id": F.col("message_id") + COPY,
                "ts": after(F.col("ts"), F.lit(ms)),
            }
        )
        return df.select("*", from_first), away

    home, away = on_nodes(published_of(events), 5)
    published = home.unionByName(away.withColumn("node", F.lit("node-b")))

    def moved(df: DataFrame) -> DataFrame:
        """What the second node handles instead of the first."""
        home, away = on_nodes(df, 0)
        return home.filter(F.col("message_id") % 3 != 0).unionByName(away)

    delivered, acknowledged = delivered_of(events), acknowledged_of(events)
    again = delivered.filter(F.col("message_id") % 7 == 0).withColumns(
        {"ts": after(F.col("ts"), F.lit(10_000)), "consumer": F.lit("w-again")}
    )
    late = again.withColumn("ts", after(F.col("ts"), F.lit(2_000))).drop("consumer")
    return (
        published,
        moved(delivered.unionByName(again)),
        moved(acknowledged.unionByName(late)),
    )


def queue_messages_of(events: DataFrame) -> DataFrame:
    """One row per message with its times on the queue: what the snapshots start from."""
    e = with_event_time(events)
    deliver = after(F.col("ts"), _deliver_ms())
    return e.select(
        F.concat(F.lit("all.iotdpp."), F.col("event_type"), F.lit(".input.src")).alias("queue"),
        F.col("ts").alias("publish_ts"),
        deliver.alias("deliver_ts"),
        F.when(F.col("event_id") % 10 != 0, after(deliver, _ack_ms())).alias("ack_ts"),
        F.concat(F.lit("w-"), key() % 4).alias("consumer"),
        F.concat(F.lit("g-"), key()).alias("group_id"),
    )


def queue_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue_messages_of(table(spark, sf_dir, "events"))


def job_outputs_of(orders: DataFrame) -> DataFrame:
    """Orders as jobs: what the source and the steps publish, as ``topic, body, ts``.

    Step A fails for some jobs, B and D need A, C needs B; some results of A are sent again later.
    """
    k = F.col("o_orderkey")
    start = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    timed = orders.select(
        k.alias("k"),
        start.alias("src"),
        F.when(k % 10 != 0, start + k % 7000 + 500).alias("a"),
    )
    timed = timed.withColumns(
        {
            "b": F.when(F.col("k") % 4 != 0, F.col("a") + F.col("k") % 3000 + 250),
            "d": F.when(F.col("k") % 5 != 0, F.col("a") + F.col("k") % 11000),
        }
    ).withColumn("c", F.when(F.col("k") % 3 != 0, F.col("b") + F.col("k") % 900))

    def sent(step: str, ms: Column) -> Column:
        return F.struct(F.lit(step).alias("step"), ms.alias("done"))

    again = F.when(F.col("k") % 6 == 1, F.col("a") + 60_000)
    rows = F.array(
        sent("src", F.col("src")), sent("stepA", F.col("a")), sent("stepB", F.col("b")),
        sent("stepC", F.col("c")), sent("stepD", F.col("d")), sent("stepA", again),
    )
    out = timed.select("k", "src", F.explode(rows).alias("m")).filter(F.col("m.done").isNotNull())

    def iso(ms: Column) -> Column:
        return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")

    done = F.concat(
        F.lit(',"worker_id":"w-'), F.col("k") % 4, F.lit('","completion_timestamp":"'), iso(F.col("m.done")), F.lit('"')
    )

    def step_json(step: str) -> Column:
        extra = F.when(F.col("m.step") == step, done).otherwise("")
        return F.concat(F.lit(f',"{step}":{{"duration":"1"'), extra, F.lit("}"))

    body = F.concat(
        F.lit('{"message_id":'), F.col("k"),
        F.lit(',"src":{"completion_timestamp":"'), iso(F.col("src")), F.lit('"}'),
        *[step_json(step) for step in JOB_STEPS], F.lit("}"),
    )
    return out.select(
        F.concat(F.lit("iotdpp/"), F.col("m.step"), F.lit("/output")).alias("topic"),
        body.alias("body"),
        F.timestamp_millis("m.done").alias("ts"),
    )


def job_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_outputs_of(table(spark, sf_dir, "orders"))


def definitions_of(events: DataFrame) -> DataFrame:
    """Sign-ups as application definitions; each third lacks its secret."""
    variables = F.concat(
        F.lit('{"APPLICATION_ID":"app-'), F.col("user_id"), F.lit('"'),
        F.when(F.col("event_id") % 3 != 0, ',"BRIDGE_SECRET":"s"').otherwise(""), F.lit("}"),
    )
    return with_event_time(events.filter(F.col("event_type") == "signup")).select(
        F.col("event_id").alias("message_id"),
        F.lit("topic://cluster.define").alias("address"),
        F.concat(F.lit('{"name":"x","env-var":'), variables, F.lit("}")).alias("body"),
        "ts",
    )


def requests_of(events: DataFrame) -> DataFrame:
    """Purchases as requests; some come without a correlation id."""
    return with_event_time(events.filter(F.col("event_type") == "purchase")).select(
        F.col("event_id").alias("message_id"),
        F.concat(F.lit("app-"), F.col("user_id")).alias("application_id"),
        F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("c"), F.col("event_id"))).alias("correlation_id"),
        "ts",
    )


def replies_of(events: DataFrame) -> DataFrame:
    """Every second request is answered 1.5 seconds later."""
    return (
        requests_of(events)
        .filter(F.col("message_id") % 2 == 0)
        .withColumns({"message_id": F.col("message_id") + 1_000_000_000, "ts": after(F.col("ts"), F.lit(1500))})
    )


def role_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as roles, with attributes written as one-element lists."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")

    def yes(when: Column) -> Column:
        return F.when(when, "[Yes]").otherwise("[false]")

    attributes = F.create_map(
        F.lit("is_managed"), F.when(k % 4 != 0, "[true]").otherwise("[no]"),
        F.lit("match"), F.when(k % 7 == 0, "[ ]").otherwise(F.concat(F.lit("[data."), n, F.lit(".>]"))),
        F.lit("read"), yes(k % 2 == 0), F.lit("write"), yes(k % 3 == 0),
        F.lit("send"), F.when(k % 5 == 0, "[T]").otherwise("[]"), F.lit("createAddress"), F.lit("1"),
    )
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("r-"), k).alias("id"),
        F.concat(F.lit("role-"), k % 40).alias("name"),
        F.when(k % 11 != 0, attributes).alias("attributes"),
        "c_custkey",
    )
