"""Running the operators as streams.

Narrow operators take a streaming frame as they are. Here are the stateful ones, each with a
watermark, and the helpers that write a stream to files.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewire.operators import bridging, jobs, lifecycle, lookup, routing, snapshots
from tidewire.settings import materialize, scratch_path
from tidewire.streaming import store

WATERMARK = "10 minutes"


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
HEAP_STORE = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
DISK_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def on_disk(df: DataFrame) -> DataFrame:
    """Let the state of the stream spill to disk: the default store holds all of it in memory.

    A store that the session has chosen itself stays.
    """
    conf = df.sparkSession.conf
    if conf.get(STATE_STORE, HEAP_STORE) == HEAP_STORE:
        conf.set(STATE_STORE, DISK_STORE)
        conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return df


def stream_files(spark: SparkSession, path: str, schema, per_trigger: int | None = None) -> DataFrame:
    """A file source; ``per_trigger`` bounds the files of one micro-batch."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def _trigger(interval: str | None) -> dict:
    return {"processingTime": interval} if interval else {"availableNow": True}


def to_files(df: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Append a stream to files; without an interval it handles what is there and stops."""
    return (
        df.writeStream.trigger(**_trigger(interval))
        .option("checkpointLocation", checkpoint)
        .format("parquet")
        .start(path)
    )


def for_each_batch(
    df: DataFrame,
    consume: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    interval: str | None = None,
) -> StreamingQuery:
    """Hand every micro-batch to a function of the user: the sink for events, snapshots or metrics."""
    return (
        df.writeStream.trigger(**_trigger(interval))
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(consume)
        .start()
    )


def first_match(
    log: DataFrame, checkpoint: str, *, application: str | None = None, topic: str | None = None,
    predicate: Column | None = None, timeout: float | None = None, interval: str | None = "1 second",
) -> Row | None:
    """Wait for the first row of a streamed ``lookup.stored_log`` that meets the conditions: the stream ends as
    soon as a micro-batch has one.

    Of several in one micro-batch the earliest counts. Without an interval only what is there is looked at.
    After ``timeout`` seconds, or at the end of what is there, the result is none. The driver holds one row.
    """
    found: list[Row] = []

    def look(batch: DataFrame, batch_id: int) -> None:
        if not found:
            found.extend(lookup.find_first(batch).collect())

    wanted = lookup.log_lookup(log, application, topic, predicate)
    query = for_each_batch(wanted, look, checkpoint, interval=interval)
    ends = None if timeout is None else time.monotonic() + timeout
    while not found and query.isActive and (ends is None or time.monotonic() < ends):
        query.awaitTermination(0.2)
    query.stop()
    if query.exception() is not None:
        raise query.exception()
    return found[0] if found else None


def write_batch(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each micro-batch to its own folder; a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def run_to_table(df: DataFrame, name: str) -> DataFrame:
    """Run an append stream over all there is, then read the result back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    to_files(df, f"{path}/data", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/data")


def first_publish_stream(messages: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """One row per original message, whichever node's copy comes first."""
    return (
        on_disk(messages)
        .withColumn("original_message_id", F.coalesce("original_message_id", "message_id"))
        .withWatermark("ts", watermark)
        .dropDuplicatesWithinWatermark(["original_message_id"])
    )


def plain_time(name: str) -> Column:
    """The time without its watermark: a stream carries one event time into the next operator."""
    return F.timestamp_micros(F.unix_micros(name))


def _lifecycle_rows(kind: str, events: DataFrame) -> DataFrame:
    """Events of one kind in the layout that all kinds share."""
    layout = {"queue": "string", "consumer": "string", "client_id": "string", "node": "string", "size": "bigint"}
    fields = [
        (F.col(c) if c in events.columns else F.lit(None)).cast(t).alias(c) for c, t in layout.items()
    ]
    return events.select(
        lifecycle.original_id(events).alias("message_id"), "ts",
        F.struct(F.lit(kind).alias("kind"), plain_time("ts").alias("at"), *fields).alias("event"),
    )


def _correlated(events: Column) -> Column:
    """Deliveries among the events of a message, in order, each with its first acknowledgement."""

    def sorted_of(kind: str) -> Column:
        return F.array_sort(F.filter(events, lambda e: e["kind"] == kind))

    delivered, acknowledged = sorted_of("delivered"), sorted_of("acknowledged")

    def with_ack(d: Column, i: Column) -> Column:
        later = F.filter(delivered, lambda x, j: (j > i) & (x["queue"] == d["queue"]))
        until = F.array_min(F.transform(later, lambda x: x["at"]))
        in_turn = F.filter(
            acknowledged,
            lambda a: (a["queue"] == d["queue"]) & (a["at"] >= d["at"]) & (until.isNull() | (a["at"] < until)),
        )
        return F.struct(
            d["queue"].alias("queue"), d["consumer"].alias("consumer"), d["at"].alias("deliver_ts"),
            F.array_min(F.transform(in_turn, lambda a: a["at"])).alias("ack_ts"),
        )

    return F.transform(delivered, with_ack)


def correlate_lifecycle_stream(
    published: DataFrame,
    delivered: DataFrame,
    acknowledged: DataFrame,
    within: str,
    watermark: str = WATERMARK,
) -> DataFrame:
    """``lifecycle.correlate_lifecycle`` for streams.

    The events of a message, known by its original id on every node, are buffered until none has come
    for ``within`` and the watermark has passed that; then its deliveries are given out, each with the first
    acknowledgement between it and the next delivery. So an acknowledgement belongs to the latest delivery
    whatever the order in which events arrive. Deliveries without an acknowledgement come out without.
    The buffer lies in the state store and holds the events of the last ``within`` only.
    """
    if "original_message_id" in published.columns:
        published = published.filter("original_message_id IS NULL OR original_message_id = message_id")
    parts = [
        _lifecycle_rows(kind, df)
        for kind, df in (("published", published), ("delivered", delivered), ("acknowledged", acknowledged))
    ]
    events = on_disk(parts[0].unionByName(parts[1]).unionByName(parts[2])).withWatermark("ts", watermark)
    buffered = events.groupBy("message_id", F.session_window("ts", within)).agg(
        F.collect_list("event").alias("events")
    )
    sent = F.array_sort(F.filter("events", lambda e: e["kind"] == "published"))
    rows = buffered.select("message_id", sent.alias("sent"), F.explode(_correlated(F.col("events"))).alias("d"))
    return rows.select("message_id", "d.*", F.explode_outer("sent").alias("p")).select(
        "message_id", "queue", "consumer", "deliver_ts", "ack_ts",
        F.col("p.at").alias("publish_ts"), F.col("p.queue").alias("publish_queue"),
        F.col("p.client_id").alias("publish_client_id"), F.col("p.node").alias("publish_node"),
        F.col("p.size").alias("message_size"),
    )


def events_from_stream(published: DataFrame, correlated: DataFrame) -> DataFrame:
    return lifecycle.publish_events(published).unionByName(lifecycle.receive_events(correlated))


def store_states(
    queue_messages: DataFrame, interval_ms: int, path: str, checkpoint: str, sketch: bool = False, **kwargs
) -> StreamingQuery:
    """Reduce each micro-batch to queue states and to the consumers and groups seen, and keep both.

    Both add up over batches, so the stream has no state and the store one row per key. ``sketch`` keeps
    sketches in the place of the consumers and groups themselves.
    """
    seen, merge_seen = _seen(sketch)
    every = kwargs.pop("every", store.MERGE_EVERY)
    states = store.write_merged(
        f"{path}/states", lambda b: snapshots.queue_states(b, interval_ms), snapshots.merge_states, every
    )
    values = store.write_merged(f"{path}/seen", lambda b: seen(b, interval_ms), merge_seen, every)

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        states(kept, batch_id)
        values(kept, batch_id)
        kept.unpersist()

    return for_each_batch(queue_messages, write, checkpoint, **kwargs)


def _seen(sketch: bool) -> tuple[Callable, Callable]:
    if sketch:
        return snapshots.sketches_per_tick, snapshots.merge_sketches
    return snapshots.values_per_tick, DataFrame.distinct


def snapshots_from_store(
    spark: SparkSession, path: str, interval_ms: int, until: int | None = None, sketch: bool = False
) -> DataFrame:
    """Snapshots with all their metrics over what is stored so far."""
    merged = materialize(store.read_store(spark, f"{path}/states", snapshots.merge_states), "queue-states")
    seen = store.read_store(spark, f"{path}/seen", _seen(sketch)[1])
    distinct = snapshots.count_sketches(seen) if sketch else snapshots.count_values(seen)
    return snapshots.snapshots_from_states(merged, interval_ms, distinct, until)


def store_job_state(parsed: DataFrame, steps: Sequence[str], path: str, checkpoint: str, **kwargs) -> StreamingQuery:
    """Follow jobs: each micro-batch adds what it says about its jobs; the stream keeps no state."""
    return store.store_merged(
        parsed, path, checkpoint, lambda b: jobs.partial_completions(b, steps), jobs.merge_completions, **kwargs
    )


def jobs_from_store(spark: SparkSession, path: str, steps: Sequence[str]) -> DataFrame:
    """The state of all jobs stored so far."""
    return jobs.merged_job_state(store.read_store(spark, path, jobs.merge_completions), steps)


def store_registry(definitions: DataFrame, path: str, checkpoint: str, **kwargs) -> StreamingQuery:
    """Keep the first definition of every application as definitions come in."""
    return store.store_merged(
        definitions, path, checkpoint, bridging.app_registry, bridging.app_registry, **kwargs
    )


def registry_from_store(spark: SparkSession, path: str) -> DataFrame:
    return store.read_store(spark, path, bridging.app_registry)


def run_steps_stream(
    messages: DataFrame,
    steps: Sequence[Mapping],
    functions: Mapping[str, routing.StepFunction],
    path: str,
    interval: str | None = None,
) -> dict[str, StreamingQuery]:
    """Run a pipeline of steps as streams: one query for each step, chained through folders.

    A step reads the folder that its input step writes, from where its own checkpoint stands, so steps
    run, fail and restart each for itself, and an output that several steps read is written once. The
    functions may have a state (``keyed.with_state``). Without an interval every step handles what is there
    and ends, one after the other; with one, all run until they are stopped.
    """
    spark = messages.sparkSession
    queries, outputs = {}, {}
    for row in routing.step_order(steps):
        step = row["step"]
        source = outputs.get(row["input_stream"], messages)
        output = routing.run_step(source, row, functions.get(step))
        out = f"{path}/output/{step}"
        queries[step] = to_files(output, out, f"{path}/checkpoint/{step}", interval)
        if interval is None:
            queries[step].awaitTermination()
        outputs[step] = stream_files(spark, out, output.schema)
    return queries


def step_output(spark: SparkSession, path: str, step: str) -> DataFrame:
    """What a step has given out so far."""
    return spark.read.parquet(f"{path}/output/{step}")


def request_reply_stream(
    requests: DataFrame, replies: DataFrame, within: str, watermark: str = WATERMARK
) -> DataFrame:
    """``bridging.request_reply`` for streams: a request waits for replies no longer than ``within``."""
    asked = on_disk(requests).select(
        F.col("message_id").alias("request_id"),
        "correlation_id",
        "application_id",
        F.col("ts").alias("request_ts"),
    ).withWatermark("request_ts", watermark)
    answers = replies.select(
        F.col("message_id").alias("reply_id"),
        F.col("ts").alias("reply_ts"),
        F.col("application_id").alias("subject"),
        F.col("correlation_id").alias("reply_correlation"),
    ).withWatermark("reply_ts", watermark)
    matching = F.expr(
        "correlation_id = reply_correlation AND reply_ts >= request_ts "
        f"AND reply_ts <= request_ts + INTERVAL {within}"
    )
    return asked.join(answers, matching, "left").drop("reply_correlation")
