"""Messages between a control plane and applications."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import normalize_topic

# The property that marks a bridged message, and how bridge users are named.
BRIDGED = "NEB_BRIDGED"
APPLICATION = "application"
BRIDGE_USER, BRIDGE_USER_PREFIX = "bridge", "bridge-"


def prop(name: str) -> Column:
    return F.try_element_at(F.col("properties"), F.lit(name))


def bridge_filter(messages: DataFrame, application: str, bridged: str = BRIDGED) -> DataFrame:
    """Messages of the application that no bridge has passed on before."""
    return messages.filter((prop(APPLICATION) == application) & prop(bridged).isNull())


def mark_bridged(messages: DataFrame, bridged: str = BRIDGED) -> DataFrame:
    marked = F.map_concat(
        F.coalesce("properties", F.create_map().cast("map<string,string>")),
        F.create_map(F.lit(bridged), F.lit("true")),
    )
    return messages.withColumn("properties", marked)


def bridge_messages(messages: DataFrame, application: str, bridged: str = BRIDGED) -> DataFrame:
    """What goes over the bridge of an application, marked so that it does not come back."""
    return mark_bridged(bridge_filter(messages, application, bridged), bridged)


def allowed_topics(messages: DataFrame, topics: DataFrame) -> DataFrame:
    """Messages to a topic of the list; ``topics`` has one column ``topic``."""
    keys = topics.select(F.col("topic").alias("__topic"))
    return messages.join(keys, normalize_topic(F.col("address")) == F.col("__topic"), "left_semi")


def bridge_user_app(user: Column) -> Column:
    """The application a bridge user stands for; null for other users."""
    # only the first occurrence of the prefix goes, wherever it is
    start = F.instr(user, BRIDGE_USER_PREFIX)
    cut = F.concat(
        F.substring(user, F.lit(1), start - 1),
        F.substring(user, start + len(BRIDGE_USER_PREFIX), F.length(user)),
    )
    return F.when(user.startswith(BRIDGE_USER), F.when(start > 0, cut).otherwise(user))


def audit_senders(messages: DataFrame) -> DataFrame:
    """Add ``accepted``: a bridge user may only send for its own application."""
    app = bridge_user_app(F.col("user"))
    return messages.withColumn("accepted", app.isNull() | app.eqNullSafe(prop(APPLICATION)))


def authorize_senders(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected messages."""
    audited = audit_senders(messages)
    return (
        audited.filter("accepted").drop("accepted"),
        audited.filter("not accepted").drop("accepted"),
    )


def app_definitions(
    messages: DataFrame, topic: str, required: Sequence[str], id_variable: str = "APPLICATION_ID"
) -> DataFrame:
    """Application definitions sent to ``topic`` whose ``env-var`` object holds all required keys.

    Only the application id is given out; secrets among the variables stay behind.
    """
    variables = F.from_json(F.get_json_object("body", "$.env-var"), "map<string,string>")
    complete = F.lit(True)
    for name in (*required, id_variable):
        complete = complete & F.coalesce(F.map_contains_key(F.col("__vars"), F.lit(name)), F.lit(False))
    return (
        messages.filter(normalize_topic(F.col("address")) == topic)
        .withColumn("__vars", variables)
        .filter(complete)
        .select(
            "message_id", "ts", F.try_element_at("__vars", F.lit(id_variable)).alias("application_id")
        )
    )


def app_registry(definitions: DataFrame) -> DataFrame:
    """The first definition of each application; later ones are ignored."""
    first = F.min_by(F.struct("message_id", "ts"), F.struct("ts", "message_id"))
    return definitions.groupBy("application_id").agg(first.alias("f")).select("application_id", "f.*")


def registered_requests(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Requests of registered applications."""
    return requests.join(registry.select("application_id"), "application_id", "left_semi")


def unanswered_requests(
    requests: DataFrame, bridged: DataFrame, control_plane: bool = True, bucket: str = "app_%s_bucket"
) -> DataFrame:
    """Credential requests to answer here, with the bucket to name in the answer.

    The control plane leaves those of bridged applications to them.
    """
    if control_plane:
        requests = requests.join(bridged.select("application_id"), "application_id", "left_anti")
    return requests.withColumn("bucket", F.format_string(bucket, F.col("application_id")))


def request_reply(requests: DataFrame, replies: DataFrame, laid_out: bool = False) -> DataFrame:
    """Each request with its replies by correlation id, or with none.

    ``requests``: ``message_id, correlation_id, application_id, ts``; the same for ``replies``. Requests
    without an id get a join key of their own, which no reply has, so that they do not meet in one task.
    With ``laid_out``, both are bucketed by the correlation id; requests without one then stay out of the
    join, which needs no shuffle, and the requests are read twice.
    """
    asked = requests.select(
        F.col("message_id").alias("request_id"),
        "correlation_id",
        "application_id",
        F.col("ts").alias("request_ts"),
    )
    answers = replies.filter(F.col("correlation_id").isNotNull()).select(
        "correlation_id",
        F.col("message_id").alias("reply_id"),
        F.col("ts").alias("reply_ts"),
        F.col("application_id").alias("subject"),
    )
    if laid_out:
        met = asked.filter("correlation_id is not null").join(answers, "correlation_id", "left")
        none = {c: F.lit(None).cast(t) for c, t in answers.dtypes if c != "correlation_id"}
        nameless = asked.filter("correlation_id is null").withColumns(none)
        return met.select(nameless.columns).unionByName(nameless)
    own = F.struct(F.lit(None).cast("string").alias("id"), F.col("request_id").alias("own"))
    given = F.struct(F.col("correlation_id").alias("id"), F.lit(None).cast("bigint").alias("own"))
    keyed = asked.withColumn("__key", F.when(F.col("correlation_id").isNull(), own).otherwise(given))
    found = answers.withColumn("__key", given).drop("correlation_id")
    return keyed.join(found, "__key", "left").drop("__key")
