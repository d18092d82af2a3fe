"""Address patterns, roles and policies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import wildcards
from tidewire.functions.attributes import POLICY_FLAGS, ROLE_FLAGS, flag, unwrap
from tidewire.settings import materialize


def match_patterns(addresses: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rows of ``addresses`` with each ``pattern`` that matches their ``address``, as a hash join.

    An address can match only one pattern of each shape (``data.*.>`` has the shape ``w.*.>``), and
    that pattern can be written down. So each address is joined on the few patterns it could match.
    ``addresses`` should have each address once; its other columns are kept.
    """
    listed = patterns.select("pattern").distinct().withColumn("shape", wildcards.shape(F.col("pattern")))
    # a shape is met only by addresses of fitting length, so this is an equi-join too
    shapes = listed.select(F.col("shape").alias("__shape")).distinct()
    shapes = shapes.withColumn("__length", wildcards.length_of(F.col("__shape")))
    possible = (
        addresses.withColumn("__length", F.explode(wildcards.lengths_for(F.col("address"))))
        .join(shapes, "__length")
        .withColumn("__key", wildcards.generalize(F.col("address"), F.col("__shape")))
        .filter(F.col("__key").isNotNull())
        .drop("__length", "__shape")
    )
    keyed = listed.select(
        "pattern",
        wildcards.normalized(F.col("pattern")).alias("__key"),
        wildcards.pattern_regex(F.col("pattern")).alias("__regex"),
    )
    # words between two any-words are the only thing that the key leaves open
    several = F.length(F.regexp_replace("pattern", "[^>#]", "")) > 1
    exact = F.when(several, F.expr("concat('.', address) RLIKE __regex")).otherwise(True)
    return possible.join(keyed, "__key").filter(exact).drop("__key", "__regex")


def subscription_match(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """How many messages each subscription (``subscription, pattern``) receives, by address.

    Messages are counted per address before any matching.
    """
    traffic = messages.groupBy("address").agg(F.count(F.lit(1)).alias("messages"))
    matched = match_patterns(traffic, subscriptions)
    return matched.join(subscriptions, "pattern").select("subscription", "pattern", "address", "messages")


def eligible_roles(roles: DataFrame, marker: str) -> DataFrame:
    """Roles with attributes, with the yes/no attribute ``marker`` set and with a match.

    ``roles`` has ``id, name, attributes map<string,string>``.
    """
    match = unwrap(F.try_element_at("attributes", F.lit("match")))
    return (
        roles.filter(F.col("attributes").isNotNull() & flag(F.col("attributes"), marker))
        .withColumn("match", match)
        .filter(F.length(F.trim("match")) > 0)
    )


def role_flags(eligible: DataFrame) -> DataFrame:
    """One boolean column per permission."""
    flags = [flag(F.col("attributes"), name).alias(name) for name in ROLE_FLAGS]
    return eligible.select("id", "name", "match", *flags)


def roles_by_match(flags: DataFrame) -> DataFrame:
    """The set of roles of each match, as rows: a match may have any number of roles."""
    return flags.select("match", "name", *POLICY_FLAGS).distinct()


def reconcile(current: DataFrame, incoming: DataFrame, group: str, key: str) -> DataFrame:
    """Bring a table of grouped rows up to date with another.

    A group that exists keeps the rows whose key the other side has too, with the values of the
    other side; groups only the other side has are taken whole. A group left without rows stays as
    one row with a null key. New keys of an existing group are not added.
    """
    values = [c for c in incoming.columns if c not in (group, key)]
    renewed = incoming.select(group, key, *values, F.lit(True).alias("__there"))
    held = current.select(group, key).distinct().join(renewed, [group, key], "left")
    kept = held.filter(F.col("__there")).select(group, key, *values)
    emptied = (
        held.groupBy(group)
        .agg(F.max("__there").alias("__there"))
        .filter(F.col("__there").isNull())
        .select(
            group,
            F.lit(None).cast(incoming.schema[key].dataType).alias(key),
            *[F.lit(None).cast(incoming.schema[v].dataType).alias(v) for v in values],
        )
    )
    fresh = incoming.join(current.select(group).distinct(), group, "left_anti").select(group, key, *values)
    return kept.unionByName(emptied).unionByName(fresh)


def access_audit(
    messages: DataFrame, user_roles: DataFrame, policies: DataFrame, permission: str = "write"
) -> DataFrame:
    """Per user and address: how many messages, and whether a role of the user permits them.

    ``user_roles``: ``user, role``; ``policies``: ``match, name`` and the permission flags. Messages are
    counted per user and address once; roles are matched with addresses, not with messages.
    """
    counted = messages.groupBy("user", "address").agg(F.count(F.lit(1)).alias("messages"))
    sends = materialize(counted, "sends")
    granting = policies.filter(F.col(permission)).select(
        F.col("match").alias("pattern"), F.col("name").alias("role")
    ).distinct()
    matched = match_patterns(sends.select("address").distinct(), granting.select("pattern").distinct())
    # an address matches at most one pattern of each form, so this stays near the size of ``sends``
    covered = sends.select("user", "address").join(matched, "address")
    # the roles of users first: as many rows as users have patterns, not users times roles
    granted = user_roles.select("user", "role").join(granting, "role").select("user", "pattern").distinct()
    permitted = (
        covered.join(granted, ["user", "pattern"], "left_semi")
        .select("user", "address")
        .distinct()
        .withColumn("allowed", F.lit(True))
    )
    return sends.join(permitted, ["user", "address"], "left").withColumn(
        "allowed", F.coalesce("allowed", F.lit(False))
    )
