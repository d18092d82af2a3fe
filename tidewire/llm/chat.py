"""Chat formatting with collapse of cumulative snapshots.

A log often holds a conversation again each time it grew. ``collapse`` keeps a conversation only if it is
not the beginning of a longer one; of equal conversations the one with the smallest id stays. ``render``
writes the kept ones in a chat format.

Every turn gets a hash of its place, role and text, in two independent forms; the running exclusive-or of
these identifies a conversation's first k turns. The prefixes are reduced to distinct ones before anything
is joined, so an opening that a third of all conversations share is one row. Places and running hashes are
formed per block of ``BLOCK`` turn numbers, and a conversation is rendered in parts of ``BLOCK`` turns, so a
conversation of any length never has to fit into one task as long as its turns are numbered; turns of null or
equal numbers are sorted in one task, on disk where they are many.

Turns are in the order of turn number, role and text; null turn numbers come first. Repeated rows are turns
of their own. A null role is rendered as ``user``, a null text as empty, but they differ from those when
conversations are compared. Rows without a conversation id are left out. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.settings import materialize

BLOCK = 1024
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """The turns with their place in the conversation (from 1) and the hashes of the prefix they end."""
    rows = turns.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text"
    ).filter("conv is not null")
    block = F.coalesce(F.floor(F.col("turn") / BLOCK).cast("long"), F.lit(-(1 << 62)))
    rows = rows.withColumn("block", block)
    inside = Window.partitionBy("conv", "block").orderBy(
        F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()
    )
    numbered = rows.withColumn("number", F.row_number().over(inside))
    sizes = rows.groupBy("conv", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("conv", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    placed = numbered.join(first, ["conv", "block"]).select(
        "conv", "block", "role", "text", (F.col("first") + F.col("number")).cast("long").alias("place")
    )
    # a null is told apart from any text
    what = ["place", F.col("role").isNull(), "role", F.col("text").isNull(), "text"]
    placed = placed.withColumn("h1", F.xxhash64(*what)).withColumn(
        "h2", F.xxhash64(F.lit("second"), F.sha1(F.coalesce("text", F.lit(""))), *what[:-1])
    )
    placed = materialize(placed, "turns")
    sums = placed.groupBy("conv", "block").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    carried = sums.select(
        "conv", "block", *[F.coalesce(F.bit_xor(x).over(earlier), F.lit(0)).alias(x) for x in ("x1", "x2")]
    )
    running = Window.partitionBy("conv", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(carried, ["conv", "block"]).select(
        "conv", "place", "role", "text",
        F.col("x1").bitwiseXOR(F.bit_xor("h1").over(running)).alias("p1"),
        F.col("x2").bitwiseXOR(F.bit_xor("h2").over(running)).alias("p2"),
    )


def collapse(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns as ``turn_prefixes`` gives them, and the conversations to keep.

    The latter have ``conv``, ``n_turns`` and ``n_snapshots``: how many conversations are equal to the
    kept one, itself included.
    """
    prefixes = materialize(turn_prefixes(turns), "turn-prefixes")
    lengths = prefixes.groupBy("conv").agg(F.max("place").alias("n_turns"))
    lengths = materialize(lengths, "conversation-lengths")
    keyed = prefixes.select("conv", "place", "p1", "p2").join(lengths, "conv")
    keyed = materialize(keyed, "prefix-keys")
    key = ["place", "p1", "p2"]
    whole = keyed.filter("place = n_turns")
    conversations = whole.groupBy(*key).agg(F.min("conv").alias("conv"), F.count("*").alias("n_snapshots"))
    begun = keyed.filter("place < n_turns").select(*key).distinct()
    kept = conversations.join(begun, key, "left_anti")
    return prefixes, kept.select("conv", F.col("place").alias("n_turns"), "n_snapshots")


def render(prefixes: DataFrame, kept: DataFrame) -> DataFrame:
    """The kept conversations as chat text: ``conv_id``, ``part``, ``n_turns`` of the conversation,
    ``n_snapshots`` and ``rendered``; a conversation of up to ``BLOCK`` turns is one part."""
    role = F.coalesce("role", F.lit("user"))
    body = F.coalesce("text", F.lit(""))
    line = F.concat(F.lit(TURN_START), role, F.lit("\n"), body, F.lit(f"{TURN_END}\n"))
    turns = prefixes.join(kept, "conv").select(
        "conv", "n_turns", "n_snapshots", "place", line.alias("line"),
        F.floor((F.col("place") - 1) / BLOCK).cast("long").alias("part"),
    )
    lines = F.sort_array(F.collect_list(F.struct("place", "line")))
    parts = turns.groupBy("conv", "part").agg(
        F.first("n_turns").alias("n_turns"), F.first("n_snapshots").alias("n_snapshots"), lines.alias("lines")
    )
    return parts.select(
        F.col("conv").alias("conv_id"), "part", "n_turns", "n_snapshots",
        F.concat_ws("", F.transform("lines", lambda x: x["line"])).alias("rendered"),
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """``render`` of the conversations that ``collapse`` keeps."""
    return render(*collapse(turns))
