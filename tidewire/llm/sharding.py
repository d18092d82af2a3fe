"""Shards of near-equal size that cut few links, by balanced label propagation.

Documents with equal values of a link column are linked. Each link is cut into ``CELLS`` cells by a hash of
the id, and a cell starts on a shard by its number. In every round the cells of a link are joined with the
shards where the link's other cells are, each cell asks to move to the shard that holds most of them, and
moves are granted in an order by hash up to the room that the shard's capacity leaves. Rounds end when no
move is granted. Then the documents without links fill the shards up to equal size. What is uneven then is evened out with parts of
links that are larger than a shard and are cut anyway.

The state is a row per cell, at most ``CELLS`` per link, however often a text occurs; a link that holds a
third of all rows is spread over its cells like any other, and fills one shard after the other. What the
driver sees has a bound: sizes per shard and hash bucket (64 x 1,024 rows at most for 8 shards) and, for the documents
without links, per class of size and hash bucket (64 x 1,024 rows at most).

A null text has size 1 and, like the empty text, is linked with nothing. Repeated rows are documents of
their own, linked by their text. Ties are broken by hash. An empty table gives an empty result; columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.settings import materialize

CELLS = 64
MOVE_BUCKETS = 1024
FILL_BUCKETS = 1024
EVEN_PARTS = 4096
SLOT_ROWS = 20_000  # rows numbered in one task, about


def _granted(wanted: list, load: dict[int, int], capacity: float) -> tuple[list[tuple], set[int]]:
    """Which of the wanted moves (from, target, bucket, bytes) fit the capacity, and the full shards.

    A move makes room where it starts, so the list is gone through until nothing more fits.
    """
    load = dict(load)
    left = sorted(wanted, key=lambda r: (r["target"], r["bucket"], r["shard"]))
    granted: list[tuple] = []
    while True:
        denied = []
        for row in left:
            if load.get(row["target"], 0) + row["bytes"] <= capacity:
                load[row["target"]] = load.get(row["target"], 0) + row["bytes"]
                load[row["shard"]] -= row["bytes"]
                granted.append((row["shard"], row["target"], row["bucket"], True))
            else:
                denied.append(row)
        if len(denied) in (0, len(left)):
            return granted, {row["target"] for row in denied}
        left = denied


def _propagated(cells: DataFrame, shards: int, capacity: float, rounds: int) -> DataFrame:
    """The cells (``link``, ``cell``, ``n``, ``bytes``, ``shard``) with their shards after all rounds."""
    spark = cells.sparkSession
    full: set[int] = set()
    for _ in range(rounds):
        sizes = cells.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()
        load = {r["shard"]: r["bytes"] for r in sizes}
        order = sorted(range(shards), key=lambda s: (load.get(s, 0), s))
        emptier = spark.createDataFrame(
            [(s, -rank, s not in full) for rank, s in enumerate(order)], "shard int, room int, open boolean"
        )
        # of shards with as many of the link's documents, the emptier one
        votes = cells.groupBy("link", "shard").agg(F.sum("n").alias("votes")).join(emptier, "shard")
        votes = votes.withColumn("rank", F.struct("votes", "room"))
        best = votes.filter("open").groupBy("link")
        best = best.agg(F.max_by("shard", "rank").alias("home"), F.max("rank").alias("most"))
        # a cell asks for the shard with most of its link, among those that are not full; it never
        # leaves for one with fewer
        better = F.col("most") > F.col("rank")
        bucket = F.pmod(F.xxhash64("link", "cell"), F.lit(MOVE_BUCKETS))
        known = cells.join(votes.select("link", "shard", "rank"), ["link", "shard"])
        asks = known.join(best, "link", "left").select(
            *cells.columns, bucket.alias("bucket"), F.when(better, F.col("home")).alias("target")
        )
        asks = materialize(asks, "moves")
        wanted = asks.filter("target is not null and target <> shard").groupBy("shard", "target", "bucket")
        # shards x shards x MOVE_BUCKETS rows at most
        wanted = wanted.agg(F.sum("bytes").alias("bytes")).collect()
        granted, denied = _granted(wanted, load, capacity)
        if not granted and denied <= full:
            return cells
        full |= denied
        if granted:
            grants = spark.createDataFrame(granted, "shard int, target int, bucket long, granted boolean")
            moved = asks.join(F.broadcast(grants), ["shard", "target", "bucket"], "left")
            shard = F.when(F.col("granted"), F.col("target")).otherwise(F.col("shard"))
            cells = materialize(moved.select("link", "cell", "n", "bytes", shard.alias("shard")), "cells")
    return cells


def _filled(free: list, load: dict[int, int], shards: int) -> list[tuple]:
    """The shard of each group of unlinked documents: the largest first, to the least loaded shard."""
    heap = [(load.get(s, 0), s) for s in range(shards)]
    heapq.heapify(heap)
    out = []
    for row in sorted(free, key=lambda r: (-r["bytes"], r["kind"], r["bucket"])):
        size, shard = heapq.heappop(heap)
        out.append((row["kind"], row["bucket"], shard))
        heapq.heappush(heap, (size + row["bytes"], shard))
    return out


def _moved(parts: list, load: dict[int, int], share: float) -> list[tuple]:
    """Which parts (shard, part, bytes) go where, so that no shard keeps more than its share if it can."""
    heap = [(size, s) for s, size in load.items()]
    heapq.heapify(heap)
    left = dict(load)
    out = []
    for row in sorted(parts, key=lambda r: (-r["bytes"], r["part"], r["shard"])):
        size, shard = heap[0]
        while size != left[shard]:  # the shard has given something away since
            heapq.heapreplace(heap, (left[shard], shard))
            size, shard = heap[0]
        home, n = row["shard"], row["bytes"]
        if left[home] - n >= share - n / 2 and size + n <= share + n / 2 and home != shard:
            left[home] -= n
            left[shard] += n
            heapq.heapreplace(heap, (left[shard], shard))
            out.append((home, row["part"], shard))
    return out


def _evened(ready: DataFrame, cells: DataFrame, shards: int, share: float) -> DataFrame:
    """``ready`` with rows of the largest links moved from shards that hold more than their share.

    Fewer links than there are shards can be larger than a shard; their rows in a shard are cut into
    ``EVEN_PARTS`` parts by hash, so the driver sees at most that many numbers for each shard.
    """
    spark = ready.sparkSession
    large = cells.groupBy("link").agg(F.sum("bytes").alias("bytes")).filter(F.col("bytes") > share)
    large = materialize(large.select("link", F.lit(True).alias("large")), "large-links")
    part = F.when(F.col("large"), F.pmod(F.shiftright("hash", 20), F.lit(EVEN_PARTS)))
    ready = ready.join(F.broadcast(large), "link", "left").withColumn("part", part).drop("large", "link")
    ready = materialize(ready, "filled")
    load = dict.fromkeys(range(shards), 0)
    load |= {r["shard"]: r["bytes"] for r in ready.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}
    sizes = ready.filter("part is not null").groupBy("shard", "part").agg(F.sum("bytes").alias("bytes"))
    moves = _moved(sizes.collect(), load, share)
    if not moves:
        return ready.drop("part")
    moves = spark.createDataFrame(moves, "shard int, part long, target int")
    moved = ready.join(F.broadcast(moves), ["shard", "part"], "left")
    return moved.withColumn("shard", F.coalesce("target", "shard")).drop("target", "part")


def balanced_shards(
    docs: DataFrame, shards: int = 8, *, id_column: str = "doc_id", text_column: str = "text",
    rounds: int = 10,
) -> DataFrame:
    """Each row's ``size`` in bytes plus 1, ``text_crc32``, ``shard`` and ``slot``.

    Rows of equal text are linked. Slots count from 0 in each shard without gaps. The law is ``bytes``:
    the shards' sums of sizes are near equal.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_column).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("bytes"),
        F.crc32(text).alias("crc"),
        F.when(F.octet_length(text) > 0, F.unhex(F.sha2(text, 256))).alias("link"),
        F.xxhash64(F.col(id_column).cast("string"), text).alias("hash"),
        F.monotonically_increasing_id().alias("number"),
    )
    rows = materialize(rows, "sizes")
    # equal rows have equal hashes; the numbers, written above, tell them apart
    repeated = rows.groupBy("hash").count().filter("count > 1").select("hash", F.lit(True).alias("repeated"))
    rows = rows.join(materialize(repeated, "repeated-rows"), "hash", "left")
    rows = rows.withColumn("hash", F.when(F.col("repeated"), F.xxhash64("hash", "number")).otherwise(F.col("hash")))
    rows = rows.withColumn("cell", F.pmod("hash", F.lit(CELLS)).cast("int")).drop("number", "repeated")
    rows = materialize(rows, "documents")

    grouped = rows.filter("link is not null").groupBy("link", "cell")
    grouped = grouped.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    more = Window.partitionBy("link")  # at most CELLS rows
    linked = grouped.withColumn("all", F.sum("n").over(more)).filter("all > 1").drop("all")
    cells = linked.withColumn("shard", F.pmod(F.col("cell") + F.hash("link"), F.lit(shards)))
    cells = materialize(cells, "cells")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    cells = _propagated(cells, shards, total / shards, rounds)

    placed = rows.join(cells.select("link", "cell", "shard"), ["link", "cell"], "left")
    placed = placed.select("id", "bytes", "crc", "hash", "link", "shard")
    kind = F.floor(F.log2(F.col("bytes").cast("double"))).cast("int")
    bucket = F.pmod(F.shiftright("hash", 8), F.lit(FILL_BUCKETS))
    placed = materialize(placed.withColumn("kind", kind).withColumn("bucket", bucket), "placed")
    load = cells.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()
    free = placed.filter("shard is null").groupBy("kind", "bucket").agg(F.sum("bytes").alias("bytes"))
    plan = _filled(free.collect(), {r["shard"]: r["bytes"] for r in load}, shards)
    plan = spark.createDataFrame(plan, "kind int, bucket long, filled int")
    # at most 64 x FILL_BUCKETS rows
    ready = placed.join(F.broadcast(plan), ["kind", "bucket"], "left")
    ready = ready.withColumn("shard", F.coalesce("shard", "filled"))
    ready = _evened(ready, cells, shards, total / shards)

    # slots: rows are numbered in hash buckets, after the rows of the buckets before
    buckets = 1 + (rows.count() // SLOT_ROWS)
    ready = ready.withColumn("part", F.pmod(F.shiftright("hash", 20), F.lit(buckets)))
    ready = materialize(ready.select("id", "bytes", "crc", "hash", "shard", "part"), "shards")
    counts = ready.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    offsets = materialize(offsets, "offsets")
    inside = Window.partitionBy("shard", "part").orderBy("hash", "id", "bytes")
    numbered = ready.withColumn("number", F.row_number().over(inside) - 1)
    out = numbered.join(offsets, ["shard", "part"])
    return out.select(
        F.col("id").alias(id_column), F.col("bytes").alias("size"), F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("number")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
