"""Jaccard similarity join of word shingles by a token-group matrix, exact and without all pairs.

A document's set is its distinct 5-word shingles (hashes of 64 bits). Documents with equal sets are one
class. Two classes link when 100 * |intersection| >= ``percent`` * |union|.

1. *Tokens that can matter.* If two sets link, they have at least ``needed(n)`` of the first
   ``prefix_length(n)`` tokens of each in common, in any order that all sets follow. The order puts tokens
   of frequent cells last; the cell counts (2^20 counters over all documents) decide the cost only, never
   the result. Tokens that one class alone has are dropped, and so are classes left with too few.
2. *Seeds.* Each class is compared with the hub of its token lists, the class on a list that shares most
   of its own listed tokens, if the two share enough. In a large group of near copies this connects most
   classes by a number of comparisons in proportion to their number.
3. *Token-group matrix.* Classes with the same hub form groups, split into those the seeds connected with
   the hub and the rest, and into parts of some ``PART`` classes. A row for each token of each part is the
   union of its classes' tokens. Two parts can only hold a link between classes that are not connected yet
   if their unions have enough tokens in common; only these pairs of parts are opened, and their classes
   compared in one task, which gives out the links and nothing else.
4. *Components* of all links found. Classes that are connected already are not compared.

Comparisons use 40 of the 64 bits of the tokens, so that less is moved; that a pair is misjudged by this
has a chance below 1 in 10^8.

Texts that are null, empty or without words have no set and link with nothing, and so do rows without an
id. Repeated rows are copies of one class. Whole texts are read. An empty table gives an empty result;
columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.flat import sets_of, signed
from tidewire.llm.frames import released, small_batches
from tidewire.llm.graph import components
from tidewire.settings import materialize

CELL_BITS = 20
CHUNK_BITS = 14  # cells of a row of counts
PART = 32  # classes of a part of a group, about
PART_TOKENS = 1 << 16  # tokens of all sets of a part, about
SPARE = 16  # one listed token more for each so many tokens of a set
FILTER_BITS = 1 << 27  # of the filter for texts to read again, at most
TOKEN_BYTES = 5


def _digest(tokens: np.ndarray) -> int:
    raw = hashlib.blake2b(tokens.tobytes(), digest_size=8).digest()
    return int.from_bytes(raw, "little", signed=True)


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """Size and digest of each document's set; beside them, as rows of their own, the cell counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELL_BITS, np.int32)
        seen: set[int] = set()
        none = None
        for batch in batches:
            sizes, digests, fresh, pending = [], [], [], 0
            for _, tokens in sets_of(batch.column(1), shingle):
                digest = _digest(tokens) if len(tokens) else none
                sizes.append(len(tokens))
                digests.append(digest)
                if digest is not none and digest not in seen:
                    seen.add(digest)
                    fresh.append(_cells(tokens))
                    pending += len(tokens)
                    if pending > 1 << CELL_BITS:
                        np.add.at(counts, np.concatenate(fresh), 1)
                        fresh, pending = [], 0
            if fresh:
                np.add.at(counts, np.concatenate(fresh), 1)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.int64()),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                names=names,
            )
        if seen:
            chunks = counts.reshape(-1, 1 << CHUNK_BITS)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(chunks), id_arrow), pa.nulls(len(chunks), pa.int64()),
                 pa.nulls(len(chunks), pa.int64()), pa.array(range(len(chunks)), pa.int32()),
                 pa.array([zlib.compress(c.tobytes(), 1) for c in chunks], pa.binary())],
                names=names,
            )

    from pyspark.sql.pandas.types import to_arrow_type

    names = ["id", "n", "digest", "chunk", "counts"]
    id_arrow = to_arrow_type(docs.schema["id"].dataType)
    id_type = docs.schema["id"].dataType.simpleString()
    out = docs.mapInArrow(lambda b: released(run(b)), f"id {id_type}, n long, digest long, chunk int, counts binary")
    return materialize(out, "shingle-sets")


def _levels(counted: DataFrame) -> np.ndarray:
    """Per cell how far its count stands out: 0 for the many, more for frequent tokens' cells."""

    def add(key, pdf):
        import pandas as pd

        total = np.zeros(1 << CHUNK_BITS, np.int64)
        for counts in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(counts), np.int32)
        return pd.DataFrame({"chunk": [key[0]], "counts": [total.tobytes()]})

    sums = counted.groupBy("chunk").applyInPandas(add, "chunk int, counts binary")
    cells = np.zeros((1 << (CELL_BITS - CHUNK_BITS), 1 << CHUNK_BITS), np.int64)
    for row in sums.collect():  # 64 rows, 8 MB, whatever the input
        cells[row["chunk"]] = np.frombuffer(row["counts"], np.int64)
    cells = cells.reshape(-1)
    usual = cells.mean()
    limit = max(16.0, 8.0 * usual**0.5)
    return np.where(cells > usual + limit, 1 + np.log2(np.maximum(cells - usual, limit) / limit), 0).astype(np.uint8)


def prefix_length(n: int, percent: int) -> int:
    """How many tokens of a set of ``n`` are listed: enough to see ``needed`` common ones of every set
    that links with it. Two such sets have c >= n * percent / 100 in common; the k-th of these in the
    order has at most n - c tokens that are not common before it."""
    return min(n, n + (-n * percent) // 100 + 1 + n // SPARE)


def needed(n: str, percent: int) -> str:
    """SQL for the number of listed tokens a set of ``n`` shares with any set it links with."""
    return f"(1 + (({n} * {percent} + 99) div 100) div {SPARE})"


def _postings(docs: DataFrame, shared, shingle: int, percent: int) -> DataFrame:
    """The tokens of each class that can matter, once per task and class; ``shared`` holds the levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        seen: set[int] = set()
        for batch in batches:
            found, owners, size = [], [], 0

            def flush(found=found, owners=owners):
                return pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.concatenate(found))),
                     pa.array(np.repeat(np.array(owners, np.int64), list(map(len, found))))],
                    names=["token", "digest"],
                )

            for _, tokens in sets_of(batch.column(1), shingle):
                digest = _digest(tokens) if len(tokens) else None
                if digest is None or digest in seen:
                    continue
                seen.add(digest)
                k = prefix_length(len(tokens), percent)
                if k < len(tokens):
                    late = level[_cells(tokens)].astype(np.uint64)
                    order = (late << np.uint64(57)) | (tokens >> np.uint64(7))
                    tokens = tokens[np.argpartition(order, k - 1)[:k]]
                found.append(tokens)
                owners.append(digest)
                size += len(tokens)
                if size > 1 << 17:
                    yield flush()
                    found.clear()
                    owners.clear()
                    size = 0
            if found:
                yield flush()

    return docs.mapInArrow(lambda b: released(run(b)), "token long, digest long")


def _shared(
    postings: DataFrame, classes: DataFrame, percent: int
) -> tuple[DataFrame, DataFrame]:
    """The postings (``token``, ``digest``, ``hub``) whose token belongs to more than one class, and the
    classes (``digest``, ``id``, ``n``) that have enough of them."""
    token = Window.partitionBy("token")
    ends = postings.select(
        "token", "digest",
        F.min("digest").over(token).alias("low"), F.max("digest").over(token).alias("high"),
    ).filter("low <> high")
    found = materialize(ends.select("token", "digest").distinct(), "shared-tokens")
    counted = found.groupBy("digest").agg(F.count("*").alias("listed"))
    able = counted.join(classes, "digest").filter(f"listed >= {needed('n', percent)}")
    able = materialize(able, "listed-classes")
    share = able.select("digest", (F.col("listed") / F.col("n")).alias("share"))
    hub = F.max(F.struct("share", "digest")).over(token)
    lists = found.join(share, "digest").select("token", "digest", hub["digest"].alias("hub"))
    return materialize(lists, "token-lists"), able.select("digest", "id", "copies", "n")


def _filter_of(classes: DataFrame) -> tuple[np.ndarray, int]:
    """A bit for the hash of each class's id, in at most ``FILTER_BITS`` bits."""
    rows = 1 << 15  # bits of one row of the aggregate
    bits = min(FILTER_BITS, rows * (1 + classes.count() * 32 // rows))
    place = F.pmod(F.xxhash64("id"), F.lit(bits))
    marks = classes.select(place.alias("place")).groupBy(F.floor(F.col("place") / rows).alias("row"))
    found = np.zeros((bits // rows, rows // 8), np.uint8)
    for r in marks.agg(F.bitmap_construct_agg(F.col("place") % rows).alias("bits")).collect():
        found[r["row"]] = np.frombuffer(r["bits"], np.uint8)
    return found.reshape(-1), bits


def _sets_of_classes(docs: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """The token sets of some classes (``digest``, ``id``, ``copies``, ``n``), read again from the text of the
    class's id; where rows repeat that, from one of them.

    A filter of bounded size keeps most other texts from being moved.
    """
    found, bits = _filter_of(classes)
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.asarray(batch.column(2))
            keep = (shared.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1
            yield batch.filter(pa.array(keep.astype(bool))).select(["id", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = np.asarray(batch.column(0)).tolist()
            found = [
                (digests[i], _packed(tokens))
                for i, tokens in sets_of(batch.column(1), shingle)
                if len(tokens) and _digest(tokens) == digests[i]
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in found], pa.int64()), pa.array([t for _, t in found], pa.binary())],
                names=["digest", "tokens"],
            )

    place = F.pmod(F.xxhash64("id"), F.lit(bits))
    texts = docs.filter("id is not null and text is not null").select("id", "text", place.alias("place"))
    id_type = docs.schema["id"].dataType.simpleString()
    texts = texts.mapInArrow(chosen, f"id {id_type}, text string")
    texts = texts.join(classes.select("id", "digest").hint("shuffle_hash"), "id")
    sets = texts.select("digest", "text").mapInArrow(lambda b: released(run(b)), "digest long, tokens binary")
    if not classes.filter("copies > 1").isEmpty():
        sets = sets.dropDuplicates(["digest"])
    sets = materialize(sets, "class-sets")
    shared.destroy()
    return sets


def _packed(tokens: np.ndarray) -> bytes:
    """The high bytes of sorted tokens, which keep their order."""
    raw = tokens.astype(">u8").view(np.uint8).reshape(-1, 8)
    return raw[:, :TOKEN_BYTES].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    parts = np.frombuffer(raw, np.uint8).reshape(-1, TOKEN_BYTES)
    full = np.zeros((len(parts), 8), np.uint8)
    full[:, :TOKEN_BYTES] = parts
    return full.view(">u8").reshape(-1).astype(np.uint64)


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``a``, ``b`` that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = _unpacked(x.as_buffer()), _unpacked(y.as_buffer())
                if len(y) < len(x):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int(np.count_nonzero(y[at] == x))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"]
            )

    left = sets.select(F.col("digest").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("digest").alias("b"), F.col("tokens").alias("y"))
    sides = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return materialize(sides.mapInArrow(lambda b: released(run(b)), "a long, b long").distinct(), "jaccard-links")


def _parts(classes: DataFrame, roots: DataFrame, hubs: DataFrame) -> DataFrame:
    """``digest``, ``n``, ``root`` and ``part`` of each class."""
    home = hubs.groupBy("digest").agg(F.max_by("hub", F.struct("common", "hub")).alias("family"))
    member = classes.join(roots.withColumnRenamed("node", "digest"), "digest", "left")
    member = member.select("digest", "n", F.coalesce("root", "digest").alias("root"))
    of_family = roots.select(F.col("node").alias("family"), F.col("root").alias("main"))
    member = member.join(home, "digest").join(of_family, "family", "left")
    rest = F.col("root") != F.coalesce("main", "family")
    member = materialize(member.withColumn("rest", rest).drop("main"), "groups")
    sizes = member.groupBy("family", "rest").agg(F.count("*").alias("size"), F.sum("n").alias("tokens"))
    # written, so that the join can split a large group
    sizes = materialize(sizes, "group-sizes")
    buckets = f"1 + greatest(size div {PART}, tokens div {PART_TOKENS})"
    bucket = F.pmod(F.xxhash64("digest"), F.expr(buckets))
    named = member.join(sizes, ["family", "rest"]).select(
        "digest", "n", "root", F.xxhash64("family", "rest", bucket).alias("part")
    )
    return materialize(named, "parts")


def _opened(lists: DataFrame, member: DataFrame, percent: int, every: bool = False) -> DataFrame:
    """The pairs of parts ``p``, ``q`` that the token-group matrix does not rule out. Unless ``every`` link is
    wanted, parts whose classes are all connected already are not opened."""
    facts = member.groupBy("part").agg(
        F.min("n").alias("least"), F.max("n").alias("most"),
        F.min("root").alias("root"), (F.min("root") != F.max("root")).alias("mixed"),
    )
    facts = facts.withColumn("enough", F.expr(needed("least", percent)))
    facts = materialize(facts, "part-facts")
    matrix = lists.select("token", "digest").join(member.select("digest", "part"), "digest")
    matrix = materialize(matrix.select("token", "part").distinct(), "token-group-matrix")
    other = matrix.withColumnRenamed("part", "q")
    meet = matrix.withColumnRenamed("part", "p").join(other, "token").filter("p < q")
    meet = meet.groupBy("p", "q").agg(F.count("*").alias("common"))
    x, y = facts.alias("x"), facts.alias("y")
    both = meet.join(x, F.col("p") == F.col("x.part")).join(y, F.col("q") == F.col("y.part"))
    both = both.filter("common >= greatest(x.enough, y.enough)")
    both = both.filter(f"100 * x.most >= {percent} * y.least and 100 * y.most >= {percent} * x.least")
    if not every:
        both = both.filter("x.mixed or y.mixed or x.root <> y.root")
        facts = facts.filter("mixed")
    both = both.select("p", "q")
    inside = facts.select(F.col("part").alias("p"), F.col("part").alias("q"))
    return materialize(both.unionByName(inside), "opened-parts")


def _between_parts(
    opened: DataFrame, member: DataFrame, sets: DataFrame, percent: int, every: bool = False
) -> DataFrame:
    """The links in the opened pairs of parts: ``every`` one, or those between classes not connected yet."""

    def packed(key, table):
        sizes = [len(t.as_buffer()) for t in table["tokens"]]
        return pa.table(
            {"part": pa.array([key[0].as_py()], pa.int64()),
             "digests": pa.array([np.asarray(table["digest"]).tobytes()], pa.binary()),
             "roots": pa.array([np.asarray(table["root"]).tobytes()], pa.binary()),
             "sizes": pa.array([(np.array(sizes) // TOKEN_BYTES).tobytes()], pa.binary()),
             "tokens": pa.array([b"".join(table["tokens"].to_pylist())], pa.binary())}
        )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                da, db = _part_links(x.as_py(), y.as_py(), percent, every)
                a.append(da)
                b.append(db)
            a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    wanted = opened.select(F.col("p").alias("part")).union(opened.select("q")).distinct()
    rows = member.join(wanted, "part", "left_semi").join(sets, "digest")
    parts = rows.select("part", "digest", "root", "tokens").groupBy("part").applyInArrow(
        packed, "part long, digests binary, roots binary, sizes binary, tokens binary"
    )
    parts = materialize(parts, "packed-parts")
    whole = F.struct("digests", "roots", "sizes", "tokens")
    left = parts.select(F.col("part").alias("p"), whole.alias("x"))
    right = parts.select(F.col("part").alias("q"), whole.alias("y"))
    both = opened.join(left, "p").join(right, "q").select("x", "y")
    return materialize(both.mapInArrow(lambda b: released(compared(b)), "a long, b long").distinct(), "links-between-parts")


def _part_links(x: dict, y: dict, percent: int, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs between the classes of two parts whose roots differ, or ``every`` linked pair."""
    (dx, dy), (rx, ry), (nx, ny) = (
        [np.frombuffer(side[k], np.int64) for side in (x, y)] for k in ("digests", "roots", "sizes")
    )
    tx, ty = _unpacked(x["tokens"]), _unpacked(y["tokens"])
    ox, oy = np.repeat(np.arange(len(nx)), nx), np.repeat(np.arange(len(ny)), ny)
    order = np.argsort(ty, kind="stable")
    ty, oy = ty[order], oy[order]
    first, last = np.searchsorted(ty, tx, "left"), np.searchsorted(ty, tx, "right")
    common = np.zeros((len(nx), len(ny)), np.int64)
    # the k-th class of y that has the token; as many rounds as the classes of a part at most
    k = 0
    while True:
        has = np.flatnonzero(first + k < last)
        if not len(has):
            break
        np.add.at(common, (ox[has], oy[first[has] + k]), 1)
        k += 1
    either = nx[:, None] + ny[None, :] - common
    apart = (dx[:, None] != dy[None, :]) if every else (rx[:, None] != ry[None, :])
    linked = (100 * common >= percent * either) & apart
    i, j = np.nonzero(linked)
    return np.minimum(dx[i], dy[j]), np.maximum(dx[i], dy[j])


def _prepared(docs: DataFrame, id_column: str, text_column: str, percent: int, shingle: int):
    """The documents' sizes and digests, their classes, the token lists, the sets of classes that can link, and
    the pairs of classes and hubs worth comparing."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    found = _sets(docs, shingle)
    documents = found.filter("chunk is null")
    named = documents.filter("id is not null and digest is not null")
    named = named.groupBy("digest", "id").agg(F.max("n").alias("n"), F.count("*").alias("copies"))
    first = named.groupBy("digest").agg(F.min(F.struct("id", "copies")).alias("first"), F.max("n").alias("n"))
    classes = materialize(first.select("digest", "first.*", "n"), "classes")
    levels = docs.sparkSession.sparkContext.broadcast(_levels(found.filter("chunk is not null")))
    known = docs.filter("id is not null and text is not null")
    lists, able = _shared(_postings(known, levels, shingle, percent), classes, percent)
    levels.destroy()
    sets = _sets_of_classes(docs, able, shingle)
    hubs = lists.groupBy("hub", "digest").agg(F.count("*").alias("common"))
    hubs = materialize(hubs, "hubs")
    n = able.select("digest", "n")
    near = hubs.filter("hub <> digest").select(F.col("hub").alias("a"), F.col("digest").alias("b"), "common")
    near = near.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b")
    near = near.filter(f"100 * na >= {percent} * nb and 100 * nb >= {percent} * na")
    near = near.filter(f"common >= greatest({needed('na', percent)}, {needed('nb', percent)})")
    return documents, classes, lists, n, sets, hubs, near


def jaccard_components(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = 80,
    shingle: int = 5,
) -> DataFrame:
    """Per row the id, ``n_shingles`` (size of its set) and ``component_id``: the smallest id that
    can be reached by links, itself included."""
    documents, classes, lists, n, sets, hubs, near = _prepared(docs, id_column, text_column, percent, shingle)
    links = _compared(near, sets, percent)
    roots = components(links)
    member = _parts(n, roots, hubs)
    opened = _opened(lists, member, percent)
    if not opened.isEmpty():
        more = _between_parts(opened, member, sets, percent)
        if not more.isEmpty():
            roots = components(links.unionByName(more))
    linked = roots.withColumnRenamed("node", "digest").join(classes, "digest")
    lowest = materialize(linked.groupBy("root").agg(F.min("id").alias("component")), "lowest")
    reached = linked.select("digest", "root").join(lowest, "root").select("digest", "component")
    reached = classes.join(reached, "digest", "left")
    reached = materialize(
        reached.select("digest", F.coalesce("component", "id").alias("component")), "reached"
    )
    out = documents.join(reached, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id")
    )


def jaccard_links(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = 80,
    shingle: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """All links between different sets, and who has which set.

    The first table has a row ``a``, ``b`` for each pair of linked classes, by their smallest ids; the second
    each row's id and ``class_id``, null without a set. Rows of one class have equal sets and are not paired. In a
    group of n near copies that all link there are n * (n - 1) / 2 links; ``jaccard_components`` does without.
    """
    documents, classes, lists, n, sets, hubs, near = _prepared(docs, id_column, text_column, percent, shingle)
    member = _parts(n, components(_compared(near, sets, percent)), hubs)
    found = _between_parts(_opened(lists, member, percent, True), member, sets, percent, True)
    named = classes.select("digest", "id")
    links = found.join(named.toDF("a", "x"), "a").join(named.toDF("b", "y"), "b")
    links = links.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    owner = named.toDF("digest", "class_id")
    members = documents.join(owner, "digest", "left").select(
        F.col("id").alias(id_column), F.when(F.col("id").isNotNull(), F.col("class_id")).alias("class_id")
    )
    return links, members
