"""Prefix trie of conversations by union-find over sorted neighbours.

A conversation is the sequence of its turns' digests. Equal sequences are one, with a count. The distinct ones
are sorted over all partitions; then every node of the trie is a run of neighbours, and how long a prefix two
neighbours share (LCP) is all that its shape depends on.

1. *In a partition* the edges between neighbours are taken in descending depth. Each joins two components
   (union-find); a merge at a depth where the left component does not have its top yet makes a branching node
   there. A node that holds neither the first nor the last sequence of its partition is complete: nothing
   outside can belong to it, so its rows are given out, and only its sums go up.
2. *Across boundaries.* What is left of a partition is contracted to the paths of its first and last sequence,
   with the sums of what hangs on them. These paths, two for a partition, are neighbours again, and the same
   union-find in descending depth merges them. They are handled by one task: their number is that of the
   partitions, whatever the number of conversations.
3. Nodes between two branchings differ in depth only and are made when rows are given out. A complete node
   below a contracted one learns its parent by a join.

Turns are ordered by turn number, nulls first, then by role and text; null roles and texts are empty. Repeated
rows are turns of their own. Rows without a conversation id are left out. An empty table gives an empty
result; other columns are ignored. Digests have 128 bits. A conversation is one row of 16 bytes a turn (texts
never meet in one place), so its length is bounded by what a row may hold, some 10^7 turns.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.settings import materialize

DIGEST = 16  # bytes of a turn
PART_ROWS = 50_000  # sequences sorted in one partition, about
PART_BYTES = 32 << 20
ID_CHUNK = 4096  # ids joined to one text before they go to their node
NO_ENDS = hashlib.sha256(b"").hexdigest()

_ROW = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends long, ender long"
)
_NAMES = [part.split()[0] for part in _ROW.split(", ")]


def sequences(turns: DataFrame) -> DataFrame:
    """Per conversation ``conv``, ``turns``: an array of (digest in hex, code points of the text) in order."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).filter("conv is not null")
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = rows.select(
        "conv", F.row_number().over(order).alias("place"),
        F.md5(F.concat(F.char_length("role"), F.lit(":"), "role", "text")).alias("digest"),
        F.char_length("text").alias("size"),
    )
    found = placed.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("place", "digest", "size"))).alias("all"))
    return found.select("conv", F.transform("all", lambda t: F.struct(t["digest"], t["size"])).alias("turns"))


def with_shared_openings(found: DataFrame, every: int = 100, longest: int = 5) -> DataFrame:
    """Conversations rebuilt: c gets the first h turns of the conversation whose id is c without its
    remainder by ``every``, then its own after its first h, with h = crc32 of its id modulo ``longest`` + 1."""
    base = found.filter(F.col("conv") % every == 0).select(
        F.col("conv").alias("base"), F.slice("turns", 1, longest).alias("opening")
    )
    own = found.withColumn("base", F.col("conv") - F.col("conv") % every)
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % (longest + 1)).cast("int")
    joined = own.join(base, "base", "left").withColumn("h", h)
    opening = F.coalesce(F.slice("opening", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return joined.select("conv", F.concat(opening, rest).alias("turns"))


def _shared(x: bytes, y: bytes) -> int:
    """How many turns two sequences begin with in common."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n // DIGEST
    a, b = np.frombuffer(x, np.uint8, n), np.frombuffer(y, np.uint8, n)
    return int(np.argmax(a != b)) // DIGEST


class _Forest:
    """Nodes of a trie over a sorted run of sequences, made from the deepest up.

    ``sums`` of a node: conversations, smallest conversation, children, leaves below, tokens saved below.
    """

    def __init__(self, cumulated: list[np.ndarray], held=lambda low, high: False) -> None:
        n = len(cumulated)
        self.cumulated = cumulated  # by sequence: code points of the first d texts
        self.held = held  # whether a node with these sequences stays out of its parent's sums
        self.head = list(range(n))  # union-find
        self.low, self.high = list(range(n)), list(range(n))
        self.top: list[int] = [-1] * n  # of a component, at its head
        self.depth: list[int] = []
        self.parent: list[int] = []
        self.span: list[tuple[int, int]] = []
        self.sums: list[list] = []
        self.end: list[tuple[int, int]] = []  # conversations that end here, and the smallest

    def find(self, i: int) -> int:
        while self.head[i] != i:
            self.head[i] = self.head[self.head[i]]
            i = self.head[i]
        return i

    def leaves(self, node: int) -> int:
        return self.sums[node][3] if self.sums[node][2] else 1

    def saved(self, node: int, above: int) -> int:
        """Tokens saved in the subtree and in the chain of nodes down to it from depth ``above``."""
        cumulated = self.cumulated[self.span[node][0]]
        n, _, _, _, below = self.sums[node]
        return below + (n - 1) * int(cumulated[self.depth[node]] - cumulated[above])

    def node_at(self, component: int, depth: int) -> int:
        """The top of a component at this depth; made if its top is deeper."""
        top = self.top[component]
        if top >= 0 and self.depth[top] == depth:
            return top
        new = len(self.depth)
        self.depth.append(depth)
        self.parent.append(-1)
        self.span.append((self.low[component], self.high[component]))
        self.sums.append([0, None, 0, 0, 0])
        self.end.append((0, -1))
        if top >= 0:
            self.attach(top, new)
        self.top[component] = new
        return new

    def attach(self, child: int, node: int) -> None:
        self.parent[child] = node
        own = self.sums[child]
        if not self.held(*self.span[child]):
            self.add(node, own[0], own[1], 1, self.leaves(child), self.saved(child, self.depth[node]))
        low, high = self.span[node]
        self.span[node] = (min(low, self.span[child][0]), max(high, self.span[child][1]))

    def add(self, node: int, n: int, conv: int | None, children: int, leaves: int, saved: int) -> None:
        sums = self.sums[node]
        sums[0] += n
        if conv is not None:
            sums[1] = conv if sums[1] is None else min(sums[1], conv)
        sums[2] += children
        sums[3] += leaves
        sums[4] += saved

    def merge(self, i: int, depth: int) -> None:
        """The edge between the sequences i and i + 1, which share ``depth`` turns."""
        left, right = self.find(i), self.find(i + 1)
        node = self.node_at(left, depth)
        if self.top[right] >= 0:
            self.attach(self.top[right], node)
        self.head[right] = left
        self.high[left] = self.high[right]
        self.span[node] = (self.low[left], self.high[left])

    def build(self, shared: list[int], points: list[tuple]) -> dict[tuple[int, int], int]:
        """All nodes, from the LCPs of neighbours and points (sequence, depth, sums, ends) that are nodes in
        any case. Returns the node of each point."""
        by_depth: dict[int, tuple[list, list]] = {}
        for i, d in enumerate(shared):
            by_depth.setdefault(d, ([], []))[0].append(i)
        for point in points:
            by_depth.setdefault(point[1], ([], []))[1].append(point)
        found = {}
        for d in sorted(by_depth, reverse=True):
            edges, own = by_depth[d]
            for i in edges:  # from left to right, so that only the left component can have its top here
                self.merge(i, d)
            for i, _, sums, end in own:
                node = self.node_at(self.find(i), d)
                self.add(node, *sums)
                if end[0]:
                    self.end[node] = end
                found[i, d] = node
        return found

    def rows(self, nodes: list[int], parents: list[int | None]) -> dict[str, list]:
        """The rows of some nodes and of those between them and their parents; a parent's conversation
        that is not known here is null."""
        out: dict[str, list] = {name: [] for name in _NAMES}
        for node, parent in zip(nodes, parents, strict=True):
            above = self.depth[self.parent[node]] if self.parent[node] >= 0 else -1
            n, conv, children, _, below = self.sums[node]
            depth = self.depth[node]
            count = depth - above
            cumulated = self.cumulated[self.span[node][0]]
            out["conv_id"] += [conv] * count
            out["depth"] += range(above + 1, depth + 1)
            out["parent_conv_id"] += [parent, *[conv] * (count - 1)]
            out["n_convs"] += [n] * count
            out["n_children"] += [*[1] * (count - 1), children]
            out["n_leaves"] += [self.leaves(node)] * count
            # the root, at depth 0, has no text
            begins = cumulated[above:depth] if depth else cumulated[:1]
            out["saved_tokens"] += (below + (n - 1) * (cumulated[depth] - begins)).tolist()
            out["ends"] += [*[0] * (count - 1), self.end[node][0]]
            out["ender"] += [*[None] * (count - 1), self.end[node][1] if self.end[node][0] else None]
        return out


def _local_forest(seqs: list[bytes], weights: list, convs: list, sizes: list):
    """Rows of the complete nodes of a partition, the (side, depth) of a parent that is not complete, and the
    contracted rest: for the first and the last sequence its bytes, sizes and points."""
    cumulated = [np.concatenate([[0], np.cumsum(s, dtype=np.int64)]) for s in sizes]
    last = len(seqs) - 1
    forest = _Forest(cumulated, lambda low, high: low == 0 or high == last)
    ends = [
        (i, len(s) // DIGEST, (weights[i], convs[i], 0, 0, 0), (weights[i], convs[i])) for i, s in enumerate(seqs)
    ]
    points = forest.build([_shared(x, y) for x, y in zip(seqs, seqs[1:])], [*ends, (0, 0, (0, None, 0, 0, 0), (0, -1))])
    paths, side_of = [], {}
    for side, i in enumerate([0, last] if last else [0]):
        path = []
        node = points[i, len(seqs[i]) // DIGEST]
        while node >= 0 and node not in side_of:
            side_of[node] = side
            path.append((forest.depth[node], tuple(forest.sums[node]), forest.end[node]))
            node = forest.parent[node]
        paths.append((seqs[i], np.asarray(sizes[i], np.int64), path))
    complete = [k for k in range(len(forest.depth)) if k not in side_of]
    above = [forest.parent[k] for k in complete]
    rows = forest.rows(complete, [None if p in side_of else forest.sums[p][1] for p in above])
    counts = [forest.depth[k] - forest.depth[p] for k, p in zip(complete, above, strict=True)]
    side, level = [], []
    for p, count in zip(above, counts, strict=True):
        open_ = p in side_of
        side += [side_of[p] if open_ else None, *[None] * (count - 1)]
        level += [forest.depth[p] if open_ else None, *[None] * (count - 1)]
    return rows, side, level, paths


def _merged(parts: list[tuple[int, list]]):
    """The rows of all nodes on contracted paths, and (part, side, depth, conversation) of each point."""
    parts = sorted(parts, key=lambda p: p[1][0][0])
    items = [(part, side, *path) for part, paths in parts for side, path in enumerate(paths)]
    cumulated = [np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]) for _, _, _, sizes, _ in items]
    forest = _Forest(cumulated)
    points = [(i, depth, sums, end) for i, item in enumerate(items) for depth, sums, end in item[4]]
    found = forest.build([_shared(x[2], y[2]) for x, y in zip(items, items[1:])], points)
    nodes = list(range(len(forest.depth)))
    rows = forest.rows(nodes, [forest.sums[p][1] if p >= 0 else None for p in forest.parent])
    known = [(items[i][0], items[i][1], d, forest.sums[node][1]) for (i, d), node in found.items()]
    return rows, known


def _arrow(rows: dict, extra: dict) -> Iterator[pa.RecordBatch]:
    columns = {**rows, **extra}
    kinds = {"spine": pa.binary(), "part": pa.int32(), "side": pa.int32(), "level": pa.int64()}
    arrays = {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in columns.items()}
    yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))


def _forests(distinct: DataFrame) -> DataFrame:
    """Over sorted partitions, the rows of complete nodes and one row with the rest of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seqs, weights, convs, sizes = [], [], [], []
        for batch in batches:
            for column, out in zip(batch.columns, (seqs, weights, convs, sizes), strict=True):
                out += column.to_pylist()
        if seqs:
            part = TaskContext.get().partitionId()
            rows, side, level, paths = _local_forest(seqs, weights, convs, sizes)
            n = len(side)
            yield from _arrow(rows, {"part": [part] * n, "side": side, "level": level, "spine": [None] * n})
            spine = {name: [None] for name in _NAMES}
            yield from _arrow(spine, {"part": [part], "side": [None], "level": [None], "spine": [pickle.dumps(paths)]})

    size = distinct.agg(F.count("*").alias("rows"), F.sum(F.octet_length("seq")).alias("bytes")).first()
    wanted = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(wanted, 1 + size["rows"] // PART_ROWS, 1 + (size["bytes"] or 0) // PART_BYTES)
    ordered = distinct.select("seq", "weight", "conv", "sizes").repartitionByRange(wanted, "seq")
    found = ordered.sortWithinPartitions("seq").mapInArrow(
        run, f"{_ROW}, part int, side int, level long, spine binary"
    )
    return materialize(found, "forests")


def _merge_boundaries(forests: DataFrame) -> DataFrame:
    """The rows of the nodes that reach over partitions, and under ``part``, ``side``, ``level`` the
    conversations of the points of the contracted paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [
            (part, pickle.loads(spine))
            for batch in batches
            for part, spine in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        ]
        if parts:
            rows, known = _merged(parts)
            none = [None] * len(rows["depth"])
            yield from _arrow(rows, {"part": none, "side": none, "level": none})
            points = {name: [None] * len(known) for name in _NAMES}
            points["conv_id"] = [k[3] for k in known]
            yield from _arrow(points, {n: [k[j] for k in known] for j, n in enumerate(("part", "side", "level"))})

    spines = forests.filter("spine is not null").select("part", "spine")  # one row per partition
    merged = spines.repartition(1).mapInArrow(run, f"{_ROW}, part int, side int, level long")
    return materialize(merged, "merged-forest")


def ends_digests(members: DataFrame) -> DataFrame:
    """Per ``ender`` the SHA-256 of its ids ``conv``, in ascending order, joined by commas.

    Ids are joined within ranges of ``ID_CHUNK`` first; then a task goes through the ranges of a node in
    order and never holds more than one of them.
    """
    chunks = members.groupBy("ender", F.floor(F.col("conv") / ID_CHUNK).alias("chunk")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["ender", "digest"]
        current, digest = None, None
        for batch in batches:
            done = []
            for ender, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ender != current:
                    if digest is not None:
                        done.append((current, digest.hexdigest()))
                    current, digest = ender, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            yield pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=names
            )
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current]), pa.array([digest.hexdigest()])], names=names)

    ordered = chunks.repartition("ender").sortWithinPartitions("ender", "chunk")
    return ordered.select("ender", "ids").mapInArrow(run, "ender long, digest string")


def prefix_trie(found: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations as ``sequences`` gives them.

    Per node ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` (over its subtree, code points of a node's last text times its members less
    one) and ``ends_sha256`` of the members that end there.
    """
    convs = found.select(
        "conv", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("seq"),
        F.transform("turns", lambda t: t["size"]).alias("sizes"),
    )
    convs = materialize(convs.withColumn("key", F.unhex(F.md5("seq"))), "conversations")
    distinct = convs.groupBy("key").agg(
        F.first("seq").alias("seq"), F.first("sizes").alias("sizes"), F.count("*").alias("weight"),
        F.min("conv").alias("conv"),
    )
    distinct = materialize(distinct, "distinct-conversations")
    forests = _forests(distinct)
    merged = _merge_boundaries(forests)

    points = merged.filter("part is not null").select(
        "part", "side", "level", F.col("conv_id").alias("point_conv")
    )
    complete = forests.filter("spine is null").drop("spine").join(points, ["part", "side", "level"], "left")
    complete = complete.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "point_conv")).select(*_NAMES)
    nodes = complete.unionByName(merged.filter("part is null").select(*_NAMES))

    repeated = distinct.filter("weight > 1").select("key", F.col("conv").alias("ender"))
    digests = materialize(ends_digests(convs.select("conv", "key").join(repeated, "key")), "ends")
    own = F.sha2(F.col("ender").cast("string").cast("binary"), 256)
    ends = F.when(F.col("ends") == 0, F.lit(NO_ENDS)).when(F.col("ends") == 1, own).otherwise(F.col("digest"))
    return nodes.join(digests, "ender", "left").select(*_NAMES[:7], ends.alias("ends_sha256"))
