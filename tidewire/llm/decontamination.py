"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` cuts the documents into blocks and stores, per block, the positions of every word that
a benchmark item uses: one list per word, ascending, over all documents of the block. The index is a
table that any number of searches can read. ``search`` sends the windows of the items to the blocks. For
each window it takes the list of the rarest word (counted over the whole index), moves it by the word's
place in the window, and meets it with the lists of the other words from rare to frequent; it ends as
soon as nothing is left. ``slop`` 0 gives exact phrases, more gives proximity matches: every word within
``slop`` words of its place.

Postings are not shuffled: they stay with their block, so no list of a frequent word is ever in one task. The
windows are formed by tasks and written as a table; they are sent to the blocks in groups of at most about
``ITEM_BYTES``, one group at a time, and what documents have of several groups is put together by document.
Of the benchmark the driver holds one group and, for each of its distinct words, a hash and a count.

Words are runs of ASCII letters and digits and of all non-ASCII bytes, A-Z lower-cased. A window is
``WINDOW`` consecutive words of an item; an item of fewer words is one window, an item without words has
none; items without an id are left out. Null and empty texts have no words. Repeated rows and equal items each count for themselves; an
empty table gives an empty result, an empty benchmark gives documents without hits. Input columns other
than the id and the text are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewire.llm.flat import ALPHANUMERIC, flat_bytes, row_slices, word_hashes
from tidewire.llm.frames import regrouped, released, small_batches
from tidewire.settings import materialize, scratch_path

WINDOW = 10
BLOCK_BYTES = 8 << 20  # text of an index block; a longer text is a block of its own
ITEM_BYTES = 16 << 20  # of the windows that are sent to the tasks at once

WINDOWS_AT_ONCE = 10_000

INDEX_SCHEMA = (
    "block long, doc_ids binary, word_counts binary, words binary, posting_ends binary, positions binary"
)


@dataclass(frozen=True)
class Windows:
    """Windows of some items: rows of word hashes, rarest first, with their places in the window."""

    words: list[np.ndarray]
    places: list[np.ndarray]
    lengths: np.ndarray
    items: np.ndarray


def item_words(benchmark: DataFrame, item_column: str, text_column: str) -> DataFrame:
    """``item`` and its ``words``, as hashes; items without an id or without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in row_slices(batch.column(1)):
                flat, counts = word_hashes(*flat_bytes(batch.column(1).slice(begin, end - begin)), ALPHANUMERIC)
                words = np.split(flat, np.cumsum(counts)[:-1])
                some = [i for i, w in enumerate(words) if len(w)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin).take(pa.array(some, pa.int64())),
                     pa.array([words[i].tobytes() for i in some], pa.binary())],
                    names=["item", "words"],
                )

    items = benchmark.select(F.col(item_column).cast("string").alias("item"), F.col(text_column).alias("text"))
    items = items.filter("item is not null and text is not null")
    return materialize(items.mapInArrow(run, "item string, words binary"), "benchmark-words")


def vocabulary_of(words: DataFrame) -> np.ndarray:
    """The distinct words of the items, sorted: 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(found)], names=["word"])

    found = words.select("words").mapInArrow(run, "word long").distinct().toPandas()["word"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


def build_index(
    docs: DataFrame, vocabulary: np.ndarray, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The positional index of ``docs`` for the words of ``vocabulary`` (sorted hashes), written to
    the shared folder: one row per block."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known = shared.value
        number = TaskContext.get().partitionId() << 24
        for batch in regrouped(batches, size=BLOCK_BYTES):
            texts = batch.column(1)
            for begin, end in row_slices(texts, BLOCK_BYTES):
                ids, counts, word, position = [], [], [], []
                base = 0
                block = texts.slice(begin, end - begin)
                for low, high in row_slices(block):
                    hashes, n = word_hashes(*flat_bytes(block.slice(low, high - low)), ALPHANUMERIC)
                    counts.append(n)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                        hit = np.flatnonzero(known[at] == hashes)
                        word.append(at[hit].astype(np.int32))
                        position.append((hit + base).astype(np.int32))
                    base += len(hashes)
                words = np.concatenate(word) if word else np.zeros(0, np.int32)
                order = np.argsort(words, kind="stable")
                listed, first = np.unique(words[order], return_index=True)
                positions = np.concatenate(position)[order] if word else words
                ids = pickle.dumps(batch.column(0).slice(begin, end - begin).to_pylist())
                row = [
                    ids,
                    np.concatenate(counts).astype(np.int64).tobytes(),
                    known[listed].tobytes() if len(known) else b"",
                    np.append(first, len(words))[1:].astype(np.int64).tobytes(),
                    positions.tobytes(),
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), *[pa.array([v], pa.binary()) for v in row]],
                    names=["block", "doc_ids", "word_counts", "words", "posting_ends", "positions"],
                )
                number += 1

    path = scratch_path(spark, "positional-index")
    chosen = docs.select(F.col(f"`{id_column}`"), F.col(f"`{text_column}`"))
    blocks = chosen.mapInArrow(lambda batches: released(run(batches)), INDEX_SCHEMA)
    blocks.write.option("compression", "zstd").parquet(path)
    shared.destroy()
    return spark.read.schema(INDEX_SCHEMA).parquet(path)


def word_frequencies(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each word of the vocabulary occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, ends in zip(batch.column(0), batch.column(1), strict=True):
                n = np.diff(np.frombuffer(ends.as_py(), np.int64), prepend=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(words.as_py(), np.int64)), pa.array(n)],
                    names=["word", "n"],
                )

    counted = index.select("words", "posting_ends").mapInArrow(run, "word long, n long")
    found = counted.groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(vocabulary), np.int64)
    out[np.searchsorted(vocabulary, found["word"].to_numpy(np.int64).view(np.uint64))] = found["n"].to_numpy()
    return out


def item_windows(words: DataFrame, vocabulary: np.ndarray, counts: np.ndarray, window: int) -> DataFrame:
    """The windows of the items that can occur: ``item``, ``words`` (rarest first) and their ``places``."""
    shared = words.sparkSession.sparkContext.broadcast((vocabulary, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = shared.value
        for batch in batches:
            for item, raw in zip(batch.column(0), batch.column(1), strict=True):
                hashes = np.frombuffer(raw.as_buffer(), np.uint64)
                rarity = often[np.searchsorted(known, hashes)]
                size = min(window, len(hashes))
                for begin in range(0, len(hashes) - size + 1, WINDOWS_AT_ONCE):
                    part = slice(begin, begin + WINDOWS_AT_ONCE + size - 1)
                    cut, rare = (np.lib.stride_tricks.sliding_window_view(x[part], size) for x in (hashes, rarity))
                    can = rare.min(axis=1) > 0  # else a word occurs nowhere
                    cut, rare = cut[can], rare[can]
                    order = np.argsort(rare, axis=1, kind="stable")
                    sorted_words = np.take_along_axis(cut, order, axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item.as_py()] * len(order), pa.string()),
                         pa.array([r.tobytes() for r in sorted_words], pa.binary()),
                         pa.array([r.tobytes() for r in order.astype(np.int32)], pa.binary())],
                        names=["item", "words", "places"],
                    )

    found = words.mapInArrow(run, "item string, words binary, places binary")
    found = materialize(found, "benchmark-windows")
    shared.destroy()
    return found


def window_parts(windows: DataFrame) -> Iterator[Column]:
    """Conditions that cut the windows into groups of at most about ``ITEM_BYTES``."""
    size = windows.agg(F.sum(F.octet_length("words") + F.octet_length("places"))).first()[0] or 0
    groups = 1 + size // ITEM_BYTES
    part = F.pmod(F.xxhash64("item", "words", "places"), F.lit(groups))
    return (part == g for g in range(groups))


def _group(windows: DataFrame, part: Column) -> Windows:
    rows = windows.filter(part).collect()
    words = [np.frombuffer(r["words"], np.uint64) for r in rows]
    places = [np.frombuffer(r["places"], np.int32) for r in rows]
    lengths = np.array([len(w) for w in words], np.int64)
    return Windows(words, places, lengths, np.array([r["item"] for r in rows], object))


def _near(sorted_positions: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which of the ranges (both ends included) hold a listed position."""
    at = np.searchsorted(sorted_positions, least)
    inside = np.minimum(at, len(sorted_positions) - 1)
    return (at < len(sorted_positions)) & (sorted_positions[inside] <= most)


def _occurrences(lists, windows: Windows, i: int, starts: np.ndarray, ends: np.ndarray, slop: int):
    """Positions in the block at which window ``i`` begins, inside one document.

    ``starts`` and ``ends`` are those of the documents that have words.
    """
    begin = None
    for word, place in zip(windows.words[i].tolist(), windows.places[i].tolist(), strict=True):
        positions = lists.get(word)
        if positions is None:
            return None
        if begin is None:
            doc = np.searchsorted(starts, positions, side="right") - 1
            begin = positions - place
            fits = (begin >= starts[doc]) & (begin + windows.lengths[i] <= ends[doc])
            begin, doc = begin[fits], doc[fits]
        else:
            wanted = begin + place
            least, most = np.maximum(wanted - slop, starts[doc]), np.minimum(wanted + slop, ends[doc] - 1)
            fits = _near(positions, least, most)
            begin, doc = begin[fits], doc[fits]
        if not len(begin):
            return None
    return begin


def _joined(spans: list[tuple[int, int]]) -> list[dict]:
    """Spans in order of their begin, with those that touch or overlap made one."""
    out: list[dict] = []
    for begin, end in spans:
        if out and begin <= out[-1]["end"]:
            out[-1]["end"] = max(end, out[-1]["end"])
        else:
            out.append({"begin": begin, "end": end})
    return out


FOUND = "block long, place long, doc_id {}, n_words long, items array<string>, spans array<struct<begin:long,end:long>>"


def search(index: DataFrame, windows: Windows, slop: int = 0, id_type: str = "long") -> DataFrame:
    """Per document the items that match, and where.

    Columns ``block`` and ``place`` (of the document in the index), ``doc_id``, ``n_words``, ``items`` (sorted as
    text) and ``spans`` (begin and end of the merged matches, in words of the document).
    """
    shared = index.sparkSession.sparkContext.broadcast(windows)
    id_arrow = to_arrow_type(T.DataType.fromDDL(id_type))

    def block(row) -> dict[str, list]:
        counts = np.frombuffer(row["word_counts"], np.int64)
        words = np.frombuffer(row["words"], np.uint64).tolist()
        ends = np.frombuffer(row["posting_ends"], np.int64)
        positions = np.frombuffer(row["positions"], np.int32).astype(np.int64)
        lists = dict(zip(words, np.split(positions, ends[:-1]), strict=True)) if words else {}
        starts = np.cumsum(counts) - counts
        ends_of = np.cumsum(counts)
        filled = np.flatnonzero(counts)  # documents with words; their starts differ
        begins, finishes, owners = [], [], []
        windows = shared.value
        for i in range(len(windows.words)):
            found = _occurrences(lists, windows, i, starts[filled], ends_of[filled], slop)
            if found is not None:
                begins.append(found)
                finishes.append(found + windows.lengths[i])
                owners.append(np.full(len(found), windows.items[i], object))
        items: list[list[str]] = [[] for _ in counts]
        spans: list[list[tuple[int, int]]] = [[] for _ in counts]
        if begins:
            begin, end, owner = map(np.concatenate, (begins, finishes, owners))
            doc = filled[np.searchsorted(starts[filled], begin, side="right") - 1]
            order = np.lexsort((end, begin))
            for d, b, e, item in zip(
                doc[order].tolist(), (begin - starts[doc])[order].tolist(),
                (end - starts[doc])[order].tolist(), owner[order], strict=True,
            ):
                items[d].append(item)
                spans[d].append((b, e))
        return {
            "block": [row["block"]] * len(counts),
            "place": list(range(len(counts))),
            "doc_id": pickle.loads(row["doc_ids"]),
            "n_words": counts.tolist(),
            "items": [sorted(set(x)) for x in items],
            "spans": [_joined(x) for x in spans],
        }

    arrow = {
        "block": pa.int64(), "place": pa.int64(), "doc_id": id_arrow, "n_words": pa.int64(),
        "items": pa.list_(pa.string()), "spans": pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
                out = block(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, arrow.get(k)) for k, v in out.items()], names=list(out)
                )

    return index.mapInArrow(lambda batches: released(run(batches)), FOUND.format(id_type))


def _together(found: list[DataFrame]) -> DataFrame:
    """What documents have of several groups of windows; only the first part has documents without any."""
    rest = functools.reduce(DataFrame.unionByName, [f.filter(F.size("items") > 0) for f in found[1:]], found[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = [_joined([(s["begin"], s["end"]) for s in row.as_py()]) for row in batch.column("spans")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(spans, kind)], names=batch.schema.names
            )

    merged = rest.groupBy("block", "place").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    return merged.mapInArrow(run, merged.schema)


def matches(
    docs: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int = 0,
) -> DataFrame:
    """``search`` of all items in all documents, with an index made for them: ``doc_id``, ``n_words``, ``n_hit`` (words
    inside a match), ``items`` and ``spans``."""
    small_batches(docs.sparkSession)
    words = item_words(benchmark, item_column, item_text)
    vocabulary = vocabulary_of(words)
    index = build_index(docs, vocabulary, id_column, text_column)
    windows = item_windows(words, vocabulary, word_frequencies(index, vocabulary), window)
    id_type = docs.schema[id_column].dataType.simpleString()
    parts = list(window_parts(windows))
    if len(parts) == 1:
        found = search(index, _group(windows, parts[0]), slop, id_type)
    else:  # each is written before the next, so that one group is held at a time
        found = [materialize(search(index, _group(windows, p), slop, id_type), "matches") for p in parts]
        found = _together(found)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), "items", "spans")


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``matches`` with the number and digest of the items and whether there is any hit.

    Adds ``n_items``, ``items_sha256`` (of the sorted ids, comma between; of the empty text without
    any) and ``contaminated``.
    """
    found = matches(docs, benchmark, **options)
    return found.select(
        "*",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def items_digest(items: list[str]) -> str:
    """The digest ``contamination`` gives for these items."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
