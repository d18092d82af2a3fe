"""Texts of an Arrow batch as flat numpy arrays: words, word hashes and shingles.

Texts are worked on as the UTF-8 bytes of a batch. Work is cut into pieces of ``PIECE`` bytes at word
breaks, so that memory follows the piece and not the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 256 << 10

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
SHINGLE_FACTORS = np.array(
    [pow(0xD1342543DE82EF95, i + 1, 1 << 64) for i in range(16)], dtype=np.uint64
)


def _table(is_word) -> tuple[np.ndarray, np.ndarray]:
    word = np.array([is_word(b) for b in range(256)])
    lower = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint64)
    return word, lower + np.uint64(1)


# Words between ASCII white space, A-Z lower-cased.
BY_SPACE = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
# Runs of ASCII letters and digits and of all bytes above ASCII, A-Z lower-cased.
ALPHANUMERIC = _table(lambda b: b >= 0x80 or chr(b).isalnum())


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts after each other, and where each begins (one more entry: the end).

    A null counts as empty text.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(texts: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text; a longer text is a range of its own."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts.fill_null("")), dtype=np.int64))
    begin = 0
    while begin < len(ends):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield begin, end
        begin = end


class _Powers:
    """Powers of the base and of its inverse, grown on demand and kept per worker."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, PIECE + 1)
            self.up, self.down = (np.full(size + 1, base) for base in (_BASE, _BASE_INVERSE))
            for powers in (self.up, self.down):
                powers[0] = 1
                np.cumprod(powers, out=powers)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def word_bounds(
    data: np.ndarray, starts: np.ndarray, table=BY_SPACE
) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of flat texts begin and end (exclusive). No word spans two texts."""
    inside = table[0][data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    begins = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    return begins, np.flatnonzero(inside & (~after | edge[1:])) + 1


def _piece_hashes(data: np.ndarray, starts: np.ndarray, table) -> tuple[np.ndarray, np.ndarray]:
    begins, ends = word_bounds(data, starts, table)
    up, down = _POWERS.upto(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(table[1][data] * up[: len(data)])])
    return mixed((sums[ends] - sums[begins]) * down[begins]), begins


def word_hashes(data: np.ndarray, starts: np.ndarray, table=BY_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and the number of words of each text."""
    parts, counts = [], np.zeros(len(starts) - 1, np.int64)
    begin, total = 0, len(data)
    while begin < total:
        end = begin + PIECE
        if end < total:  # go back to the last word break, or on to the next one
            breaks = np.flatnonzero(~table[0][data[begin:end]])
            if len(breaks):
                end = begin + int(breaks[-1]) + 1
            else:
                while end < total and table[0][data[end]]:
                    ahead = np.flatnonzero(~table[0][data[end : end + PIECE]])
                    end = end + int(ahead[0]) if len(ahead) else min(total, end + PIECE)
        end = min(end, total)
        first, last = np.searchsorted(starts, [begin, end])
        inner = starts[first : np.searchsorted(starts, end, side="right")] - begin
        hashes, begins = _piece_hashes(data[begin:end], inner, table)
        parts.append(hashes)
        text = np.searchsorted(starts, begins + begin, side="right") - 1
        counts += np.bincount(text, minlength=len(counts))[: len(counts)]
        begin = end
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), counts


def shingle_sets(words: np.ndarray, counts: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``k``-word shingles.

    A text of fewer words has one shingle, the whole sequence; a text without words has none.
    """
    n = max(len(words) - k + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for j in range(k):
        rolled += words[j : n + j] * SHINGLE_FACTORS[j]
    rolled = mixed(rolled)
    sets, begin = [], 0
    for count in counts.tolist():
        if count >= k:
            sets.append(np.unique(rolled[begin : begin + count - k + 1]))
        elif count:
            short = words[begin : begin + count] * SHINGLE_FACTORS[:count]
            sets.append(mixed(np.array([short.sum(dtype=np.uint64) ^ SHINGLE_FACTORS[8 + count]])))
        else:
            sets.append(np.zeros(0, np.uint64))
        begin += count
    return sets


def sets_of(texts: pa.Array, k: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and shingle set of each text of a batch."""
    for begin, end in row_slices(texts):
        words, counts = word_hashes(*flat_bytes(texts.slice(begin, end - begin)))
        yield from enumerate(shingle_sets(words, counts, k), begin)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
