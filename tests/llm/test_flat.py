import random

import numpy as np
import pyarrow as pa
import pytest

import brute
from tidewire.llm import flat

TEXTS = [None, "", "a", "Hello  wORLD\tx\x00y", " é ü A\x0b b", "x" * 100, "ÀÉ z ok"]


@pytest.mark.parametrize("piece", [2 << 20, 37])
@pytest.mark.parametrize(
    "table, pattern", [(flat.BY_SPACE, brute.BY_SPACE), (flat.ALPHANUMERIC, brute.ALPHANUMERIC)]
)
def test_words_and_sets(monkeypatch, piece, table, pattern):
    monkeypatch.setattr(flat, "PIECE", piece)
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("ab C\n é-9") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    hashes, counts = flat.word_hashes(*flat.flat_bytes(pa.array(texts)), table)
    expected = [brute.words(t, pattern) for t in texts]
    assert counts.tolist() == [len(w) for w in expected]
    seen = {}
    for word, value in zip([w for x in expected for w in x], hashes.tolist(), strict=True):
        assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)
    if table is flat.BY_SPACE:
        sets = dict(flat.sets_of(pa.array(texts)))
        assert [len(sets[i]) for i in range(len(texts))] == [len(brute.shingles(t)) for t in texts]


def test_slices_cover_all_rows():
    texts = pa.array(["x" * n for n in (1, 50, 0, 200, 3, 3)] + [None])
    ranges = list(flat.row_slices(texts, 60))
    assert [b for b, _ in ranges] + [len(texts)] == [0] + [e for _, e in ranges]
    assert list(flat.row_slices(texts.slice(0, 0))) == []


def test_sliced_arrays_keep_their_texts():
    texts = pa.array(["one two", "three", None, "four five six"]).slice(1, 3)
    data, starts = flat.flat_bytes(texts)
    assert data.tobytes() == b"threefour five six" and starts.tolist() == [0, 5, 5, 18]
    assert np.array_equal(flat.word_hashes(data, starts)[1], [1, 0, 3])


def test_few_words():
    for text in ("", "a", "a b", "a b c", "a b c d", "a b c d e"):
        assert [len(s) for _, s in flat.sets_of(pa.array([text]))] == [1 if text else 0]
