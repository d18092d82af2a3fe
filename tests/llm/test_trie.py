"""The prefix trie against plain Python."""

import hashlib
import random

import brute
import pytest

from tidewire.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def result(df, rebuilt=True):
    found = trie.sequences(df)
    found = trie.prefix_trie(trie.with_shared_openings(found) if rebuilt else found).collect()
    rows = [tuple(r) for r in found]
    assert len(set(rows)) == len(rows)
    return set(rows)


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(250):
        for t in range(rng.choice([1, 2, 3, 9])):
            turn = rng.choice([t, None, 0]) if seed else t
            conv = rng.choice([c, c, None]) if seed == 2 else c
            rows.append((conv, turn, rng.choice(["u", None, ""]), rng.choice(["a", "b", None, "aé😀"])))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert result(df) == brute.prefix_trie(rows)
    assert result(df, rebuilt=False) == brute.prefix_trie(rows, rebuilt=False)


def test_copies_prefixes_and_long_conversations(spark, monkeypatch):
    """A third of all conversations are equal; some are prefixes of others; one is long."""
    monkeypatch.setattr(trie, "ID_CHUNK", 16)
    rows = [(c, t, "u", f"t{t}") for c in range(300, 400) for t in range(4)]
    rows += [(c, t, "u", f"t{t}") for c in range(20) for t in range(1 + c % 9)]
    rows += [(-7, t, "a", "x" * (t % 5)) for t in range(3000)]
    rows += [(-8, t, "a", "x" * (t % 5)) for t in range(2990)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(df, rebuilt=False) == brute.prefix_trie(rows, rebuilt=False)


def test_edge_cases(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == set()
    # a conversation without turns of its own after its opening, which nobody has, is a member of the root
    lone = next(c for c in range(101, 200) if brute.crc(c) % 6 == 3)
    rows = [(lone, 0, "u", "a"), (None, 0, "u", "b")]
    empty = hashlib.sha256(str(lone).encode()).hexdigest()
    assert result(spark.createDataFrame(rows, SCHEMA)) == {(lone, 0, None, 1, 0, 1, 0, empty)}
    rows = [(1, 0, "u", "a" * 1_000_000), (1, 0, "u", "a" * 1_000_000), (2, None, None, None)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA + ", depth int, `a.b` string")
    assert result(df, rebuilt=False) == brute.prefix_trie(rows, rebuilt=False)


def test_sequences_are_told_apart(spark):
    rows = [(1, 0, "a", "bc"), (2, 0, "ab", "c"), (3, 0, "", "abc")]
    assert len(result(spark.createDataFrame(rows, SCHEMA), rebuilt=False)) == 4
