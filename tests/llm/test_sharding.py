import random
import zlib
from collections import defaultdict

import pytest

from tidewire.llm.sharding import balanced_shards


def result(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, shard string, link int")
    return balanced_shards(docs.repartition(3), **options).collect()


def check(rows, got, shards=8):
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    slots, load, text = defaultdict(list), defaultdict(int), dict(rows)
    homes = defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
        if text[r["doc_id"]]:
            homes[text[r["doc_id"]]].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return load, homes


def test_small_groups_stay_whole_and_sizes_are_even(spark):
    rng = random.Random(1)
    rows, n = [], 0
    for group in range(150):
        text = "é" * rng.randint(0, 200) + str(group)
        for _ in range(rng.choice([1, 1, 1, 2, 3, 5])):
            rows.append((n, text))
            n += 1
    rows += [(n + i, f"{i} " * rng.randint(1, 60)) for i in range(600)]  # without links
    load, homes = check(rows, result(spark, rows))
    assert max(load.values()) <= 1.02 * sum(load.values()) / 8 and len(load) == 8
    assert all(len(h) == 1 for h in homes.values())


def test_a_group_larger_than_a_shard(spark):
    rng = random.Random(2)
    rows = [(i, "the same text " * 10) for i in range(400)]
    rows += [(400 + i, "".join(rng.choice("abc") for _ in range(rng.randint(1, 300)))) for i in range(500)]
    load, homes = check(rows, result(spark, rows))
    assert max(load.values()) <= 1.05 * sum(load.values()) / 8
    assert len(homes["the same text " * 10]) <= 5  # it fills some three shards


def test_edge_cases(spark):
    rows = [(1, None), (2, None), (3, ""), (4, "x"), (5, "x"), (6, "y" * 100_000)]
    check(rows, result(spark, rows, shards=3), 3)
    got = result(spark, [(1, "a"), (1, "a"), (1, "a")])
    assert len(got) == 3 and {r["shard"] for r in got} and len({(r["shard"], r["slot"]) for r in got}) == 3
    assert result(spark, [(None, "a"), (None, None)])[0]["doc_id"] is None
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert balanced_shards(empty).count() == 0


@pytest.mark.parametrize("rows", [5, 40])
def test_slots_over_many_parts(spark, monkeypatch, rows):
    monkeypatch.setattr("tidewire.llm.sharding.SLOT_ROWS", rows)
    data = [(i, f"text {i % 70}") for i in range(200)]
    check(data, result(spark, data))


@pytest.mark.parametrize("rows", [
    [(1, "seven x")] * 800,
    [(1, "y" * 1000)] * 400 + [(1000 + i, "z" * (i % 50)) for i in range(400)],
    [(None, None)] * 800 + [(i, "few") for i in range(12)],
    [(i, "the same for all") for i in range(4000)],
])
def test_repeated_rows_are_spread(spark, rows):
    got = result(spark, rows)
    load = [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]
    assert len(got) == len(rows) and max(abs(x - sum(load) / 8) for x in load) <= max(0.01 * sum(load) / 8, max(r["size"] for r in got))
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
