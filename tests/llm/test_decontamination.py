import random

import brute
import pytest

from tidewire.llm.decontamination import contamination, items_digest, matches

WORDS = [f"w{i}" for i in range(12)]


def tables(spark, seed=5, n=60):
    rng = random.Random(seed)

    def text(low, high):
        return " ".join(rng.choice(WORDS) for _ in range(rng.randint(low, high)))

    items = [(i, text(1, 14)) for i in range(8)] + [(90, None), (91, ""), (92, "?!"), (93, "É-A b"), (94, "É-A b")]
    docs = [(i, text(0, 40)) for i in range(n)]
    docs += [(100 + i, f"{text(0, 9)} -- {items[i][1].upper()}; {text(0, 9)}") for i in range(8)]
    docs += [(200, None), (201, ""), (202, "é a, B"), (203, "w0 " * 30_000 + items[1][1]), (203, "again")]
    return docs, items


@pytest.mark.parametrize("block, group", [(8 << 20, 16 << 20), (300, 60)])
def test_equals_brute_force(spark, monkeypatch, block, group):
    monkeypatch.setattr("tidewire.llm.decontamination.BLOCK_BYTES", block)
    monkeypatch.setattr("tidewire.llm.decontamination.ITEM_BYTES", group)
    docs, items = tables(spark)
    table = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, n_words string")
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    got = contamination(table.repartition(3), bench, window=4).collect()
    assert len(got) == len(docs)
    rows = {(r["doc_id"], r["n_words"]): r for r in got}
    for doc, text in docs:
        (n, hit, found), = brute.contamination([(doc, text)], items, window=4).values()
        row = rows[doc, n]
        assert (row["n_hit"], row["items"], row["n_items"]) == (hit, found, len(found))
        assert row["items_sha256"] == items_digest(found) and row["contaminated"] == (hit > 0)
        assert sum(s["end"] - s["begin"] for s in row["spans"]) == hit


def test_proximity(spark):
    docs = spark.createDataFrame(
        [(1, "the red big fox jumps"), (2, "the fox red jumps"), (3, "red a b c d fox")], "doc_id long, text string"
    )
    bench = spark.createDataFrame([("i", "red fox jumps")], "item_id string, text string")
    exact = {r["doc_id"]: r["items"] for r in matches(docs, bench).collect()}
    near = {r["doc_id"]: r["items"] for r in matches(docs, bench, slop=1).collect()}
    assert exact == {1: [], 2: [], 3: []}
    assert near[1] == ["i"] and near[3] == []


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c"), (None, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    none = contamination(docs, bench.limit(0)).collect()
    assert sorted((r["n_words"], r["n_hit"], r["contaminated"]) for r in none) == [(2, 0, False), (3, 0, False)]
    assert contamination(docs.limit(0), bench).count() == 0
    assert {r["doc_id"]: r["n_hit"] for r in contamination(docs, bench).collect()} == {1: 2, None: 2}
