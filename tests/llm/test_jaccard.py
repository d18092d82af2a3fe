import random

import brute
import pytest

from tidewire.llm.graph import components
from tidewire.llm.jaccard import jaccard_components, jaccard_links, prefix_length


def corpus(seed=6):
    """Copies, near copies at all distances, shared passages and edge cases."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]

    def text(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    passage = text(40)
    bases = [text(rng.randint(6, 90)) for _ in range(12)]
    docs = []
    for base in bases:
        for _ in range(8):
            near = list(base)
            for _ in range(rng.randint(0, 4)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            docs.append(" ".join(near[rng.randint(0, 2) :]))
    docs += [" ".join(text(8) + passage + text(rng.randint(0, 12))) for _ in range(25)]
    docs += ["one", "One", "one two", "one two three four", "ONE two\tthree four", "a b c d e", "", None, " \n"]
    docs += ["long " + " ".join(text(20_000))]
    return list(enumerate(docs))


@pytest.mark.parametrize("part", [32, 2])
def test_equals_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr("tidewire.llm.jaccard.PART", part)
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n long, digest int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs.repartition(4)).collect()}
    assert got == brute.jaccard_components(rows)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(7)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(400):
        near = list(base)
        near[rng.randrange(len(near))] = f"x{i}"
        rows.append((i, " ".join(near)))
    rows += [(1000 + i, " ".join(base)) for i in range(200)]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(i, 0) for i, _ in rows}


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = "a b c d e f g"
    rows = [(5, text), (5, text), (3, text), (None, text), (None, None), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard_components(docs).collect()), key=str)
    assert got == sorted([(5, 3, 3), (5, 3, 3), (3, 3, 3), (None, 3, None), (None, 0, None), (9, 0, 9)], key=str)
    assert jaccard_components(docs.limit(0)).count() == 0
    assert jaccard_components(docs.filter("doc_id = 9")).collect()[0]["component_id"] == 9


def test_prefix_length():
    assert [prefix_length(n, 80) for n in (1, 4, 5, 10, 100)] == [1, 1, 2, 3, 27]


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(8)
    names = rng.sample(range(1 << 40), 300)
    links = [(names[i], names[i + 1]) for i in range(99)]  # a path
    links += [(names[100], names[i]) for i in range(101, 200)]  # a star
    links += [(names[i], names[(i - 200 + 1) % 50 + 200]) for i in range(200, 250)]  # a ring
    links += [(names[260], names[260]), (names[270], names[271]), (names[271], names[270])]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    groups = [names[:100], names[100:200], names[200:250], names[270:272]]
    assert set(got) == {n for g in groups for n in g}
    assert all(len({got[n] for n in g}) == 1 for g in groups) and len(set(got.values())) == 4


@pytest.mark.parametrize("part", [32, 2])
def test_all_links_between_classes(spark, monkeypatch, part):
    monkeypatch.setattr("tidewire.llm.jaccard.PART", part)
    rows = corpus(9)
    rows += [(1000 + i, t) for i, t in rows[:30:3]]
    docs = spark.createDataFrame(rows + [(None, rows[0][1])], "doc_id long, text string")
    links, members = jaccard_links(docs.repartition(4))
    sets = {i: frozenset(brute.shingles(t)) for i, t in rows}
    home = {}
    for i, s in sorted(sets.items()):
        home.setdefault(s, i)
    expected = set()
    for a, x in home.items():
        for b, y in home.items():
            if x < y and a and b and 100 * len(a & b) >= 80 * len(a | b):
                expected.add((x, y))
    got = [tuple(r) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == expected and len(expected) > 10
    assert {r["doc_id"]: r["class_id"] for r in members.collect() if r["doc_id"] is not None} == {
        i: home[s] if s else None for i, s in sets.items()
    }
