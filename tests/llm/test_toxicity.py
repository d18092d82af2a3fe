import random

import pytest

from tidewire.llm import toxicity
from tidewire.llm.toxicity import FEATURES, entries_of, features, fit_toxicity, score_toxicity

BAD = ["grobnarat", "grobnalim", "zulk", "fesh"]


def corpus(n=500, seed=2):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abdeiklmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 80))]
        toxic = int(i % 4 == 0)
        for _ in range(rng.randint(2, 5) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = [r for r in corpus() if r[0] % 3 != 1]
    rows += [(1000 + k, " ".join(f"copy{j}" for j in range(40)), 1) for k in range(80)]  # one copied text
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    marks = [(i, x) for i, _, x in rows] + [(0, 0), (5, None), (None, 1), (99_999, 1)]
    return fit_toxicity(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))


def test_held_out_rows(spark, model):
    rows = [r for r in corpus() if r[0] % 3 == 1]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, label int, Score int")
    got = score_toxicity(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    wrong = sum(r["predicted"] != r["label"] for r in got)
    assert wrong <= 0.03 * len(rows)


def test_copies_do_not_become_the_lexicon(model):
    assert not any(e.startswith("copy") for e in model.lexicon)
    assert "zulk" in model.lexicon and "grobna*" in model.lexicon


def test_edge_cases(spark, model):
    texts = [None, "", " \n", "!!!", "zulk", "x" * 200_000, "word " * 60_000, "same text", "same text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in score_toxicity(docs, model).collect()}
    assert len(got) == len(texts) and all(r["score"] is not None for r in got.values())
    assert got[0]["score"] == got[1]["score"] and got[7]["score"] == got[8]["score"]
    assert got[0]["predicted"] == 0 and got[6]["predicted"] == 0
    assert score_toxicity(docs.limit(0), model).count() == 0


def test_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    for marks, score in (([], 0.0), ([(1, 1)], 1.0), ([(1, 0), (2, 0)], 0.0)):
        model = fit_toxicity(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
        assert {r["score"] for r in score_toxicity(docs, model).collect()} == {score}


def test_a_score_does_not_depend_on_which_label_is_sampled(spark):
    """Of the texts with many exclamation marks a third is toxic, also when only clean rows are left out."""
    rng = random.Random(5)
    rows = []
    for i, text in enumerate(t for _, t, _ in corpus(2400, seed=6)):
        words = [w for w in text.split() if w not in BAD]
        toxic = int(i % 6 == 0)
        if i % 12 == 0 or (i % 6 in (1, 2) and i % 12 < 6 and not toxic):
            words = [f"{w}!!" for w in words]
        elif toxic:
            words[rng.randrange(len(words))] = rng.choice(BAD)
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    border = [r for r in rows if "!!" in r[1]]
    share = sum(r[2] for r in border) / len(border)
    assert share == pytest.approx(1 / 3)
    for max_rows in (6000, 450):
        model = fit_toxicity(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), max_rows=max_rows)
        scored = score_toxicity(docs.filter("text like '%!!%'"), model).collect()
        assert sum(r["score"] for r in scored) / len(scored) == pytest.approx(share, abs=0.12)


def test_features():
    lexicon = {"zulk": 3.0, "grobna*": 2.0}
    value = dict(zip(FEATURES, features("You are a ZULK, grobnarat! And z.u1k z0z", lexicon), strict=True))
    assert value["lexicon_density"] == pytest.approx(2 / 11)
    assert value["heaviest_entry"] == 3.0 and value["densest_stretch"] == 2
    assert value["second_person_proximity"] == pytest.approx(2.718281828 ** (-3 / 5))
    assert value["shouting"] == pytest.approx(1 / 11) and value["obfuscated_density"] == pytest.approx(2 / 11)
    assert features(None, lexicon) == features("", lexicon) == [0.0] * len(FEATURES)
    assert list(entries_of("abcdef")) == ["abcdef", "abcd*", "abcde*"]


@pytest.mark.parametrize("n", [60, 4000])
def test_rare_sure_words_are_learned_at_every_size(spark, n):
    """A word of ten toxic texts enters the lexicon, whatever the number of toxic texts."""
    rows = [(float(i % 2), f"the common words of text {i}" + (" vilest" if i % 2 and i < 20 else "")) for i in range(n)]
    sample = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "label double, text string, mark long")
    assert "vilest" in toxicity._lexicon(sample, 100)


def exchanged(plan):
    """The columns that each exchange of a plan moves."""
    own = [plan.output().mkString(" ")] if plan.nodeName() == "Exchange" else []
    children = plan.children()
    return own + [x for k in range(children.size()) for x in exchanged(children.apply(k))]


def test_texts_are_not_moved_to_meet_their_labels(spark, monkeypatch):
    """With labels too many for a broadcast only ids and marks are dealt out; the sample stays the same."""
    written, write = {}, toxicity.materialize
    monkeypatch.setattr(toxicity, "materialize", lambda df, name: written.setdefault(name, df) and write(df, name))
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words"), (2, "a b c d e f"), (3, None), (4, "no label"), (None, "no id"), (5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = [(1, 1), (1, 0), (2, 0), (3, 1), (4, None), (None, 1), (5, 0), (6, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        sample, sizes = toxicity._sample(docs, labels, 100)
        moved = exchanged(written["toxicity-marks"]._jdf.queryExecution().executedPlan())
        got = sorted((r["label"], r["text"]) for r in sample.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert moved and not any("text" in columns for columns in moved)
    assert got == [(0.0, "a b c d e f"), (0.0, "x"), (1.0, ""), (1.0, "a b c d e f"), (1.0, "other words")]
    assert sizes == {0.0: 2, 1.0: 3}
