import math
import random

import numpy as np
import pytest

from tidewire.llm import language
from tidewire.llm.language import LanguageModels, fit_characters, fit_languages, identify, letters

SYLLABLES = {"aa": "ka lo mi tu ne", "bb": "schra öst wur ges ßen", "cc": "бор нет два чай"}


def texts(lang, n, seed=1):
    rng = random.Random(f"{lang}{seed}")
    parts = SYLLABLES[lang].split()
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    return [" ".join(word() for _ in range(rng.randint(8, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def models(spark):
    rows = [(t, lang) for lang in SYLLABLES for t in texts(lang, 60)]
    rows += [(None, "aa"), ("no language", None), ("", "dd")]
    return fit_languages(spark.createDataFrame(rows, "text string, lang string"))


def test_held_out_rows_and_edge_cases(spark, models):
    rows = [(t, lang) for lang in SYLLABLES for t in texts(lang, 30, seed=2)]
    odd = [None, "", "123 !? \n", "½ ²", "x" * 50, "kalomi", "kalomi", " ".join(texts("bb", 300, seed=3))]
    data = [(i, t, lang, 7) for i, (t, lang) in enumerate(rows + [(t, "?") for t in odd])]
    docs = spark.createDataFrame(data, "id long, text string, lang string, SCORE int")
    got = {r["id"]: r for r in identify(docs, models).collect()}
    assert len(got) == len(data)
    for i, (_, lang) in enumerate(rows):
        assert got[i]["lang_pred"] == lang and 0.9 < got[i]["score"] <= 1 and not got[i]["rejected"]
    odd = [got[len(rows) + k] for k in range(len(odd))]
    assert all((r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True) for r in odd[:4])
    assert odd[4]["rejected"]
    assert odd[5]["lang_pred"] == "aa" and odd[5]["score"] == odd[6]["score"]
    assert odd[7]["lang_pred"] == "bb" and not odd[7]["rejected"]
    assert identify(docs.limit(0), models).count() == 0


def test_without_training_rows(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    out = identify(spark.createDataFrame([("abc",)], "text string"), fit_languages(empty)).collect()
    assert [tuple(r) for r in out] == [("abc", "und", 0.0, None, True)]


def test_bounds_of_the_sample(spark):
    rows = [(t, lang) for lang in ("aa", "bb") for t in texts(lang, 300)] * 2
    labelled = spark.createDataFrame(rows, "text string, lang string")
    small = fit_languages(labelled, max_texts=40, max_grams=50)
    assert all(len(m.grams[-1][0]) <= 50 for m in small.models)
    probe = spark.createDataFrame([(t, lang) for lang in ("aa", "bb") for t in texts(lang, 10, 9)], "text string, lang string")
    assert all(r["lang"] == r["lang_pred"] for r in identify(probe, small).collect())


def test_mislabelled_texts_do_not_loosen_the_limit(spark):
    """Texts of a language left out of training are rejected, also with a few of them under other labels."""
    rows = [(t, lang) for lang in ("aa", "bb") for t in texts(lang, 300)]
    rows += [(t, lang) for lang in ("aa", "bb") for t in texts("cc", 12, seed=lang)]
    rows += [(t, "few") for t in texts("aa", 4, seed=7)]
    fitted = fit_languages(spark.createDataFrame(rows, "text string, lang string"))
    assert np.isfinite(fitted.limit).all()
    rng = random.Random(3)
    mixed = ["".join(rng.choice("kalomitune") for _ in range(5)) for _ in range(400)]
    foreign = [" ".join(mixed[i : i + 20]) for i in range(0, 400, 20)]
    assert all(r for *_, r in fitted.predict(foreign))
    own = [(t, lang) for lang in ("aa", "bb") for t in texts(lang, 30, 4)]
    got = list(fitted.predict([t for t, _ in own]))
    assert not any(r for *_, r in got)


def test_limits_by_median():
    """One held-back text far off, in a language of many, moves neither limit; few texts are pooled."""
    fitted = LanguageModels(["aa", "bb", "cc"], [None] * 3)
    rng = np.random.default_rng(1)
    own = [rng.normal(1.4, 0.02, 200), rng.normal(1.5, 0.02, 200), np.array([1.45, 3.4])]
    limits = []
    for outlier in (1.4, 3.4):
        own[0][0] = outlier
        values = np.full((402, 3), 4.0)
        truth = np.repeat([0, 1, 2], [200, 200, 2])
        values[np.arange(402), truth] = np.concatenate(own)
        given = iter(np.array_split(values, [100, 200, 300, 400]))
        fitted.cross_entropies = lambda some, given=given: next(given)
        fitted.calibrate(["abc"] * 402, [fitted.languages[j] for j in truth])
        limits.append((*fitted.limit[:2], *fitted.spread[:2]))
        assert np.isfinite(fitted.limit).all() and fitted.limit[2] < 3.4
    assert limits[0] == pytest.approx(limits[1], rel=0.02)
    assert all(x < 2 for x in limits[1][:2])


def test_characters_follow_a_distribution(models):
    """After any context the probabilities of all characters sum to one."""
    model = models.models[0]
    alphabet = sorted(set("".join(texts("aa", 60)) + " "))
    for context in ("kal", "   ", "o m", "xyz", "lox"):
        known = [np.full(len(alphabet), ord(c), np.uint64) for c in context]
        last = np.array([ord(c) for c in alphabet], np.uint64)
        seen = np.exp(model.log_probability([*known, last])).sum()
        # the rest is spread over characters that were not seen
        others = [np.array([ord(c)], np.uint64) for c in context] + [np.array([0x4E00], np.uint64)]
        unseen = math.exp(model.log_probability(others)[0])
        assert 0 < unseen and seen + (256 - len(alphabet)) * unseen == pytest.approx(1.0, abs=1e-6)


def test_kneser_ney_by_hand():
    """Order four from two n-grams, with discount 0.5 and an alphabet of ten."""
    grams = np.array([[ord(c) for c in g] for g in ("abcd", "abce")], dtype="<u4")
    model = fit_characters(grams, np.array([3, 1]), 10)
    columns = [np.array([ord(c)], np.uint64) for c in "abcd"]
    # lower orders: d and e each follow one distinct context
    lower = (1 - 0.5) / 2 + 0.5 * ((1 - 0.5) / 2 + 0.5 * ((1 - 0.5) / 2 + 0.5 * 0.1))
    assert math.exp(model.log_probability(columns)[0]) == pytest.approx((3 - 0.5) / 4 + (2 * 0.5 / 4) * lower)


def test_cache_does_not_change_scores(models, monkeypatch):
    some = [letters(t) for t in texts("aa", 40, 5) + texts("cc", 40, 5)]
    models.forget()
    once = models.cross_entropies(some)
    monkeypatch.setattr(language, "CACHED_GRAMS", 10)
    models.forget()
    again = np.concatenate([models.cross_entropies([t]) for t in some])
    assert np.allclose(once, again)
    assert LanguageModels([], []).languages == []
