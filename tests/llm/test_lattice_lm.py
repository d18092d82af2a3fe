import math
import random
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest

from tidewire.llm import lattice_lm
from tidewire.llm.lattice_lm import (
    expected_pieces, lattice_of, piece_scores, score_texts, urn_log_probabilities, word_log_probabilities,
)

PATH = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(text):
    if not text:
        yield []
    for n in range(1, len(text) + 1):
        for rest in segmentations(text[n:]):
            yield [text[:n], *rest]


@pytest.fixture(scope="module")
def small():
    pieces = ["▁", "▁a", "▁ab", "a", "b", "ab", "ba", "bab"] + [f"<0x{b:02X}>" for b in range(256)]
    return pieces, lattice_of(pieces, -np.arange(len(pieces), dtype=float))


def by_hand(pieces, lattice, word):
    """ln of the sum over all segmentations, and the expected count of each piece."""
    number = {p: i for i, p in enumerate(pieces)}
    total, counts = 0.0, np.zeros(len(pieces))
    for cut in segmentations("▁" + word):
        parts = [number.get(p) for p in cut]
        if any(n is None for n in parts):
            continue
        weight = math.exp(sum(lattice.log_p[n] for n in parts) + lattice.log_end)
        total += weight
        for n in parts:
            counts[n] += weight
    return math.log(total), counts / total


def test_marginals_equal_all_segmentations(small):
    pieces, lattice = small
    words = ["a", "b", "ab", "abab", "babab", "aabbab"]
    values = word_log_probabilities(lattice, words)
    for word, value in zip(words, values, strict=True):
        assert value == pytest.approx(by_hand(pieces, lattice, word)[0])
    counts, ends = expected_pieces(lattice, words)
    assert ends == len(words)
    assert np.allclose(counts, sum(by_hand(pieces, lattice, w)[1] for w in words))


def test_words_follow_a_distribution(small):
    """Over all words of up to eight letters the probabilities sum to a little less than one."""
    _, lattice = small
    words = [w for n in range(1, 9) for w in _words("ab", n)]
    total = np.exp(word_log_probabilities(lattice, words)).sum()
    assert 0.5 < total < 1


def _words(letters, n):
    return [""] if n == 0 else [w + c for w in _words(letters, n - 1) for c in letters]


def test_characters_without_a_piece_are_spelled_in_bytes(small):
    _, lattice = small
    values = word_log_probabilities(lattice, ["é", "aéb", "中" * 300, "x" * 3000])
    assert np.all(np.isfinite(values)) and values[1] < values[0] < 0


def test_urn_by_hand():
    log_p = np.log([0.2, 0.05, 0.001])
    got = urn_log_probabilities(np.array([0, 0, 1]), log_p, np.array([3, 1, 40]), 3)
    a = lattice_lm.CONCENTRATION
    first = math.lgamma(a) - math.lgamma(a + 4) + math.log(a * 0.05)
    first += math.lgamma(a * 0.2 + 3) - math.lgamma(a * 0.2)
    second = math.lgamma(a) - math.lgamma(a + 40) + math.lgamma(a * 0.001 + 40) - math.lgamma(a * 0.001)
    assert np.allclose(got, [first, second, 0.0])


def texts(seed=4, n=150):
    rng = random.Random(seed)
    parts = {"aa": ["the", "ing", "er", "on", "re"], "bb": ["sch", "ung", "ei", "ach", "en"]}
    rows = []
    for i in range(n):
        lang = rng.choice(["aa", "bb"])
        word = lambda: "".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3)))  # noqa: B023, E731
        rows.append((i, " ".join(word() for _ in range(rng.randint(0, 50))), lang))
    rows += [(900, None, "aa"), (901, "", None), (902, "É x\x00 \x0b ▁y", None), (903, "Ü" * 5000, "aa"), (904, "er " * 20_000, "bb")]
    return rows


@pytest.mark.parametrize("block", [16 << 20, 2000])
def test_counts_and_base_scores(spark, monkeypatch, block):
    monkeypatch.setattr(lattice_lm, "BLOCK_BYTES", block)
    rows = [(i, t, brute.crc(i) % 7 != 2, lang) for i, t, lang in texts()]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, train boolean, lang string, n0 int")
    got = {r["doc_id"]: r for r in score_texts(docs.repartition(3), PATH, class_column="lang").collect()}
    expected = brute.base_scores([r[:3] for r in rows])
    assert len(got) == len(rows)
    for i, (n, known, total, base) in expected.items():
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (n, known, total)
        assert got[i]["base_score"] == pytest.approx(base, rel=1e-9)
        assert math.isfinite(got[i]["score"]) and got[i]["score"] < 0
    held = [i for i, _, train, _ in rows if not train and i < 900]
    assert sum(got[i]["score"] for i in held) > sum(got[i]["base_score"] for i in held)


def test_repeated_rows_and_no_training(spark):
    docs = spark.createDataFrame([(1, "a b", False), (1, "a b", False), (2, None, None)], "doc_id long, text string, train boolean")
    got = sorted(map(tuple, score_texts(docs, PATH).collect()))
    assert [r[:4] for r in got] == [(1, 3, 0, 0), (1, 3, 0, 0), (2, 1, 0, 0)] and got[0] == got[1]
    assert got[2][4] == 0.0 and got[0][5] < got[2][5] <= 0
    assert score_texts(docs.limit(0), PATH).count() == 0


def scores_by_hand(rows, spelled):
    """{id: (score, lattice score)} word by word, for rows of (id, text, train, class)."""
    end = object()
    tokens = {i: [w.decode() for w in brute.words(t)] for i, t, _, _ in rows}
    groups = {None: [i for i, _, train, _ in rows if train]}
    for i, _, train, kind in rows:
        if train and kind is not None:
            groups.setdefault(kind, []).append(i)
    counts = {k: Counter(w for i in ids for w in tokens[i]) for k, ids in groups.items()}
    totals = {k: sum(c.values()) + len(groups[k]) for k, c in counts.items()}
    ones, twos = (sum(n == k for n in counts[None].values()) for k in (1, 2))
    d = ones / (ones + 2 * twos) if ones and twos else 0.5

    def p(word, kind):
        if word is end:
            own = max(len(groups[kind]) - d, 1e-9 if kind is None else 0.0) / totals[kind]
            return own if kind is None else own + d * len(counts[kind]) / totals[kind] * p(word, None)
        lower = math.exp(spelled[word]) if kind is None else p(word, None)
        taken = d * len(counts[kind]) / totals[kind] if counts[kind] else 1.0
        return max(counts[kind][word] - d, 0.0) / totals[kind] + taken * lower

    a = lattice_lm.CONCENTRATION
    unclassed = len(groups[None]) - sum(len(v) for k, v in groups.items() if k is not None)
    out = {}
    for i, words in tokens.items():
        total = 0.0
        for kind in groups:
            share = ((unclassed if kind is None else len(groups[kind])) + 1) / (len(groups[None]) + len(groups))
            seen, chance = Counter(), math.log(share)
            for k, w in enumerate([*words, end]):
                chance += math.log((a * p(w, kind) + seen[w]) / (a + k))
                seen[w] += 1
            total += math.exp(chance)
        stop = len(groups[None]) / totals[None]
        alone = sum(spelled[w] / math.log(10) + math.log10(1 - stop) for w in words) + math.log10(stop)
        out[i] = (math.log10(total), alone)
    return out


@pytest.mark.parametrize("classes", [1, 20])
def test_scores_by_hand(spark, classes):
    rng = random.Random(classes)
    rows = [
        (i, " ".join(rng.choice("ab ba abba Baba é ing er".split()) for _ in range(rng.randint(0, 12))), i % 5 != 0,
         rng.choice([None, *[f"class {k}" for k in range(classes)]]))
        for i in range(120)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean, kind string")
    got = score_texts(docs, PATH, class_column="kind", rounds=0).collect()
    lattice = lattice_of(*piece_scores(PATH))
    words = sorted({w.decode() for _, t, _, _ in rows for w in brute.words(t)})
    spelled = dict(zip(words, word_log_probabilities(lattice, words).tolist(), strict=True))
    expected = scores_by_hand(rows, spelled)
    for r in got:
        assert (r["score"], r["lattice_score"]) == pytest.approx(expected[r["doc_id"]], rel=1e-4)
