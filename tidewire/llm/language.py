"""Language identification by interpolated Kneser-Ney character models.

For each language a model of ``ORDER`` characters is kept as sorted arrays of 64-bit hashes, one pair per
order: the log probability of each n-gram seen and the log back-off weight of each context. A text gets the
language of lowest cross-entropy per character. It is rejected when even that is higher than what the
held-back part of the training rows shows for texts of its length.

The models are fitted on a bounded sample of the labelled rows: whole texts, each distinct text once, about
``max_texts`` per language chosen by their hash. Of these every fifth is held back to calibrate. Of the
n-grams of a language the ``max_grams`` most frequent are kept, with the back-off weights holding the rest
of the mass, so the size of the models has a bound.

Texts that are null or have no letter get ``und`` with score 0 and are rejected; so do all texts when there
is no training row. Texts of any length are read whole. Ties go to the first language by name. Rows are
independent, so repeated rows get equal results. An input column with the name of an output is replaced.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.flat import mixed, row_slices
from tidewire.llm.frames import appended, with_columns

ORDER = 4
UNDETERMINED = "und"
MAX_TEXTS = 2000
MAX_GRAMS = 200_000
HELD_BACK = 5
FEW = 20  # held-back texts below which a language takes the limits of all
CACHED_GRAMS = 1 << 20  # n-grams of which a worker keeps the scores
TEMPERATURES = (1, 2, 4, 8, 16, 32, 64)

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def letters(text: str | None) -> str:
    """Lower-case words with one space between; empty if there is no letter."""
    words = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return words if any(map(str.isalpha, words)) else ""


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts, each after ``ORDER - 1`` spaces and before one; where each begins;
    and which positions are predicted."""
    pad = " " * (ORDER - 1)
    flat = np.frombuffer("".join([f"{pad}{t} " for t in texts]).encode("utf-32-le"), "<u4")
    lengths = np.array([len(t) + ORDER for t in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    counted = np.ones(len(flat), bool)
    for k in range(ORDER - 1):
        counted[starts + k] = False
    return flat.astype(np.uint64), starts, counted


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of each row of code points."""
    total = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        total = mixed(total * _FACTOR + column + np.uint64(1))
    return total


@dataclass
class CharacterModel:
    """Sorted hashes with values; entry k is for n-grams, or contexts, of k + 1 characters."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    unseen: float

    def log_probability(self, columns: list[np.ndarray]) -> np.ndarray:
        """ln P(last | first three) of each row of code points."""
        value = np.full(len(columns[0]), self.unseen)
        for k in range(1, ORDER + 1):
            if k > 1:
                keys, weights = self.contexts[k - 2]
                found, at = _find(keys, _hash(columns[ORDER - k : ORDER - 1]))
                value = value + np.where(found, weights[at], 0.0)
            keys, logs = self.grams[k - 1]
            found, at = _find(keys, _hash(columns[ORDER - k :]))
            value = np.where(found, logs[at], value)
        return value


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


def _grouped(columns: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their weights."""
    rows, inverse = np.unique(columns, axis=0, return_inverse=True)
    return rows, np.bincount(inverse.reshape(-1), weights, len(rows))


def fit_characters(rows: np.ndarray, counts: np.ndarray, alphabet: int) -> CharacterModel:
    """The model of n-grams (a row of code points each) with their counts."""
    tables = {ORDER: (rows, counts.astype(float))}
    for k in range(ORDER - 1, 0, -1):  # lower orders count the distinct characters before
        tables[k] = _grouped(tables[k + 1][0][:, 1:], np.ones(len(tables[k + 1][0])))
    grams, contexts = [], []
    before: tuple[np.ndarray, np.ndarray] | None = None
    floor = 1.0 / alphabet
    for k in range(1, ORDER + 1):
        rows, counts = tables[k]
        ones, twos = np.count_nonzero(counts == 1), np.count_nonzero(counts == 2)
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        kept = np.maximum(counts - discount, 0.0)
        if k == 1:
            left = discount * len(rows) / counts.sum()
            probability = kept / counts.sum() + left * floor
            unseen = float(np.log(left * floor))
        else:
            heads, head = np.unique(rows[:, :-1], axis=0, return_inverse=True)
            head = head.reshape(-1)
            total = np.bincount(head, counts, len(heads))
            left = 1.0 - np.bincount(head, kept, len(heads)) / total
            tails = _hash([rows[:, j].astype(np.uint64) for j in range(1, k)])
            found, at = _find(before[0], tails)
            lower = np.where(found, np.exp(before[1][at]), floor)
            probability = kept / total[head] + left[head] * lower
            keys = _hash([heads[:, j].astype(np.uint64) for j in range(k - 1)])
            order = np.argsort(keys)
            contexts.append((keys[order], np.log(np.maximum(left[order], 1e-12))))
        keys = _hash([rows[:, j].astype(np.uint64) for j in range(k)])
        order = np.argsort(keys)
        before = keys[order], np.log(probability[order])
        grams.append(before)
    return CharacterModel(grams, contexts, unseen)


class LanguageModels:
    """The models of all languages, with the calibration of scores and of the rejection."""

    def __init__(self, languages: list[str], models: list[CharacterModel]) -> None:
        self.languages, self.models = languages, models
        self.temperature = 16.0
        self.limit = np.full(len(languages), np.inf)
        self.spread = np.zeros(len(languages))
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.values = np.zeros((0, len(self.models)))

    def _learn(self, columns: list[np.ndarray], keys: np.ndarray) -> None:
        """Keep the scores of the n-grams that are not kept yet."""
        distinct, first = np.unique(keys, return_index=True)
        if len(self.keys):
            fresh = ~_find(self.keys, distinct)[0]
            distinct, first = distinct[fresh], first[fresh]
        if len(self.keys) + len(distinct) > CACHED_GRAMS and len(self.keys):
            self.forget()
            return self._learn(columns, keys)
        if len(distinct):
            columns = [c[first] for c in columns]
            scores = np.stack([m.log_probability(columns) for m in self.models], axis=1)
            keys = np.concatenate([self.keys, distinct])
            order = np.argsort(keys, kind="stable")
            self.keys = keys[order]
            self.values = np.concatenate([self.values, scores])[order]
        return None

    def cross_entropies(self, texts: list[str]) -> np.ndarray:
        """Per text (as ``letters`` gives it) and language, nats per predicted character."""
        flat, starts, counted = _codes(texts)
        columns = [flat[k : len(flat) - ORDER + 1 + k] for k in range(ORDER)]
        keys = _hash(columns)
        use = counted[ORDER - 1 :]
        self._learn(columns, keys)
        at = np.searchsorted(self.keys, keys)
        lengths = np.diff(np.append(starts, len(flat))) - (ORDER - 1)
        out = np.empty((len(texts), len(self.models)))
        for j in range(len(self.models)):
            value = np.where(use, self.values[at, j], 0.0)
            # the n-gram that begins at a text's start is the first that ends inside it
            out[:, j] = -np.add.reduceat(value, starts) / lengths
        return out

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float, float | None, bool]]:
        """Per text the language, the score, its cross-entropy and whether it is rejected."""
        cleaned = [letters(t) for t in texts]
        some = [t for t in cleaned if t]
        if not self.models or not some:
            yield from ((UNDETERMINED, 0.0, None, True) for _ in texts)
            return
        entropies = self.cross_entropies(some)
        best = np.argmin(entropies, axis=1)
        lowest = entropies[np.arange(len(some)), best]
        gaps = np.exp(-self.temperature * (entropies - lowest[:, None]))
        score = 1.0 / gaps.sum(axis=1)
        size = np.array([len(t) + 1 for t in some])
        rejected = lowest > self.limit[best] + self.spread[best] / np.sqrt(size)
        rows = zip(best.tolist(), score.tolist(), lowest.tolist(), rejected.tolist(), strict=True)
        for text in cleaned:
            if text:
                b, s, e, r = next(rows)
                yield self.languages[b], s, e, r
            else:
                yield UNDETERMINED, 0.0, None, True

    def calibrate(self, texts: list[str], languages: list[str]) -> None:
        """Fit the temperature of the scores and the limits of the rejection.

        The limit is far above what the held-back texts show: six standard deviations and a fifth
        of the median, and more for short texts. The deviations are formed from medians, so a
        mislabelled or foreign text among many does not move them. Languages with fewer than ``FEW``
        held-back texts take the deviations of all, and no lower centre than that of all.
        """
        pairs = [(letters(t), x) for t, x in zip(texts, languages, strict=True)]
        pairs = [(t, self.languages.index(x)) for t, x in pairs if t and x in self.languages]
        if not pairs:
            return
        entropies = np.concatenate(
            [self.cross_entropies([t for t, _ in pairs[i : i + 100]]) for i in range(0, len(pairs), 100)]
        )
        truth = np.array([x for _, x in pairs])
        size = np.array([len(t) + 1 for t, _ in pairs])

        def loss(temperature: float) -> float:
            logits = -temperature * (entropies - entropies.min(axis=1, keepdims=True))
            chosen = logits[np.arange(len(truth)), truth]
            return float(np.mean(np.log(np.exp(logits).sum(axis=1)) - chosen))

        self.temperature = float(min(TEMPERATURES, key=loss))
        own = entropies[np.arange(len(truth)), truth]
        medians = np.full(len(self.languages), -np.inf)
        for j in set(truth.tolist()):
            medians[j] = np.median(own[truth == j])
        # what all languages show, for those with few held-back texts
        middle, apart = float(np.median(own)), own - medians[truth]
        pooled = _deviations(apart, size)
        for j in range(len(self.languages)):
            mine = truth == j
            enough = np.count_nonzero(mine) >= FEW
            center = float(medians[j]) if enough else max(float(medians[j]), middle)
            deviation, per_character = _deviations(apart[mine], size[mine]) if enough else pooled
            self.limit[j] = 1.2 * center + 6 * deviation
            self.spread[j] = 6 * per_character  # the deviation of one character's share


def _deviations(apart: np.ndarray, size: np.ndarray) -> tuple[float, float]:
    """Standard deviations of the differences and of one character's share, from the medians of their
    absolute values, which single texts do not move."""
    return 1.4826 * float(np.median(np.abs(apart))), 1.4826 * float(np.median(np.abs(apart) * np.sqrt(size)))


def fit_languages(
    labelled: DataFrame, text_column: str = "text", lang_column: str = "lang", *,
    max_texts: int = MAX_TEXTS, max_grams: int = MAX_GRAMS,
) -> LanguageModels:
    """Models of every language in ``labelled``; rows without text or language are left out."""
    rows = labelled.select(F.col(text_column).alias("text"), F.col(lang_column).alias("lang"))
    rows = rows.filter("text is not null and lang is not null")
    rows = rows.withColumn("hash", F.xxhash64("text"))
    distinct = F.approx_count_distinct("hash", 0.02).alias("n")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(distinct).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModels([], [])
    share = F.create_map(
        *itertools.chain.from_iterable(
            (F.lit(x), F.lit(int(min(1.0, max_texts / max(1, sizes[x])) * (1 << 30)))) for x in languages
        )
    )
    # each distinct text once; bits of the hash choose
    chosen = rows.filter(F.pmod("hash", F.lit(1 << 30)) <= share[F.col("lang")])
    sample = chosen.groupBy("lang", "hash").agg(F.min("text").alias("text"))
    back = F.pmod(F.shiftright("hash", 32), F.lit(HELD_BACK)) == 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for begin, end in row_slices(batch.column(1)):
                texts = batch.column(1).slice(begin, end - begin).to_pylist()
                for lang in sorted(set(langs[begin:end])):
                    mine = [letters(t) for t, x in zip(texts, langs[begin:end], strict=True) if x == lang]
                    mine = [t for t in mine if t]
                    if not mine:
                        continue
                    flat, _, counted = _codes(mine)
                    use = counted[ORDER - 1 :]
                    columns = [flat[k : len(flat) - ORDER + 1 + k][use] for k in range(ORDER)]
                    _, first, n = np.unique(_hash(columns), return_index=True, return_counts=True)
                    grams = np.stack([c[first] for c in columns], axis=1).astype("<u4")
                    text = grams.tobytes().decode("utf-32-le")
                    cut = [text[i : i + ORDER] for i in range(0, len(text), ORDER)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(cut)), pa.array(cut), pa.array(n)],
                        names=["lang", "gram", "n"],
                    )

    found = sample.filter(~back).select("lang", "text")
    found = found.mapInArrow(count, "lang string, gram string, n long")
    found = found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_count = F.row_number().over(_most_frequent())
    table = found.withColumn("rank", by_count).filter(F.col("rank") <= max_grams).toPandas()
    alphabet = max(256, 2 * len(set("".join(table["gram"])))) if len(table) else 256
    models, known = [], []
    for lang in languages:
        mine = table[table["lang"] == lang]
        if not len(mine):
            continue
        text = "".join(mine["gram"])
        grams = np.frombuffer(text.encode("utf-32-le"), "<u4").reshape(-1, ORDER)
        models.append(fit_characters(grams, mine["n"].to_numpy(), alphabet))
        known.append(lang)
    fitted = LanguageModels(known, models)
    held = sample.filter(back).select("lang", "text").toPandas()  # bounded as the sample
    fitted.calibrate(held["text"].tolist(), held["lang"].tolist())
    fitted.forget()
    return fitted


def _most_frequent():
    from pyspark.sql import Window

    return Window.partitionBy("lang").orderBy(F.desc("n"), "gram")


FIELDS = [
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("cross_entropy", T.DoubleType()),
    T.StructField("rejected", T.BooleanType()),
]


def identify(docs: DataFrame, models: LanguageModels) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1), ``cross_entropy`` and ``rejected``."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            for begin, end in row_slices(texts):
                rows = list(known.predict(texts.slice(begin, end - begin).to_pylist()))
                yield appended(batch.slice(begin, end - begin), FIELDS, zip(*rows, strict=True))

    return with_columns(docs, FIELDS, run)
