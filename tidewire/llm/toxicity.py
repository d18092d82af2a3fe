"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities and weights of lexicon words, how close second-person words stand to them,
the densest stretch, and the rates of capitals, shouting, punctuation, repeated letters and obfuscated
words. The lexicon is learned from labelled rows: words, and beginnings of words, that many toxic and hardly
any other texts have. Trees are fitted on one part of the rows and calibrated on another, by Spark's own
estimators.

Labelled rows are sampled: at most about ``max_rows`` of each label, whole texts; texts with the same
smallest shingle (copies, mostly) count once and are chosen by a hash of it, so that a text with many copies
does not become the lexicon. Each stands for as many distinct texts of its label as the sample leaves out,
in the trees and in the calibration, so a score means the same however many rows there are. Scoring reads
every text whole.

Null and empty texts are scored like any other (all features 0). Rows whose label is null are left out; of
several labels of an id the highest counts. Without both labels in the sample every score is the share of
toxic rows (0 without any). Repeated rows get equal scores. An input column with the name of an output is
replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.flat import row_slices, sets_of, signed
from tidewire.llm.frames import appended, with_columns
from tidewire.settings import materialize

MAX_ROWS = 6000  # sampled rows of each label
MAX_ENTRIES = 2000  # of the lexicon
THRESHOLD = 0.7
LEAST_ODDS = 3.0  # ln of how much more often toxic texts have an entry of the lexicon
LEAST_TEXTS = 3  # toxic texts with an entry
LEAST_SIGNIFICANCE = 10.8  # chance would give it to one entry in a thousand
STEMS = (4, 5, 6, 7, 8)  # lengths of word beginnings
CALIBRATION = 4  # every fourth row calibrates
WINDOW = 20  # words of a stretch

# Second-person words of the languages at hand.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer sie ihnen tu te toi ton ta tes "
    "vous votre vos tú ti tuyo tuya usted ustedes vosotros os".split()
)
# Signs that stand for letters.
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")

_WORD = re.compile(r"[^\W\d_]+")
_INNER_SIGN = re.compile(r"(?<=[^\W\d_])[\d@$!*._\-]+(?=[^\W\d_])")
_NOT_LETTER = re.compile(r"[\W\d_]+")
_REPEATED = re.compile(r"([^\W\d_])\1\1")
_CAPITAL = re.compile("[A-ZÀ-ÖØ-Þ]")
_SHOUTED = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")

FEATURES = (
    "lexicon_density", "lexicon_hits", "distinct_hits", "lexicon_weight", "heaviest_entry", "densest_stretch",
    "second_person", "second_person_proximity", "obfuscated_density", "obfuscated_hits", "capitals",
    "shouting", "punctuation", "repeated_letters", "words",
)


def entries_of(word: str) -> Iterator[str]:
    """The lexicon entries that fit a word: itself and its beginnings."""
    yield word
    for n in STEMS:
        if len(word) > n:
            yield word[:n] + "*"


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    """The values of ``FEATURES`` for a text."""
    text = text or ""
    lower = text.lower()
    words = _WORD.findall(lower)
    distinct = set(words)
    weights = {w: max(lexicon.get(e, 0.0) for e in entries_of(w)) for w in distinct}
    weights = {w: x for w, x in weights.items() if x}
    hits = [(i, weights[w]) for i, w in enumerate(words) if w in weights] if weights else []
    persons = distinct & SECOND_PERSON
    you = [i for i, w in enumerate(words) if w in persons] if persons else []
    n = max(1, len(words))
    near, dense = 0.0, 0
    if hits:
        places = np.array([i for i, _ in hits])
        dense = int(np.max(np.searchsorted(places, places + WINDOW) - np.arange(len(places))))
        if you:
            others = np.array(you)
            at = np.searchsorted(others, places)
            after = others[np.minimum(at, len(others) - 1)]
            before = others[np.maximum(at - 1, 0)]
            apart = np.minimum(np.abs(after - places), np.abs(places - before))
            near = float(np.exp(-apart / 5.0).max())
    hidden, hidden_hits = 0, 0
    if _INNER_SIGN.search(lower):
        for token in lower.split():
            if _INNER_SIGN.search(token):
                hidden += 1
                plain = _NOT_LETTER.sub("", token.translate(LOOKALIKES))
                hidden_hits += any(e in lexicon for e in entries_of(plain))
    chars = max(1, len(text))
    capitals = len(_CAPITAL.findall(text))
    total = sum(w for _, w in hits)
    return [
        len(hits) / n, float(np.log1p(len(hits))), float(np.log1p(len(weights))), total / n, max((w for _, w in hits), default=0.0),
        float(dense), len(you) / n, near, hidden / n, float(hidden_hits), capitals / chars,
        len(_SHOUTED.findall(text)) / n, (text.count("!") + text.count("?")) / chars,
        len(_REPEATED.findall(lower)) / n, float(np.log1p(len(words))),
    ]


@dataclass
class ToxicityModel:
    """The lexicon, the trees and the calibration; without trees, one score for all."""

    lexicon: dict[str, float] = field(default_factory=dict)
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = None
    constant: float = 0.0


def _marked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``__mark``, the smallest shingle of the text; null texts count as empty."""
    fields = [T.StructField("__mark", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).fill_null("")
            lowest = [int(signed(s[:1])[0]) if len(s) else 0 for _, s in sets_of(texts)]
            yield appended(batch, fields, [lowest])

    return with_columns(rows, fields, run)


def _sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> tuple[DataFrame, dict[float, int]]:
    """``label``, ``text`` and ``mark`` of a bounded sample of the distinct labelled texts, and how many
    there are of each label."""
    marks = labels.filter("doc_id is not null and toxic is not null")
    marks = marks.groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
    here = docs.select("doc_id", "text")
    # marks first: the join moves an id and a mark of each document, whatever the length of the texts
    found = _marked(here.filter("doc_id is not null")).select("doc_id", F.col("__mark").alias("mark"))
    found = found.join(marks, "doc_id")
    groups = found.groupBy("label", "mark").agg(F.min("doc_id").alias("doc_id"))
    groups = materialize(groups, "toxicity-marks")
    sizes = {r["label"]: r["count"] for r in groups.groupBy("label").count().collect()}
    limit = F.lit(0)
    for label, n in sizes.items():
        part = int(min(1.0, max_rows / n) * (1 << 30))
        limit = F.when(F.col("label") == label, part).otherwise(limit)
    # as many rows as ``max_rows`` allows, so it may be sent to all tasks
    chosen = F.broadcast(groups.filter(F.pmod(F.xxhash64("mark"), F.lit(1 << 30)) <= limit))
    # of several texts of an id only the one that the mark is from
    texts = _marked(here.join(chosen, "doc_id")).filter("mark = __mark")
    texts = texts.groupBy("label", "mark").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return texts, sizes


def _lexicon(sample: DataFrame, max_entries: int) -> dict[str, float]:
    """Entries that toxic texts have much more often than others, with the log odds per word.

    An entry stands in at least ``LEAST_TEXTS`` toxic texts, and its counts are too uneven for chance: twice
    their log likelihood ratio is ``LEAST_SIGNIFICANCE`` or more. So a rare sure word is learned from the same
    few texts however many there are.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {"": [0, 0, 0]}
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = Counter(_WORD.findall(text.as_py().lower()))
                entries: Counter[str] = Counter()
                for word, n in words.items():
                    for entry in entries_of(word):
                        entries[entry] += n
                entries[""] = sum(words.values())
                for entry, n in entries.items():
                    row = counts.setdefault(entry, [0, 0, 0])
                    row[int(label)] += n
                    row[2] += int(label)
            columns = zip(*counts.values(), strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts)), *[pa.array(c, pa.int64()) for c in columns]],
                names=["entry", "other", "toxic", "texts"],
            )

    table = sample.select("label", "text").mapInArrow(found, "entry string, other long, toxic long, texts long")
    names = ("other", "toxic", "texts")
    table = materialize(table.groupBy("entry").agg(*[F.sum(n).alias(n) for n in names]), "toxicity-entries")
    total = table.filter("entry = ''").first()
    share = total["toxic"] / max(1, total["toxic"] + total["other"])
    # a quarter of an occurrence more, dealt out as words are, so that few occurrences have the same odds at
    # every size of the two samples
    odds = F.log((F.col("toxic") + share / 4) / max(1, total["toxic"]))
    odds = odds - F.log((F.col("other") + (1 - share) / 4) / max(1, total["other"]))
    n = F.col("toxic") + F.col("other")

    def surprise(count, expected):
        return F.when(count > 0, count * F.log(count / expected)).otherwise(0.0)

    ratio = surprise(F.col("toxic"), n * share) + surprise(F.col("other"), n * (1 - share))
    sure = (F.col("texts") >= LEAST_TEXTS) & (2 * ratio >= LEAST_SIGNIFICANCE)
    best = table.withColumn("odds", odds).filter(sure & (F.col("odds") >= LEAST_ODDS))
    rows = best.orderBy(F.desc(F.col("odds") * F.sqrt("texts")), "entry").limit(max_entries)
    return {r["entry"]: r["odds"] for r in rows.collect()}


def _with_features(rows: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)
    fields = [T.StructField("__features", T.ArrayType(T.DoubleType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            for begin, end in row_slices(texts):
                values = [features(t.as_py(), known) for t in texts.slice(begin, end - begin)]
                yield appended(batch.slice(begin, end - begin), fields, [values])

    return with_columns(rows, fields, run)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, max_entries: int = MAX_ENTRIES
) -> ToxicityModel:
    """A model from ``docs`` (``doc_id``, ``text``) and ``labels`` (``doc_id``, ``toxic`` 0 or 1)."""
    sample, whole = _sample(docs, labels, max_rows)
    sample = materialize(sample, "toxicity-sample")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return ToxicityModel(constant=1.0 if 1.0 in sizes else 0.0)
    lexicon = _lexicon(sample, max_entries)
    rows = _with_features(sample.select("label", "text", "mark"), lexicon)
    rows = materialize(
        rows.select("label", (F.pmod(F.xxhash64("mark"), F.lit(CALIBRATION)) == 0).alias("held"), "__features"),
        "toxicity-features",
    )
    toxic, clean = (whole[label] / sizes[label] for label in (1.0, 0.0))
    weight = F.when(F.col("label") == 1.0, toxic).otherwise(clean).alias("weight")
    vectors = rows.select("label", "held", weight, array_to_vector("__features").alias("features"))
    fit, held = vectors.filter("not held"), vectors.filter("held")
    if fit.select("label").distinct().count() < 2:
        fit = vectors
    trees = GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.3, seed=1, maxBins=64, weightCol="weight")
    trees = trees.fit(fit.coalesce(4))
    raw = trees.transform(held)
    raw = raw.select("label", "weight", vector_to_array("probability")[1].alias("raw"))
    if held.select("label").distinct().count() < 2:
        return ToxicityModel(lexicon, trees)
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight").fit(raw)
    return ToxicityModel(lexicon, trees, calibration)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on)."""
    new = ("score", "predicted")
    kept = docs.select([F.col(f"`{c}`") for c in docs.columns if c.lower() not in new])
    if model.trees is None:
        scored = kept.withColumn("score", F.lit(model.constant))
    else:
        # the whole row beside its text, so that no column can clash with one of the row
        row = F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row")
        rows = _with_features(kept.select(row, "text"), model.lexicon)
        vectors = rows.select("row", array_to_vector("__features").alias("features"))
        raw = model.trees.transform(vectors)
        raw = raw.select("row", vector_to_array("probability")[1].alias("raw"))
        score = F.col("raw")
        if model.calibration is not None:
            raw = model.calibration.setPredictionCol("calibrated").transform(raw)
            score = F.col("calibrated")
        scored = raw.select("row.*", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
