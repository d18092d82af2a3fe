"""A training corpus from raw documents: five stages, each written and read again by the next.

Every stage works on all rows its predecessor kept and drops whole rows: texts of no known language, toxic
texts, all but one of each group of near copies, texts that hold benchmark passages. The last turns the rest
into tokens.

In every stage rows are judged by their text, each for itself, so repeated rows, repeated ids and null ids
need no care (the second and the third stage say what ids mean to them). A null text counts as empty. Empty
tables give empty tables. Columns of any name are kept as they are, those that clash with an operator's own
included, and names with dots too; the last stage returns its own columns only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm.bpe import encode_decode
from tidewire.llm.decontamination import contamination
from tidewire.llm.frames import crc32_of_id
from tidewire.llm.jaccard import jaccard_components
from tidewire.llm.language import fit_languages, identify
from tidewire.llm.toxicity import fit_toxicity, score_toxicity
from tidewire.settings import materialize

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _carried(docs: DataFrame) -> DataFrame:
    """The whole row beside its text, so that no operator's column can clash with one of the row."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the models know; the others are rejected.

    Null and empty texts and texts without letters have no language and go, of very long texts all letters
    count. The models learn from rows with a text and a ``lang``; without any, all rows go.
    """
    models = fit_languages(docs.filter(crc32_of_id() % 5 != 0))
    return identify(_carried(docs), models).filter("not rejected").select("row.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic.

    A null or empty text gets the score of one without any features. Labels of null or unknown ids teach
    nothing; a label of a repeated id belongs to all its texts. Without labels of both kinds nothing goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(crc32_of_id() % 3 != 1)
    model = fit_toxicity(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    return score_toxicity(_carried(docs), model).filter("predicted = 0").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, null ids last.

    Groups are formed by text, whatever the ids: of repeated rows one stays, rows of one id with different
    texts are different documents, and rows without an id are copies like others. Of rows with the same
    id and text any one stays. Texts without words belong to no group and all stay.
    """
    named = F.struct(F.col("row.doc_id").isNull().alias("nameless"), F.col("row.doc_id").alias("id"), F.xxhash64("text").alias("mark"))
    rows = _carried(docs).withColumn("id", named)
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    some = rows.filter(worded)
    found = jaccard_components(some.select("id", "text"), id_column="id")
    kept = found.filter("id = component_id").select("id").distinct()
    single = some.join(materialize(kept, "kept-copies").hint("shuffle_hash"), "id", "left_semi")
    single = single.select("row", "id").dropDuplicates(["id"]).select("row.*")
    return single.unionByName(rows.filter(~worded).select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage. Decided by the text alone, so by a hash of it.

    Null and empty texts and texts without words hold no passage and stay; items without an id or words
    are no passages.
    """
    marked = _carried(docs).withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination(marked.select("mark", "text"), items, id_column="mark")
    bad = materialize(found.filter("contaminated").select(F.col("doc_id").alias("mark")).distinct(), "contaminated")
    return marked.join(bad, "mark", "left_anti").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each document, with digests of the ids and of the text they decode to.

    One row for each row, null ids and repeated rows included; a null or empty text has no tokens.
    """
    outputs = ("n_tokens", "token_ids", "ids_sha256", "decoded_sha256")
    return encode_decode(docs.select("doc_id", "text"), VOCABULARY, outputs).drop("text")


STAGES = [
    ("language", language),
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("tokens", tokens),
]
# Trained models and hashing of shingles have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
