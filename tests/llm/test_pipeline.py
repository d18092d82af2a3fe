"""Every stage of the corpus pipeline against a plain form of it, on the rows it was given."""

import brute
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tidewire.settings import materialize

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def given(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    extra = [
        (9001, None, "en", "s", 0), (9002, "", None, "s", 0), (9003, "#!? 123 456", "de", "s", 5),
        (None, docs.first()["text"], "en", "s", 1), (None, None, None, None, None),
    ]
    rows = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    return materialize(rows.unionByName(docs.filter("doc_id = 3")), "pipeline-test")


def stage(spark, name, docs):
    return materialize(dict(corpus_pipeline.STAGES)[name](spark, docs, SF_DIR), "pipeline-test")


def test_stages(spark, given):
    columns = given.columns
    docs = given
    known = stage(spark, "language", docs)
    assert known.columns == columns
    lost = {r["doc_id"] for r in given.collect()} - {r["doc_id"] for r in known.collect()}
    assert lost >= {9001, 9002, 9003} and len(lost) <= 8

    clean = stage(spark, "toxicity", known)
    assert clean.columns == columns and 0.7 * known.count() < clean.count() < known.count()

    single = stage(spark, "near_copies", clean)
    rows = clean.collect()
    component = brute.jaccard_components(list(enumerate(r["text"] for r in rows)))
    groups = {}
    for k, (size, root) in component.items():
        groups.setdefault((root if size else k), []).append(rows[k])
    first = [min(g, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)) for g in groups.values()]
    got = single.collect()
    assert single.columns == columns
    assert sorted(got, key=str) == sorted(first, key=str)

    pure = stage(spark, "decontamination", single)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    hits = brute.contamination([(k, r["text"]) for k, r in enumerate(got)], items)
    expected = sorted((r for k, r in enumerate(got) if not hits[k][1]), key=str)
    assert pure.columns == columns and sorted(pure.collect(), key=str) == expected

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = stage(spark, "tokens", pure).collect()
    texts = {r["doc_id"]: r["text"] for r in expected}
    assert len(tokens) == len(expected)
    for r in tokens:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["token_ids"] == " ".join(map(str, ids))


def test_empty_documents(spark, given):
    for name, run in corpus_pipeline.STAGES:
        out = run(spark, given.limit(0), SF_DIR)
        assert out.count() == 0, name


def test_columns_that_clash(spark, given):
    docs = given.selectExpr(
        "*", "1 AS score", "'x' AS lang_pred", "2 AS row", "3 AS n_words", "4 AS __row2", "5 AS __row", "6 AS __mark",
        "7 AS __features", "8 AS `a.b`", "9 AS mark", "10 AS id",
    )
    for name, run in corpus_pipeline.STAGES[:-1]:
        out = run(spark, docs, SF_DIR)
        assert out.columns == docs.columns, name
        assert all(r[-6:] == (5, 6, 7, 8, 9, 10) for r in map(tuple, out.collect())), name
    assert run(spark, docs, SF_DIR).count() > 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)
    assert 0 < out.count() < 200


def test_copies_by_text(spark):
    """Rows of one id with different texts are different documents; of equal texts one row stays."""
    a, b, c = ("one two three four five six", "seven eight nine ten eleven twelve", "other words that stand for themselves here")
    rows = [(5, a), (5, b), (7, a), (7, a), (None, c), (None, c), (None, c), (None, a), (1, None), (1, None), (2, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_copies(spark, docs, SF_DIR).collect()
    expected = [(5, a), (5, b), (None, c), (1, None), (1, None), (2, " ")]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
