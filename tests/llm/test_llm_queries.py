"""The registered queries on the smallest tables: against SQL where there is one, else brute force."""

import hashlib
import itertools

import brute
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import oracle
from tidewire.llm import queries as llm

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()


def run(spark, name):
    return entry.queries()[name](spark, SF_DIR)


@pytest.mark.parametrize("name", list(llm.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert oracle.difference(run(spark, name), con, entry.oracle_sql()[name]) is None


def test_every_operator_has_a_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in llm.QUERIES)
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()


def test_op1(spark, documents):
    got = {r["doc_id"]: r for r in run(spark, "op1_toxicity").collect()}
    assert set(got) == {r["doc_id"] for r in documents} and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (brute.crc(i) % 3 == 1) for i, r in got.items())
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in got.values())


def test_op2(spark, documents):
    got = {r["doc_id"]: r for r in run(spark, "op2_language").collect()}
    assert len(got) == len(documents)
    held = [r for r in documents if brute.crc(r["doc_id"]) % 5 == 0 and r["lang"] is not None]
    assert all(got[r["doc_id"]]["held_out"] for r in held)
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.9


def test_op3(spark, documents):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in run(spark, "op3_bpe").collect()}
    assert len(got) == len(documents)
    for r in documents:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        texts = " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
        row = got[r["doc_id"]]
        assert [row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]] == [len(ids), *digests]


def test_op4(spark, documents):
    got = run(spark, "op4_sharding").collect()
    size = {r["doc_id"]: len((r["text"] or "").encode()) + 1 for r in documents}
    assert {r["doc_id"]: r["size"] for r in got} == size and len(got) == len(documents)
    load = [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]
    assert max(load) <= 1.1 * sum(load) / 8


def test_op6(spark, documents):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, "op6_jaccard_join").collect()}
    assert got == brute.jaccard_components([(r["doc_id"], r["text"]) for r in documents])


def test_op8(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    links = []
    for x, y in itertools.combinations([r for r in rows if r["label"] is not None], 2):
        if x["label"] == y["label"]:
            a, b = np.array(x["embedding"], float), np.array(y["embedding"], float)
            if a @ b >= 0.93 * np.linalg.norm(a) * np.linalg.norm(b):
                links.append((x["vec_id"], y["vec_id"]))
    component = brute.smallest_reachable([r["vec_id"] for r in rows], links)
    got = {r["vec_id"]: tuple(r)[1:] for r in run(spark, "op8_lattice_dedup").collect()}
    for i, root in component.items():
        assert got[i] == (sum(i in k for k in links), root, i == root)


def test_op9(spark, documents):
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()
    got = {r["doc_id"]: r for r in run(spark, "op9_decontamination").collect()}
    expected = brute.contamination(
        [(r["doc_id"], r["text"]) for r in documents], [(r["item_id"], r["text"]) for r in items]
    )
    for i, (n, hit, found) in expected.items():
        digest = hashlib.sha256(",".join(found).encode()).hexdigest()
        row = got[i]
        assert (row["n_words"], row["n_hit"], row["n_items"], row["items_sha256"]) == (n, hit, len(found), digest)
        assert row["contaminated"] == (hit > 0)


def test_op10(spark, documents):
    got = {r["doc_id"]: r for r in run(spark, "op10_lattice_lm").collect()}
    rows = [(r["doc_id"], r["text"], brute.crc(r["doc_id"]) % 7 != 2) for r in documents]
    for i, (n, known, total, base) in brute.base_scores(rows).items():
        row = got[i]
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (n, known, total)
        assert row["base_score"] == pytest.approx(base) and row["score"] <= 0
        assert row["held_out"] == (brute.crc(i) % 7 == 2)


def test_op12(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    expected = brute.whitened([(r["vec_id"], r["embedding"]) for r in rows])
    got = {(r["vec_id"], r["component"]): r for r in run(spark, "op12_whitening").collect()}
    brute.compare_whitened(got, expected)
