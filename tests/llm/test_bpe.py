import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewire.llm.bpe import Encoder, Vocabulary, encode_decode

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)


def test_encoder_equals_the_library(library):
    rng = random.Random(4)
    planes = [(0, 0x2FF), (0x300, 0xD7FF), (0xE000, 0x1FFFF)]
    texts = ["", " \n", "<|endoftext|>", "a<|endoftext|>b<|start", "İΣΑΣ ﬁ Å \x85​½²", "don't I'LL 2024 c++"]
    for _ in range(400):
        size = rng.randint(0, 30)
        texts.append("".join(chr(rng.randint(*rng.choice(planes))) for _ in range(size)))
        texts.append("".join(rng.choice("aAbB'stre!? éÉ\t09ΣσİIı<|endoftext|>") for _ in range(size)))
        texts.append("".join(rng.choice("abeinortsh") for _ in range(20 * size)))
    texts.append("aaaa" * 5000 + " " + "word " * 20_000)
    for got, text in zip(Encoder(Vocabulary(PATH)).encode(texts), texts, strict=True):
        assert got == expected(library, text), text[:60]


def test_words_are_forgotten_when_there_are_too_many(library, monkeypatch):
    monkeypatch.setattr("tidewire.llm.bpe.KEPT_WORDS", 20)
    monkeypatch.setattr("tidewire.llm.bpe.PENDING_WORDS", 3)
    encoder = Encoder(Vocabulary(PATH))
    for round in range(3):
        texts = [f"alpha{i} beta gamma{round}x words" for i in range(5)]
        assert list(encoder.encode(texts)) == [expected(library, t) for t in texts]


def test_rows(spark, library):
    texts = [None, "", "Hello world", "Hello world", "x " * 30_000]
    rows = [(i, t, "input") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS string")
    out = encode_decode(docs, PATH, ("n_tokens", "token_ids", "decoded", "ids_sha256", "decoded_sha256"))
    got = {r["doc_id"]: r for r in out.collect()}
    for i, text in enumerate(texts):
        n, ids, decoded = expected(library, text)
        assert (got[i]["n_tokens"], got[i]["token_ids"], got[i]["decoded"]) == (n, ids, decoded)
        assert got[i]["ids_sha256"] == hashlib.sha256(ids.encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert encode_decode(docs.limit(0), PATH).count() == 0
