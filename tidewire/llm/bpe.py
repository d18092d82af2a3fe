"""Byte-pair encoding and decoding with a public word vocabulary, by batched merge rounds.

Texts are normalised (canonical composition, runs of white space as one space, lower case), cut into
words and encoded word by word. The words not met before are encoded together: the symbols of all of
them stand in one flat array, and in each round every word merges its pair of lowest rank, found by
binary search over the sorted pair keys. Encoded words are kept in a table of bounded size per worker.

Null and empty texts give no tokens. Texts of any length are encoded whole; a row depends on no other
row, so repeated rows and ties play no part. An input column with the name of an output is replaced.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, pre_tokenizers

from tidewire.llm.flat import row_slices
from tidewire.llm.frames import appended, with_columns

WORD_END = "</w>"
KEPT_WORDS = 200_000  # encoded words a worker keeps
PENDING_WORDS = 50_000  # words encoded together at most

# Fixed value: the vocabulary's word cut, which follows lower-casing.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


LATIN_END = 0x180  # texts below this code point take the quick word cut; lower case stays below


def _class(codes: Iterable[int]) -> str:
    """The code points as the body of a character class."""
    return "".join(f"\\u{c:04x}" for c in codes)


def word_patterns() -> tuple[str, str]:
    """The word cut spelled out for Latin texts, and what finds unassigned code points (first plane).

    Engines differ on code points that are new or unassigned, so a text that holds one is left to the
    vocabulary's own library.
    """
    latin = range(LATIN_END)
    letter = _class(c for c in latin if unicodedata.category(chr(c))[0] == "L")
    number = _class(c for c in latin if unicodedata.category(chr(c))[0] == "N")
    blank = _class(c for c in latin if regex.match(r"\p{White_Space}", chr(c)))
    cut = f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{blank}{letter}{number}]+"
    unassigned = (c for c in range(0x10000) if unicodedata.category(chr(c)) == "Cn")
    return cut, f"[{_class(unassigned)}]"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, others from U+0100."""
    letters, spare = [], 0x100
    for byte in range(256):
        if 0x21 <= byte <= 0x7E or 0xA1 <= byte <= 0xAC or 0xAE <= byte <= 0xFF:
            letters.append(chr(byte))
        else:
            letters.append(chr(spare))
            spare += 1
    return letters


class Vocabulary:
    """A vocabulary file as sorted arrays; small and of fixed size, so it can be sent to all tasks."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, number in [*ids.items(), *self.special.items()]:
            self.tokens[number] = token
        letters = byte_letters()
        self.inner = np.array([ids[c] for c in letters], np.int64)
        self.last = np.array([ids[c + WORD_END] for c in letters], np.int64)
        left, right, merged = [], [], []
        for pair in spec["model"]["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left.append(ids[a])
            right.append(ids[b])
            merged.append(ids[a + b])
        self.patterns = word_patterns()
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.splitter = pre_tokenizers.Split(Regex(WORDS), "removed", invert=True)
        keys = np.array(left, np.int64) * len(self.tokens) + np.array(right, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.merged = np.array(merged, np.int64)[order]

    def ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (``never`` if it cannot merge) and its place in the sorted keys."""
        pair = left * len(self.tokens) + right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], len(self.keys)), at

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The token ids of each (non-empty) word."""
        never = len(self.keys)
        lengths = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        symbols = self.inner[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        rank, at = self.ranked(symbols, np.append(symbols[1:], 0))
        rank[ends - 1] = never  # no pair spans two words
        done: list[list[int]] = [[]] * len(words)
        while len(symbols):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(first, len(word)))
            lowest = np.minimum.reduceat(rank, first)
            ready = lowest == never
            if ready.any():
                ended = symbols[np.repeat(ready, size)].tolist()
                begin = 0
                for w, n in zip(word[first[ready]].tolist(), size[ready].tolist(), strict=True):
                    done[w] = ended[begin : begin + n]
                    begin += n
            chosen = (rank == np.repeat(lowest, size)) & (rank < never)
            # of overlapping pairs (a run of equal symbols) every second one is merged
            run_start = chosen & ~np.append(False, chosen[:-1])
            places = np.arange(len(chosen))
            started = np.maximum.accumulate(np.where(run_start, places, 0))
            chosen &= (places - started) % 2 == 0
            where = np.flatnonzero(chosen)
            symbols[where] = self.merged[at[where]]
            keep = ~np.repeat(ready, size)
            keep[where + 1] = False
            last = np.append(word[1:] != word[:-1], True)
            last[where] |= last[where + 1]
            # only pairs that begin or end at a merged symbol change
            fresh = chosen | np.append(chosen[1:], False)
            fresh[:-2] |= chosen[2:] & ~keep[1:-1]
            symbols, word, rank, at = symbols[keep], word[keep], rank[keep], at[keep]
            last, fresh = last[keep], np.flatnonzero(fresh[keep])
            if len(fresh):
                after = np.append(symbols[1:], 0)[fresh]
                rank[fresh], at[fresh] = self.ranked(symbols[fresh], after)
                rank[last] = never
        return done


class Encoder:
    """Encodes texts with a vocabulary, keeping the words met before."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.numbers = [str(i) for i in range(len(vocabulary.tokens))]
        self.special = re.compile("(" + "|".join(map(re.escape, vocabulary.special)) + ")")
        self.latin_cut, self.unassigned = map(re.compile, vocabulary.patterns)
        self.beyond_latin = re.compile(f"[^{chr(0)}-{chr(LATIN_END - 1)}]")
        self.beyond_first_plane = re.compile("[\U00010000-\U0010ffff]")
        self.cut = regex.compile(WORDS.replace(r"\s", r"\p{White_Space}"), regex.V0)
        self.forget()

    def forget(self) -> None:
        special = self.vocabulary.special
        self.ids = {s: str(i) for s, i in special.items()}  # word: its ids as text
        self.decoded = {s: s for s in special}  # word: its tokens as text

    def words(self, text: str) -> list[str]:
        """The words and special tokens in order. White space only separates words."""
        found = []
        for part in self.special.split(text) if "<|" in text else (text,):
            if part in self.vocabulary.special:
                found.append(part)
            elif self.beyond_latin.search(part) is None:
                found += self.latin_cut.findall(unicodedata.normalize("NFC", part).lower())
            elif self.has_unassigned(part):
                part = self.vocabulary.normalizer.normalize_str(part)
                found += [w for w, _ in self.vocabulary.splitter.pre_tokenize_str(part)]
            else:
                # each letter for itself: no special form of a last sigma
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                found += self.cut.findall(part)
        return found

    def has_unassigned(self, text: str) -> bool:
        beyond = set(self.beyond_first_plane.findall(text))
        unknown = any(unicodedata.category(c) == "Cn" for c in beyond)
        return unknown or self.unassigned.search(text) is not None

    def learn(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.ids]
        if len(self.ids) + len(fresh) > KEPT_WORDS:
            self.forget()
            fresh = [w for w in words if w not in self.ids]
        tokens, numbers = self.vocabulary.tokens, self.numbers
        for begin in range(0, len(fresh), PENDING_WORDS):
            some = fresh[begin : begin + PENDING_WORDS]
            encoded = self.vocabulary.encode_words([w.encode() for w in some])
            for w, ids in zip(some, encoded, strict=True):
                self.ids[w] = " ".join([numbers[i] for i in ids])
                self.decoded[w] = " ".join([tokens[i] for i in ids])

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Per text the number of tokens, the ids and the decoded text (one space between)."""
        cut = [self.words(text) for text in texts]
        self.learn(set(itertools.chain.from_iterable(cut)))
        for words in cut:
            ids = " ".join(map(self.ids.__getitem__, words))
            decoded = " ".join(map(self.decoded.__getitem__, words))
            yield (ids.count(" ") + 1 if ids else 0), ids, decoded


FIELDS = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("token_ids", T.StringType()),
    T.StructField("decoded", T.StringType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
]


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode_decode(
    docs: DataFrame,
    vocabulary_path: str,
    outputs: Sequence[str] = ("n_tokens", "token_ids", "decoded"),
) -> DataFrame:
    """``docs`` with the tokens of its column ``text`` and the text they decode to.

    ``outputs`` names the columns to add: ``n_tokens``, ``token_ids`` (decimal ids, one space between),
    ``decoded``, and the SHA-256 of the last two as ``ids_sha256`` and ``decoded_sha256``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path))
    fields = [f for f in FIELDS if f.name in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            for begin, end in row_slices(texts):
                rows = []
                some = [t or "" for t in texts.slice(begin, end - begin).to_pylist()]
                for n, ids, decoded in encoder.encode(some):
                    row = {"n_tokens": n, "token_ids": ids, "decoded": decoded}
                    if "ids_sha256" in outputs:
                        row["ids_sha256"] = _sha256(ids)
                    if "decoded_sha256" in outputs:
                        row["decoded_sha256"] = _sha256(decoded)
                    rows.append([row[f.name] for f in fields])
                columns = zip(*rows, strict=True)
                yield appended(batch.slice(begin, end - begin), fields, columns)

    return with_columns(docs, fields, run)
