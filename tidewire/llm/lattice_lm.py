"""Language-model scores of documents by subword lattice likelihood.

The pieces of an existing vocabulary weight every way to cut a word: the probability of a word is the sum,
over all segmentations, of the product of their pieces, found by forward recursion in log space. The
pieces start from the vocabulary's own scores and are re-estimated from every distinct training word
(expected counts over all segmentations). A word of the training texts also has its own count; counts are
discounted, and the mass taken off goes to the lattice:

    P(word) = max(c - d, 0) / N + d * V / N * P_lattice(word).

Classes of texts (languages, say) have counts of their own in the same form, with P in the place of the
lattice. A text of a class is drawn from an urn: a word's chance is (A * P_class(word) + times seen before
in this text) / (A + words before), with A = ``CONCENTRATION``. The probability of a text is the sum over the
classes, by their shares of the training texts, of the product over its words and its end. So it is the
marginal over the segmentations of all words and over the classes; the class of a text is never an input.

Everything counted grows with the corpus and stays distributed. Texts are cut into blocks; a block keeps
the numbers of its words, and its vocabulary (each distinct word once, with its counts in training texts of
the block) is joined with the counts of all blocks by a 64-bit hash of the word and comes back by block. So what is shuffled are
the distinct words of blocks, not the tokens, and no word, however frequent, has more rows than there are
blocks. Only the piece weights, a number per piece of the fixed vocabulary, pass through the driver.

Words are runs of anything but ASCII white space, A-Z lower-cased; every text has one end besides. Null is
the empty text: only the end. Repeated rows count each. A training row without a class counts for the
general model only. Class counts are rows (class, word, count), so there may be any number of classes; every
text is scored by each of them, and a row per class passes through the driver. Without training rows
the words have their lattice probability, the end has probability one and all base counts are zero. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewire.llm.flat import flat_bytes, mixed, row_slices, signed, word_bounds, word_hashes
from tidewire.llm.frames import regrouped, released, small_batches
from tidewire.settings import materialize, scratch_path

BLOCK_BYTES = 16 << 20  # text of a block; a longer text is a block of its own
ROUNDS = 2  # of re-estimation
WORDS_AT_ONCE = 20_000
ROWS_AT_ONCE = 50_000
CONCENTRATION = 3000.0  # words of the urn before the first draw
PRIOR = 1000.0  # weight of the vocabulary's own scores, in words
WORD_START = "▁"

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_NEVER = -1e300


@dataclass
class Lattice:
    """Pieces by length as sorted hashes, with the log probability of each piece.

    Pieces that begin a word and those that continue it are two distributions; the second also has
    the end of the word.
    """

    keys: list[np.ndarray]  # by length - 1
    numbers: list[np.ndarray]  # of the pieces, in the order of the keys
    first: np.ndarray  # whether a piece begins a word
    bytes_of: np.ndarray  # numbers of the 256 byte pieces
    log_p: np.ndarray
    log_end: float

    @property
    def longest(self) -> int:
        return len(self.keys)


def piece_scores(path: str) -> tuple[list[str], np.ndarray]:
    """The pieces of a vocabulary file with their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    return [model.id_to_piece(i) for i in range(n)], np.array([model.get_score(i) for i in range(n)])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)


def _hash(codes: np.ndarray) -> np.ndarray:
    """A hash of each row of code points."""
    total = np.zeros(len(codes), np.uint64)
    for k in range(codes.shape[1]):
        total = total * _FACTOR + codes[:, k] + np.uint64(1)
    return mixed(total)


def lattice_of(pieces: list[str], scores: np.ndarray) -> Lattice:
    """The lattice with the vocabulary's own scores, read as ranks: p falls as 1 / rank."""
    byte = {f"<0x{b:02X}>": b for b in range(256)}
    bytes_of = np.zeros(256, np.int64)
    by_length: dict[int, list[int]] = {}
    weight = np.zeros(len(pieces))
    first = np.zeros(len(pieces), bool)
    for i, piece in enumerate(pieces):
        if piece in byte:
            bytes_of[byte[piece]] = i
            weight[i] = 1e-6
        elif not (piece.startswith("<") and piece.endswith(">")) and piece.rfind(WORD_START) <= 0:
            by_length.setdefault(len(piece), []).append(i)
            first[i] = piece.startswith(WORD_START)
            weight[i] = 1.0 / (2.0 - scores[i])
    keys, numbers = [], []
    for n in range(1, max(by_length) + 1):
        own = np.array(by_length.get(n, []), np.int64)
        hashes = _hash(np.array([_codes(pieces[i]) for i in own], np.uint64).reshape(-1, n))
        order = np.argsort(hashes)
        keys.append(hashes[order])
        numbers.append(own[order])
    lattice = Lattice(keys, numbers, first, bytes_of, np.zeros(len(pieces)), 0.0)
    lattice.log_p, lattice.log_end = _normalised(weight, weight[~first].sum() / 3, first)
    return lattice


def _normalised(weight: np.ndarray, ends: float, first: np.ndarray) -> tuple[np.ndarray, float]:
    total = np.where(first, weight[first].sum(), weight[~first].sum() + ends)
    with np.errstate(divide="ignore"):
        return np.where(weight > 0, np.log(weight / total), _NEVER), float(np.log(ends / total[~first][0]))


def _edges(lattice: Lattice, codes: np.ndarray) -> list[tuple]:
    """For each piece length, the log weight and the number of the piece at each place of each word.

    ``codes`` has a word per row, with the word start in front. A character without a piece is spelled
    with the byte pieces; its number is -1.
    """
    width = codes.shape[1]
    rolled = np.zeros(codes.shape, np.uint64)
    edges = []
    for n in range(1, min(lattice.longest, width) + 1):
        # the hash of the n characters that end at a place
        rolled = rolled[:, : width - n + 1] if n == 1 else rolled[:, :-1]
        rolled = rolled * _FACTOR + codes[:, n - 1 :] + np.uint64(1)
        wanted = mixed(rolled)
        keys = lattice.keys[n - 1]
        if len(keys):
            at = np.minimum(np.searchsorted(keys, wanted.ravel()), len(keys) - 1).reshape(wanted.shape)
            found = keys[at] == wanted
            number = np.where(found, lattice.numbers[n - 1][at], -1)
        else:
            number = np.full(wanted.shape, -1)
        weight = np.where(number >= 0, lattice.log_p[number], _NEVER)
        if n == 1:
            spelled = number < 0
            if spelled.any():
                cost = {c: float(lattice.log_p[lattice.bytes_of[list(chr(c).encode())]].sum())
                        for c in np.unique(codes[spelled]).tolist()}
                weight[spelled] = [cost[c] for c in codes[spelled].tolist()]
            if (number[:, 0] < 0).any():  # without a piece for the word start alone
                weight[:, 0] = _NEVER
        edges.append((weight, number))
    return edges


def _forward(edges: list[tuple], width: int, rows: int) -> np.ndarray:
    """ln of the summed weight of all ways to the place before each character, and to the end."""
    alpha = np.full((width + 1, rows), _NEVER)
    alpha[0] = 0.0
    for end in range(1, width + 1):
        for n in range(1, min(len(edges), end) + 1):
            begin = end - n
            alpha[end] = np.logaddexp(alpha[end], alpha[begin] + edges[n - 1][0][:, begin])
    return alpha


def _backward(edges: list[tuple], width: int, rows: int) -> np.ndarray:
    beta = np.full((width + 1, rows), _NEVER)
    beta[width] = 0.0
    for begin in range(width - 1, -1, -1):
        for n in range(1, min(len(edges), width - begin) + 1):
            beta[begin] = np.logaddexp(beta[begin], beta[begin + n] + edges[n - 1][0][:, begin])
    return beta


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and code points (word start in front) of words of equal length, some at a time."""
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    sizes, begins = np.unique(lengths[order], return_index=True)
    start = _codes(WORD_START)[0]
    for size, group in zip(sizes.tolist(), np.split(order, begins[1:]), strict=True):
        step = max(1, min(WORDS_AT_ONCE, (1 << 19) // (size + 1)))
        for some in np.split(group, range(step, len(group), step)):
            codes = _codes("".join([words[i] for i in some.tolist()])).reshape(len(some), size)
            yield some, np.concatenate([np.full((len(some), 1), start, np.uint64), codes], axis=1)


def word_log_probabilities(lattice: Lattice, words: list[str]) -> np.ndarray:
    """ln P_lattice of each (non-empty) word: the marginal over all its segmentations."""
    out = np.empty(len(words))
    for rows, codes in _by_length(words):
        edges = _edges(lattice, codes)
        out[rows] = _forward(edges, codes.shape[1], len(rows))[-1] + lattice.log_end
    return out


def expected_pieces(lattice: Lattice, words: list[str]) -> tuple[np.ndarray, float]:
    """How often each piece is expected in the segmentations of the words, and the number of ends."""
    total = np.zeros(len(lattice.log_p))
    ends = 0.0
    for rows, codes in _by_length(words):
        width = codes.shape[1]
        edges = _edges(lattice, codes)
        alpha, beta = _forward(edges, width, len(rows)), _backward(edges, width, len(rows))
        whole = alpha[-1]
        for n, (weight, number) in enumerate(edges, 1):
            for begin in range(width - n + 1):
                share = np.exp(alpha[begin] + weight[:, begin] + beta[begin + n] - whole)
                known = number[:, begin] >= 0
                total += np.bincount(number[known, begin], share[known], len(total))
        ends += len(rows)
    return total, ends


def _blocks(docs: DataFrame) -> DataFrame:
    """One row per block: ids, word numbers of all texts, and the block's vocabulary with its counts in
    all training texts and, where there are any, in those of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        for batch in regrouped(batches, size=BLOCK_BYTES):
            texts = batch.column(1)
            for begin, end in row_slices(texts, BLOCK_BYTES):
                hashes, counts, words = [], [], {}
                block = texts.slice(begin, end - begin)
                for low, high in row_slices(block):
                    data, starts = flat_bytes(block.slice(low, high - low))
                    own, n = word_hashes(data, starts)
                    begins, ends = word_bounds(data, starts)
                    distinct, first = np.unique(own, return_index=True)
                    for h, b, e in zip(distinct.tolist(), begins[first].tolist(), ends[first].tolist(), strict=True):
                        if h not in words:
                            words[h] = data[b:e].tobytes().lower()
                    hashes.append(own)
                    counts.append(n)
                hashes, counts = np.concatenate(hashes), np.concatenate(counts)
                train = np.asarray(batch.column(2).slice(begin, end - begin).fill_null(False))
                distinct, n = np.unique(hashes, return_counts=True)
                order = np.argsort(-n, kind="stable")  # frequent words get small numbers
                place = np.empty(len(order), np.int32)
                place[order] = np.arange(len(order), dtype=np.int32)
                numbers = place[np.searchsorted(distinct, hashes).astype(np.int32)]
                del hashes
                learned = np.repeat(train, counts)
                trained = np.bincount(numbers[learned], minlength=len(order))
                row = [
                    pickle.dumps(batch.column(0).slice(begin, end - begin).to_pylist()),
                    counts.tobytes(), numbers.tobytes(),
                    b"\n".join([words[h] for h in distinct[order].tolist()]),
                    trained.astype(np.int64).tobytes(),
                    pickle.dumps(_by_class(batch.column(3).slice(begin, end - begin), train, counts, numbers)),
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), *[pa.array([v], pa.binary()) for v in row]],
                    names=["block", "ids", "counts", "numbers", "words", "trained", "classes"],
                )
                number += 1

    schema = (
        "block long, ids binary, counts binary, numbers binary, words binary, trained binary, classes binary"
    )
    path = scratch_path(docs.sparkSession, "text-blocks")
    blocks = docs.mapInArrow(lambda batches: released(run(batches)), schema)
    blocks.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def _by_class(kinds: pa.Array, train: np.ndarray, counts: np.ndarray, numbers: np.ndarray) -> list[tuple]:
    """Per class that training texts of a block have, the numbers of its words and how often they occur."""
    known = np.asarray(kinds.is_valid()) & train
    kind = np.asarray(kinds.fill_null(0))
    found = []
    for k in np.unique(kind[known]).tolist():
        mine = np.repeat(known & (kind == k), counts)
        words, n = np.unique(numbers[mine], return_counts=True)
        found.append((k, words.astype(np.int32), n.astype(np.int32)))
    return found


def _keys(words: bytes) -> np.ndarray:
    data = np.frombuffer(words, np.uint8)
    return signed(word_hashes(data, np.array([0, len(data)]))[0])


def _counts(blocks: DataFrame) -> DataFrame:
    """``word``, ``kind``, ``n``: how often training texts of a block have a word, by class; null stands for texts
    without one. Words that only other texts have are there with 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, trained, classes in zip(*batch.columns, strict=True):
                rest = np.frombuffer(trained.as_py(), np.int64).copy()
                words = pa.array(words.as_py().split(b"\n") if len(rest) else [], pa.binary())
                parts = pickle.loads(classes.as_buffer())
                there = np.zeros(len(rest), bool)
                for _, numbers, n in parts:
                    rest[numbers] -= n
                    there[numbers] = True
                others = np.flatnonzero((rest > 0) | ~there)
                for kind, numbers, n in [*parts, (None, others, rest[others])]:
                    for begin in range(0, len(n), ROWS_AT_ONCE):
                        some = numbers[begin : begin + ROWS_AT_ONCE]
                        yield pa.RecordBatch.from_arrays(
                            [words.take(pa.array(some)), pa.array([kind] * len(some), pa.int64()),
                             pa.array(n[begin : begin + ROWS_AT_ONCE].astype(np.int64))],
                            names=["word", "kind", "n"],
                        )

    rows = blocks.select("words", "trained", "classes")
    return rows.mapInArrow(run, "word binary, kind long, n long")


def _places(blocks: DataFrame) -> DataFrame:
    """Each distinct word of a block by its hash ``key``, with the ``block`` and its ``number`` there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words in zip(*batch.columns, strict=True):
                keys = _keys(words.as_py())
                for begin in range(0, len(keys), ROWS_AT_ONCE):
                    some = keys[begin : begin + ROWS_AT_ONCE]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some), pa.array(np.full(len(some), block.as_py())),
                         pa.array(np.arange(begin, begin + len(some), dtype=np.int32))],
                        names=["key", "block", "number"],
                    )

    return blocks.select("block", "words").mapInArrow(run, "key long, block long, number int")


def _words(blocks: DataFrame) -> DataFrame:
    """Each distinct ``word`` with its count ``c0`` in all training texts and, as ``own``, those by class."""
    dealt = _counts(blocks).repartition("word")  # both groupings below are by the word
    by_class = dealt.groupBy("word", "kind").agg(F.sum("n").alias("c"))
    own = F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("kind", "c")))
    return materialize(by_class.groupBy("word").agg(F.sum("c").alias("c0"), own.alias("own")), "words")


def _decoded(column: pa.Array) -> list[str]:
    # a word's bytes are cut at ASCII, so they are whole characters
    return [w.decode("utf-8", "replace") for w in column.to_pylist()]


def _reestimated(words: DataFrame, lattice: Lattice, rounds: int) -> Lattice:
    """The piece weights after some rounds over all distinct training words."""
    own = np.where(lattice.log_p > _NEVER, np.exp(lattice.log_p), 0.0)
    prior_ends = float(np.exp(lattice.log_end))
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast(lattice)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total, ends = np.zeros(len(shared.value.log_p)), 0.0
            for batch in regrouped(batches, WORDS_AT_ONCE):
                if batch.num_rows:
                    found, n = expected_pieces(shared.value, _decoded(batch.column(0)))
                    total += found
                    ends += n
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(used, -1)), pa.array(np.append(total[used], ends))], names=["piece", "n"]
            )

        found = words.filter("c0 > 0").select("word").mapInArrow(run, "piece long, n double")
        sums = {r["piece"]: r["n"] for r in found.groupBy("piece").agg(F.sum("n").alias("n")).collect()}
        shared.destroy()
        ends = sums.pop(-1, 0.0) + PRIOR * prior_ends
        weight = PRIOR * own
        for piece, n in sums.items():
            weight[piece] += n
        log_p, log_end = _normalised(weight, ends, lattice.first)
        lattice = Lattice(
            lattice.keys, lattice.numbers, lattice.first, lattice.bytes_of, log_p, log_end
        )
    return lattice


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 1: eight steps up, then Stirling's series."""
    product = np.ones_like(x)
    for k in range(8):
        product = product * (x + k)
    y = x + 8.0
    inverse = 1.0 / (y * y)
    series = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(product)


def urn_log_probabilities(
    doc: np.ndarray, log_p: np.ndarray, times: np.ndarray, texts: int
) -> np.ndarray:
    """ln of the chance to draw each text's words in order, from pairs of text and distinct word.

    ``log_p`` is the word's ln probability, ``times`` how often the text has it.
    """
    # the first draw of a word, then the others, which find it in the urn
    value = np.log(CONCENTRATION) + log_p
    again = np.flatnonzero(times > 1)
    prior = CONCENTRATION * np.exp(log_p[again])
    value[again] += _log_gamma(prior + times[again]) - _log_gamma(prior + 1.0)
    drawn = np.bincount(doc, times, texts)
    start = np.full(texts, CONCENTRATION)
    return np.bincount(doc, value, texts) - (_log_gamma(start + drawn) - _log_gamma(start))


def score_texts(
    docs: DataFrame, vocabulary_path: str, *, id_column: str = "doc_id", text_column: str = "text",
    train_column: str = "train", class_column: str | None = None, rounds: int = ROUNDS,
) -> DataFrame:
    """Per row the id, its tokens and the log10 probability of its text.

    Rows with a true ``train_column`` are learned from. ``n_tokens`` counts the words and the end,
    ``n_known`` those that the training texts have, ``train_tokens`` all tokens of the training texts.
    ``base_score`` is the score of a plain word model with one added to each count, ``score`` that of the
    lattice model, ``lattice_score`` that of the lattice alone: no word has a count of its own, its
    probability is the sum over its segmentations.
    """
    small_batches(docs.sparkSession)
    kind = F.lit(None) if class_column is None else F.col(class_column)
    train = F.coalesce(F.col(train_column), F.lit(False))
    chosen = docs.select(
        F.col(id_column).alias("id"), F.col(text_column).alias("text"), train.alias("train"),
        F.when(kind.isNotNull(), F.xxhash64(kind.cast("string"))).alias("kind"),
    )
    id_type = chosen.schema["id"].dataType
    trained = chosen.filter("train").groupBy("kind").agg(F.count("*").alias("texts"))
    texts_of = {r["kind"]: r["texts"] for r in trained.collect()}  # a row per class
    texts = sum(texts_of.values())
    blocks = _blocks(chosen)
    words = _words(blocks)
    facts = words.agg(
        F.count(F.when(F.col("c0") > 0, 1)).alias("distinct"), F.coalesce(F.sum("c0"), F.lit(0)).alias("tokens"),
        F.count(F.when(F.col("c0") == 1, 1)).alias("ones"), F.count(F.when(F.col("c0") == 2, 1)).alias("twos"),
    ).first()
    by_class = words.select(F.inline("own")).groupBy("kind")
    by_class = by_class.agg(F.count("*").alias("distinct"), F.sum("c").alias("tokens"))
    seen = {r["kind"]: (r["distinct"], r["tokens"]) for r in by_class.collect()}
    classes = sorted(k for k in texts_of if k is not None)
    # by model, the general one first: ends of texts, distinct words and tokens (ends included)
    ends = [texts, *[texts_of[k] for k in classes]]
    counted = [(facts["distinct"], facts["tokens"]), *[seen.get(k, (0, 0)) for k in classes]]
    tokens = [n + e for (_, n), e in zip(counted, ends, strict=True)]
    distinct = facts["distinct"] + (1 if texts else 0)  # V
    ones, twos = facts["ones"], facts["twos"]
    discount = ones / (ones + 2 * twos) if ones and twos else 0.5
    taken = [discount * v / n if v else 1.0 for (v, _), n in zip(counted, tokens, strict=True)]
    lattice = _reestimated(words, lattice_of(*piece_scores(vocabulary_path)), rounds)
    shared = docs.sparkSession.sparkContext.broadcast(lattice)

    def base_of(count):
        return np.log10((count + 1.0) / (tokens[0] + 1.0 * (distinct + 1)))

    def mixed_log(counts, lower, k):
        """ln P of the model ``k`` from its counts and what it falls back to."""
        with np.errstate(divide="ignore"):
            own = np.log(np.maximum(counts - discount, 0.0) / max(tokens[k], 1))
        return np.logaddexp(own, np.log(taken[k]) + lower)

    numbers_of = np.array(classes or [0], np.int64)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in regrouped(batches, WORDS_AT_ONCE):
            spelled = word_log_probabilities(shared.value, _decoded(batch.column(0)))
            own = batch.column(2)
            kinds, counts = (np.asarray(x) for x in own.flatten().flatten())
            # class and count as one number
            codes = np.searchsorted(numbers_of, kinds) + counts * len(numbers_of)
            ends = np.append(0, np.cumsum(np.asarray(pc.list_value_length(own)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_keys(b"\n".join(batch.column(0).to_pylist()))), batch.column(1),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(codes)), pa.array(spelled.astype(np.float32))],
                names=["key", "c0", "own", "spelled"],
            )

    # counts are mostly small, so they move in less space than the probabilities made of them
    values = words.select("word", "c0", "own").mapInArrow(scored, "key long, c0 long, own array<long>, spelled float")
    values = materialize(values, "word-scores")
    shared.destroy()
    local = _places(blocks).join(values, "key").drop("key")
    # the end is a word like the others, but no piece spells it
    end_general = float(np.log(max(texts - discount, 1e-9) / tokens[0])) if texts else 0.0
    end_logs = [end_general]
    end_logs += [float(mixed_log(np.float64(e), end_general, k)) for k, e in enumerate(ends) if k]
    unclassed = texts - sum(ends[1:])
    shares = np.log((np.array([unclassed, *ends[1:]]) + 1.0) / (texts + len(ends)))
    share_of_end = float(np.log10(texts / tokens[0])) if texts else 0.0

    def per_text(key, left, right):
        right = right.combine_chunks()
        order = np.argsort(np.asarray(right["number"]))
        spelled = np.asarray(right["spelled"])[order].astype(float)
        general = np.asarray(right["c0"])[order]
        own = right["own"].combine_chunks()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        owner = np.repeat(place, np.asarray(pc.list_value_length(own)))
        counts, kinds = np.divmod(np.asarray(own.flatten()), len(numbers_of))
        base, known = base_of(general.astype(float)), general > 0
        log_general = mixed_log(general.astype(float), spelled, 0)
        out = {n: [] for n in ("id", "n_tokens", "n_known", "base_score", "score", "lattice_score")}
        for ids, sizes, numbers in zip(left["ids"], left["counts"], left["numbers"], strict=True):
            sizes = np.frombuffer(sizes.as_buffer(), np.int64)
            n = len(sizes)
            width = max(1, len(general))
            pairs = np.repeat(np.arange(n), sizes) * width + np.frombuffer(numbers.as_buffer(), np.int32)
            pairs, times = np.unique(pairs, return_counts=True)
            doc, word = np.divmod(pairs, width)
            # the end of each text as one more pair
            doc_and_end, times_and_end = np.append(doc, np.arange(n)), np.append(times, np.ones(n, np.int64))
            total = np.full(n, -np.inf)
            for k, (share, end) in enumerate(zip(shares, end_logs, strict=True)):
                log_p = log_general
                if k:
                    mine = kinds == k - 1
                    in_class = np.zeros(len(general))
                    in_class[owner[mine]] = counts[mine]
                    log_p = mixed_log(in_class, log_general, k)
                drawn = urn_log_probabilities(doc_and_end, np.append(log_p[word], np.full(n, end)), times_and_end, n)
                total = np.logaddexp(total, share + drawn)
            out["id"] += pickle.loads(ids.as_buffer())
            out["n_tokens"] += (sizes + 1).tolist()
            out["n_known"] += (np.bincount(doc, times * known[word], n) + (texts > 0)).astype(np.int64).tolist()
            out["base_score"] += (np.bincount(doc, times * base[word], n) + base_of(float(texts))).tolist()
            out["score"] += np.minimum(0.0, total / np.log(10.0)).tolist()
            alone = np.bincount(doc, times * spelled[word], n) / np.log(10.0)
            # the lattice spells words; between them stands the chance that a text goes on or ends
            goes_on = sizes * np.log10(max(1.0 - 10.0**share_of_end, 1e-300)) if texts else 0.0
            out["lattice_score"] += (alone + goes_on + share_of_end).tolist()
        types = [to_arrow_type(id_type), pa.int64(), pa.int64(), *[pa.float64()] * 3]
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    rows = blocks.select("block", "ids", "counts", "numbers")
    result = rows.groupBy("block").cogroup(local.groupBy("block")).applyInArrow(
        per_text,
        f"id {id_type.simpleString()}, n_tokens long, n_known long, base_score double, score double, "
        "lattice_score double",
    )
    return result.select(
        F.col("id").alias(id_column), "n_tokens", "n_known",
        F.lit(int(tokens[0])).cast("long").alias("train_tokens"), "base_score", "score", "lattice_score",
    )
