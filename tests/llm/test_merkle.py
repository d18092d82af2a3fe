"""Merkle fingerprints against plain Python."""

import hashlib
import re

from pyspark.sql import functions as F

from tidewire.llm import merkle

SCHEMA = "doc_id long, text string"


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def tree(text):
    """The fingerprint and the distinct clauses of a text."""
    clauses = [
        [md5(c) for c in re.findall("[^.,;:!?]*[.,;:!?]|[^.,;:!?]+", p)] for p in (text or "").split("\n")
    ]
    sections, last = [[]], False
    for c in clauses:
        digest = md5("".join(c))
        if last:
            sections.append([])
        sections[-1].append((digest, c))
        last = digest < "4"
    digests = [md5("".join(d for d, _ in s)) for s in sections]
    shown = [
        "/" + d[:16] + "".join(f"|{p[:12]}=" + ",".join(x[:8] for x in c) for p, c in s)
        for d, s in zip(digests, sections, strict=True)
    ]
    return md5("".join(digests)) + "".join(shown), {x[:8] for c in clauses for x in c}


def near(a, b):
    (x, xs), (y, ys) = tree(a), tree(b)
    if x.split("/")[0] == y.split("/")[0]:
        return 1.0
    return len(xs & ys) / max(len(xs), len(ys)) if xs or ys else 0.0


def expected(rows):
    """Rows of unique ids."""
    rows = sorted(((i, t or "") for i, t in rows), reverse=True)
    out = set()
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        moved = len(text) // 3
        edited = text[: len(text) - moved] + following[:moved]
        out.add(
            (i, len(text), hashlib.sha256(edited.encode()).hexdigest(), tree(text)[0], tree(edited)[0],
             near(text, edited), near(text, following))
        )
    return out


def result(df):
    return [tuple(r) for r in merkle.edited_fingerprints(df).collect()]


def test_equals_plain_python(spark):
    texts = [None, "", "\n", "a", "a.b,c\n\nd; é😀 x\ne", "\n\n\n", "no end " * 50, "x. " * 4000, "l1\nl2\nl3\nl4\nl5\nl6\nl7"]
    rows = [(100 - 7 * i, t) for i, t in enumerate(texts * 6)]
    got = result(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert len(got) == len(rows) and set(got) == expected(rows)


def test_repeated_rows_and_null_ids(spark):
    rows = [(5, "a, b"), (5, "a, b"), (5, "other"), (None, "q. r"), (None, "q. r"), (7, "z")]
    got = result(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r[0] or -1, r[1]) for r in got) == [(-1, 4), (-1, 4), (5, 4), (5, 4), (5, 5), (7, 1)]
    assert len({r for r in got if r[0] is None}) == 1 and len({r for r in got if r[0] == 5 and r[1] == 4}) == 1
    # after the last document, of null id, comes the first
    last = next(r for r in got if r[0] is None)
    assert last[2] == hashlib.sha256(b"q. z").hexdigest()
    # many equal rows are one document in the order
    many = spark.createDataFrame([(1, "x, y")] * 500 + [(2, "abc")], SCHEMA)
    assert sorted(set(result(many))) == sorted(expected([(1, "x, y"), (2, "abc")])) and len(result(many)) == 501


def test_empty_single_and_clashing_columns(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == []
    assert set(result(spark.createDataFrame([(1, "abc")], SCHEMA))) == expected([(1, "abc")])
    df = spark.createDataFrame(
        [(1, "a.b", 1, 2, 3, 4), (2, "c", 1, 2, 3, 4)],
        SCHEMA + ", tree int, `a.b` int, fingerprint int, __clauses int",
    )
    assert set(result(df)) == expected([(1, "a.b"), (2, "c")])
    found = merkle.with_fingerprint(df)
    assert found.columns == ["doc_id", "text", "tree", "a.b", "__clauses", "fingerprint"]
    assert {r["fingerprint"] for r in found.collect()} == {tree("a.b")[0], tree("c")[0]}


def test_long_text(spark):
    text = "word " * 400_000 + "\n" + "a, b. " * 50_000
    rows = [(1, text), (2, text[::-1])]
    assert set(result(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_edits_are_located(spark):
    lines = [f"line {i}, with words {i * i}." for i in range(60)]
    edited = [*lines[:30], "new here.", *lines[31:]]
    df = spark.createDataFrame([("\n".join(lines), "\n".join(edited))], "a string, b string")
    df = merkle.with_fingerprint(merkle.with_fingerprint(df, "a", "x"), "b", "y")
    row = df.select(
        merkle.differing(F.col("y"), F.col("x")).alias("there"), merkle.differing(F.col("x"), F.col("x")).alias("none"),
        merkle.likeness(F.col("x"), F.col("y")).alias("near"),
    ).first()
    assert len(row["there"]) == 1 and row["none"] == []
    section, paragraph = row["there"][0]
    fingerprint = tree("\n".join(edited))[0]
    assert fingerprint.split("/")[1 + section].split("|")[1 + paragraph].startswith(md5(md5("new here."))[:12])
    assert 0.95 < row["near"] < 1
