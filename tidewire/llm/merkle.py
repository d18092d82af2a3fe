"""Document fingerprints: Merkle trees over sections, paragraphs and clauses, in Spark SQL functions only.

A text is cut into paragraphs at line feeds and each paragraph into clauses, which end with one of
``. , ; : ! ?``. A paragraph whose digest falls in a quarter of all digests ends a section, so that cuts follow
the content and an edit moves no section but its own. The digest of a clause is the MD5 of its text; that of a
paragraph, a section and the root is the MD5 of its children's digests. Equal roots mean equal texts.

The fingerprint is the tree as text: the root, then for each section ``/`` and the section's digest, for each
of its paragraphs ``|`` and the paragraph's digest, and after ``=`` the digests of its clauses. Inner digests
are written short; the root is made of whole ones. ``likeness`` compares two fingerprints, ``differing`` says
which sections and paragraphs of the first are not in the second.

Nulls count as empty text, which has one paragraph without clauses. Whole texts are read; a clause without an
end is as long as its paragraph. An empty table gives an empty result. Input columns with the name of a
result are replaced, others are kept by ``with_fingerprint``; ``edited_fingerprints`` reads the id and text
only. How it orders documents, null and repeated ids included, is said there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.settings import materialize

CLAUSE = "[^.,;:!?]*[.,;:!?]|[^.,;:!?]+"
SECTION_END = "4"  # digests of paragraphs below this end a section
SECTION_DIGITS, PARAGRAPH_DIGITS, CLAUSE_DIGITS = 16, 12, 8


def _joined(parts: Column, separator: str = "") -> Column:
    return F.array_join(parts, separator)


def _sections(parts: Column, digests: Column) -> Column:
    """``parts``, one for each paragraph, put together by section."""
    ends = F.zip_with(
        parts, digests, lambda part, d: F.when(d < SECTION_END, F.concat(part, F.lit("/"))).otherwise(part)
    )
    return F.split(F.regexp_replace(_joined(ends), "/$", ""), "/", -1)


def _with_tree(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the fingerprint of the column ``text`` as ``name``; works in steps, so that no step is
    computed twice."""
    kept = [F.col(f"`{c}`") for c in df.columns]
    paragraphs = F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n", -1)
    clauses = F.transform(paragraphs, lambda p: F.transform(F.regexp_extract_all(p, F.lit(CLAUSE), F.lit(0)), F.md5))
    df = df.select(*kept, clauses.alias("__clauses"))
    df = df.select(*kept, "__clauses", F.transform("__clauses", lambda c: F.md5(_joined(c))).alias("__paragraphs"))
    shown = F.zip_with(
        "__paragraphs", "__clauses",
        lambda p, c: F.concat(
            F.lit("|"), F.substring(p, 1, PARAGRAPH_DIGITS), F.lit("="),
            _joined(F.transform(c, lambda x: F.substring(x, 1, CLAUSE_DIGITS)), ","),
        ),
    )
    whole = F.col("__paragraphs")
    df = df.select(
        *kept, F.transform(_sections(whole, whole), F.md5).alias("__sections"),
        _sections(shown, whole).alias("__shown"),
    )
    branches = F.zip_with(
        "__sections", "__shown", lambda s, b: F.concat(F.lit("/"), F.substring(s, 1, SECTION_DIGITS), b)
    )
    tree = F.concat(F.md5(_joined(F.col("__sections"))), _joined(branches))
    return df.select(*[c for c, n in zip(kept, df.columns, strict=False) if n != name], tree.alias(name))


def with_fingerprint(docs: DataFrame, text_column: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with one more column, the fingerprint of the text."""
    clash = [c for c in docs.columns if c.lower() == name.lower() and c != text_column]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in clash]).alias("row")
    found = _with_tree(docs.select(row, F.col(f"`{text_column}`").alias("text")), "text", "tree")
    return found.select("row.*", F.col("tree").alias(name))


def root(fingerprint: Column) -> Column:
    """The digest of the whole text."""
    return F.substring_index(fingerprint, "/", 1)


def clause_digests(fingerprint: Column) -> Column:
    """The distinct clauses of the text, by digest."""
    return F.array_distinct(
        F.regexp_extract_all(fingerprint, F.lit(f"[=,]([0-9a-f]{{{CLAUSE_DIGITS}}})"), F.lit(1))
    )


def _likeness(a: Column, b: Column, same: Column) -> Column:
    most = F.greatest(F.size(a), F.size(b))
    share = F.size(F.array_intersect(a, b)) / F.nullif(most, F.lit(0))
    return F.when(same, F.lit(1.0)).otherwise(F.coalesce(share, F.lit(0.0)))


def likeness(a: Column, b: Column) -> Column:
    """How alike two fingerprints are: 1 when their roots are equal, else the share of distinct clauses that
    both have of those of the text with more; 0 when neither has any."""
    return _likeness(clause_digests(a), clause_digests(b), root(a) == root(b))


def differing(a: Column, b: Column) -> Column:
    """Where the text of ``a`` is not that of ``b``: an array of (section, paragraph), counted from 0.

    Sections that the other tree has too are passed over as wholes; in the others the paragraphs that
    the other tree has nowhere are named.
    """
    sections = F.slice(F.split(a, "/", -1), 2, F.greatest(F.size(F.split(a, "/", -1)) - 1, F.lit(0)))
    others = F.split(b, "/", -1)
    known = F.split(F.regexp_replace(b, "/[0-9a-f]*", ""), r"\|", -1)

    def paragraphs(section: Column, i: Column) -> Column:
        parts = F.split(section, r"\|", -1)
        found = F.transform(
            F.slice(parts, 2, F.size(parts) - 1),
            lambda p, j: F.struct(i.alias("section"), j.alias("paragraph"), (~F.array_contains(known, p)).alias("new")),
        )
        return F.when(~F.array_contains(others, section), F.filter(found, lambda p: p["new"]))

    named = F.flatten(F.filter(F.transform(sections, paragraphs), lambda p: p.isNotNull()))
    return F.transform(named, lambda p: F.struct(p["section"], p["paragraph"]))


def _blocks(keys: DataFrame, number: int) -> list:
    """The lowest and the highest key of each of about ``number`` ranges of keys, the highest range first."""
    key = F.struct("id", "hash")
    ranged = keys.repartitionByRange(number, F.col("id").desc(), F.col("hash").desc())
    ranged = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.min(key).alias("low"), F.max(key).alias("high"))
    found = ranged.collect()  # at most ``number`` rows
    return [(r["low"], r["high"]) for r in sorted(found, key=lambda r: r["part"])]


def edited_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every document beside an edited copy of it and the next document.

    Documents are ordered by descending id, null ids last, and of one id by a hash of the text; after the last
    comes the first. In the edited text the last third of the code points (rounded down) is replaced by the
    first as many of the next document's text, or all that it has. Rows of equal id and text are one
    document in the order; each gets its row. Returns the id, ``n_chars``, ``edited_sha256``,
    ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and ``near_next``: the likeness of the fingerprint to
    that of the edited text and of the next document.

    Texts are moved once: to the block of their range of keys, where the next row is at hand. The first
    document of a block also goes to the end of the block before, so no block has to see another.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    keys = materialize(rows.groupBy("id", "hash").agg(F.count("*").alias("copies")), "document-keys")
    blocks = _blocks(keys, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    id_type = rows.schema["id"].dataType

    def literal(key) -> Column:
        return F.struct(F.lit(key["id"]).cast(id_type).alias("id"), F.lit(key["hash"]).cast("long").alias("hash"))

    def listed(values: list, element: str) -> Column:
        return F.array(*values) if values else F.array().cast(f"array<{element}>")

    kind = f"struct<id:{id_type.simpleString()},hash:bigint>"
    lows = listed([literal(low) for low, _ in blocks], kind)
    repeated = keys.filter("copies > 1").select("id", "hash")
    any_repeated = not repeated.isEmpty()
    distinct = rows
    if any_repeated:
        same = [F.col("r.id").eqNullSafe(F.col("k.id")), F.col("r.hash") == F.col("k.hash")]
        copies = rows.alias("r").join(repeated.alias("k"), same, "left_semi")
        distinct = rows.alias("r").join(repeated.alias("k"), same, "left_anti")
        distinct = distinct.unionByName(copies.dropDuplicates(["id", "hash"]))
    # how many blocks end above the key
    key = F.struct("id", "hash")
    block = F.size(F.filter(lows, lambda low: low > key))
    own = distinct.select("*", block.alias("block"), F.lit(False).alias("ahead"))
    firsts = listed([literal(high) for _, high in blocks], kind)
    ahead = distinct.filter(F.array_contains(firsts, key)).select(
        "*", F.pmod(block - 1, F.lit(max(1, len(blocks)))).alias("block"), F.lit(True).alias("ahead")
    )
    order = Window.partitionBy("block").orderBy("ahead", F.col("id").desc(), F.col("hash").desc())
    treed = _with_tree(own.unionByName(ahead), "text", "tree")
    paired = treed.withColumns({"next_text": F.lead("text").over(order), "next_tree": F.lead("tree").over(order)})
    paired = paired.filter("not ahead")
    moved = F.expr("char_length(text) div 3").cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.char_length("text") - moved), F.substring("next_text", F.lit(1), moved)
    )
    found = paired.select(
        "id", "hash", F.char_length("text").cast("long").alias("n_chars"), "tree", "next_tree", edited.alias("edited")
    )
    found = _with_tree(found, "edited", "edited_tree")
    trees = ("tree", "edited_tree", "next_tree")
    found = found.select(
        "id", "hash", "n_chars", "edited", *trees, *[clause_digests(F.col(t)).alias(f"of_{t}") for t in trees]
    )
    near = {
        name: _likeness(F.col("of_tree"), F.col(f"of_{t}"), root(F.col("tree")) == root(F.col(t)))
        for name, t in (("near_edited", "edited_tree"), ("near_next", "next_tree"))
    }
    found = found.select(
        "id", "hash", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.col("tree").alias("fingerprint"), F.col("edited_tree").alias("edited_fingerprint"),
        *[c.alias(n) for n, c in near.items()],
    )
    if any_repeated:
        found = materialize(found, "fingerprints")
        same = [F.col("f.id").eqNullSafe(F.col("r.id")), F.col("f.hash") == F.col("r.hash")]
        names = found.columns[2:]
        found = rows.select("id", "hash").alias("r").join(found.alias("f"), same).select("r.id", *names)
    return found.select(F.col("id").alias(id_column), *found.columns[1 if any_repeated else 2:])
