"""Address patterns: words between ``.``, ``*`` for one word, ``>`` or ``#`` for any words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANY_WORDS = (">", "#")
ONE_WORD = "*"


def pattern_regex(pattern: Column) -> Column:
    """The pattern as an anchored regex for the address with a dot before it.

    Any-words also stands for no word at all.
    """
    words = F.split(F.translate(pattern, "#", ">"), r"\.")
    parts = F.transform(
        words,
        lambda w, i: F.when(w == ">", F.lit(r"(?:\.[^.]+)*"))
        .when(w == ONE_WORD, F.lit(r"\.[^.]+"))
        .otherwise(F.concat(F.lit(r"\.\Q"), w, F.lit(r"\E"))),
    )
    return F.concat(F.lit(r"\A"), F.array_join(parts, ""), F.lit(r"\z"))


def normalized(pattern: Column) -> Column:
    """One sign for any-words, and one any-words from the first to the last of them."""
    return F.regexp_replace(F.translate(pattern, "#", ">"), r"(^|\.)>(?:\..*\.>|\.>)(?=\.|$)", "$1>")


def shape(pattern: Column) -> Column:
    """What kind of word stands at each place, such as ``w.w.*.>``."""
    return F.array_join(
        F.transform(
            F.split(normalized(pattern), r"\."),
            lambda w: F.when(w.isin(">", ONE_WORD), w).otherwise(F.lit("w")),
        ),
        ".",
    )


def length_of(shape_: Column) -> Column:
    """The number of places of a shape, and whether it has any-words."""
    places = F.split(shape_, r"\.")
    return F.struct(F.size(places).alias("places"), F.array_contains(places, ">").alias("open"))


def lengths_for(address: Column) -> Column:
    """The ``length_of`` all shapes that an address can match: as many places as it has words, or any-words
    and up to one place more."""
    n = F.size(F.split(address, r"\."))
    opened = F.transform(F.sequence(F.lit(1), n + 1), lambda p: F.struct(p.alias("places"), F.lit(True).alias("open")))
    return F.array_append(opened, F.struct(n.alias("places"), F.lit(False).alias("open")))


def generalize(address: Column, shape_: Column) -> Column:
    """The only pattern of the given shape that can match the address; null when none can.

    Places before any-words count from the front, places after it from the back.
    """
    words, places = F.split(address, r"\."), F.split(shape_, r"\.")
    open_at = F.array_position(places, ">")  # 1-based, 0 when absent
    surplus = F.size(words) - F.size(places)
    fits = F.when(open_at == 0, surplus == 0).otherwise(surplus >= -1)
    generalized = F.array_join(
        F.transform(
            places,
            lambda place, i: F.when(
                place == "w",
                F.get(words, F.when((open_at == 0) | (i < open_at), i).otherwise(i + surplus)),
            ).otherwise(place),
        ),
        ".",
    )
    return F.when(fits, generalized)
