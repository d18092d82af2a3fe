"""Running values over long ordered groups, without one task per group.

A group is cut into blocks of its order. Each block is summed up first; what came before a block is
then one small row per block, and the rows of a block meet only each other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEFORE = (Window.unboundedPreceding, -1)
UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)


def carried(
    blocks: DataFrame, keys: Sequence[str], block: str, aggregates: Mapping[str, Column]
) -> DataFrame:
    """Per key and block, the aggregate over all earlier blocks (null for the first)."""
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(*BEFORE)
    return blocks.select(
        *keys, block, *[agg.over(earlier).alias(name) for name, agg in aggregates.items()]
    )


def with_previous(
    df: DataFrame, keys: Sequence[str], order: str, block: Column, columns: Sequence[str]
) -> DataFrame:
    """Add ``previous_<column>``: the value in the row before, by ``order`` within the keys.

    ``block`` must not fall as ``order`` rises. Within a block this is ``lag``; the first row of a
    block takes the last row of the block before. Rows of equal ``order`` follow each other by ``columns``.
    """
    cut = df.withColumn("__block", block)
    last = F.max_by(F.struct(*columns), F.struct(order, *columns))
    ends = cut.groupBy(*keys, "__block").agg(last.alias("__end"))
    by_block = Window.partitionBy(*keys).orderBy("__block")
    starts = ends.select(*keys, "__block", F.lag("__end").over(by_block).alias("__start"))
    inside = Window.partitionBy(*keys, "__block").orderBy(order, *columns)
    joined = cut.join(starts, [*keys, "__block"])
    ranked = joined.withColumn("__lag", F.lag(F.struct(*columns)).over(inside))
    previous = F.coalesce("__lag", "__start")
    return ranked.select(*df.columns, *[previous[c].alias(f"previous_{c}") for c in columns])


def running_total(
    df: DataFrame, keys: Sequence[str], order: str, block: Column, column: str, name: str
) -> DataFrame:
    """Add ``name``: the sum of ``column`` up to each row, by ``order`` within the keys.

    ``block`` must not fall as ``order`` rises. ``df`` is read twice.
    """
    cut = df.withColumn("__block", block)
    sums = cut.groupBy(*keys, "__block").agg(F.sum(column).alias("__sum"))
    before = carried(sums, keys, "__block", {"__before": F.sum("__sum")})
    inside = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(*UP_TO_HERE)
    total = F.coalesce(F.col("__before"), F.lit(0)) + F.sum(column).over(inside)
    return cut.join(before, [*keys, "__block"]).select(*df.columns, total.alias(name))


# Rows of a piece of a group; a frame of some rows before each row reaches into the piece before.
PIECE_ROWS = 4096


def numbered_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, name: str = "__row"
) -> DataFrame:
    """Add ``name``: the place of each row in its group, from 0, without one task per group.

    ``block`` must not fall as the order rises. Rows that are equal in ``order`` are in any order.
    """
    cut = df.withColumn("__block", block)
    sizes = cut.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = carried(sizes, keys, "__block", {"__before": F.sum("__n")})
    inside = Window.partitionBy(*keys, "__block").orderBy(*order)
    place = F.coalesce(F.col("__before"), F.lit(0)) + F.row_number().over(inside) - 1
    # a group of null keys is one too
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "__block"]]
    joined = cut.alias("c").join(before.alias("b"), same).select("c.*", "__before")
    return joined.withColumn(name, place).drop("__block", "__before")


def over_last_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, last: int,
    aggregates: Mapping[str, Column],
) -> DataFrame:
    """Add aggregates over the ``last`` rows before each row, by ``order`` within the keys.

    Rows are numbered, and a group is cut into pieces of equal numbers of rows; each piece also gets the
    last rows of the piece before. So every frame lies in one piece and a group uses many tasks.
    """
    size = max(PIECE_ROWS, last)
    rows = numbered_rows(df, keys, order, block)
    piece = F.expr(f"__row div {size}")
    pieces = F.when(F.col("__row") % size >= size - last, F.array(piece, piece + 1)).otherwise(F.array(piece))
    dealt = rows.select("*", F.explode(pieces).alias("__piece"))
    frame = Window.partitionBy(*keys, "__piece").orderBy("__row").rowsBetween(-last, -1)
    found = dealt.select("*", *[agg.over(frame).alias(name) for name, agg in aggregates.items()])
    return found.filter(piece == F.col("__piece")).drop("__row", "__piece")
