"""Readings of vehicles: outliers against the last readings, and exits from a zone.

A vehicle with very many readings is spread over many tasks: frames are bounded in rows and cross the borders
of blocks, and stays outside a zone are numbered by running counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.times import millis
from tidewire.plans.running import over_last_rows, running_total

# Cells of the grid per side of a zone's bounding box, about.
GRID = 16


def flag_outliers(
    readings: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, block: Column, *,
    last: int = 10, least: int = 5, deviations: int = 3,
) -> DataFrame:
    """``readings`` with ``seen`` (how many of the ``last`` readings before there are) and ``outlier``: the value,
    a whole number, is more than so many standard deviations from their mean.

    Readings with fewer than ``least`` before them are never outliers. The rule is checked in whole
    numbers, so nothing depends on the order of sums.
    """
    x = F.col(value).cast("decimal(38,0)")
    aggregates = {
        "seen": F.count(value), "__sum": F.sum(x), "__squares": F.sum((x * x).cast("decimal(38,0)")),
    }
    with_frame = over_last_rows(readings, keys, order, block, last, aggregates)
    n = F.col("seen").cast("decimal(38,0)")
    off = (n * x - F.col("__sum")).cast("decimal(18,0)")
    spread = (n * F.col("__squares") - F.col("__sum") * F.col("__sum")).cast("decimal(38,0)")
    far = (off * off).cast("decimal(38,0)") > (spread * (deviations * deviations)).cast("decimal(38,0)")
    outlier = F.coalesce((F.col("seen") >= least) & far, F.lit(False))
    return with_frame.withColumn("outlier", outlier).drop("__sum", "__squares")


def inside(x: Column, y: Column, corners: Column) -> Column:
    """Whether a point lies in a polygon: a ray to the right crosses its border an odd number of times.

    ``corners``: array of (x, y), whole numbers, in order; a corner on the ray belongs to the upper edge.
    """
    n = F.size(corners)

    def crossed(a: Column, i: Column) -> Column:
        b = F.element_at(corners, F.when(i + 2 > n, 1).otherwise(i + 2).cast("int"))
        rises = b["y"] > a["y"]
        side = (x - a["x"]) * (b["y"] - a["y"]) - (b["x"] - a["x"]) * (y - a["y"])
        return ((a["y"] > y) != (b["y"] > y)) & F.when(rises, side < 0).otherwise(side > 0)

    return F.size(F.filter(corners, crossed)) % 2 == 1


def _cell(value: Column, width: Column) -> Column:
    """The number of the cell on an axis; rounds down, for negative values too."""
    return F.call_function("div", value - F.pmod(value, width), width)


def zone_cells(zones: DataFrame, grid: int = GRID) -> DataFrame:
    """The grid cells that a zone may touch: ``zone, width, cx, cy, corners``.

    ``zones``: ``zone, corners``. ``corners`` is null for a cell that lies in the zone wholly, where no point
    needs the polygon; cells that the zone cannot touch are left out.
    """
    xs, ys = F.transform("corners", lambda c: c["x"]), F.transform("corners", lambda c: c["y"])
    extent = F.greatest(F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))
    width = F.greatest(F.lit(1), F.ceil(extent / grid)).cast("bigint")
    sized = zones.select("zone", "corners", width.alias("width"), xs.alias("xs"), ys.alias("ys"))

    def cells(values: str) -> Column:
        least, most = F.array_min(values), F.array_max(values)
        return F.sequence(_cell(least, F.col("width")), _cell(most, F.col("width")))

    wide = sized.select("zone", "corners", "width", F.explode(cells("xs")).alias("cx"), "ys")
    wide = wide.select("zone", "corners", "width", "cx", F.explode(cells("ys")).alias("cy"))
    left, low = F.col("cx") * F.col("width"), F.col("cy") * F.col("width")
    right, high = left + F.col("width"), low + F.col("width")
    n = F.size("corners")

    def near(a: Column, i: Column) -> Column:
        """An edge whose box meets that of the cell."""
        b = F.element_at("corners", F.when(i + 2 > n, 1).otherwise(i + 2).cast("int"))
        return (
            (F.least(a["x"], b["x"]) <= right) & (F.greatest(a["x"], b["x"]) >= left)
            & (F.least(a["y"], b["y"]) <= high) & (F.greatest(a["y"], b["y"]) >= low)
        )

    border = F.size(F.filter("corners", near)) > 0
    marked = wide.withColumns({"border": border, "corner_in": inside(left, low, F.col("corners"))})
    touched = marked.filter("border or corner_in")
    return touched.select(
        "zone", "width", "cx", "cy", F.when(F.col("border"), F.col("corners")).alias("corners")
    )


def in_zone(points: DataFrame, zones: DataFrame, grid: int = GRID) -> DataFrame:
    """``points`` (with ``zone, x, y``) and ``inside``: whether the point lies in its zone.

    Cells decide most points by an equi-join; only those in cells at the border are held against the
    polygon. A point whose zone is not known is outside.
    """
    cells = zone_cells(zones, grid)
    widths = cells.select("zone", "width").distinct()
    placed = points.join(widths, "zone", "left")
    for axis in ("x", "y"):
        placed = placed.withColumn(f"c{axis}", _cell(F.col(axis), F.col("width")))
    known = cells.withColumn("__cell", F.lit(True)).drop("width")
    met = placed.join(known, ["zone", "cx", "cy"], "left")
    in_cell = F.when(F.col("__cell"), F.col("corners").isNull() | inside(F.col("x"), F.col("y"), F.col("corners")))
    return met.select(*points.columns, F.coalesce(in_cell, F.lit(False)).alias("inside"))


def exits(
    readings: DataFrame, keys: Sequence[str], block: Column, at_least_ms: int, order: Sequence[str] = ("ts",)
) -> DataFrame:
    """Stays outside that last a period or more: ``keys, left_at, returned_at, outside_ms, readings``.

    ``readings``: ``keys, ts, inside``, in the order of ``order``, which begins with the time. A stay begins with the first reading outside
    after one inside and ends with the next inside; one that has not ended counts up to its last reading.
    ``block`` must not fall as the time rises. Each reading inside begins a new number, so a stay is
    the readings outside with one number, wherever they lie.
    """
    keys = list(keys)
    counted = readings.withColumns({"__in": F.col("inside").cast("bigint"), "__at": F.struct(*order)})
    numbered = running_total(counted, keys, "__at", block, "__in", "__stay")
    per_stay = numbered.groupBy(*keys, "__stay").agg(
        F.min(F.when(~F.col("inside"), F.col("ts"))).alias("left_at"),
        F.max(F.when(~F.col("inside"), F.col("ts"))).alias("last"),
        F.min(F.when(F.col("inside"), F.col("ts"))).alias("came"),
        F.count_if(~F.col("inside")).alias("readings"),
    )
    back = per_stay.select(*keys, (F.col("__stay") - 1).alias("__stay"), F.col("came").alias("returned_at"))
    stays = per_stay.filter("__stay > 0 and readings > 0").join(back, [*keys, "__stay"], "left")
    outside = millis(F.coalesce("returned_at", "last")) - millis(F.col("left_at"))
    return stays.withColumn("outside_ms", outside).filter(F.col("outside_ms") >= at_least_ms).select(
        *keys, "left_at", "returned_at", "outside_ms", "readings"
    )
