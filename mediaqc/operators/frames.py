"""Device frames: regions of edge cells that form a large upright or leaning quadrilateral, found by joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaqc.functions import transforms
from mediaqc.operators.graphs import components
from mediaqc.plans.lineage import cut, forget

#: Steps to the neighbours of a cell (down, right) that come after it; the others are the same pairs from the other side.
AFTER = ((0, 1), (1, -1), (1, 0), (1, 1))


def gradients(levels: Column, side: int) -> Column:
    """|horizontal| + |vertical| Sobel gradient of each cell, borders repeated."""

    def at(e: Column, r: Column, k: Column) -> Column:
        inside = lambda x: F.greatest(F.least(x, F.lit(side - 1)), F.lit(0))
        return F.element_at(e, inside(r) * side + inside(k) + 1)

    def cell(e: Column, i: Column) -> Column:
        r, k = F.floor(i / side).cast("int"), i % side
        across = [at(e, r + d, k + 1) - at(e, r + d, k - 1) for d in (-1, 0, 1)]
        down = [at(e, r + 1, k + d) - at(e, r - 1, k + d) for d in (-1, 0, 1)]
        return sum(F.abs(a + 2 * b + c) for a, b, c in (across, down))

    return transforms.let(levels, lambda e: F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: cell(e, i)))


def regions(grids: DataFrame, side: int, low: int, high: int) -> DataFrame:
    """(id, area, height, width, corners' area) of each region of two or more neighbouring cells (eight ways) with gradients
    of at least ``low``, one of them at least ``high``. ``grids`` has id, a whole number, and levels.

    The area is that of the outline through the outermost cells of each row; the corners are the region's ends along both
    diagonals.
    """
    n = side * side
    found = grids.where("id IS NOT NULL AND levels IS NOT NULL").groupBy("id").agg(F.min("levels").alias("levels"))
    cells = found.select("id", F.posexplode(gradients(F.col("levels"), side)).alias("cell", "g")).where(F.col("g") >= low)
    cells = cut(cells.select("id", "cell", "g", (F.col("id") * n + F.col("cell")).alias("node")), "edge_cells")
    r, k = F.floor(F.col("cell") / side).cast("int"), F.col("cell") % side
    steps = [F.when((r + down < side) & (k + right).between(0, side - 1), F.col("node") + down * side + right) for down, right in AFTER]
    near = cells.select(F.col("node").alias("l"), F.explode(F.array_compact(F.array(*steps))).alias("r"))
    pairs = near.join(cells.select(F.col("node").alias("r")), "r", "left_semi").select("l", "r")
    labelled = cells.join(components(pairs), "node").withColumn("r", r).withColumn("k", k)
    rows = labelled.groupBy("id", "root", "r").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.max("g").alias("g"))

    def corner(best, place: Column, end: str, name: str) -> Column:
        return best(F.struct(place, F.col("r").alias("r"), F.col(end).alias("k"))).alias(name)

    ends = [corner(F.min, F.col("r") + F.col("lo"), "lo", "a"), corner(F.min, F.col("r") - F.col("hi"), "hi", "b"), corner(F.max, F.col("r") + F.col("hi"), "hi", "c"), corner(F.max, F.col("r") - F.col("lo"), "lo", "d")]
    wide = F.col("hi") - F.col("lo")
    whole = rows.groupBy("id", "root").agg(
        (F.sum(wide) - (F.min_by(wide, "r") + F.max_by(wide, "r")) / 2.0).alias("area"),
        (F.max("r") - F.min("r") + 1).alias("height"), (F.max("hi") - F.min("lo") + 1).alias("width"), F.max("g").alias("g"), *ends,
    )
    around = "abcda"
    twice = sum((F.col(f"{p}.r") * F.col(f"{q}.k") - F.col(f"{q}.r") * F.col(f"{p}.k") for p, q in zip(around, around[1:], strict=False)), F.lit(0))
    out = cut(whole.where(F.col("g") >= high).select("id", "area", "height", "width", (F.abs(twice) / 2.0).alias("quad")), "regions")
    forget(cells)
    return out


def frames(grids: DataFrame, side: int = 8, low: int = 50, high: int = 150, share: float = 0.3, slack: float = 0.1) -> DataFrame:
    """(id, has_bezel, bezel_score, regions): whether a region of more than ``share`` of the grid is a quadrilateral, within
    ``slack`` of its area, and neither very wide nor very high; the score is the share of the largest one.

    Regions are components of the graph of neighbouring edge cells; a grid has side x side cells at most, so no grid is
    hot. Defined results: of a repeated id the least grid counts; null or malformed levels, flat grids and single cells have no frame; an
    empty table gives an empty table; a null id takes no part.
    """
    of = regions(grids, side, low, high)
    aspect = F.col("width") / F.col("height")
    frame = (F.col("area") > share * side * side) & (F.abs(F.col("quad") - F.col("area")) <= slack * F.col("area")) & (aspect > 0.3) & (aspect < 3.0)
    best = of.groupBy("id").agg(F.max(F.when(frame, F.least(F.col("area") / F.lit(side * side), F.lit(1.0)))).alias("best"), F.count(F.lit(1)).alias("n"))
    return grids.where("id IS NOT NULL").select("id").distinct().join(best, "id", "left").select(
        "id", F.col("best").isNotNull().alias("has_bezel"), F.coalesce("best", F.lit(0.0)).alias("bezel_score"), F.coalesce("n", F.lit(0)).cast("long").alias("regions")
    )
