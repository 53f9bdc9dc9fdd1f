"""Two-dimensional transforms of small grids as matrix products in array expressions: cosines, Haar wavelets, recompression.

A grid is a row-major array of side x side numbers. Defined results: a null grid, one with a null or non-finite
component and one of another length give null.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The luminance table of the public still-image standard, at quality 50, by row.
LUMINANCE = (
    (16, 11, 10, 16, 24, 40, 51, 61),
    (12, 12, 14, 19, 26, 58, 60, 55),
    (14, 13, 16, 24, 40, 57, 69, 56),
    (14, 17, 22, 29, 51, 87, 80, 62),
    (18, 22, 37, 56, 68, 109, 103, 77),
    (24, 35, 55, 64, 81, 104, 113, 92),
    (49, 64, 78, 87, 103, 121, 120, 101),
    (72, 92, 95, 98, 112, 100, 103, 99),
)
#: Transformed values are compared at so many decimals, so that the order in which they are added never decides.
DECIMALS = 9


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also inside lambdas; null for null."""
    return F.element_at(F.transform(F.array(value), lambda v: F.when(v.isNotNull(), use(v))), 1)


def cosines(rows: int, side: int, orthonormal: bool = False) -> list[list[float]]:
    """The ``rows`` lowest frequencies over ``side`` places."""
    scale = [math.sqrt((1 if u == 0 else 2) / side) if orthonormal else 1.0 for u in range(rows)]
    return [[scale[u] * math.cos((2 * t + 1) * u * math.pi / (2 * side)) for t in range(side)] for u in range(rows)]


def haar(rows: int, side: int) -> list[list[float]]:
    """The ``rows`` coarsest orthonormal Haar wavelets over ``side`` places, both powers of two; the first is the mean."""
    out = [[1 / math.sqrt(side)] * side]
    for u in range(1, rows):
        level = u.bit_length() - 1
        width = side >> level
        start = (u - (1 << level)) * width
        out.append([(math.sqrt(1 / width) if t - start < width // 2 else -math.sqrt(1 / width)) if start <= t < start + width else 0.0 for t in range(side)])
    return out


def constant(m: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in m])


def rows_of(e: Column, side: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda r: F.slice(e, r * side + 1, F.lit(side)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def two_sided(m: list[list[float]], rows: Column) -> Column:
    """M X M' of the rows of X: the product with the transposed matrix, twice."""

    def times(of: Column) -> Column:
        return F.transform(constant(m), lambda u: F.transform(of, lambda x: dot(u, x)))

    return let(rows, lambda x: let(times(x), times))


def transposed(m: list[list[float]]) -> list[list[float]]:
    return [list(column) for column in zip(*m, strict=True)]


def well_formed(e: Column, side: int) -> Column:
    """The grid as doubles, or null."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when((F.size(e) == side * side) & F.forall(e.cast("array<double>"), finite), e.cast("array<double>"))


def rounded(rows: Column) -> Column:
    return F.transform(F.flatten(rows), lambda x: F.round(x, DECIMALS))


def low_cosines(e: Column, side: int = 8) -> Column:
    """The 8 x 8 lowest frequencies, row-major."""
    return let(well_formed(e, side), lambda x: rounded(two_sided(cosines(8, side), rows_of(x, side))))


def coarse_haar(e: Column, side: int = 8) -> Column:
    """The 8 x 8 approximation of the grid by Haar wavelets, without the mean, row-major; ``side`` is 8, 16, 32 or the like.

    The coarsest 64 coefficients are taken, that of the mean is set to 0, and the others are transformed back.
    """

    def back(coefficients: Column) -> Column:
        no_mean = F.transform(coefficients, lambda row, i: F.transform(row, lambda x, k: F.when((i == 0) & (k == 0), F.lit(0.0)).otherwise(x)))
        return rounded(two_sided(transposed(haar(8, 8)), no_mean))

    return let(well_formed(e, side), lambda x: let(two_sided(haar(8, side), rows_of(x, side)), back))


def grey_levels(e: Column, side: int = 8) -> Column:
    """A grid of any numbers as whole levels from 0 (its least) to 255 (its most); all 0 where they are equal."""

    def level(x: Column) -> Column:
        return let(F.struct(F.array_min(x).alias("low"), F.array_max(x).alias("high")), lambda m: F.transform(x, lambda v: F.when(m["high"] > m["low"], F.floor((v - m["low"]) / (m["high"] - m["low"]) * 255.0)).otherwise(F.lit(0)).cast("int")))

    return let(well_formed(e, side), level)


def quantisers(quality: int) -> list[list[int]]:
    """The luminance table at a quality from 1 to 100."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [[min(max((q * scale + 50) // 100, 1), 255) for q in row] for row in LUMINANCE]


def recompressed(levels: Column, quality: int = 90) -> Column:
    """What a lossy recompression leaves of a block of 8 x 8 grey levels: cosine transform, quantisation, and back."""
    basis = cosines(8, 8, orthonormal=True)
    q = constant(quantisers(quality))

    def kept(c: Column) -> Column:
        return F.zip_with(c, q, lambda row, by: F.zip_with(row, by, lambda x, n: F.floor(F.round(x, DECIMALS) / n + 0.5) * n))

    def shown(x: Column) -> Column:
        return F.greatest(F.least(F.floor(x + 128.0 + 0.5), F.lit(255)), F.lit(0)).cast("int")

    centred = F.transform(well_formed(levels, 8), lambda x: x - 128.0)
    return let(let(centred, lambda x: two_sided(basis, rows_of(x, 8))), lambda c: F.transform(rounded(two_sided(transposed(basis), kept(c))), shown))


def recompression_error(levels: Column, quality: int = 90) -> Column:
    """Mean change of a block by recompression, as a share of 255."""
    changed = F.zip_with(levels, recompressed(levels, quality), lambda a, b: F.abs(a - b))
    return F.aggregate(changed, F.lit(0).cast("long"), lambda s, x: s + x) / (F.size(levels) * 255.0)
