"""Image statistics of small grids as array expressions: a row-major vector of side x side values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def spread(a: Column) -> Column:
    """Population variance."""
    m = _mean(a)
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x) / F.size(a) - m * m


def laplacian_variance(e: Column, side: int = 8) -> Column:
    """Variance of the 3 x 3 Laplacian with borders mirrored without the edge."""

    def mirrored(i: int) -> int:
        return -i if i < 0 else 2 * (side - 1) - i if i >= side else i

    def at(r: int, k: int) -> Column:
        return F.element_at(e, mirrored(r) * side + mirrored(k) + 1)

    cells = [at(r - 1, k) + at(r + 1, k) + at(r, k - 1) + at(r, k + 1) - at(r, k) * 4.0 for r in range(side) for k in range(side)]
    return spread(F.array(*cells))


def row_steps(e: Column, side: int = 8) -> Column:
    """Absolute differences of the means of neighbouring rows."""
    means = F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda r: _mean(F.slice(e, r * side + 1, F.lit(side))))
    return F.transform(F.sequence(F.lit(1), F.lit(side - 1)), lambda r: F.abs(F.element_at(means, r + 1) - F.element_at(means, r)))


def percentile(a: Column, q: float) -> Column:
    """Linear interpolation between order statistics."""
    s = F.array_sort(a)
    at = (F.size(a) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    x, y = F.element_at(s, low + 1), F.element_at(s, F.least(low + 2, F.size(a)))
    return x + (y - x) * (at - low)


def border(e: Column, side: int = 8) -> Column:
    """The values of the outer rows and columns; corners count twice, as they are in both."""
    rows = [F.slice(e, F.lit(1), F.lit(side)), F.slice(e, F.lit(side * (side - 1) + 1), F.lit(side))]
    columns = [F.array(*[F.element_at(e, r * side + k) for r in range(side)]) for k in (1, side)]
    return F.concat(*rows, *columns)


def histogram_peaks(e: Column, bins: int = 32) -> Column:
    """Bins, of ``bins`` equal ones between least and most, with more than three times the mean count."""
    low, high = F.array_min(e), F.array_max(e)
    place = F.transform(e, lambda x: F.least(F.floor((x - low) / (high - low) * bins).cast("int"), F.lit(bins - 1)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(place, lambda p: p == b)))
    return F.size(F.filter(counts, lambda n: n > F.size(e) * 3.0 / bins))
