"""Perceptual hashes as two halves of 32 bits each, and distances between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediaqc.functions import transforms

HASHES = ("ph", "dh", "wh")


def _bits(values: Column, n: int, start: Column, bit, follow=lambda held, x: held) -> Column:
    """The ``n`` bits of up to 32 values as a number, the first as the highest of 32. ``bit`` compares what is held, computed once, with a value."""
    begin = F.struct(F.lit(0).cast("long").alias("acc"), start.alias("held"))

    def step(s: Column, x: Column) -> Column:
        return F.struct((s["acc"] * 2 + F.when(bit(s["held"], x), 1).otherwise(0)).alias("acc"), follow(s["held"], x).alias("held"))

    return F.aggregate(values, begin, step, lambda s: s["acc"] * F.lit(1 << (32 - n)))


def sign_hashes(vector: Column) -> dict[str, Column]:
    """Hashes of a vector of 64: its signs, its gradients and its comparison with the median. Each reads the vector once."""
    e = vector.cast("array<double>")
    ordered = F.array_sort(e)
    median = (F.element_at(ordered, 32) + F.element_at(ordered, 33)) / 2
    above = lambda held, x: x > held
    out = {}
    for side, first in (("hi", 1), ("lo", 33)):
        half = F.slice(e, first, 32)
        out[f"ph_{side}"] = _bits(half, 32, F.lit(0.0), above)
        out[f"dh_{side}"] = _bits(F.slice(e, first + 1, 32), 32 if first == 1 else 31, F.element_at(e, first), above, lambda held, x: x)
        out[f"wh_{side}"] = _bits(half, 32, median, above)
    return {f"{n}_{side}": out[f"{n}_{side}"] for n in HASHES for side in ("hi", "lo")}


def transform_hashes(grid: Column, side: int = 8) -> dict[str, Column]:
    """Hashes of a grid of side x side (8, 16, 32, ...) by transforms: which of the 64 lowest frequencies are above their
    median (ph), and which of the 64 coarsest cells, by Haar wavelets without the mean, are above theirs (wh)."""
    out = {}
    for name, values in (("ph", transforms.low_cosines(grid, side)), ("wh", transforms.coarse_haar(grid, side))):
        ordered = transforms.let(values, lambda v: F.struct(v.alias("values"), F.array_sort(v).alias("sorted")))
        median = lambda s: (F.element_at(s["sorted"], 32) + F.element_at(s["sorted"], 33)) / 2
        both = transforms.let(ordered, lambda s: F.struct(*[_bits(F.slice(s["values"], first, 32), 32, median(s), lambda held, x: x > held).alias(half) for half, first in (("hi", 1), ("lo", 33))]))
        out |= {f"{name}_{half}": both[half] for half in ("hi", "lo")}
    return out


def hamming(name: str, a: str = "a", b: str = "b") -> Column:
    """The number of bits that differ between the hashes of sides ``a`` and ``b``."""
    return sum((F.bit_count(F.col(f"{a}.{name}_{s}").bitwiseXOR(F.col(f"{b}.{name}_{s}"))) for s in ("hi", "lo")), F.lit(0)).cast("int")


def whole(name: str) -> Column:
    """The 64 bits of a hash as one (signed) number."""
    return F.shiftleft(F.col(f"{name}_hi"), 32).bitwiseOR(F.col(f"{name}_lo"))


def from_hex(text: Column) -> tuple[Column, Column]:
    """Halves of a hash written in 16 hex digits; null for anything else."""
    ok = text.rlike("^[0-9A-Fa-f]{16}$")
    half = lambda start: F.when(ok, F.conv(F.substring(text, start, 8), 16, 10).cast("long"))
    return half(1), half(9)
