"""What several operators share: the words of a text, bounded memory of workers, sieves, rows that stay."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaqc.plans.lineage import cut, forget, shared_folder

__all__ = ["COUNTERS", "SPACE", "WORD", "Remembered", "cut", "documents", "forget", "shared_folder", "sieve", "sifted", "slices", "text_of", "thinned"]

#: White space of the operators' contracts: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: A key with more than 1/COUNTERS of all rows counts as hot; there are fewer than COUNTERS of them.
COUNTERS = 2000


def text_of(column: str):
    """The text, with null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


class Remembered(dict):
    """key -> ``make(key)``, kept for at most ``most`` keys of up to 64 characters.

    Made anew in each task: workers are reused by later stages, and what a module remembers would stay in them.
    """

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches a few rows at a time, so that what Python makes of them is small; at the end the worker gives back what Arrow held."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


#: Bits a key of a sieve, and words of 64 bits at most: 134 million bits, about 100 MB as a broadcast table.
SIEVE_BITS, MOST_SIEVE_WORDS = 16, 1 << 21


def sieve(keys: DataFrame, *columns: str) -> DataFrame:
    """(_word, _bits): a bit for the hash of each key. A key whose bit is unset is not in it.

    It grows with the number of keys up to ``MOST_SIEVE_WORDS`` rows. Beyond some ten million keys more and more other
    rows pass it and take the ordinary join behind it, at worst all.
    """
    words, n_keys = 1 << 8, keys.count()
    while words < MOST_SIEVE_WORDS and words * 64 < n_keys * SIEVE_BITS:
        words *= 2
    h = F.xxhash64(*columns)
    found = keys.select(F.pmod(h, F.lit(words)).alias("_word"), F.shiftrightunsigned(h, 58).cast("int").alias("_bit"))
    made = cut(found.groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits")), "sieve")
    made._words = words
    return made


def sifted(rows: DataFrame, made: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with ``_maybe``, false where the key is surely not in the sieve: those rows need no join, so no shuffle.

    ``rows`` has no columns but the caller's own: what came from outside is packed in one of them.
    """
    h = F.xxhash64(*columns)
    marked = rows.withColumn("_word", F.pmod(h, F.lit(made._words))).join(F.broadcast(made), "_word", "left")
    hit = F.call_function("getbit", F.col("_bits"), F.shiftrightunsigned(F.xxhash64(*columns), 58).cast("int"))
    return marked.withColumn("_maybe", F.coalesce(hit == 1, F.lit(False))).drop("_word", "_bits")


def thinned(rows: DataFrame, changed: DataFrame, keys: list[str], total: int, order: Column) -> DataFrame:
    """The packed ``row`` columns that stay: those whose keys are not in ``changed``, and of equal keys there one or none.

    ``rows`` has row (a struct) and the keys; ``changed`` has the keys, n_rows (of all ``total`` rows) and stays. A sieve
    keeps other rows out of every shuffle. Keys of more than 1/COUNTERS of all rows meet a broadcast of fewer than COUNTERS
    rows; which one of equal rows stays (the greatest by ``order``) is found by partial aggregation.
    """
    marked = sifted(rows.withColumn("_order", order), sieve(changed, *keys), *keys)
    maybe = marked.where("_maybe")
    table = changed.select(*[F.col(k).alias(f"_{k}") for k in keys], "n_rows", "stays")
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    mine = ["row", "_order", *keys]
    hot = F.col("n_rows") * COUNTERS > F.lit(total)
    often = maybe.join(F.broadcast(table.where(hot)), match, "left").select(*mine, "stays")
    seldom = often.where("stays IS NULL").drop("stays").join(table.where(~hot), match, "left").select(*mine, "stays")
    out = marked.where("NOT _maybe").select("row").unionByName(seldom.where("stays IS NULL").select("row"))
    if not changed.where("stays").isEmpty():
        repeated = often.where("stays").unionByName(seldom.where("stays"))
        out = out.unionByName(repeated.groupBy(*keys).agg(F.max_by("row", "_order").alias("row")).select("row"))
    return out.select("row.*")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
