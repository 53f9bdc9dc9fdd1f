"""Mixing sources to target weights by weighted fair queueing.

Each source is a shuffled stream of its documents, passed over up to ``MAX_EPOCHS`` times. A document's copy has the
virtual finish time (words of its source up to and with it) / (the source's target). In a fluid system all sources are
served at their weights and the total budget (all words) is reached at time 1, as the targets add up to it; the global
order is cut there. Documents stay whole: a copy is taken if at least half of it is served by then, so that each source
ends within half a document of its target. The cut is a comparison with a known time, so no global sort is left to do.

The stream of a source is ordered by a hash of the id in buckets of hash ranges, as many as the root of the source's rows;
cumulative words are prefix sums over buckets plus a window inside each, so that no source meets in one task. Rows that
are repeated whole stand next to each other in the stream as one entry with a number, and are told apart at the end.
Sources themselves are numbered and summed by ranges, so that there may be any number of them.

Defined results: a null text or one without words has size 0 and is never taken; the null source is a source of its own,
last in order; repeated rows are rows of their own; a copy that is half served counts as taken; without any word all
targets are 0; an empty table gives an empty table; columns of any other names are not read, or carried as they came. The
same rows give the same mix on each run, however they are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaqc.llm.common import WORD, cut, documents, forget, text_of

MAX_EPOCHS = 3
#: Copies of a repeated row that one task writes.
REPEATS = 1000


def size_of(text_col: str) -> Column:
    return F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """(id, source, size, tie, m): a row for each different one, with its number; ``tie`` orders the stream."""
    order = F.xxhash64(F.lit(seed), F.col(id_col), F.col(source_col))
    slim = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(text_col).alias("size"), order.alias("tie"))
    return slim.groupBy("id", "source", "size", "tie").agg(F.count(F.lit(1)).alias("m"))


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds to each row of a cut table the sums over the rows before it in a global order: ranges, then windows in each."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = {f"_v{k}": v for k, v in enumerate(sums.values())}
    parted = cut(rows.withColumns(values).repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = parted.groupBy("_part").agg(*[F.sum(v).alias(f"_t{v}") for v in values])  # at most n rows
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_part").alias("_p"), *[F.coalesce(F.sum(f"_t{v}").over(earlier), F.lit(0)).alias(f"_o{v}") for v in values])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = parted.join(F.broadcast(offsets), F.col("_part") == F.col("_p"))
    out = out.withColumns({name: F.col(f"_o{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for name, v in zip(sums, values, strict=True)})
    made = cut(out.select(*rows.columns, *sums), "sums")
    forget(parted)
    return made


def targets(slim: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """A row a source: rank by name, words, rows, weight and target; targets stop at max_epochs times the source.

    The sources that stop are the first in order of most / weight; the level at which the others are filled follows from
    the sums before the first of them.
    """
    named = cut(slim.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.lit(1)).alias("n_rows")), "sources")
    ranked = running(named, [F.col("source").asc_nulls_last()], {"source_rank": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("source_rank"), F.lit(len(weights))) + 1).cast("int"))
    t = cut(ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * max_epochs).withColumn("ratio", F.col("most") / F.col("weight")), "weighed")
    filled = running(t, [F.col("ratio"), F.col("source_rank")], {"most_before": F.col("most"), "weight_before": F.col("weight")})
    forget(named, ranked)
    total = t.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    rest, rest_weight = F.lit(total[0]) - F.col("most_before"), F.lit(total[1]) - F.col("weight_before")
    full = F.col("most") * rest_weight <= rest * F.col("weight")
    first = filled.where(~full).agg(F.min(F.struct("ratio", "source_rank", (rest / rest_weight).alias("level")))).first()[0]
    forget(t)
    target = F.when(full, F.col("most").cast("double"))
    target = target.otherwise(F.lit(float(first.level)) * F.col("weight")) if first is not None else target
    made = cut(filled.select("source", "source_rank", "source_size", "n_rows", target.alias("target")), "targets")
    forget(filled)
    return made


def queued(slim: DataFrame, by_source: DataFrame) -> DataFrame:
    """Each entry with its source's figures and ``before``, the words of its source's stream before it."""
    of = by_source.withColumnRenamed("source", "_source")
    joined = slim.join(of, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    n_buckets = F.ceil(F.sqrt("n_rows"))  # as many buckets as rows in a bucket
    lot = F.shiftrightunsigned("tie", 33)  # 31 bits, uniform
    rows = joined.withColumn("bucket", F.shiftright(lot * n_buckets, 31).cast("int")).withColumn("words", F.col("size") * F.col("m"))
    key = ["source_rank", "bucket"]
    earlier = Window.partitionBy("source_rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*key).agg(F.sum("words").alias("bucket_words")).withColumn("earlier", F.coalesce(F.sum("bucket_words").over(earlier), F.lit(0))).drop("bucket_words")
    inside = Window.partitionBy(*key).orderBy(*stream()).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("inside", F.coalesce(F.sum("words").over(inside), F.lit(0)))
        .join(offsets, key)
        .withColumn("before", F.col("earlier") + F.col("inside"))
        .drop("earlier", "inside", "bucket", "n_rows", "words")
    )


def stream() -> list[Column]:
    """The order of a source's stream: that of the unsigned hash, then id and size."""
    return [F.shiftrightunsigned("tie", 33), F.col("tie"), F.col("id"), F.col("size")]


def copies(before: Column, max_epochs: int) -> Column:
    """How many passes take a document of ``size`` that starts at ``before``: half of its copy is served at time 1."""
    halves = [F.when((F.col("size") > 0) & (2 * (e * F.col("source_size") + before) + F.col("size") <= 2 * F.col("target")), 1).otherwise(0) for e in range(max_epochs)]
    return sum(halves[1:], halves[0])


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, copies): how often the mix takes each row."""
    rows = queue(docs, weights, max_epochs, seed, id_col, text_col, source_col)
    one = rows.where("m = 1").withColumn("k", F.lit(0).cast("long"))
    # repeated rows: their numbers are made in many tasks
    parts = rows.where("m > 1").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / REPEATS)))).repartition("id", "source", "part")
    last = F.least(F.col("m"), (F.col("part") + 1) * REPEATS) - 1
    many = parts.withColumn("k", F.explode(F.sequence(F.col("part") * REPEATS, last))).drop("part")
    found = one.unionByName(many.select(one.columns))
    return found.select("id", "source", "size", "source_size", "target", copies(F.col("before") + F.col("k") * F.col("size"), max_epochs).alias("copies"))


def queue(docs, weights, max_epochs, seed, id_col, text_col, source_col) -> DataFrame:
    slim = cut(sizes(docs, id_col, text_col, source_col, seed), "sizes")
    by_source = targets(slim, weights, max_epochs)
    rows = cut(queued(slim, by_source), "queue")
    forget(slim, by_source)
    return rows


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of the mix, all columns as they came whatever their names, each as often as the mix takes it.

    What a source gives is some whole passes over its stream and the head of one more, so a row a source tells each row
    of ``docs`` how often it is taken; no text is moved. Only where the head ends among repeated rows are these numbered.
    """
    rows = queue(docs, weights, max_epochs, seed, id_col, text_col, source_col).where("size > 0")
    first, last = copies(F.col("before"), max_epochs), copies(F.col("before") + (F.col("m") - 1) * F.col("size"), max_epochs)
    place = F.struct(*[x.alias(f"p{k}") for k, x in enumerate(stream())])
    taken = rows.select("source", place.alias("place"), first.alias("first"), last.alias("last"), "before", "m", "size", "source_size", "target")
    passes = taken.groupBy("source").agg(F.min("last").alias("passes"))
    both = taken.join(passes.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # the entry where the head ends: of repeated rows its first ones may be in the head and the others not
    heads = both.where("first > passes").groupBy("source").agg(F.max(F.struct("place", "last", "before", "m", "size", "source_size", "target")).alias("end"))
    ends = passes.join(heads.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").select(F.col("source").alias("_source"), "passes", "end")
    ends = cut(ends.withColumn("split", F.coalesce(F.col("end.last") == F.col("passes"), F.lit(False))), "ends")
    forget(rows)
    order = F.xxhash64(F.lit(seed), F.col(id_col), F.col(source_col))
    here = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("_from"), F.col(id_col).alias("id"), size_of(text_col).alias("size"), order.alias("tie")).where("size > 0")
    met = here.withColumn("place", place).join(ends, F.col("_from").eqNullSafe(F.col("_source")))
    at_end = F.coalesce(F.col("split") & (F.col("place") == F.col("end.place")), F.lit(False))
    in_head = F.coalesce(F.col("place") <= F.col("end.place"), F.lit(False))
    counted = met.where(~at_end).withColumn("times", F.col("passes") + F.when(in_head, 1).otherwise(0)).select("row", "times")
    if not ends.where("split").isEmpty():
        counted = counted.unionByName(numbered(met.where(at_end), max_epochs))
    return counted.where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def numbered(rows: DataFrame, max_epochs: int) -> DataFrame:
    """(row, times) of repeated rows at the end of a head: each gets a number among those of its source, without one task
    for a source: partitions are counted, then numbered inside by the row numbers that they were written with."""
    kept = cut(rows.select("row", F.col("_source"), "end", F.monotonically_increasing_id().alias("number")), "repeated")
    part = F.shiftright("number", 33)
    counts = kept.groupBy("_source", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("least"))
    earlier = Window.partitionBy("_source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_source").alias("source"), "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))  # a row a source and partition
    inside = Window.partitionBy("_source", "part").orderBy("number")
    at = kept.withColumn("part", part).withColumn("k", F.row_number().over(inside) - 1).alias("a").join(offsets.alias("o"), F.col("a._source").eqNullSafe(F.col("o.source")) & (F.col("a.part") == F.col("o.part")))
    at = at.select("row", (F.col("k") + F.col("offset")).alias("k"), F.col("end.before").alias("before"), F.col("end.size").alias("size"), F.col("end.source_size").alias("source_size"), F.col("end.target").alias("target"))
    return at.select("row", copies(F.col("before") + F.col("k") * F.col("size"), max_epochs).alias("times"))


def query(spark, sf_dir: str) -> DataFrame:
    m = mix(documents(spark, sf_dir))
    return m.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
