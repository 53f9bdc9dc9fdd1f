"""Sharding by longest-processing-time scheduling under the law ``bytes``: shard sizes are near equal.

Groups of equal texts stay together; sorted by size, each goes to the least-loaded shard. Groups of one size go through the
heap as one run: what a heap would pop for them is the merge of the shards' loads, each going up by that size, so a run is a
few stretches in which shards take turns, and a group's shard follows from its rank among the groups of its size. The
result is that of all groups one by one, at any number of groups; the driver holds one row a different size, of which
there are at most the square root of twice all bytes. A group that alone exceeds a shard's even share (fewer groups than shards) cannot stay
together under this law and is cut into the fewest pieces. Ranks are counted by ranges of the digest, slots by
1/GRAINS of a shard's rows, and groups with more than 1/GRAINS of all rows are met by a broadcast, so that no shard,
group, size or source meets in one task.

Defined results: a null text counts as empty (size 1) and groups with empty texts; groups of equal size go by their digest;
rows repeated with their id get slots of their own; an empty table gives an empty table; columns of any other names are
not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaqc.llm.common import cut, documents, forget, text_of

#: A group with more than 1/GRAINS of all rows is broadcast with its shard; also the number of cells of a shard's rows.
GRAINS = 4096


def deal(items: list[tuple[int, object]], n: int) -> dict:
    """Longest processing time first: (size, key) to the bin that has the least so far."""
    heap = [(0, b) for b in range(n)]
    placed = {}
    for size, key in sorted(items, key=lambda x: (-x[0], x[1])):
        load, b = heap[0]
        placed[key] = b
        heapq.heapreplace(heap, (load + size, b))
    return placed


def run(loads: list[int], size: int, n: int) -> list[tuple[int, list[int]]]:
    """``n`` items of one size, each to the least-loaded bin: (rank of the first item, bins that take turns from there).

    ``loads`` goes up accordingly. A bin with load l takes items at l, l + size, ...: the items go by these numbers, then by bin. In
    the level floor(number / size) every bin that has reached it takes one, in the order of its remainder.
    """
    level, turn = [x // size for x in loads], sorted(range(len(loads)), key=lambda b: (loads[b] % size, b))
    starts, out, at = sorted(set(level)), [], 0
    for here, following in zip(starts, [*starts[1:], None], strict=True):
        bins = [b for b in turn if level[b] <= here]
        taken = n - at if following is None else min(n - at, (following - here) * len(bins))
        out.append((at, bins))
        each, more = divmod(taken, len(bins))
        for k, b in enumerate(bins):
            loads[b] += size * (each + (k < more))
        at += taken
        if at == n:
            break
    return out


def slim_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.unhex(F.md5(text.cast("binary"))).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )


def pieces_of(slim: DataFrame, groups: DataFrame, n_shards: int, total: int, n_rows: int) -> list[tuple[int, bytearray, int, list[int]]]:
    """(size, digest, number of parts, parts of the piece) of each piece of the groups above an even share: fewer groups than shards."""
    over = groups.where(F.col("bytes") * n_shards > F.lit(total)).collect()
    if not over:
        return []
    parts = slim.sparkSession.createDataFrame([(r.digest, max(-(-r.n * GRAINS // n_rows), 1)) for r in over], "digest binary, parts int")
    counted = slim.join(F.broadcast(parts), "digest").groupBy("digest", "parts", part_of(F.col("parts")).alias("part")).agg(F.sum("size").alias("bytes")).collect()
    out = []
    for r in over:
        mine = {x.part: x.bytes for x in counted if x.digest == r.digest}
        n_parts = next(x.parts for x in counted if x.digest == r.digest)
        bin_of = deal([(size, part) for part, size in mine.items()], -(-r.bytes * n_shards // total))
        for piece in sorted(set(bin_of.values())):
            inside = [part for part in mine if bin_of[part] == piece]
            out.append((sum(mine[p] for p in inside), r.digest, n_parts, inside))
    return sorted(out, key=lambda x: (-x[0], bytes(x[1]), x[3]))


def part_of(parts: Column) -> Column:
    return F.pmod(F.xxhash64("row"), parts).cast("int")


def ranked(whole: DataFrame) -> DataFrame:
    """Adds ``rank``, from 0 by digest among the groups of equal bytes: counts of 4,096 ranges of the digest, then ranks inside."""
    ranges = whole.withColumn("range", F.substring(F.hex("digest"), 1, 3))
    before = Window.partitionBy("bytes").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = ranges.groupBy("bytes", "range").agg(F.count(F.lit(1)).alias("k")).withColumn("first", F.coalesce(F.sum("k").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("bytes", "range").orderBy("digest")) - 1
    return ranges.withColumn("inside", inside).join(first.drop("k"), ["bytes", "range"]).withColumn("rank", F.col("first") + F.col("inside"))


def schedule(slim: DataFrame, n_shards: int) -> tuple[DataFrame, DataFrame, int]:
    """(digest, n, shard) of the groups that stay together, (digest, parts, part, shard) of the others, and the number of rows."""
    spark = slim.sparkSession
    groups = cut(slim.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "groups")
    total, n_rows = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    whole = groups.where(F.col("bytes") * n_shards <= F.lit(total))
    pieces = pieces_of(slim, groups, n_shards, total, n_rows)
    sizes = [(r[0], r[1]) for r in whole.groupBy("bytes").agg(F.count(F.lit(1))).collect()]
    loads, turns, cut_up = [0] * n_shards, [], []
    for size, _, n, piece in sorted([(s, 1, n, None) for s, n in sizes] + [(p[0], 0, 1, p) for p in pieces], key=lambda x: (-x[0], x[1])):
        stretches = run(loads, size, n)
        if piece is None:
            turns.append((size, stretches))
        else:
            cut_up += [(piece[1], piece[2], part, stretches[0][1][0]) for part in piece[3]]
    turns = spark.createDataFrame(turns, "bytes long, stretches array<struct<start: long, bins: array<int>>>")
    here = F.element_at(F.filter("stretches", lambda s: s["start"] <= F.col("rank")), -1)
    shard = F.element_at(here["bins"], ((F.col("rank") - here["start"]) % F.size(here["bins"])).cast("int") + 1)
    placed = cut(ranked(whole).join(turns, "bytes").select("digest", "n", shard.alias("shard")), "placed")
    forget(groups)
    return placed, spark.createDataFrame(cut_up, "digest binary, parts int, part int, shard int"), n_rows


def with_shards(slim: DataFrame, n_shards: int) -> DataFrame:
    """Adds ``shard``. Frequent groups, at most GRAINS, and pieces meet a broadcast, all others a join of two exchanges."""
    placed, pieces, n_rows = schedule(slim, n_shards)
    often = F.col("n") * GRAINS > F.lit(n_rows)
    hot = placed.where(often).select("digest", "shard")
    known = hot.select("digest").unionByName(pieces.select("digest").distinct())
    parts = slim.join(F.broadcast(pieces.select("digest", "parts").distinct()), "digest").withColumn("part", part_of(F.col("parts")))
    columns = [*slim.columns, "shard"]
    out = [
        slim.join(F.broadcast(hot), "digest").select(columns),
        parts.join(F.broadcast(pieces.drop("parts")), ["digest", "part"]).select(columns),
        slim.join(F.broadcast(known), "digest", "left_anti").join(placed.where(~often).select("digest", "shard"), "digest").select(columns),
    ]
    done = cut(out[0].unionByName(out[1]).unionByName(out[2]).withColumn("cell", F.pmod(F.xxhash64("id", "row"), F.lit(GRAINS)).cast("int")), "sharded")
    forget(placed)
    return done


def shard(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, crc, shard, slot) of each row."""
    slim = cut(slim_rows(docs, id_col, text_col), "sizes")
    rows = with_shards(slim, n_shards)
    forget(slim)
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("k")).withColumn("first", F.coalesce(F.sum("k").over(before), F.lit(0)))
    ordered = Window.partitionBy("shard", "cell").orderBy("id", "digest", "row")
    return (
        rows.withColumn("at", F.row_number().over(ordered) - 1)
        .join(F.broadcast(cells.drop("k")), ["shard", "cell"])  # at most GRAINS a shard
        .select("id", "size", "crc", "shard", (F.col("first") + F.col("at")).alias("slot"))
    )


def query(spark, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
