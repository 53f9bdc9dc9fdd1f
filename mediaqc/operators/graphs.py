"""Graphs of pairs: connected components, and registration in order of the rows."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaqc.plans.lineage import cut, forget

#: Pairs that one task decides in order.
FOLD = 1 << 20


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (l, r), the root being the least node that it reaches.

    Stars take turns: each node hands its least neighbour to its larger ones, then to its smaller ones, until nothing changes;
    chains shorten by a factor each time. Every step joins a table of one row a node and keeps each edge once, so edges never
    grow in number; the adaptive skew join (``session.tuned``) splits a node of many edges.

    Defined results: repeated edges count once; an edge of a node with itself adds nothing; null ends are left out; no edges
    give an empty table.
    """
    now = cut(edges.select(F.greatest("l", "r").alias("u"), F.least("l", "r").alias("v")).where("l <> r").distinct(), "edges")
    before = None
    while True:
        for larger in (True, False):
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else now
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            told = both.join(least, "u")
            moved = told.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if larger else told.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
            after = cut(moved.where("u <> v").distinct(), "edges")
            forget(now)
            now = after
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first())
        if seen == before:
            break
        before = seen
    found = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _folded(pairs: DataFrame) -> DataFrame:
    """(node, registered) of the nodes of the pairs (cell, l, r), each cell decided in order of r by one task."""

    def run(cell: pa.Table) -> pa.Table:
        l, r = cell["l"].to_numpy(), cell["r"].to_numpy()
        nodes, at = np.unique(np.concatenate([l, r]), return_inverse=True)
        of_l, of_r = at[: len(l)], at[len(l) :]
        order = np.argsort(of_r, kind="stable")
        registered = [True] * len(nodes)
        for a, b in zip(of_l[order].tolist(), of_r[order].tolist(), strict=True):  # all pairs of a came before, as a < b
            if registered[a]:
                registered[b] = False
        return pa.table({"node": pa.array(nodes), "registered": pa.array(registered, pa.bool_())})

    return pairs.select("cell", F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r")).groupBy("cell").applyInArrow(run, "node long, registered boolean")


def registered(nodes: DataFrame, edges: DataFrame, fold: int | None = None) -> DataFrame:
    """(node, registered): in order, a row registers unless an earlier registered row is its duplicate.

    ``nodes`` has node, ``edges`` (l, r) with l < r. Components are independent: those of up to ``fold`` pairs are dealt to
    cells of about that many and decided in order, each cell in one task, however long their chains are. Of a larger
    component the earliest rows are decided the same way, as many as have ``fold`` pairs, then what follows from them: their
    later neighbours fall out, and what is left usually comes apart. So rounds grow with the pairs of the largest component
    over ``fold``, not with its longest chain. ``_rounds`` of the result tells how many there were.

    Defined results: repeated pairs count once; rows without pairs register; no rows give an empty table.
    """
    fold = fold or FOLD
    left = cut(edges.select("l", "r").distinct(), "pairs")
    n, rounds, decided = left.count(), 0, []
    while n:
        rounds += 1
        if n <= fold:
            decided.append(cut(_folded(left.withColumn("cell", F.lit(0))), "decided"))
            break
        roots = cut(components(left), "roots")
        rooted = cut(left.join(roots.withColumnRenamed("node", "l"), "l"), "rooted")
        sizes = cut(rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "sizes")
        small, giant = sizes.where(F.col("n") <= fold), sizes.where(F.col("n") > fold)
        n_small, most = small.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], giant.agg(F.max("n")).first()[0]
        cell = F.pmod(F.xxhash64("root"), F.lit(max(1, -(-n_small // fold)))).alias("cell")
        decided.append(cut(_folded(rooted.join(small.select("root"), "root").select(cell, "l", "r")), "decided"))
        if most is None:
            break
        rest = cut(rooted.join(giant.select("root"), "root"), "giants")
        upto = rest.groupBy("root").agg(F.percentile_approx("r", fold / most, 100_000).alias("upto"))
        early = rest.join(upto, "root").where("r < upto").select(F.col("root").alias("cell"), "l", "r")
        sources = rest.select("l").distinct().join(rest.select(F.col("r").alias("l")), "l", "left_anti")  # nothing is before them
        told = cut(_folded(early).unionByName(sources.select(F.col("l").cast("long").alias("node"), F.lit(True).alias("registered"))).distinct(), "told")
        hit = rest.join(told.where("registered").select(F.col("node").alias("l")), "l", "left_semi").select(F.col("r").cast("long").alias("node"), F.lit(False).alias("registered"))
        known = cut(told.unionByName(hit).distinct(), "decided")
        open_ = rest.select("l", "r").join(known.select(F.col("node").alias("r")), "r", "left_anti").join(known.select(F.col("node").alias("l")), "l", "left_anti")
        after = cut(open_.select("l", "r"), "pairs")
        decided.append(known)
        forget(left, roots, rooted, sizes, rest, told)
        left, n = after, after.count()
    out = nodes.select("node")
    if decided:
        fallen = reduce(DataFrame.unionByName, decided).where("NOT registered").select("node", F.lit(False).alias("registered"))
        out = out.join(fallen, "node", "left").select("node", F.coalesce("registered", F.lit(True)).alias("registered"))
    else:
        out = out.withColumn("registered", F.lit(True))
    out._rounds = rounds
    return out
