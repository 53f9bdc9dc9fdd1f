"""Connected components by contraction: each node hooks to its least neighbour, chains are shortened by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaqc.llm.common import cut, forget


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); the root is the least node that it reaches.

    Each round halves the number of roots that have edges at least, so rounds grow with the logarithm of the nodes. Every
    step is a join or an aggregation by node that combines before the shuffle; no component meets in one task.

    Defined results: repeated edges count once; an edge of a node with itself adds nothing, and a node with no other edge
    has no row; edges with a null end are left out; no edges give an empty table; other columns are not read.
    """
    left = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")  # null ends fail the test
    known = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")), "hooks")
        while True:
            above = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = cut(up.join(above, "root").select("node", F.col("above").alias("root"), (F.col("above") < F.col("root")).alias("moved")), "jumps")
            moved = not jumped.where("moved").isEmpty()
            forget(up)
            up = jumped.drop("moved")
            up._cut_path = jumped._cut_path
            if not moved:
                break
        if known is None:
            now = up
        else:
            step = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
            now = cut(known.join(step, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "roots")
        a, b = up.select(F.col("node").alias("a"), F.col("root").alias("ra")), up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        rest = left.join(a, "a").join(b, "b").where("ra <> rb")
        rest = cut(rest.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        forget(left)
        if known is not None:
            forget(known, up)
        known, left = now, rest
    if known is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return known
