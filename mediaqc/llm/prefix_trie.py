"""Prefix trie of conversations by heavy-path decomposition.

Conversations are rebuilt first: the first h turns come from the head of the conversation's block of ``BLOCK``, h by a
checksum of its id. A node is a distinct sequence of first turns; its name is its smallest member and its depth. Equal
sequences are found without comparing them as a whole: each turn gives ``LANES`` numbers of 31 bits from a SHA-256 of its
role and text and from its place, and the sums over the first d turns (124 bits) name the sequence. Sums can be taken in
pieces: positions come from a range sort, a conversation's turns are summed in chunks of ``CHUNK`` and chunk totals are
summed on, so no conversation has to fit one task.

The child with most members is a node's heavy child (ties: smaller name); heavy edges form paths, each down to a leaf, and
a path is named by its leaf. A light child has at most half of its parent's members, so a leaf has at most log2(members)
light edges above it: its level. From the deepest level up, the nodes of a level's paths form arrays of at most ``CHUNK``
nodes, each array is summed from its end, the totals of later arrays are added, and the total of a path's head is attached
to the head's parent, which lies one level above.

Hot keys: conversations of many turns meet tables of one row a conversation in plain joins, which Spark's adaptive skew
join (``session.tuned``) splits; members of a node are counted by partial aggregation. The digest of a node's ended
members is one SHA-256, so they pass one task, as a stream in order of their ids.

Defined results: rows without a conv_id belong to no conversation; turns are ordered by turn (null first), then role,
then text; repeated rows are turns of their own; null roles and texts are empty; ids may be negative (remainders have the
sign of the id); an empty table has no nodes; columns of any other names are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaqc.llm.common import WORD, cut, forget, text_of

#: Conversations that share a head, and the number of different lengths of what they share.
BLOCK, HEADS = 20, 4
#: Turns that are summed together, and nodes of a path array at most.
CHUNK = 1024
LANES = 4
KEY = ["depth", *(f"k{i}" for i in range(LANES))]
EMPTY = hashlib.sha256(b"").hexdigest()


def placed(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(c, pos, digest, words): the turns of each conversation by place, from 0.

    A range sort over all turns splits long conversations; places are those in a partition and what earlier ones hold.
    """
    role, text = text_of(role_col), text_of(text_col)
    rows = turns.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("row")).where("c IS NOT NULL")
    order = ["c", F.asc_nulls_first("turn"), "role", "text", "row"]  # equal rows are told apart, or a repeated one could not be split
    said = F.unhex(F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text"), 256))
    sort = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    lines = cut(sort.select("c", said.alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("at")), "turns")
    part = F.shiftrightunsigned("at", 33).alias("part")
    runs = lines.groupBy("c", part).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = cut(runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "runs")
    known = lines.withColumn("part", part).join(runs, ["c", "part"])
    out = cut(known.select("c", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "digest", "words"), "placed")
    forget(lines, runs)
    return out


def rebuilt(places: DataFrame, block: int = BLOCK, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(c, pos, digest, words) of the rebuilt conversations, and (c, turns) of each, with those that have none."""
    h = F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(heads))
    lengths = cut(places.groupBy("c").agg(F.max("pos").alias("last")).select("c", (F.col("last") + 1).alias("n"), h.alias("h"), (F.col("c") - F.col("c") % block).alias("head")), "lengths")
    heads_of = lengths.select(F.col("c").alias("head"), F.col("n").alias("head_n"))
    taken = F.least("h", F.coalesce("head_n", F.lit(0)))
    convs = lengths.join(heads_of, "head", "left").select("c", "head", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns"))
    convs = cut(convs, "conversations")
    first = places.where(F.col("pos") < heads - 1).select(F.col("c").alias("head"), "pos", "digest", "words")
    shared = first.join(convs.select("c", "head", "h"), "head").where("pos < h").select("c", "pos", "digest", "words")
    own = places.join(convs.select("c", "h", "taken"), "c").where("pos >= h").select("c", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "words")
    forget(lengths)
    return shared.unionByName(own), convs.select("c", "turns")


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(c, depth, k0.., words): the name of each conversation's first d turns, for all d, and the words of the last of them."""
    lanes = [F.shiftrightunsigned(F.xxhash64(F.lit(i), "digest", "pos"), 33).alias(f"t{i}") for i in range(LANES)]
    terms = turns.select("c", "pos", F.floor(F.col("pos") / CHUNK).alias("chunk"), "words", *lanes)
    so_far = Window.partitionBy("c", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inside = cut(terms.select("c", "chunk", "pos", "words", *[F.sum(f"t{i}").over(so_far).alias(f"k{i}") for i in range(LANES)]), "sums")
    ends = inside.groupBy("c", "chunk").agg(*[F.max(f"k{i}").alias(f"k{i}") for i in range(LANES)])  # terms are not negative
    earlier = Window.partitionBy("c").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    upto = ends.select("c", (F.col("chunk") + 1).alias("chunk"), *[F.sum(f"k{i}").over(earlier).alias(f"b{i}") for i in range(LANES)])
    later = inside.where("chunk > 0").join(upto, ["c", "chunk"]).withColumns({f"k{i}": F.col(f"k{i}") + F.col(f"b{i}") for i in range(LANES)})
    all_ = inside.where("chunk = 0").unionByName(later.select(inside.columns)).select("c", (F.col("pos") + 1).alias("depth"), *KEY[1:], "words")
    root = convs.select("c", *[F.lit(0).cast("long").alias(k) for k in [*KEY, "words"]])
    out = cut(all_.unionByName(root), "prefixes")
    forget(inside)
    return out


def ended(last: DataFrame) -> DataFrame:
    """(node, depth, ends): the SHA-256 of the ids (c) of the conversations that end at each node, ascending and comma-joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            done: list[tuple] = []
            for node, depth, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (node, depth) == now:
                    sha.update(b",%d" % c)
                else:
                    if now is not None:
                        done.append((*now, sha.hexdigest()))
                    now, sha = (node, depth), hashlib.sha256(b"%d" % c)
            yield table(done)
        if now is not None:
            yield table([(*now, sha.hexdigest())])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["node", "depth", "ends"])

    keys = ["node", "depth"]
    return last.select(*keys, "c").repartition(*keys).sortWithinPartitions(*keys, "c").mapInArrow(run, "node long, depth long, ends string")


def suffix_sums(paths: DataFrame) -> DataFrame:
    """``paths`` (path, depth, chunk, leaves, saved and others) with leaves and saved summed from the end of each path."""
    rest = [c for c in paths.columns if c not in ("path", "chunk")]
    arrays = paths.groupBy("path", "chunk").agg(F.sort_array(F.collect_list(F.struct("depth", *[c for c in rest if c != "depth"])), False).alias("nodes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            nodes = lists.flatten()
            columns = {f.name: nodes.field(f.name) for f in nodes.type}
            first = np.repeat(np.cumsum(sizes) - sizes, sizes)
            for name in ("leaves", "saved"):
                total = np.cumsum(np.append(0, columns[name].to_numpy()))
                columns[name] = pa.array(total[1:] - total[first])
            path, chunk = (pa.array(np.repeat(batch.column(k).to_numpy(), sizes)) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([path, chunk, *(columns[c] for c in rest)], names=["path", "chunk", *rest])

    kind = lambda c: paths.schema[c].dataType.simpleString()
    inside = cut(arrays.mapInArrow(run, ", ".join(f"{c} {kind(c)}" for c in ["path", "chunk", *rest])), "suffixes")
    totals = inside.groupBy("path", "chunk").agg(F.max("leaves").alias("l"), F.max("saved").alias("s"))  # neither is negative
    after = Window.partitionBy("path").orderBy("chunk").rowsBetween(1, Window.unboundedFollowing)
    more = totals.select("path", "chunk", F.sum("l").over(after).alias("l"), F.sum("s").over(after).alias("s")).where("l IS NOT NULL")
    out = inside.join(more, ["path", "chunk"], "left")
    return out.withColumns({"leaves": F.col("leaves") + F.coalesce("l", F.lit(0)), "saved": F.col("saved") + F.coalesce("s", F.lit(0))}).drop("l", "s")


def nodes_of(named: DataFrame, nodes: DataFrame, convs: DataFrame) -> DataFrame:
    """(node, depth, parent, n_convs, saved, ends, n_children, heavy): heavy if it is its parent's heavy child, or the root."""
    at = named.select(F.col("c").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    tree = cut(nodes.join(at, ["node", "depth"], "left"), "tree")
    child = F.max(F.struct("n_convs", (-F.col("node")).alias("first"), "node"))
    below = tree.where("depth > 0").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"), child.alias("child"))
    below = cut(below, "children")
    heavy = below.select(F.col("child.node").alias("node"), (F.col("depth") + 1).alias("depth"), F.lit(True).alias("heavy"))
    ends = ended(named.join(convs, "c").where("depth = turns"))
    out = tree.join(below.drop("child"), ["node", "depth"], "left").join(heavy, ["node", "depth"], "left").join(ends, ["node", "depth"], "left")
    saved = (F.col("n_convs") - 1) * F.col("words")
    out = out.select("node", "depth", "parent", "n_convs", saved.alias("saved"), F.coalesce("ends", F.lit(EMPTY)).alias("ends"), F.coalesce("n_children", F.lit(0)).alias("n_children"), (F.coalesce("heavy", F.lit(False)) | (F.col("depth") == 0)).alias("heavy"))
    out = cut(out, "nodes")
    forget(tree, below)
    return out


def paths_of(named: DataFrame, tree: DataFrame) -> DataFrame:
    """The nodes with path (the leaf's name), level, and chunk, in folders by level."""
    leaves = tree.where("n_children = 0").select(F.col("node").alias("c"))  # all members of a leaf end there
    above = named.join(leaves, "c", "left_semi").join(tree.select("node", "depth", "heavy"), ["node", "depth"])
    above = cut(above.select(F.col("c").alias("path"), "node", "depth", "heavy"), "chains")
    light = F.when(~F.col("heavy"), F.col("depth"))
    heads = above.groupBy("path").agg(F.coalesce(F.max(light), F.lit(0)).alias("head"), F.count(light).alias("level"))
    mine = above.join(heads, "path").where("depth >= head").select("path", "level", "head", "node", "depth")
    rows = mine.join(tree, ["node", "depth"]).withColumn("chunk", F.floor((F.col("depth") - F.col("head")) / CHUNK)).withColumn("leaves", (F.col("n_children") == 0).cast("long"))
    out = cut(rows.drop("heavy"), "paths", "level")
    forget(above)
    return out


def trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(node, depth, parent, n_convs, n_children, leaves, saved, ends), a row a node."""
    places = placed(turns, conv_col, turn_col, role_col, text_col)
    said, convs = rebuilt(places)
    rows = prefixes(said, convs)
    nodes = cut(rows.groupBy(*KEY).agg(F.min("c").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words")), "names")
    named = cut(rows.join(nodes.select(*KEY, "node"), KEY).select("c", "depth", "node"), "members")
    tree = nodes_of(named, nodes.drop(*KEY[1:]), convs)
    paths = paths_of(named, tree)
    forget(places, rows, nodes, named, tree)
    deepest = paths.agg(F.max("level")).first()[0]
    out, attached = [], None
    for level in range(deepest if deepest is not None else -1, -1, -1):
        mine = paths.where(F.col("level") == level).drop("level")
        if attached is not None:
            mine = mine.join(attached, ["node", "depth"], "left").withColumns({k: F.col(k) + F.coalesce(f"a_{k}", F.lit(0)) for k in ("leaves", "saved")}).drop("a_leaves", "a_saved")
        done = cut(suffix_sums(mine), "level")
        out.append(done)
        heads = done.where("depth = head AND depth > 0")
        attached = heads.groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.sum("leaves").alias("a_leaves"), F.sum("saved").alias("a_saved"))
    out = reduce(DataFrame.unionByName, out) if out else paths
    return out.select("node", "depth", "parent", "n_convs", "n_children", "leaves", "saved", "ends")


def query(spark, sf_dir: str) -> DataFrame:
    found = trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return found.select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256")
    )


#: The checksum, bit by bit; the nodes of a subtree are those whose smallest member passes its top.
ORACLE = r"""
WITH t AS MATERIALIZED (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL
),
k AS MATERIALIZED (
  SELECT DISTINCT c, c - c % 20 AS head, xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda s, b: list_reduce([xor(s, b)] || [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 4 AS h FROM t
),
r AS (
  SELECT k.c, 0 AS own, t.pos, t.role, t.text FROM k JOIN t ON t.c = k.head AND t.pos < k.h
  UNION ALL SELECT k.c, 1, t.pos, t.role, t.text FROM k JOIN t ON t.c = k.c AND t.pos >= k.h
),
o AS (SELECT c, row_number() OVER w AS d, list({'role': role, 'text': text}) OVER w AS seq, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r WINDOW w AS (PARTITION BY c ORDER BY own, pos)),
p AS MATERIALIZED (SELECT c, d, seq, words FROM o UNION ALL SELECT c, 0, [], 0 FROM k),
n AS MATERIALIZED (SELECT d, seq, min(c) AS node, count(*) AS n_convs, max(words) AS words FROM p GROUP BY d, seq),
m AS MATERIALIZED (SELECT p.c, p.d, n.node, p.d = max(p.d) OVER (PARTITION BY p.c) AS last FROM p JOIN n ON n.d = p.d AND n.seq = p.seq),
u AS MATERIALIZED (SELECT n.node, n.d, m.node AS parent, n.n_convs, (n.n_convs - 1) * n.words AS saved FROM n LEFT JOIN m ON m.c = n.node AND m.d = n.d - 1),
ch AS MATERIALIZED (SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM u WHERE d > 0 GROUP BY ALL),
sub AS (SELECT m.node, m.d, sum(u.saved) AS saved, count(*) FILTER (WHERE ch.node IS NULL) AS n_leaves FROM u JOIN m ON m.c = u.node AND m.d <= u.d LEFT JOIN ch ON ch.node = u.node AND ch.d = u.d GROUP BY m.node, m.d),
e AS (SELECT node, d, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends FROM m WHERE last GROUP BY node, d)
SELECT u.node AS conv_id, CAST(u.d AS BIGINT) AS depth, u.parent AS parent_conv_id, u.n_convs, coalesce(ch.n_children, 0) AS n_children, sub.n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM u JOIN sub ON sub.node = u.node AND sub.d = u.d LEFT JOIN ch ON ch.node = u.node AND ch.d = u.d LEFT JOIN e ON e.node = u.node AND e.d = u.d
"""
