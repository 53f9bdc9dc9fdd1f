"""Near-duplicate documents by MinHash with tensored banding, links verified on full shingle sets.

Sketching makes two collections of ``PARTS`` part keys of ``ROWS`` minhashes each; a table key is a pair (i, j) of one
part of either, so that PARTS * PARTS tables cost 2 * PARTS * ROWS minhashes, about the root of what they would cost one
by one. At similarity 0.75 two documents miss all tables with a chance of 2 * (1 - 0.75**ROWS)**PARTS = 1e-4.
Parts that no other document has are dropped before the pairs are formed, so unrelated documents never form any.

Documents of equal sets are one representative from the start. In a table's bucket all members are held against one
centre; the centre then leaves and, for a few rounds, the next one follows, as long as the bucket has members that
nothing links yet. What is left in buckets of many unrelated members (a passage that many documents share) goes an exact
way without a cap: a prefix join on the rarest shingles. Its key is a shingle and a class of set sizes; a frequent key is
salted, so that no task holds more than a bounded part of it; the smaller set of a pair comes only by the shingles from
which enough follow for any larger partner, and keys whose documents are all linked already are left out. Candidates are
first held against their sketches (a miss by more than six standard deviations drops a pair), then their full sets are
intersected.

Defined results: documents without words (null, empty, white space) have an empty set, link with nothing and are their
own component; fewer words than a shingle are one shingle; rows that share an id are one node; rows without an id link
with nothing and are kept; an empty table gives an empty table; columns of any other names are not read, or carried as
they came. A group of equal sets that holds more than 1/COUNTERS of all rows meets a broadcast, all others a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaqc.llm.common import COUNTERS, Remembered, cut, documents, forget, sieve, sifted, slices, text_of, thinned
from mediaqc.llm.components import components

WORDS = 5
PERCENT = 75
PARTS, ROWS = 18, 3
CENTRES = 2
#: Word hashes that a task remembers.
REMEMBERED = 100_000
#: Rows of one key of the prefix join that a task holds against the others of the key.
SALT_ROWS = 4096

_N = 2 * PARTS * ROWS
_RANDOM = np.random.default_rng(20240607)
_A = _RANDOM.integers(0, 1 << 63, _N, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, _N, np.uint64)
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Least share of equal minhashes of a candidate: the expected share less six standard deviations.
_LEAST_EQUAL = int(_N * (PERCENT / 100 - 6 * (0.75 * 0.25 / _N) ** 0.5))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _Q
    return x ^ (x >> np.uint64(27))


def word_hashes() -> Remembered:
    return Remembered(xxhash.xxh3_64_intdigest, REMEMBERED)


def shingles(text: str, hashes: Remembered) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct shingles of a text."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(WORDS, len(h))
    out = h[: len(h) - width + 1].copy()
    for i in range(1, width):
        out = _mix(out * _P + h[i : len(h) - width + 1 + i])
    return np.unique(_mix(out * _P + np.uint64(width)))


def minhashes(s: np.ndarray) -> np.ndarray:
    least = np.full(_N, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        part = s[at : at + 4096]
        for k in range(0, _N, 12):
            np.minimum(least[k : k + 12], (_A[k : k + 12, None] * part[None, :] + _B[k : k + 12, None]).min(axis=1), out=least[k : k + 12])
    return least


def part_keys(m: np.ndarray) -> np.ndarray:
    """2 * PARTS keys: the first PARTS of one collection, the others of the other."""
    rows = m.reshape(2 * PARTS, ROWS)
    keys = np.arange(1, 2 * PARTS + 1, dtype=np.uint64)
    for r in range(ROWS):
        keys = _mix(keys * _P + rows[:, r])
    return keys.view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, digest of the set, part keys, low bytes of the minhashes)."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for part in slices(batches):
            n, digests, keys, lows = [], [], [], []
            for text in part.column(1).to_pylist():
                s = shingles(text, hashes)
                n.append(len(s))
                digests.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                m = minhashes(s) if len(s) else None
                keys.append(None if m is None else part_keys(m))
                lows.append(None if m is None else (m >> np.uint64(32)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(lows, pa.binary())], names=["id", "n", "digest", "parts", "low"])

    return slim.mapInArrow(run, "id long, n long, digest binary, parts array<long>, low binary")


def sets_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, set) of the documents in ``ids`` (node)."""
    slim = docs.select(F.col(id_col).cast("long").alias("node"), text_of(text_col).alias("text"))
    slim = sifted(slim, sieve(ids, "node"), "node").where("_maybe").drop("_maybe").join(ids, "node", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for part in slices(batches):
            sets = [shingles(t, hashes).view(np.int64) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    return slim.mapInArrow(run, "node long, set array<long>")


def buckets(nodes: DataFrame) -> DataFrame:
    """(key, node, n): the table keys that several nodes have. Counts are cut, so that both sides of a join are plain
    exchanges, whose frequent keys the adaptive skew join splits."""
    parts = nodes.select("node", "n", F.posexplode("parts").alias("i", "part"))
    shared = cut(parts.groupBy("part").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("part"), "shared")
    kept = parts.join(shared, "part").groupBy("node", "n").agg(
        F.collect_list(F.when(F.col("i") < PARTS, F.col("part"))).alias("x"), F.collect_list(F.when(F.col("i") >= PARTS, F.col("part"))).alias("y")
    )  # at most PARTS each
    kept = cut(kept, "kept")
    forget(shared)
    keys = kept.select("node", "n", F.explode("x").alias("x"), "y").select(F.col("node"), F.col("n"), F.col("x"), F.explode("y").alias("y"))
    keys = keys.select(F.xxhash64("x", "y").alias("key"), "node", "n")
    several = cut(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "several")
    out = cut(keys.join(several, "key"), "buckets")
    forget(kept, several)
    return out


def near(a, b):
    """The sizes of two sets let them reach the similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    low = nodes.select("node", "low")
    both = pairs.join(low.select(F.col("node").alias("a"), F.col("low").alias("x")), "a").join(low.select(F.col("node").alias("b"), F.col("low").alias("y")), "b")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, _N) for k in (2, 3))
            alike = (x == y).sum(axis=1) >= _LEAST_EQUAL
            yield batch.select([0, 1]).filter(pa.array(alike))

    likely = cut(both.select("a", "b", "x", "y").mapInArrow(close, "a long, b long"), "likely")
    ids = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct()
    sets = cut(sets_of(docs, ids, id_col, text_col), "sets")
    full = likely.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    links = cut(full.where(common * 100 >= (F.size("x") + F.size("y") - common) * PERCENT).select("a", "b"), "links")
    forget(sets, likely)
    return links


def prefix_pairs(rest: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All pairs (a, b) of ``rest`` (node, root) of different roots that can reach the similarity.

    Sets that reach it share one of their n - ceil(0.75 n) + 1 rarest shingles, at a place from which enough follow: of the
    smaller set, of n shingles, at least 6/7 of n, as the other is as large at least.
    """
    sets = cut(sets_of(docs, rest.select("node"), id_col, text_col), "sets")
    rows = sets.select("node", F.size("set").alias("n"), F.explode("set").alias("s"))
    counts = cut(rows.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "counts")
    per_node = rows.join(counts, "s").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("shared"))
    per_node = per_node.withColumn("alone", F.col("n") - F.size("shared"))
    first = (F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1 - F.col("alone")).cast("int")
    prefix = per_node.withColumn("first", F.greatest(first, F.lit(0))).where("first > 0")
    posts = prefix.select("node", "n", "alone", F.posexplode(F.slice("shared", F.lit(1), F.col("first"))).alias("at", "x"))
    posts = posts.select(F.col("x.s").alias("s"), "node", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("left")).join(rest, "node")
    # sizes that reach the similarity are of one class or of neighbouring ones
    posts = cut(posts.withColumn("band", F.floor(F.log(F.col("n") + 0.5) / F.lit(log(100 / PERCENT) + 1e-9)).cast("int")), "prefixes")
    forget(sets, counts)
    small = posts.where(F.col("left") * (100 + PERCENT) >= 2 * F.col("n") * PERCENT)
    large = posts.withColumn("band", F.explode(F.array("band", F.col("band") - 1)))
    here = small.groupBy("s", "band").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    there = large.groupBy("s", "band").agg(F.min("root").alias("lo_b"), F.max("root").alias("hi_b"))
    apart = (F.col("lo") != F.col("hi")) | (F.col("lo_b") != F.col("hi_b")) | (F.col("lo") != F.col("lo_b"))
    keys = cut(here.join(there, ["s", "band"]).where(apart).select("s", "band", F.ceil(F.col("c") / SALT_ROWS).cast("int").alias("salts")), "keys")
    a = small.join(keys, ["s", "band"]).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    b = large.join(keys, ["s", "band"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    a, b = (x.select("s", "band", "salt", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "left", "root")]) for k, x in (("a", a), ("b", b)))
    order = (F.col("n_a") < F.col("n_b")) | (F.col("n_a") == F.col("n_b")) & (F.col("node_a") != F.col("node_b"))
    reach = F.least("left_a", "left_b") * (100 + PERCENT) >= (F.col("n_a") + F.col("n_b")) * PERCENT
    pairs = a.join(b, ["s", "band", "salt"]).where(order & (F.col("root_a") != F.col("root_b")) & near(F.col("n_a"), F.col("n_b")) & reach)
    found = cut(pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct(), "pairs")
    forget(posts, keys)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component) of each row."""
    rows = cut(sketches(docs, id_col, text_col), "sketches")
    named = rows.where("id IS NOT NULL AND n > 0")
    # equal sets are one node: partial aggregation, no join
    classes = cut(named.groupBy("digest").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n_rows"), F.min_by(F.struct("n", "parts", "low"), "id").alias("best")), "classes")
    nodes = classes.select("node", "best.n", "best.parts", "best.low")
    open_buckets = buckets(nodes)
    links, roots, made = None, None, []
    for turn in range(CENTRES):
        if turn and open_buckets.isEmpty():
            break
        labelled = with_roots(open_buckets, roots)
        member = F.struct(F.xxhash64("node", F.lit(turn)), "node", "n", "root")
        centre = cut(labelled.groupBy("key").agg(F.min(member).alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key", "c"), "centres")
        held = cut(labelled.join(centre, "key").where("node <> c.node").select("key", "node", "n", "root", F.col("c.node").alias("c"), F.col("c.n").alias("c_n"), F.col("c.root").alias("c_root")), "held")
        pairs = held.where(F.col("root") != F.col("c_root")).where(near(F.col("n"), F.col("c_n"))).select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()
        found = verified(pairs, nodes, docs, id_col, text_col)
        made.append(found)
        links = found if links is None else links.unionByName(found)
        forget(open_buckets, centre, roots)
        roots = components(links)
        again = with_roots(held.select("key", "node", "n"), roots)
        several = cut(again.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key"), "several")
        open_buckets = cut(again.join(several, "key").select("key", "node", "n"), "buckets")
        forget(held, several)
    rest = cut(with_roots(open_buckets.select("node").distinct(), roots).select("node", "root"), "rest")
    forget(open_buckets)
    if not rest.isEmpty():
        pairs = prefix_pairs(rest, docs, id_col, text_col)
        found = verified(pairs, nodes, docs, id_col, text_col)
        made.append(found)
        links = found if links is None else links.unionByName(found)
        forget(roots, pairs)
        roots = components(links)
    of_class = cut(with_roots(classes.select("digest", "node", "n_rows"), roots).select("digest", "n_rows", F.col("root").alias("component")), "components")
    forget(classes, rest, roots, *made)
    out = [F.col("id"), F.col("n").alias("n_shingles"), F.col("component")]
    hot = F.col("n_rows") * COUNTERS > F.lit(rows.count())  # fewer than COUNTERS classes
    often = named.join(F.broadcast(of_class.where(hot)), "digest", "left")
    seldom = often.where("component IS NULL").drop("component", "n_rows").join(of_class.where(~hot), "digest")
    alone = rows.where("id IS NULL OR n = 0").withColumn("component", F.col("id"))
    found = seldom.select(out).unionByName(often.where("component IS NOT NULL").select(out)).unionByName(alone.select(out))
    found._reads = [rows, of_class]
    return found


def with_roots(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Adds the root of ``node``; a node without links is its own."""
    if roots is None:
        return rows.withColumn("root", F.col("node"))
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def keep_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one row a component, as they came whatever their columns are named."""
    found = near_duplicates(docs, id_col, text_col)
    per_id = found.where("id IS NOT NULL").groupBy("id").agg((F.min("component") == F.col("id")).alias("stays"), F.count(F.lit(1)).alias("n_rows"))
    changed = cut(per_id.where("NOT stays OR n_rows > 1"), "dropped")
    forget(*found._reads)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return thinned(rows, changed, ["id"], docs.count(), F.struct(F.length("text").alias("n"), F.col("text")))


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    kept = F.col("id").eqNullSafe(F.col("component"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))
