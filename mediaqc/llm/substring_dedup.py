"""Substring de-duplication: every word inside a window of ``WINDOW`` words that occurs elsewhere too is removed.

A sparse De Bruijn graph finds the windows. Token k-mers (k = 18) are its edges; of each window only the k-mer of least
hash is taken (an anchor, about one word in ten), so that equal windows have an equal anchor, and neighbouring anchors
touch. Anchors are counted; one that occurs once belongs to no repeated window. A repeated anchor whose occurrences are
all followed by the same anchor at the same distance, and which is all that ever precedes it, is joined with it: the
nonbranching paths. A path is found again in each document's own coordinates as a run of joined anchors; its text is the
same in all its occurrences, so all windows inside are repeated: two anchors that touch, hashed apart, cover each step of it.
Only windows that reach over the end of a path are counted one by one, at most 34 an occurrence; at their coordinates the
source is read again, and a second hash of its words verifies what the first says. No list of occurrences is ever gathered. Occurrences meet the
counts of anchors and windows in joins of two plain exchanges, so that the adaptive skew join splits a frequent one.

Defined results: null texts and texts without words have no words and lose none; documents shorter than a window lose
none; texts of any length are read whole; rows repeated with their id are two places, so their windows are repeated;
k-mers of equal hash in a window are all anchors; an empty table gives an empty table; columns of any other names are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaqc.llm.common import Remembered, cut, documents, forget, sieve, sifted, slices, text_of

WINDOW = 35
#: Words of an anchor. A window holds K of them, so that neighbouring anchors are at most K words apart.
K = (WINDOW + 1) // 2
#: Seed of the second word hash.
VERIFYING = 1
#: Word hashes that a task remembers.
REMEMBERED = 100_000

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def word_hashes(seed: int = 0) -> Remembered:
    return Remembered(lambda word: xxhash.xxh3_64_intdigest(word, seed), REMEMBERED)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * _P + right
    x = (x ^ (x >> np.uint64(29))) * _Q
    return x ^ (x >> np.uint64(32))


def kmers(words: list[bytes], hashes: Remembered, k: int = K) -> np.ndarray:
    """Hashes of all k-mers: of two overlapping halves, each made the same way."""
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    return _grow(h, 1, k)


def _grow(h: np.ndarray, have: int, want: int) -> np.ndarray:
    """Hashes of ``want`` words from those of ``have``, whose windows may overlap."""
    while have < want:
        step = min(have, want - have)
        h = _join(h[: len(h) - step], h[step:])
        have += step
    return h


def _slide(x: np.ndarray, width: int, take) -> np.ndarray:
    """``take`` over each ``width`` values in a row."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = take(x[: len(x) - step], x[step:])
        have += step
    return x


def anchors(words: list[bytes], hashes: Remembered) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-mers that are the least of some window."""
    if len(words) < WINDOW:
        return np.empty(0, np.int32), np.empty(0, np.uint64)
    h = kmers(words, hashes)
    least = _slide(h, WINDOW - K + 1, np.minimum)
    wide = np.concatenate([np.zeros(WINDOW - K, np.uint64), least, np.zeros(WINDOW - K, np.uint64)])
    at = np.flatnonzero(_slide(wide, WINDOW - K + 1, np.maximum) == h)
    return at.astype(np.int32), h[at]


def runs(marks: list[dict]) -> list[tuple[int, int]]:
    """Spans (first word, end) of the paths of a document, from its repeated anchors by position."""
    spans, start = [], None
    for m in marks:
        if start is None:
            start = m["pos"]
        if not m["joined"]:
            spans.append((start, m["pos"] + K))
            start = None
    return spans


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, did, th, text): did and th are never null and tell apart rows that share an id, or have none, but not the text."""
    text = text_of(text_col)
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).select(
        "id", F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("")).alias("did"), digest("text").alias("th"), "text"
    )


def digest(text_col: str):
    """128 bits of a text."""
    return F.unhex(F.md5(F.col(text_col).cast("binary")))


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """(did, th, marks): the repeated anchors of each document by position, and whether each is joined to the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in slices(batches):
            found = [anchors(words_of(t), hashes) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a for a, _ in found], pa.list_(pa.int32())), pa.array([h.view(np.int64) for _, h in found], pa.list_(pa.int64()))], names=["did", "th", "at", "hs"])

    lists = cut(rows.select("did", "th", "text").mapInArrow(run, "did string, th binary, at array<int>, hs array<long>").where("size(at) > 0"), "anchors")
    following = F.zip_with("hs", F.slice("hs", 2, F.size("hs")), lambda h, n: n)
    gaps = F.zip_with("at", F.slice("at", 2, F.size("at")), lambda a, b: b - a)
    pairs = lists.select(F.explode(F.arrays_zip(F.col("hs").alias("h"), following.alias("next"), gaps.alias("gap"))).alias("x")).select("x.h", "x.next", "x.gap")
    edge = F.when(F.col("next").isNotNull(), F.xxhash64("next", "gap"))
    counted = cut(
        pairs.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.count("next").alias("c_next"), F.min(edge).alias("lo"), F.max(edge).alias("hi"), F.min("next").alias("next")).where("c > 1"), "counts"
    )
    forward = counted.where("c = c_next AND lo = hi").select("h", "next", "c")
    joined = forward.join(counted.select(F.col("h").alias("next"), F.col("c").alias("c2")), "next").where("c = c2").select("h", F.lit(True).alias("joined"))
    known = cut(counted.select("h").join(joined, "h", "left").select("h", F.coalesce("joined", F.lit(False)).alias("joined")), "edges")
    places = lists.select("did", "th", F.explode(F.arrays_zip(F.col("at").alias("pos"), F.col("hs").alias("h"))).alias("x")).select("did", "th", "x.pos", "x.h")
    marks = places.join(known, "h").groupBy("did", "th").agg(F.sort_array(F.collect_set(F.struct("pos", "joined"))).alias("marks"))
    marks = cut(marks, "marks")
    forget(lists, counted, known)
    return marks


def doubtful(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Starts of the windows that hold a repeated anchor but lie inside no path."""
    maybe = np.zeros(max(0, n - WINDOW + 1) + 1, np.int32)
    for s, e in spans:  # the windows that hold a whole anchor of the path
        maybe[max(0, s - (WINDOW - K)) : e - K + 1] = 1
    for s, e in spans:
        if e - s >= WINDOW:
            maybe[s : e - WINDOW + 1] = 0
    return np.flatnonzero(maybe[:-1])


def repeated_windows(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """(did, th, starts): the windows over ends of paths that occur elsewhere too, by a hash and a second, independent one of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes_of, others_of = word_hashes(), word_hashes(VERIFYING)
        for part in slices(batches):
            starts, hashes, others = [], [], []
            for text, m in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                words = words_of(text)
                at = doubtful(len(words), runs(m))
                starts.append(at.astype(np.int32))
                for found, of in ((hashes, hashes_of), (others, others_of)):
                    found.append(kmers(words, of, WINDOW)[at].view(np.int64) if len(at) else at.astype(np.int64))
            lists = [pa.array(starts, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64())), pa.array(others, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], names=["did", "th", "starts", "hs", "vs"])

    lists = cut(rows.where("_maybe").select("did", "th", "text").join(marks, ["did", "th"]).mapInArrow(run, "did string, th binary, starts array<int>, hs array<long>, vs array<long>"), "windows")
    places = lists.select("did", "th", F.explode(F.arrays_zip(F.col("starts").alias("start"), F.col("hs").alias("h"), F.col("vs").alias("v"))).alias("x")).select("did", "th", "x.start", "x.h", "x.v")
    several = cut(places.groupBy("h", "v").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h", "v"), "several")
    found = places.join(several, ["h", "v"]).groupBy("did", "th").agg(F.collect_set("start").alias("starts"))
    found = cut(found, "repeated")
    forget(lists, several)
    return found


def mask(n: int, spans: list[tuple[int, int]], starts: list[int]) -> np.ndarray:
    """Which of n words are inside a repeated window."""
    edge = np.zeros(n + 1, np.int32)
    for s, e in spans:
        if e - s >= WINDOW:
            edge[s] += 1
            edge[e] -= 1
    for s in starts:
        edge[s] += 1
        edge[s + WINDOW] -= 1
    return np.cumsum(edge[:n]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of each row, and the kept text if asked."""
    rows = keyed(docs, id_col, text_col)
    marks = repeated_anchors(rows)
    rows = sifted(rows, sieve(marks, "did", "th"), "did", "th")
    found = repeated_windows(rows, marks)
    per_doc = marks.join(found, ["did", "th"], "left").select("did", "th", "marks", "starts")
    out = ["id", "text", "marks", "starts"]
    joined = rows.where("_maybe").join(per_doc, ["did", "th"], "left").select(out)
    alone = rows.where("NOT _maybe").select("id", "text", *[F.lit(None).cast(joined.schema[c].dataType).alias(c) for c in out[2:]])
    joined = joined.unionByName(alone)  # most documents repeat nothing: their texts are not moved
    id_type = joined.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            n, gone, shas, texts = [], [], [], []
            for text, m, starts in zip(*(part.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                words = words_of(text)
                n.append(len(words))
                if m:
                    out = mask(len(words), runs(m), starts or [])
                    gone.append(int(out.sum()))
                    words = [w for w, x in zip(words, out.tolist(), strict=True) if not x]
                else:
                    gone.append(0)
                kept = b" ".join(words)
                shas.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode("utf-8", "replace") if with_text else None)
            columns = [part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.string())] * with_text, names=names)

    names = ["id", "n_words", "n_removed", "kept_sha256"] + ["text"] * with_text
    return joined.mapInArrow(run, f"id {id_type}, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text)


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
