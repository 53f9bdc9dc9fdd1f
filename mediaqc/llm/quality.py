"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text is hashed to a sparse vector: its words, the first letters of its longer words, the shapes of its words (runs of
capitals, small letters, digits and signs; of a shape the first 12 runs, as a feature: the word itself counts whole) and
how much it repeats. All grades share the weights; ordered thresholds part
them: P(grade >= k) is the logistic of score minus threshold k. The fit is made on the driver over the ``MOST_RATED``
rated documents of the smallest hash of their id and, as the middle grades are rare, over those of each up to
``MOST_MIDDLE``; the loss is weighted back to the shares of the grades among all ratings. Vectors are made on the
executors. All documents are then scored where they lie.

Defined results: null and empty texts are the same document without words and are scored by that; a text of any length
is read whole; rows without a rating are scored like others; a tail equal to the threshold is kept; a document with several ratings counts with the lowest, null ratings don't count; a rated id with several texts is learnt from that of the least digest; without
ratings the weights are 0, each tail is 1/2 and everything is kept; repeated rows repeat; columns of any other names are not read, or carried as they came.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaqc.llm.common import Remembered, documents, slices, text_of

DIMENSIONS = 1 << 18
MOST_RATED = 8_000
#: Documents of each middle grade (of three: good but toxic).
MOST_MIDDLE = 4_000
#: Words that differ in their endings alone share the weight of their first letters.
BEGINNING = 5
#: Words that a task remembers.
REMEMBERED = 100_000
#: Documents of the sample that must have a feature for it to get a weight (fewer in samples of under 1000).
MOST_NEEDED = 6
#: The same for what only documents of one middle grade have.
NEEDED_ALONE = 2
ROUNDS = 150
FIT_BLOCK = 1_000
#: A document is kept if the tail probability of the selected grade is at least this.
LEAST_TAIL = 0.4

_EDGE = re.compile(r"^\W+|\W+$")
_RUNS = ((re.compile("[A-ZÀ-Þ]+"), "A"), (re.compile(r"[^\W\d_A-Z]+"), "a"), (re.compile(r"\d+"), "0"), (re.compile(r"(\W)\1+"), r"\1"))


def _at(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token.encode()) % DIMENSIONS


#: Signs of a shape that count.
SHAPE = 12


def _places(word: str) -> tuple[int, int, int]:
    """Place of the word, of its shape, of its first letters or -1 for a short word."""
    shape = word.replace("a", "b")
    for pattern, sign in _RUNS:
        shape = pattern.sub(sign, shape)
    bare = _EDGE.sub("", word.lower())
    return _at("w:" + bare), _at("s:" + shape[:SHAPE]), _at("p:" + bare[:BEGINNING]) if len(bare) > BEGINNING else -1


def word_places() -> Remembered:
    return Remembered(_places, REMEMBERED)


_ADJACENT, _DISTINCT, _EMPTY = _at("r:adjacent"), _at("r:distinct"), _at("r:empty")


def vector(text: str, places_of: Remembered) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text; a place may come several times, its values add up. One insult counts the same in a long text."""
    words = text.split()
    n = len(words)
    if not n:
        return np.array([_EMPTY], np.int32), np.array([1.0], np.float32)
    counts = Counter(words)
    k = len(counts)
    places = np.array([places_of[w] for w in counts], np.int32)
    tf = np.fromiter(counts.values(), np.float32, k)
    same = sum(map(str.__eq__, words, words[1:])) / n
    often, long = np.log1p(tf) / 2, places[:, 2] >= 0
    at = np.concatenate([places[:, 0], places[long, 2], places[:, 1], np.array([_ADJACENT, _DISTINCT], np.int32)])
    return at, np.concatenate([often, often[long], tf * np.float32(4 / n), np.array([4 * same, 2 * k / n], np.float32)])


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(DIMENSIONS, np.float32))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of each score."""
        return _logistic(scores[:, None] - self.thresholds[None, :])


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _merged(vector: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The vector with each place once."""
    places, at = np.unique(vector[0], return_inverse=True)
    return places.astype(np.int32), np.bincount(at, vector[1], len(places)).astype(np.float32)


def _known(vectors: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int) -> np.ndarray:
    """Places that get a weight: what few documents have is noise, but less so if all of them have the same middle grade."""
    seen = np.zeros((n_grades, DIMENSIONS), np.int32)
    for (places, _), grade in zip(vectors, grades, strict=True):
        seen[grade, places] += 1
    total = seen.sum(axis=0)
    needed = min(MOST_NEEDED, 1 + len(vectors) // 200)
    alone = (seen[1:-1] == total).any(axis=0)
    return total >= np.where(alone, min(NEEDED_ALONE, needed), needed)


def fit(
    vectors: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int, rounds: int = ROUNDS, rate: float = 0.2, decay: float = 2e-5, shares: np.ndarray | None = None
) -> Model:
    """Full-batch gradient steps with momentum scaled by root mean square (Adam), the same on each run.

    ``shares`` are those of the grades among all ratings; the loss is weighted to them.
    """
    model = Model(thresholds=np.zeros(n_grades - 1))
    if not vectors:
        return model
    n = len(vectors)
    known = _known(vectors, grades, n_grades)
    used = np.flatnonzero(known)
    d = len(used)
    number = np.full(DIMENSIONS, -1, np.int32)
    number[used] = np.arange(d)
    blocks = []  # so that a step's temporary arrays are small
    for start in range(0, n, FIT_BLOCK):
        part = [_merged(v) for v in vectors[start : start + FIT_BLOCK]]
        row = np.repeat(np.arange(len(part), dtype=np.int32), [len(v[0]) for v in part])
        at, x = number[np.concatenate([v[0] for v in part])], np.concatenate([v[1] for v in part])
        blocks.append((slice(start, start + len(part)), row[at >= 0], at[at >= 0], x[at >= 0]))
    here = np.bincount(grades, minlength=n_grades)
    part = np.full(n, 1 / n)  # of the loss, by row
    if shares is not None:
        part = (np.asarray(shares) / np.maximum(here, 1))[grades]
        part /= part.sum()
    # weights, first threshold, logarithms of the steps between thresholds
    p = np.zeros(d + n_grades - 1)
    p[d + 1 :] = 0.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        steps = np.exp(p[d + 1 :])
        cuts = np.concatenate([[-np.inf], p[d] + np.concatenate([[0.0], np.cumsum(steps)]), [np.inf]])
        s = np.concatenate([np.bincount(row, x * p[at], rows.stop - rows.start) for rows, row, at, x in blocks])
        low, high = _logistic(cuts[grades] - s), _logistic(cuts[grades + 1] - s)
        chance = np.maximum(high - low, 1e-12)
        d_high, d_low = part * high * (1 - high) / chance, part * low * (1 - low) / chance
        d_s = d_high - d_low  # of the loss, by the score
        d_cut = np.bincount(grades + 1, -d_high, n_grades + 1)[: n_grades + 1] + np.bincount(grades, d_low, n_grades + 1)[: n_grades + 1]
        d_cut = d_cut[1:n_grades]
        g = np.empty_like(p)
        g[:d] = decay * p[:d]
        for rows, row, at, x in blocks:
            g[:d] += np.bincount(at, x * d_s[rows][row], d)
        g[d] = d_cut.sum()
        for k in range(n_grades - 2):
            g[d + 1 + k] = d_cut[k + 1 :].sum() * steps[k]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    model.weights[used] = p[:d]
    model.thresholds = p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1 :]))])
    return model


def sample(rated: DataFrame, n_grades: int, most: int = MOST_RATED, most_middle: int = MOST_MIDDLE) -> DataFrame:
    """The rows (id, grade) of the smallest hashes: ``most`` of all, and of each middle grade up to ``most_middle``."""
    order = F.xxhash64("id"), F.col("id")
    chosen = rated.orderBy(*order).limit(most)
    for grade in range(1, n_grades - 1):
        chosen = chosen.unionByName(rated.where(F.col("grade") == grade).orderBy(*order).limit(most_middle))
    return chosen.distinct()


def train(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, most: int = MOST_RATED, id_col: str = "doc_id", text_col: str = "text", most_middle: int = MOST_MIDDLE) -> Model:
    """``ratings`` has the id and ``grade``, 0 to n_grades - 1."""
    all_rated = (
        ratings.select(F.col(id_col).alias("id"), F.col("grade").cast("int").alias("grade"))
        .where("id IS NOT NULL AND grade IS NOT NULL")
        .groupBy("id").agg(F.min("grade").alias("grade"))
    )
    shares = np.zeros(n_grades)
    for r in all_rated.groupBy("grade").count().collect():
        shares[r.grade] = r["count"]
    rated = sample(all_rated, n_grades, most, most_middle)
    slim = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    chosen = slim.join(F.broadcast(rated), "id").select("id", "grade", "text")
    # one text an id, found by partial aggregation: no more vectors come to the driver than ids are in the sample
    chosen = chosen.groupBy("id", "grade").agg(F.min(F.struct(F.sha2("text", 256).alias("digest"), "text")).alias("one")).select("id", "grade", "one.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places_of = word_places()
        for batch in slices(batches):
            found = [_merged(vector(t, places_of)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([v[0].tobytes() for v in found], pa.binary()), pa.array([v[1].tobytes() for v in found], pa.binary()), batch.column(0).cast(pa.string())], names=["grade", "places", "parts", "id"])

    # as Arrow buffers, passed through the driver's JVM as they arrive; the vectors are views of them
    table = chosen.mapInArrow(run, "grade int, places binary, parts binary, id string").toArrow()
    ids, graded = table.column("id").to_pylist(), table.column("grade").to_numpy().astype(np.int64)
    order = sorted(range(len(ids)), key=ids.__getitem__)  # an id is one row
    places, parts = table.column("places"), table.column("parts")
    vectors = [(np.frombuffer(places[k].as_buffer(), np.int32), np.frombuffer(parts[k].as_buffer(), np.float32)) for k in order]
    graded = graded[order]
    del table, ids
    return fit(vectors, graded, n_grades, shares=shares)


def score(docs: DataFrame, model: Model, least_tail: float = LEAST_TAIL, grade: int | None = None, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(id, expected_grade, tail, kept), or with ``carry`` the rows of ``docs`` that are kept, as they came."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    k = (len(model.thresholds) if grade is None else grade) - 1

    def figures(texts: pa.Array, places_of: Remembered) -> tuple[np.ndarray, np.ndarray]:
        weights = shared.value.weights
        found = [vector(t or "", places_of) for t in texts.to_pylist()]
        tails = shared.value.tails(np.array([float(weights[at] @ x) for at, x in found]).reshape(-1))
        return tails.sum(axis=1), tails[:, k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places_of = word_places()
        for part in slices(batches):
            if carry:
                tail = figures(part.column(text_at), places_of)[1]
                yield part.filter(pa.array(tail >= least_tail))
            else:
                expected, tail = figures(part.column(1), places_of)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(expected), pa.array(tail), pa.array(tail >= least_tail)], names=["id", "expected_grade", "tail", "kept"])

    if carry:
        text_at = docs.columns.index(text_col)
        return docs.mapInArrow(run, docs.schema)
    slim = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, expected_grade double, tail double, kept boolean")


def grades(labels: DataFrame) -> DataFrame:
    """Poor texts have grade 0, good ones 1 if they are toxic and 2 otherwise."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


def production(spark, docs: DataFrame, sf_dir: str) -> Model:
    return train(docs, grades(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, production(spark, docs, sf_dir)).select(F.col("id").alias("doc_id"), "expected_grade", "tail", "kept")
