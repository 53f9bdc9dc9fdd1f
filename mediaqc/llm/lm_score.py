"""Language-model scores: the marginal probability of a text over all its segmentations in a subword lattice.

The entries of the lattice are the pieces of an existing subword vocabulary (the first piece of a word carries the
word-begin sign; characters without a piece go by their bytes) and the words of the training documents. A piece's weight
starts from its score in the vocabulary, which orders the pieces; a word starts with the weight that the vocabulary gives
it, the sum over its segmentations. All entries are then re-estimated once together, by their expected counts in the
lattices of all training words, so a word keeps half of its count and its pieces share the other half. A forward recursion
in log space sums over all segmentations, the word itself among them. Begin and end of words follow from the entries, so
the weights are a distribution over texts: a text's probability is the product over its words and one end.

Words are counted in a table that grows with the corpus, and each word's lattice is summed once, there. What the ``HEAD``
most frequent words of up to ``MOST_CHARS`` characters add is broadcast (a fixed bound, in bytes too); for all others
(document, word) pairs are joined with the table. The base score is the additively smoothed word model of the contract,
from the same counts. A word of n characters takes 8 n bytes and its recursion rolls over a few columns.

Defined results: a null or empty text has one token, the end; rows without an id are in training by the checksum of the
empty text; repeated rows count and are scored as often as they come; words of equal count are in the head together or
not at all; without training documents the counts are 0 and the lattice has the vocabulary alone; an empty table gives an
empty table; columns of any other names are not read.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from math import exp, inf, log, log1p, log10

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaqc.llm.common import cut, documents, forget, slices, text_of

HEAD, MOST_CHARS = 200_000, 64
#: Longer words go through the recursion one by one.
LONG = 256
#: Words and characters that a task counts before it hands them on.
COUNTED, READ = 200_000, 32_000_000
#: Weight of the vocabulary's own order against the counts, in tokens.
PRIOR = 1000.0
BEGIN = "▁"
#: Stands for the sign inside a word, which has no piece there and goes by bytes.
OTHER = "\ue581"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_LN10 = log(10.0)


def tokens(text: str) -> list[str]:
    return [w.decode("utf-8", "replace") for w in text.encode("utf-8", "surrogatepass").translate(_LOWER).split()]


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63)


class Pieces:
    """The pieces of a vocabulary with their probabilities. The last entry of ``p`` is the end of a text."""

    def __init__(self, names: list[str], scores: list[float], data: dict[int, int]):
        """``scores`` order the pieces, best first; ``data`` has the piece of each byte."""
        usable = [i for i, (n, s) in enumerate(zip(names, scores, strict=True)) if n and (s > -1e8 or n == BEGIN) and BEGIN not in n[1:]]
        n = len(names)
        p = np.zeros(n + 1)
        for rank, i in enumerate(sorted(usable, key=lambda i: (-scores[i], i))):
            p[i] = 1 / (rank + 10)
        p /= max(p.sum(), 1e-300)
        for i in data.values():
            p[i] = 1e-3 / len(data)
        p[n] = 0.01
        self.p, self.word = p / p.sum(), 0.0
        self.bytes_at = [data[b] for b in range(256)]
        self.index: dict[str, int] = {}  # a piece or, with -1, the begin of one
        for i in usable:
            for k in range(1, len(names[i])):
                self.index.setdefault(names[i][:k], -1)
        for i in usable:
            self.index[names[i]] = i
        if self.index.get(BEGIN, -1) < 0:
            raise ValueError("the vocabulary has no piece for the begin of a word")
        self.begins = np.array([n.startswith(BEGIN) for n in names] + [False])
        self.widest = max(len(names[i]) for i in usable)
        self.begin = self.p[-1] + self.p[:-1][self.begins[:-1]].sum()

    def reweighed(self, expected: np.ndarray, n_words: int) -> None:
        """New weights from the expected counts of the pieces without the words' own entries, and of the end.

        A word's own entry starts with the weight of all its segmentations together, so in the lattice each has half of its
        ``n_words`` occurrences.
        """
        expected = np.append(expected[:-1] / 2, expected[-1])
        total = expected.sum() + n_words / 2 + PRIOR
        self.p = (expected + PRIOR * self.p) / total
        self.word = 0.5 / total  # of each occurrence
        self.begin = self.p[-1] + self.p[:-1][self.begins[:-1]].sum() + self.word * n_words

    def log_end(self) -> float:
        """Natural log of the chance that no further word begins."""
        return log(self.p[-1] / self.begin)

    def word_weight(self) -> float:
        """What an occurrence adds to the weight of a word's own entry. After it no piece can follow, only a begin or the end."""
        return self.word / self.begin

    def lattices(self, words: list[str], counts: np.ndarray | None = None):
        """Natural log of each word's marginal over its pieces; with ``counts`` the expected counts of the pieces instead."""
        logs = np.log(np.maximum(self.p, 1e-300))
        out = np.zeros(len(words))
        expected = np.zeros(len(self.p))
        by_length: dict[int, list[int]] = {}
        words = [BEGIN + w.replace(BEGIN, OTHER) for w in words]
        for k, w in enumerate(words):
            if len(w) <= LONG:
                by_length.setdefault(len(w), []).append(k)
            else:
                out[k] = self._one(w, logs.tolist(), None if counts is None else counts[k], expected)
        for n, group in by_length.items():
            size = max(1, 400_000 // (n * self.widest))
            for at in range(0, len(group), size):
                part = group[at : at + size]
                out[part] = self._same_length(n, [words[k] for k in part], logs, None if counts is None else counts[part], expected)
        return out if counts is None else expected

    def _same_length(self, n: int, words: list[str], logs: np.ndarray, counts, expected) -> np.ndarray:
        get, m = self.index.get, self.widest
        at, ids = [], []
        spelled = []  # (arc, pieces of the bytes of a character)
        for k, w in enumerate(words):
            row = k * n
            for i in range(n):
                one = False
                for j in range(i + 1, min(n, i + m) + 1):
                    piece = get(w[i:j])
                    if piece is None:
                        break
                    if piece >= 0:
                        at.append((row + i) * m + j - i - 1)
                        ids.append(piece)
                        one = one or j == i + 1
                if not one:
                    spelled.append(((row + i) * m, [self.bytes_at[b] for b in w[i].encode("utf-8", "surrogatepass")]))
        arcs = np.full(len(words) * n * m, -np.inf)
        at, ids = np.array(at, np.int64), np.array(ids, np.int64)
        arcs[at] = logs[ids]
        for a, pieces in spelled:
            arcs[a] = logs[pieces].sum()
        arcs = arcs.reshape(len(words), n, m)
        forward = np.full((len(words), n + 1), -np.inf)
        forward[:, 0] = 0
        with np.errstate(invalid="ignore"):
            for j in range(1, n + 1):
                width = min(j, m)
                reach = np.stack([forward[:, j - k] + arcs[:, j - k, k - 1] for k in range(1, width + 1)])
                most = reach.max(axis=0)
                forward[:, j] = most + np.log(np.exp(reach - most).sum(axis=0))
            if counts is None:
                return forward[:, n]
            back = np.full((len(words), n + 1), -np.inf)
            back[:, n] = 0
            for i in range(n - 1, -1, -1):
                width = min(n - i, m)
                reach = np.stack([back[:, i + k] + arcs[:, i, k - 1] for k in range(1, width + 1)])
                most = reach.max(axis=0)
                back[:, i] = most + np.log(np.exp(reach - most).sum(axis=0))
        k, i, width = at // (n * m), at // m % n, at % m + 1
        share = counts[k] * np.exp(forward[k, i] + logs[ids] + back[k, i + width] - forward[k, n])
        expected += np.bincount(ids, share, len(expected))
        for a, pieces in spelled:
            k, i = a // (n * m), a // m % n
            np.add.at(expected, pieces, counts[k] * np.exp(forward[k, i] + logs[pieces].sum() + back[k, i + 1] - forward[k, n]))
        return forward[:, n]

    def _arcs(self, w: str, i: int):
        """(end, pieces) of the arcs that start at ``i``."""
        one = False
        for j in range(i + 1, min(len(w), i + self.widest) + 1):
            piece = self.index.get(w[i:j])
            if piece is None:
                break
            if piece >= 0:
                one = one or j == i + 1
                yield j, (piece,)
        if not one:
            yield i + 1, [self.bytes_at[b] for b in w[i].encode("utf-8", "surrogatepass")]

    def _one(self, w: str, logs: list[float], count, expected: np.ndarray) -> float:
        """The same for one word of any length."""
        n = len(w)
        forward = array("d", [-inf]) * (n + 1)
        forward[0] = 0.0
        for i in range(n):
            here = forward[i]
            for j, pieces in self._arcs(w, i):
                forward[j] = _added(forward[j], here + sum(logs[p] for p in pieces))
        if count is not None:
            back = {n: 0.0}  # of the next few columns
            for i in range(n - 1, -1, -1):
                sum_here = -inf
                for j, pieces in self._arcs(w, i):
                    rest = sum(logs[p] for p in pieces) + back[j]
                    sum_here = _added(sum_here, rest)
                    share = float(count) * exp(forward[i] + rest - forward[n])
                    for p in pieces:
                        expected[p] += share
                back[i] = sum_here
                back.pop(i + self.widest + 1, None)
        return forward[n]


def _added(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    if a < b:
        a, b = b, a
    return a if b == -inf else a + log1p(exp(b - a))


def read_pieces(path: str) -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(n)]
    data = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
    plain = ["" if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else names[i] for i in range(n)]
    return Pieces(plain, [sp.get_score(i) for i in range(n)], data)


def slim_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    held = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1
    return docs.select(F.col(id_col).alias("id"), held.alias("held_out"), text_of(text_col).alias("text"))


def count_words(rows: DataFrame) -> DataFrame:
    """(h, word, c) of each word of the corpus: its count in the training documents, 0 for words of others only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        others: set = set()
        read = 0

        def out():
            words = [*counts, *(others - counts.keys())]
            return pa.RecordBatch.from_arrays([pa.array([word_hash(w) for w in words], pa.int64()), pa.array(words, pa.string()), pa.array([counts.get(w, 0) for w in words], pa.int64())], names=["h", "word", "c"])

        for batch in slices(batches):
            for held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (others if held else counts).update(tokens(text))
                read += len(text)
                if len(counts) + len(others) > COUNTED or read > READ:
                    yield out()
                    counts.clear()
                    others.clear()
                    read = 0
        if counts or others:
            yield out()

    seen = rows.select("held_out", "text").mapInArrow(run, "h long, word string, c long")
    return seen.groupBy("h").agg(F.min("word").alias("word"), F.sum("c").alias("c"))


def marginals(counted: DataFrame, pieces: Pieces) -> DataFrame:
    """(h, word, c, x): log10 of each word's lattice, once a word."""
    shared = counted.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            x = shared.value.lattices(batch.column(1).to_pylist()) / _LN10
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(x)], names=["h", "word", "c", "x"])

    return counted.select("h", "word", "c").mapInArrow(run, "h long, word string, c long, x double")


def expected_pieces(counted: DataFrame, pieces: Pieces) -> np.ndarray:
    """Expected counts of the pieces over all training words: partial sums by task, one row a piece in the end."""
    shared = counted.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            found = shared.value.lattices(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(np.float64))
            total = found if total is None else total + found
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["i", "x"])

    sums = counted.select("word", "c").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(len(pieces.p))
    for i, x in sums:
        out[i] = x
    return out


def least_count(known: DataFrame, head: int) -> int:
    """A count that at most ``head`` words reach, from the numbers of words by ranges of their count: a few hundred rows."""
    ranges = known.where("c > 0").groupBy(F.floor(F.log2("c") * 16).alias("r")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c"), F.max("c").alias("most")).collect()
    least, words = 1 + max((x.most for x in ranges), default=0), 0
    for x in sorted(ranges, key=lambda x: -x.c):
        words += x.n
        if words > head:
            break
        least = x.c
    return least


def log10_chance(c: int, x: float, own: float) -> float:
    """log10 of a token's probability: its segmentations and, of ``c`` occurrences in training, its own entry."""
    return log10(c * own + 10.0 ** max(x, -300.0)) if c * own > 0 else x


def score_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; ``path`` names a piece model."""
    spark = docs.sparkSession
    rows = slim_rows(docs, id_col, text_col)
    counted = cut(count_words(rows), "word-counts")
    n_docs = rows.where("NOT held_out").count()
    n_words, n_types = counted.where("c > 0").agg(F.sum("c"), F.count(F.lit(1))).first()
    n_train, types = (n_words or 0) + n_docs, n_types + (n_docs > 0)
    pieces = read_pieces(path)
    if n_docs:
        expected = expected_pieces(counted.where("c > 0"), pieces)
        expected[-1] = n_docs
        pieces.reweighed(expected, int(n_words or 0))
    own = pieces.word_weight()
    known = cut(marginals(counted, pieces), "words")
    forget(counted)
    top = known.where((F.col("c") >= least_count(known, head)) & (F.length("word") <= MOST_CHARS)).select("word", "c", "x").collect()
    # what each token of the head adds to the base score and to the score
    shared = spark.sparkContext.broadcast({r.word: (log10(r.c + 0.5), log10_chance(r.c, r.x, own)) for r in top})
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_head = shared.value.get
        for part in slices(batches):
            n, n_known, base, score, hs, tfs = [], [], [], [], [], []
            for text in part.column(2).to_pylist():
                words = tokens(text)
                b = s = 0.0
                k, h, f = 0, [], []
                for w, tf in Counter(words).items():
                    found = of_head(w)
                    if found is None:
                        h.append(word_hash(w))
                        f.append(tf)
                    else:
                        b += tf * found[0]
                        s += tf * found[1]
                        k += tf
                for out, value in ((n, len(words) + 1), (n_known, k), (base, b), (score, s), (hs, h), (tfs, f)):
                    out.append(value)
            columns = [pa.array(n, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base), pa.array(score), pa.array(hs, pa.list_(pa.int64())), pa.array(tfs, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=names)

    names = ["id", "held_out", "n_tokens", "known", "base", "part", "hs", "tfs"]
    schema = f"id {id_type}, held_out boolean, n_tokens long, known long, base double, part double, hs array<long>, tfs array<int>"
    lists = cut(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = lists.select("row", F.explode(F.arrays_zip("hs", "tfs")).alias("t")).select("row", F.col("t.hs").alias("h"), F.col("t.tfs").alias("tf"))
    c = F.col("c")
    of_known = F.log10(c * F.lit(own) + F.pow(F.lit(10.0), F.greatest("x", F.lit(-300.0))))
    of_word = F.when(c * F.lit(own) > 0, of_known).otherwise(F.col("x"))
    words = known.select("h", "c", F.log10(c + 0.5).alias("of_base"), of_word.alias("of_score"))
    sums = rest.join(words, "h").groupBy("row").agg(
        F.sum(F.col("tf") * F.col("of_base")).alias("base2"), F.sum(F.col("tf") * F.col("of_score")).alias("part2"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("known2")
    )
    end = pieces.log_end() / _LN10
    base_end, norm = log10(n_docs + 0.5), log10(n_train + 0.5 * (types + 1))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    return lists.drop("hs", "tfs").join(sums, "row", "left").select(
        "id",
        "held_out",
        "n_tokens",
        (F.col("known") + zero("known2") + F.lit(int(n_docs > 0))).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base2") + F.lit(base_end) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("part") + zero("part2") + F.lit(end)).alias("score"),
    )


def vocabulary() -> str:
    """The piece model of the production scorer."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir), vocabulary()).withColumnRenamed("id", "doc_id")
