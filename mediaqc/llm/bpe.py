"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary's tokens resolves pre-tokens that are themselves tokens. Tier two:
any other pre-token is a chain of linked bytes whose adjacent pairs wait in a heap by rank; the lowest rank merges until
no pair is in the vocabulary. The hash (about 0.5 MB for 50,000 tokens, bounded by the vocabulary) and the rank table are
broadcast; texts are encoded where they lie, without a shuffle. A task remembers the answers for two generations of at most
``REMEMBERED`` pre-tokens of up to 64 characters, 4 bytes an id, some tens of MB, and forgets them when it ends. The chain of a pre-token takes about
120 bytes a byte while it is merged.

Defined results: a null text counts as empty; an empty text has no ids; text of any length is encoded whole; special
tokens in a text are ordinary text; equal ranks of a chain merge from the left; rows are independent, so repeated rows
repeat; columns of any other names are not read.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaqc.llm.common import Remembered, documents, slices, text_of

REMEMBERED = 150_000
_MASK = (1 << 64) - 1


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, in order of rank; ranks are 0 to n - 1."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks are not 0 to n - 1")
    return [t for _, t in pairs]


def _slot(h: int, d: int, n: int) -> int:
    """The slot of a key with hash h in a bucket displaced by d."""
    x = (h ^ (d * 0x9E3779B97F4A7C15)) & _MASK
    x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & _MASK
    return (x ^ (x >> 29)) % n


class Generations(Remembered):
    """As ``Remembered``, but what is full becomes the old generation instead of being lost; what is asked for again comes back from it."""

    def __init__(self, make, most: int):
        super().__init__(make, most)
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class PerfectHash:
    """Hash and displace: n keys to n slots. A bucket of one key holds its slot itself, as -slot - 1."""

    def __init__(self, tokens: list[bytes], per_bucket: int = 2):
        n = self.n = len(tokens)
        self.m = max(1, -(-n // per_bucket))
        self.displaced = np.zeros(self.m, np.int32)
        self.ids = np.full(max(n, 1), -1, np.int32)
        buckets: dict[int, list[tuple[int, int]]] = {}
        for i, t in enumerate(tokens):
            h = xxhash.xxh3_64_intdigest(t)
            buckets.setdefault(h % self.m, []).append((h, i))
        for b, keys in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(keys) == 1:
                break
            d = 1
            while True:
                slots = [_slot(h, d, n) for h, _ in keys]
                if len(set(slots)) == len(slots) and all(self.ids[s] < 0 for s in slots):
                    break
                d += 1
            self.displaced[b] = d
            for s, (_, i) in zip(slots, keys, strict=True):
                self.ids[s] = i
        free = iter(np.flatnonzero(self.ids[:n] < 0).tolist())
        for b, keys in sorted(buckets.items()):
            if len(keys) == 1:
                s = next(free)
                self.displaced[b] = -s - 1
                self.ids[s] = keys[0][1]
        self.displaced, self.ids = array("i", self.displaced.tobytes()), array("i", self.ids.tobytes())  # plain numbers are read faster

    def find(self, key: bytes, tokens: list[bytes]) -> int:
        """The id of ``key``, or -1: any key has a slot, so the token found there must be the key itself."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displaced[h % self.m]
        i = self.ids[-d - 1 if d < 0 else _slot(h, d, self.n)]
        return i if tokens[i] == key else -1


def merge(piece: bytes, rank_of: dict[bytes, int]) -> list[int]:
    """The ids of ``piece`` by merging the adjacent pair of lowest rank, leftmost first."""
    n, get = len(piece), rank_of.get
    parts = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    # an entry is rank * n + place, so that entries order by rank, then leftmost
    heap = [r * n + i for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        entry = heappop(heap)
        i = entry % n
        left = parts[i]
        if not left:
            continue  # merged meanwhile
        j = after[i]
        if j >= n:
            continue
        both = left + parts[j]
        if get(both) != entry // n:
            continue
        parts[i], parts[j] = both, b""
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := get(both + parts[k])) is not None:
                heappush(heap, r * n + i)
        h = before[i]
        if h >= 0 and (r := get(parts[h] + both)) is not None:
            heappush(heap, r * n + h)
    return [rank_of[p] for p in parts if p]


class Codec:
    """Encodes and decodes. It remembers the ids of pre-tokens, so it is made anew in each task."""

    def __init__(self, tokens: list[bytes], table: PerfectHash, pattern: str):
        self.tokens, self.table = tokens, table
        self.rank_of = {t: i for i, t in enumerate(tokens)}
        self.split = regex.compile(pattern).findall
        self.decimals = list(map(str, range(len(tokens))))
        self.ids_of = Generations(self.word, REMEMBERED)

    def word(self, word: str) -> bytes:
        """The ids of a pre-token, 4 bytes each."""
        piece = word.encode()
        i = self.table.find(piece, self.tokens)
        return array("i", (i,) if i >= 0 else merge(piece, self.rank_of)).tobytes()

    def encode(self, text: str) -> list[int]:
        return array("i", b"".join(map(self.ids_of.__getitem__, self.split(text)))).tolist()

    def spelled(self, ids) -> str:
        return ",".join(map(self.decimals.__getitem__, ids))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Vocabulary:
    def __init__(self, path: str):
        self.tokens = read_ranks(path)
        self.table = PerfectHash(self.tokens)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of each text; ``path`` names a rank file that the driver reads."""
    return _map(docs, path, pattern, id_col, text_col, "ids array<int>", lambda codec, text: (codec.encode(text),))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each text, and its ids if asked: encoded, then decoded from the ids."""

    def figures(codec: Codec, text: str):
        ids = codec.encode(text)
        return *((ids,) if with_ids else ()), len(ids), hashlib.sha256(codec.spelled(ids).encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()

    return _map(docs, path, pattern, id_col, text_col, "ids array<int>, " * with_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string", figures)


def _map(docs, path, pattern, id_col, text_col, columns, figures) -> DataFrame:
    slim = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(_Vocabulary(path))
    schema = f"id {slim.schema['id'].dataType.simpleString()}, {columns}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value.tokens, shared.value.table, pattern)
        for part in slices(batches):
            rows = [figures(codec, t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True))], names=names)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fields
    names, types = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields[1:]]
    return slim.mapInArrow(run, schema)


def vocabulary() -> tuple[str, str]:
    """Rank file and pattern of the production tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), *vocabulary()).withColumnRenamed("id", "doc_id")
