"""Byte-level BPE: encoding by the ranks of a vocabulary file, and decoding.

Each match of the split pattern, a pre-token, is encoded by itself in two tiers. A minimal perfect hash over
the vocabulary finds the pre-tokens that are one token. The others are merged: their bytes form a linked list,
and a heap gives the pair of neighbours with the lowest rank, the leftmost first, until no pair has a rank. A
bounded memo in front of both keeps what a task has just encoded.

Cases: a null or empty text has no ids and decodes to nothing. Whole texts are encoded, of any length, in
batches of bounded size. Repeated rows are encoded each by itself. Kept columns pass through; other columns
play no part.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from sys import getsizeof

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import apart, broadcast, passed, table

#: Characters encoded, or ids decoded, before a batch is handed on.
CHUNK = 1 << 20
#: Bytes of the pre-tokens, with their ids, that a task remembers, and as many of those that it used before.
MEMO = 3 << 24
#: What a dictionary takes for an entry.
ENTRY = 80


class PerfectHash:
    """n distinct keys to the slots 0..n-1, and only them: every slot keeps its key for comparison.

    Keys fall in buckets; from the largest bucket on, a displacement is sought that sends all its keys to free
    slots. Buckets of one key take the free slots that are left, without a search.
    """

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.n_buckets = max(1, self.n // 4)
        buckets: list[list[tuple[int, int]]] = [[] for _ in range(self.n_buckets)]
        for i, key in enumerate(keys):
            b, x = self._places(key)
            buckets[b].append((x, i))
        self.displaced = [0] * self.n_buckets
        self.slots = [-1] * self.n
        order = sorted(range(self.n_buckets), key=lambda b: -len(buckets[b]))
        free = None
        for b in order:
            if not buckets[b]:
                break
            if len(buckets[b]) == 1:
                if free is None:
                    free = iter([s for s, i in enumerate(self.slots) if i < 0])
                slot = next(free)
                self.slots[slot], self.displaced[b] = buckets[b][0][1], -slot - 1
                continue
            d = 0
            while True:
                at = {self._slot(x, d) for x, _ in buckets[b]}
                if len(at) == len(buckets[b]) and all(self.slots[s] < 0 for s in at):
                    break
                d += 1
            self.displaced[b] = d
            for x, i in buckets[b]:
                self.slots[self._slot(x, d)] = i
        self.keys = [keys[i] for i in self.slots]

    def _places(self, key: bytes) -> tuple[int, int]:
        h = xxhash.xxh3_64_intdigest(key)
        return (h >> 32) % self.n_buckets, h

    def _slot(self, x: int, d: int) -> int:
        x = ((x ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 32)) % self.n

    def get(self, key: bytes) -> int:
        """The position of the key in the list that this was built of, or -1."""
        b, x = self._places(key)
        d = self.displaced[b]
        slot = -d - 1 if d < 0 else self._slot(x, d)
        return self.slots[slot] if self.keys[slot] == key else -1


class Memo(dict):
    """What `make` gave for the strings asked for last, in two generations: a string of the older one that is asked for again is in the newer one from then on.

    The bound is on bytes and holds within a text too, however long its pre-tokens are; what would take a large share of it is made anew each time.
    """

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.held, self.older = make, most, 0, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        weight = ENTRY + getsizeof(key) + getsizeof(value)
        if 16 * weight <= self.most:
            if self.held + weight > self.most:
                self.older, self.held = dict(self), 0
                self.clear()
            self[key] = value
            self.held += weight
        return value


class Encoder:
    """A vocabulary: tokens by rank, the perfect hash over them, and the split pattern."""

    def __init__(self, tokens: list[bytes], ranks: list[int], pattern: str):
        self.hash, self.ranks, self.pattern = PerfectHash(tokens), ranks, pattern
        self.token = dict(zip(ranks, tokens, strict=True))
        self.pair = dict(zip(tokens, ranks, strict=True))  # what two neighbours make
        self.split = None
        self.two = [self.pair.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        self.memo: Memo | None = None

    def __getstate__(self):
        return self.__dict__ | {"split": None, "memo": None}

    def rank(self, piece: bytes) -> int:
        i = self.hash.get(piece)
        return self.ranks[i] if i >= 0 else -1

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of a pre-token that is no token itself."""
        n, get = len(piece), self.pair.get
        bits = n.bit_length()
        mask = (1 << bits) - 1
        after = list(range(1, n + 1))  # where the part that starts here ends, that is, where the next starts
        before = list(range(-1, n - 1))
        two = self.two
        joint = [two[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]  # rank of the part that starts here with the next; -1: none
        joint.append(-1)
        heap = [r << bits | i for i, r in enumerate(joint) if r >= 0]
        heapify(heap)
        while heap:
            least = heappop(heap)
            start = least & mask
            if joint[start] != least >> bits:
                continue  # one of the two has been merged meanwhile
            middle = after[start]
            stop = after[start] = after[middle]
            joint[middle] = -1
            if stop < n:
                before[stop] = start
                r = joint[start] = get(piece[start : after[stop]], -1)
                if r >= 0:
                    heappush(heap, r << bits | start)
            else:
                joint[start] = -1
            if start:
                left = before[start]
                r = joint[left] = get(piece[left:stop], -1)
                if r >= 0:
                    heappush(heap, r << bits | left)
        out, i = [], 0
        while i < n:
            stop = after[i]
            out.append(get(piece[i:stop]))
            i = stop
        return tuple(out)

    def piece(self, text: str) -> bytes:
        """The ids of a pre-token, four bytes each."""
        raw = text.encode("utf-8", "surrogatepass")
        r = self.rank(raw)
        return array("i", (r,) if r >= 0 else self.merge(raw)).tobytes()

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if self.split is None:
            self.split, self.memo = regex.compile(self.pattern).findall, Memo(self.piece, MEMO)
        return np.frombuffer(b"".join(map(self.memo.__getitem__, self.split(text))), np.int32)

    def encode(self, text: str | None) -> list[int]:
        return self.ids(text).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def load(spark: SparkSession, path: str, pattern: str) -> Encoder:
    """The vocabulary of a rank file (token in base64 and rank a line), read on the driver."""
    with open(path, "rb") as f:
        lines = [line.split() for line in f if line.strip()]
    return Encoder([base64.b64decode(t) for t, _ in lines], [int(r) for _, r in lines], pattern)


def encode(docs: DataFrame, encoder: Encoder, text: str = "text", keep: tuple[str, ...] = ("doc_id",), back: bool = False) -> DataFrame:
    """The kept columns and `ids`, the tokens of the whole text; with back also `bytes`, what the ids decode to."""
    return _batched(docs, text, keep, encoder, {"ids": "array<int>"} | ({"bytes": "binary"} if back else {}), lambda enc, text: (ids := enc.ids(text), enc.decode(ids.tolist())) if back else (enc.ids(text),))


def decode(encoded: DataFrame, encoder: Encoder, keep: tuple[str, ...] = ("doc_id", "ids")) -> DataFrame:
    """The kept columns and `bytes`, what the ids stand for."""
    return _batched(encoded, "ids", keep, encoder, {"bytes": "binary"}, lambda enc, ids: (enc.decode(ids or []),))


def _batched(rows: DataFrame, column: str, keep: tuple[str, ...], encoder: Encoder, made: dict[str, str], one) -> DataFrame:
    """The kept columns and what `one` makes of each value, in batches of about CHUNK characters or ids."""
    shared = broadcast(rows.sparkSession, encoder)
    source, sent, schema = passed(rows, column, keep)
    schema = ", ".join([schema, *(f"{k} {v}" for k, v in made.items())])

    def column_of(name: str, values: list) -> pa.Array:
        if name == "bytes":
            return pa.array(values, pa.binary())
        offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared.value
        for batch in batches:
            start, done, size = 0, [], 0
            for i, value in enumerate(batch.column(sent)):
                value = value.as_py()
                done.append(one(enc, value))
                size += len(value or "")
                if size >= CHUNK or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(start, len(done)) for c in keep), *map(column_of, made, map(list, zip(*done, strict=True)))], [*keep, *made])
                    start, done, size = i + 1, [], 0

    return source.mapInArrow(run, schema)


def _public(spark: SparkSession, name: str = "byte_bpe_50k.tiktoken") -> Encoder:
    import public_tokenizers

    return load(spark, public_tokenizers.path(name), public_tokenizers.PATTERN)


def digests(docs: DataFrame) -> DataFrame:
    """Per document its number of tokens and the digests of ids and of what they decode to."""
    encoder = _public(docs.sparkSession)
    coded = encode(docs, encoder, back=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of documents with the ids of the text: what training reads. A column `ids` that was there before makes way for them."""
    docs, back = apart(docs.drop(*(c for c in docs.columns if c.lower() == "ids")))
    coded = encode(docs, _public(spark), keep=tuple(docs.columns))
    return coded.select(*back(coded), "ids")
