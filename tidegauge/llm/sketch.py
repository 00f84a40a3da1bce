"""What may occur twice, found without shuffling what does not: Bloom filters of 64-bit hashes, in blocks.

All bits of a hash lie in one block of 8 KB, so that blocks are merged side by side, in tasks. Filters of equal shape
merge by bits: twice is either side's twice, or both sides' once; no hash that occurs twice is missed.

A filter is broadcast, so it may have BITS bits at most. Where the hashes need more, `suspected` does not fill one:
hashes, of 8 bytes, are counted in a shuffle (partly within each task before it), and rows are joined with those of
their own that occur twice; rows that have none stay out of that shuffle where they are not asked for (`told_only`). Either way callers get `Suspects`: it adds
`__hashes`, null or a list, to their rows and tests hashes with it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import broadcast, written

BLOCK_BITS = 1 << 16
#: Bits of a filter at most, 32 MB: enough for 26 million hashes.
BITS = 1 << 28


def blocks_for(hashes: int) -> int:
    """Blocks for so many hashes at 10 bits each, a power of two; 0 if they would have more than BITS bits."""
    n = 1
    while n * BLOCK_BITS < 10 * hashes:
        n *= 2
    return n if n * BLOCK_BITS <= BITS else 0


def spots(hashes: np.ndarray, n_blocks: int) -> np.ndarray:
    """The three bits of each hash, all in one block (hash x 3)."""
    block = (hashes >> np.uint64(64 - (n_blocks.bit_length() - 1))).astype(np.int64) if n_blocks > 1 else np.zeros(hashes.size, np.int64)
    low = np.stack([(hashes >> np.uint64(16 * j)) & np.uint64(0xFFFF) for j in range(3)], axis=1).astype(np.int64)
    return block[:, None] * BLOCK_BITS + low


def test(bits: np.ndarray, hashes: np.ndarray, n_blocks: int) -> np.ndarray:
    at = spots(hashes, n_blocks)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def put(bits: np.ndarray, hashes: np.ndarray, n_blocks: int) -> None:
    at = spots(hashes, n_blocks).ravel()
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))


def twice_seen(rows: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], n_blocks: int) -> bytes:
    """The bits of all hashes that occur at least twice in what hashes_of finds in the batches of the rows."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = (np.zeros(n_blocks * BLOCK_BITS // 8, np.uint8) for _ in range(2))
        for batch in batches:
            for found in hashes_of(batch):
                hashes, n = np.unique(found, return_counts=True)
                put(twice, hashes[(n > 1) | test(once, hashes, n_blocks)], n_blocks)
                put(once, hashes, n_blocks)
        for b in range(n_blocks):
            part = slice(b * BLOCK_BITS // 8, (b + 1) * BLOCK_BITS // 8)
            if once[part].any():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([zlib.compress(once[part].tobytes(), 1)]), pa.array([zlib.compress(twice[part].tobytes(), 1)])], ["block", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for b, o, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                o, t = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (o, t))
                if b in seen:
                    once, twice = seen[b]
                    twice |= t | (once & o)
                    once |= o
                else:
                    seen[b] = [o.copy(), t.copy()]
        for b, (_, twice) in seen.items():
            if twice.any():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([zlib.compress(twice.tobytes(), 1)])], ["block", "bits"])

    return _gathered(rows.mapInArrow(fill, "block int, once binary, twice binary").repartition("block").mapInArrow(merge, "block int, bits binary"), n_blocks)


def _gathered(blocks: DataFrame, n_blocks: int) -> bytes:
    """The bits of merged blocks, one row each: BITS at most in all."""
    merged = np.zeros((n_blocks, BLOCK_BITS // 8), np.uint8)
    for r in blocks.toLocalIterator():
        merged[r["block"]] = np.frombuffer(zlib.decompress(bytes(r["bits"])), np.uint8)
    return merged.tobytes()


class Suspects:
    """Which hashes may occur twice: by the broadcast filter, or by the list that came with a row."""

    def __init__(self, n_blocks: int, shared: Broadcast | None, own: DataFrame | None = None):
        self.n_blocks, self.shared, self.own = n_blocks, shared, own

    def __getstate__(self):  # what tasks need
        return self.__dict__ | {"own": None}

    def told_only(self, rows: DataFrame) -> DataFrame:
        """The rows (row, ...) with `__hashes`, for work that yields nothing for rows without a suspect: where hashes
        were counted, only rows that have one are shuffled, others are sifted out where they are."""
        if self.own is None:
            return self.told(rows)
        return sifted(rows, self.own, "row").join(self.own, "row")

    def told(self, rows: DataFrame, row: str = "row") -> DataFrame:
        """The rows with `__hashes`."""
        if self.own is None:
            return rows.withColumn("__hashes", F.lit(None).cast("array<long>"))
        return rows.join(self.own.withColumnRenamed("row", row), row, "left")

    def hit(self, hashes: np.ndarray, row: np.ndarray, own: pa.Array | None) -> np.ndarray:
        """For each hash, of the numbered row of a batch with the lists `own`, whether it is suspected."""
        if self.shared is not None:
            return test(np.frombuffer(self.shared.value, np.uint8), hashes, self.n_blocks)
        found = np.zeros(hashes.size, bool)
        lists = own.to_pylist()
        for r in np.unique(row):
            mine = row == r
            found[mine] = np.isin(hashes[mine].view(np.int64), np.asarray(lists[r] or [], np.int64))
        return found


def suspected(rows: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], hashes: int) -> Suspects:
    """What tells which hashes of the rows (row, text) may occur twice; about so many there are.

    hashes_of is given batches with `text`. A row's own repetitions count too, unless hashes_of leaves them out.
    """
    n_blocks = blocks_for(hashes)
    if n_blocks:
        return Suspects(n_blocks, broadcast(rows.sparkSession, twice_seen(rows.select("text"), hashes_of, n_blocks)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for found in hashes_of(batch.slice(i, 1)):
                    if found.size:
                        once, n = np.unique(found, return_counts=True)
                        yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(np.full(once.size, i))), pa.array(once.view(np.int64)), pa.array(n)], ["row", "hash", "n"])

    found = written(rows.select("row", "text").mapInArrow(each, "row long, hash long, n long"), "hashes")
    twice = found.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash")
    own = found.join(written(twice, "twice"), "hash", "left_semi").groupBy("row").agg(F.collect_set("hash").alias("__hashes"))
    return Suspects(0, None, written(own, "own"))


def sifted(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key (a long) is wanted, and few others: a filter of bounded size that keeps rows out of a shuffle.

    Where the wanted keys need a larger filter than may be broadcast, all rows: the join that follows is right without it.
    """
    n_blocks = blocks_for(wanted.count())
    if not n_blocks:
        return rows

    def named(keys: np.ndarray) -> np.ndarray:
        x = keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(n_blocks * BLOCK_BITS // 8, np.uint8)
        for batch in batches:
            put(bits, named(batch.column(0).to_numpy(zero_copy_only=False)), n_blocks)
        for b in range(n_blocks):
            part = bits[b * BLOCK_BITS // 8 : (b + 1) * BLOCK_BITS // 8]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)])], ["block", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = seen.setdefault(b, np.zeros(BLOCK_BITS // 8, np.uint8))
                own |= np.frombuffer(zlib.decompress(bits), np.uint8)
        for b, own in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([zlib.compress(own.tobytes(), 1)])], ["block", "bits"])

    blocks = wanted.select(key).mapInArrow(fill, "block int, bits binary").repartition("block").mapInArrow(merge, "block int, bits binary")
    shared = broadcast(wanted.sparkSession, _gathered(blocks, n_blocks))

    @F.pandas_udf("boolean")
    def sift(keys: pd.Series) -> pd.Series:  # only keys go to Python, rows stay where they are
        return pd.Series(test(np.frombuffer(shared.value, np.uint8), named(keys.to_numpy()), n_blocks))

    return rows.where(sift(key))
