"""Approximate nearest neighbours by a forest of hash prefixes.

A tree is a sorted array of long hash strings, one bit for each of BITS random hyperplanes through the centre of
the data, so that vectors with a common prefix are neighbours in the array and a prefix is found by bisection. For
a query every tree descends to its longest matching prefix; then all trees ascend together, a bit at a time. What
lies below is compared exactly as soon as it holds k + 1 rows for certain (one row has an entry in each tree), and
ascending ends by a bound that is measured on what was found: a row at an angle a shares d bits with the query in at
least one of t trees with the chance 1 - (1 - (1 - a / pi)^d)^t, and the mean of it over the k nearest found, which
are as far as those that may be missing, has to reach SURE. So near neighbours end it early, and where all rows are
about as far as each other it takes most of them, whatever the number of rows.

Rows are dealt by hash into blocks of about BLOCK, each with its own forest. Every row is shuffled once, and a query
once to each block: sorted to the end of its block, queries stream past the forest, so that a task holds one block
and one batch of queries however many there are. Only distances of candidates are computed. The nearest few of every
query and block are merged by query. Every row is indexed; the centre alone is fitted on a sample of SAMPLE rows.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without
an id. Vectors of different lengths are never compared. A row is no candidate of a query with its id. Ties go to
the smaller id; equal vectors share all prefixes and so are found together. Rows that share id and vector count once; rows that share an id
and differ in their vectors are one query with the nearest of both.
Further columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import table
from .vectors import usable

TREES = 64
BITS = 24
SURE = 0.95
BLOCK = 16384
#: Rows hashed at a time.
ROWS = 2048
SAMPLE = 4096


class Forest:
    """The sorted arrays of all trees over some rows."""

    def __init__(self, x: np.ndarray, centre: np.ndarray, trees: int = TREES, bits: int = BITS):
        self.centre, self.trees, self.bits, self.n = centre, trees, bits, len(x)
        self.planes = np.random.default_rng(x.shape[1]).standard_normal((x.shape[1], trees * bits))
        strings = self.strings(x)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=1)

    def strings(self, x: np.ndarray) -> np.ndarray:
        """The hash string of each row in each tree (tree x row), the first bit highest."""
        power = 1 << np.arange(self.bits)[::-1]
        parts = [((x[i : i + ROWS] - self.centre) @ self.planes > 0).reshape(-1, self.trees, self.bits) @ power for i in range(0, len(x), ROWS)]
        return np.ascontiguousarray(np.concatenate(parts).T)

    def below(self, strings: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Where in each tree the entries with the same first `depth` bits begin and end (tree x query)."""
        shift = self.bits - depth
        low = strings >> shift << shift
        ends = [(np.searchsorted(a, s), np.searchsorted(a, s + (1 << shift))) for a, s in zip(self.sorted, low, strict=True)]
        return np.array([a for a, _ in ends]), np.array([b for _, b in ends])

    def nearest(self, queries: np.ndarray, ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, sure: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its place, and the ids and distances of the k nearest rows found."""
        strings, waiting = self.strings(queries), np.arange(len(queries))
        found = np.zeros((len(queries), self.n), bool)
        for depth in range(self.bits, -1, -1):
            low, high = self.below(strings[:, waiting], depth)
            still = []
            for i, q in enumerate(waiting):
                if depth and (high[:, i] - low[:, i]).sum() < self.trees * (k + 1):
                    still.append(q)
                    continue
                for t in range(self.trees):
                    found[q, self.order[t, low[t, i] : high[t, i]]] = True
                at, far = nearest(queries[q], ids[q], x, x_ids, np.flatnonzero(found[q]), k)
                if depth and self.chance(queries[q], x[at], depth) < sure:
                    still.append(q)
                else:
                    yield q, x_ids[at], far
            waiting = np.array(still, int)
            if not waiting.size:
                return

    def chance(self, query: np.ndarray, rows: np.ndarray, depth: int) -> float:
        """How likely rows at the angles of these share so many bits with the query in some tree, on average."""
        a, b = query - self.centre, rows - self.centre
        length = np.linalg.norm(a) * np.linalg.norm(b, axis=1)
        cosine = np.clip(np.divide(b @ a, length, out=np.zeros(len(b)), where=length > 0), -1, 1)
        return float((1 - (1 - (1 - np.arccos(cosine) / np.pi) ** depth) ** self.trees).mean())


def nearest(query: np.ndarray, query_id: int, x: np.ndarray, x_ids: np.ndarray, among: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The places and exact distances of the k nearest rows among some, nearest first, ties to smaller ids."""
    among = among[x_ids[among] != query_id]
    far = ((x[among] - query) ** 2).sum(axis=1)
    if far.size > k:
        close = far <= np.partition(far, k - 1)[k - 1]
        among, far = among[close], far[close]
    far = np.sqrt(far)
    first = np.lexsort((x_ids[among], far))[:k]
    return among[first], far[first]


def search(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", sure: float = SURE) -> DataFrame:
    """query_id, rank, vec_id and score (the Euclidean distance) of the k nearest rows found for each query row."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), is_query.alias("query"))
    rows = rows.where(F.col("id").isNotNull() & usable("vector")).withColumn("dim", F.size("vector")).dropDuplicates(["id", "vector"])
    n = max([r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()], default=0)
    blocks = max(1, round(n / BLOCK))
    # the centre: of a sample by hash, expected to hold SAMPLE rows
    centres: dict[int, np.ndarray] = {}
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit("centre")), F.lit(max(1, n // SAMPLE))) == 0).select("dim", F.posexplode("vector").alias("i", "x")).groupBy("dim", "i").agg(F.avg("x").alias("x"))
    for r in sample.collect():
        centres.setdefault(r["dim"], np.zeros(r["dim"]))[r["i"]] = r["x"]

    indexed = rows.select("dim", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), "id", "vector")
    asked = rows.where("query").select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "id", "vector")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, forest, own, own_ids = None, [], None, None, None
        for batch in batches:
            dims, block, asks, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "block", "asks", "id"))
            edges = np.flatnonzero(np.append(True, (np.diff(dims) != 0) | (np.diff(block) != 0) | (asks[1:] != asks[:-1])))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(ids)], strict=True):
                dim = int(dims[a])
                x = batch.column("vector").slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                if (dim, block[a]) != at:
                    at, parts, forest = (dim, block[a]), [], None
                if not asks[a]:
                    parts.append((x, ids[a:b]))
                    continue
                if not parts and forest is None:
                    continue  # a block without rows
                if forest is None:
                    own, own_ids = (np.concatenate(c) for c in zip(*parts, strict=True))
                    forest, parts = Forest(own, centres.get(dim, np.zeros(dim))), []
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for start in range(0, b - a, 256):
                    for q, near, far in forest.nearest(x[start : start + 256], ids[a:b][start : start + 256], own, own_ids, k, sure):
                        out.append((np.full(near.size, ids[a + start + q]), near, far))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    dealt = indexed.unionAll(asked).repartition(blocks, "dim", "block").sortWithinPartitions("dim", "block", "asks")
    found = dealt.mapInArrow(meet, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)
