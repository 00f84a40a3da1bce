"""Near-duplicates among embeddings, by a subspace pigeonhole join.

Unit vectors with a cosine of c or more lie within a squared distance of 2 - 2c. A fixed rotation spreads that
distance over all coordinates, which are split into BLOCKS subspaces, each with a share of the squared distance
in proportion to its dimensions. A pair within the whole distance is within the share in one subspace at least,
so a range join in each subspace finds it; the union of these candidates is verified with the whole vectors.

A range join deals vectors into slabs of the share's width along the subspace's first coordinate, so that partners
lie in the same or the next slab; there are at most some 10 slabs whatever the number of vectors. A slab is cut by
hash into tiles of TILE vectors, and a task compares two tiles. A pair counts in the first subspace that finds it.
A task returns sums of links and a spanning forest of its links, never the pairs.

Equal vectors are one vector that counts as many times.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, and each is a
component of its own; so do vectors of different lengths. Rows that share vec_id and vector are links of each
other; vec_id should differ between different vectors. A row without a vec_id takes no part. Further columns of
the input play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import table, written
from .graph import components

BLOCKS = 4
TILE = 16384
#: Rows of a tile compared with another tile at a time.
ROWS = 256
#: Candidates verified at a time.
PAIRS = 1 << 15


def usable(vector: str) -> Column:
    """Whether a vector has a direction: only finite components, one of them not 0."""
    c = F.col(vector)
    return F.coalesce(F.forall(c, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)) & F.exists(c, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def subspaces(dim: int, blocks: int, within: float) -> list[tuple[slice, float]]:
    """The coordinates of each subspace and its share of the squared distance."""
    edges = np.linspace(0, dim, min(blocks, dim) + 1).round().astype(int)
    return [(slice(a, b), within * (b - a) / dim * (1 + 1e-9) + 1e-12) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, row numbers and vectors of the rows whose vectors have that length."""
    column = batch.column("vector")
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        yield int(dim), rows, flat[column.offsets.to_numpy()[rows][:, None] + np.arange(dim)].astype(np.float64)


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merges the sets of nodes i and j in label, where every node points to the least of its set."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label[label] != label).any():
            label[:] = label[label]


def compare(a: np.ndarray, b: np.ndarray, same: bool, block: int, spaces: list[tuple[slice, float]], turn: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of rows of a and of b that link and that no earlier subspace finds."""
    ra, rb = a @ turn, b @ turn
    space, share = spaces[block]
    one = lambda n: np.ones((n, 1))
    square = lambda x: (x * x).sum(axis=1, keepdims=True)
    # squared distances as one product, in single precision with more slack than it loses
    left = np.hstack([-2 * ra[:, space], square(ra[:, space]), one(len(a))]).astype(np.float32)
    right = np.ascontiguousarray(np.hstack([rb[:, space], one(len(b)), square(rb[:, space])]).astype(np.float32).T)

    def gap(i: np.ndarray, j: np.ndarray, k: int) -> np.ndarray:
        d = ra[i, spaces[k][0]] - rb[j, spaces[k][0]]
        return (d * d).sum(axis=1)

    for start in range(0, len(a), ROWS):
        i, j = np.nonzero(left[start : start + ROWS] @ right <= share + 1e-5)
        i += start
        if same:
            i, j = i[i < j], j[i < j]
        for part in range(0, i.size, PAIRS):
            x, y = i[part : part + PAIRS], j[part : part + PAIRS]
            ok = (a[x] * b[y]).sum(axis=1) >= least
            x, y = x[ok], y[ok]
            ok = gap(x, y, block) <= share
            for k in range(block):
                ok &= gap(x, y, k) > spaces[k][1]
            yield x[ok], y[ok]


def linked(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.9, blocks: int = BLOCKS, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Different vectors (node: the least key of equal ones, n: how many, vector) and their links (node, links, to)."""
    good = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("key").isNotNull() & usable("vector"))
    nodes = written(good.groupBy("vector").agg(F.min("key").alias("node"), F.count("*").alias("n")), "nodes")
    within = 2 - 2 * least

    def slabs(dim: int, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        turned = unit(x) @ rotation(dim)
        for b, (space, share) in enumerate(subspaces(dim, blocks, within)):
            yield b, np.floor(turned[:, space.start] / np.sqrt(share)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, _, x in by_dim(batch):
                for b, slab in slabs(dim, x):
                    at, n = np.unique(slab, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(at.size, dim)), pa.array(np.full(at.size, b)), pa.array(at), pa.array(n)], ["dim", "block", "slab", "n"])

    sizes = nodes.select("vector").mapInArrow(count, "dim long, block long, slab long, n long").groupBy("dim", "block", "slab").agg(F.sum("n").alias("n")).collect()
    tiles = {(r["dim"], r["block"], r["slab"]): -(-r["n"] // tile) for r in sizes}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows, x in by_dim(batch):
                sub = batch.take(pa.array(rows))
                turn = np.array([xxhash.xxh3_64_intdigest(v) >> 1 for v in sub.column("node").to_numpy().astype("<i8").reshape(-1, 1)], np.int64)
                for b, slab in slabs(dim, x):
                    for s in np.unique(slab).tolist():
                        own = np.flatnonzero(slab == s)
                        k = tiles[dim, b, s]
                        mine = turn[own] % k
                        for i in range(k):
                            part = sub.take(pa.array(own[mine == i]))
                            if not part.num_rows:
                                continue
                            pairs = [(s, min(i, j), s, max(i, j), j < i) for j in range(k)]
                            pairs += [(s, i, s + 1, j, False) for j in range(tiles.get((dim, b, s + 1), 0))]
                            pairs += [(s - 1, j, s, i, True) for j in range(tiles.get((dim, b, s - 1), 0))]
                            for s1, i1, s2, i2, second in pairs:
                                at = [pa.array(np.full(part.num_rows, v, np.int64)) for v in (dim, b, s1, i1, s2, i2)]
                                yield pa.RecordBatch.from_arrays([*at, pa.array(np.full(part.num_rows, second)), part.column("node"), part.column("n"), part.column("vector").cast(pa.list_(pa.float64()))], ["dim", "block", "s1", "i1", "s2", "i2", "second", "node", "n", "vector"])

    def meet(group: pa.Table) -> pa.Table:
        dim, b, s1, i1, s2, i2 = (group.column(c)[0].as_py() for c in ("dim", "block", "s1", "i1", "s2", "i2"))
        same = (s1, i1) == (s2, i2)
        x = unit(group.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, dim))
        node, n, second = (group.column(c).to_numpy() for c in ("node", "n", "second"))
        first, other = (np.arange(len(node)),) * 2 if same else (np.flatnonzero(~second), np.flatnonzero(second))
        order = np.argsort(node, kind="stable")  # a label is a place in this order, so that the least is the least node
        place = np.empty(len(node), np.int64)
        place[order] = np.arange(len(node))
        label, links = np.arange(len(node)), np.zeros(len(node), np.int64)
        if first.size and other.size:
            for i, j in compare(x[first], x[other], same, b, subspaces(dim, blocks, within), rotation(dim), least):
                i, j = first[i], other[j]
                links += np.bincount(i, n[j], len(node)).astype(np.int64) + np.bincount(j, n[i], len(node)).astype(np.int64)
                joined(label, place[i], place[j])
        some = np.flatnonzero(links)
        return pa.table({"node": node[some], "links": links[some], "to": node[order][label[place[some]]]})

    at = ["dim", "block", "s1", "i1", "s2", "i2"]
    dealt = nodes.mapInArrow(deal, "dim long, block long, s1 long, i1 long, s2 long, i2 long, second boolean, node long, n long, vector array<double>")
    return nodes, written(dealt.groupBy(*at).applyInArrow(meet, "node long, links long, to long"), "links")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.9, **how) -> DataFrame:
    """key, n_links and component_id of each row (see the module)."""
    nodes, links = linked(vectors, key, vector, least, **how)
    sums = links.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(links.select(F.col("node").alias("u"), F.col("to").alias("v")))
    told = written(nodes.join(sums, "node", "left").join(parts, "node", "left").select("vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")), "told")
    rows = vectors.select(F.col(key).alias("vec_id"), F.when(F.col(key).isNotNull(), F.col(vector).cast("array<double>")).alias("vector"))
    out = rows.join(told, "vector", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", F.col("vec_id")).alias("component_id"))


def op9_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    told = near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return told.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), c(node, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT c.node, l.w FROM c JOIN l ON c.other = l.u
)
SELECT c.node AS vec_id, coalesce(n, 0)::BIGINT AS n_links, min(c.other) AS component_id, c.node = min(c.other) AS kept
FROM c LEFT JOIN (SELECT u, count(*) AS n FROM l GROUP BY u) k ON k.u = c.node GROUP BY c.node, n"""
