"""Recall of the neighbour search at several sizes, on data without structure and on clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import neighbours


@pytest.mark.parametrize("n", [500, 2000, 10_000])
@pytest.mark.parametrize("clusters", [0, 40])
def test_forest_recall(n, clusters):
    r = np.random.default_rng(n)
    x = r.normal(size=(n, 32))
    if clusters:
        x = x * 0.3 + r.normal(size=(clusters, 32))[r.integers(0, clusters, n)]
    ids = np.arange(n)
    forest, asked = neighbours.Forest(x, x.mean(axis=0)), ids[ids % 100 == 0]
    hits = 0
    for q, near, _ in forest.nearest(x[asked], ids[asked], x, ids, 10, neighbours.SURE):
        far = ((x - x[asked[q]]) ** 2).sum(axis=1)
        far[asked[q]] = np.inf
        hits += len(set(near) & set(np.argsort(far, kind="stable")[:10]))
    assert hits >= 0.9 * 10 * len(asked)


def test_query_recall(spark):
    """The query itself on 2,000 given vectors."""
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = {}
    for r in neighbours.op8_nearest_neighbours(spark, folder).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = 0
    for q in ids[ids % 100 == 0]:
        far = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        far[ids == q] = np.inf
        hits += len({v for v, _ in got[q]} & set(ids[np.lexsort((ids, far))[:10]]))
        assert all(s == pytest.approx(far[ids == v][0]) for v, s in got[q])
    assert hits >= 0.9 * 10 * len(got)
    assert neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).count() == 0
