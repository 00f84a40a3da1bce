"""Places of rows among those of their key, also where one key holds most of the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import written


def numbered(rows: DataFrame, key: str, order: list[str], tag: str) -> DataFrame:
    """The rows with `place`, from 1 on, among those of a key in the order given, nulls first; the key is never null.

    Rows are range-sorted by key and order, so that the rows of one key may lie in many tasks; each task counts its own,
    and only of keys that go on from one task to the next, of which there are no more than tasks, counts are added."""
    spark = rows.sparkSession
    by = [F.col(c).asc_nulls_first() for c in (key, *order)]
    placed = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id())
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema] + ["near long"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, so_far = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key)
            new = np.r_[keys[0] != last, pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)]
            at = np.arange(batch.num_rows)
            start = np.maximum.accumulate(np.where(new, at, -so_far))
            near = at - start + 1
            last, so_far = keys[-1], int(near[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], [*batch.schema.names, "near"])

    placed = written(placed.mapInArrow(count, schema), tag)
    spans = placed.groupBy(key, "part").agg(F.max("near").alias("n"))
    before = "PARTITION BY {0} ORDER BY part".format(f"`{key}`")
    spans = spans.withColumn("before", F.expr(f"sum(n) OVER ({before} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")).where("before is not null").select(key, "part", "before")
    return placed.join(F.broadcast(spans), [key, "part"], "left").withColumn("place", F.col("near") + F.coalesce("before", F.lit(0))).drop("part", "near", "before")
