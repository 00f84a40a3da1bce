"""Removal of lines that many documents share.

A line's key is the line without white space at both ends and with A-Z in lower case. Every task puts the
hashes of its keys, once a document, in two Bloom filters: seen once, and seen twice (see sketch.py). No
repeat is missed, so that only the lines in the merged twice filter, the suspects, are shuffled, with their
whole keys. Counting them confirms the repeats exactly and chooses the one document that keeps each.

Where the lines need a larger filter than may be broadcast, their hashes are counted instead (see sketch.py); lines that
are no suspects stay where they are.

Cases: a null or empty text is one empty line. A document is a doc_id: rows that share one count once and
keep a line together; a null doc_id sorts first. Lines shorter than the least length always stay. With
nothing left a text is empty. Further columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sketch
from .base import apart, doc_number, table, written

LEAST_CHARS = 20
LEAST_DOCS = 3
SPACES = " \t\n\x0b\x0c\r"


def keys_of(text: str | None, least: int) -> Iterator[tuple[int, bytes]]:
    """Number and key of every line that is long enough."""
    for i, line in enumerate((text or "").split("\n")):
        key = line.strip(SPACES)
        if len(key) >= least:
            yield i, key.encode().lower()


def hashes_of(least: int):
    """Hashes of the keys in a batch of texts, each once a document."""

    def run(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for start in range(0, batch.num_rows, 512):
            yield np.array([h for text in batch.column("text")[start : start + 512].to_pylist() for h in {xxhash.xxh3_64_intdigest(k) for _, k in keys_of(text, least)}], np.uint64)

    return run


def suspects(rows: DataFrame, least: int, told: sketch.Suspects) -> DataFrame:
    """row, doc, key and the numbers of its lines, for every key that may occur in several documents."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                where, keys, lines = [], [], []
                for r, text in enumerate(part.column("text").to_pylist()):
                    own: dict[bytes, list[int]] = {}
                    for i, k in keys_of(text, least):
                        own.setdefault(k, []).append(i)
                    where += [r] * len(own)
                    keys += own
                    lines += own.values()
                if not keys:
                    continue
                hit = np.flatnonzero(told.hit(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64), np.array(where), part.column("__hashes")))
                of = pa.array([where[i] for i in hit], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("row").take(of), part.column("doc").take(of), pa.array([keys[i].decode() for i in hit], pa.string()), pa.array([lines[i] for i in hit], pa.list_(pa.int32()))], ["row", "doc", "key", "lines"])

    return rows.select("row", "doc", "text", "__hashes").mapInArrow(look, "row long, doc long, key string, lines array<int>")


def repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, keep: str = "last", text: str = "text", key: str = "doc_id") -> DataFrame:
    """row (see row_id) and the numbers of the lines that it loses. keep: which document in the order of ids keeps a line, first or last."""
    rows = docs.select(row_id(text, key).alias("row"), doc_number(key).alias("doc"), F.col(text).alias("text"))
    n_lines = rows.agg(F.sum(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"))) + 1)).first()[0] or 0
    told = sketch.suspected(rows, hashes_of(least_chars), n_lines)
    found = written(suspects(told.told_only(rows), least_chars, told), "suspects")
    chosen = F.max("doc") if keep == "last" else F.min("doc")
    shared = written(found.groupBy("key").agg(F.count_distinct("doc").alias("n_docs"), chosen.alias("keeper")).where(F.col("n_docs") >= least_docs), "repeats")
    lost = found.join(shared, "key").where("doc <> keeper").select("row", F.explode("lines").alias("line"))
    return lost.groupBy("row").agg(F.sort_array(F.collect_set("line")).alias("lost"))


def row_id(text: str = "text", key: str = "doc_id") -> Column:
    """Names a row by what it holds; equal rows share it and are treated alike."""
    return F.xxhash64(F.col(key), F.col(text))


def drop_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """All columns of docs with the kept text in place of the text, and __n_lines and __n_dropped."""
    gone = repeated_lines(docs, text=text, key=key, **how)
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    joined = docs.withColumn("__row", row_id(text, key)).join(gone.select(F.col("row").alias("__row"), F.col("lost").alias("__lost")), "__row", "left")
    n, stay = F.size(lines), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__lost"))
    left = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    out = joined.withColumn("__n_lines", n.cast("long")).withColumn("__n_dropped", F.coalesce(F.size("__lost"), F.lit(0)).cast("long"))
    return out.withColumn(text, F.when(F.col("__lost").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(left)).drop("__row", "__lost")


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that others repeat; n_chars follows the text."""
    docs, back = apart(docs)
    out = drop_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*back(out))


ORACLE_KEY = r"translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP2_SQL = f"""
WITH l AS (
  SELECT doc_id, i, line, {ORACLE_KEY} AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), r AS (
  SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT l.doc_id, l.i, l.line, r.k IS NOT NULL AND l.doc_id <> r.keeper AS lost FROM l LEFT JOIN r ON l.k = r.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
