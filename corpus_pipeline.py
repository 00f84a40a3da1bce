"""Documents to training data: five stages, each written before the next reads it.

Cases: an empty table stays empty through all stages. Rows that are equal are told apart by no stage but mixing, which
takes each as often as its queue says; null texts and ids, very long texts and further columns, also of names that
the operators use, are as the operators' modules say, and all columns of documents come out of all but the last
stage, which adds `ids`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm import bpe, langid, lines, minhash, mixing
from tidegauge.llm.base import Scratch, table, written

#: What the stage before left behind. Its result has been written when the next stage begins.
_before: list[Scratch] = []


def _fresh(stage):
    """The stage, which first deletes the working tables and broadcasts of the one before, and nobody else's."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _before:
            _before.pop().drop(spark)
        with Scratch() as scratch:
            _before.append(scratch)
            return stage(spark, docs, sf_dir)

    return run


#: Each takes (spark, docs, sf_dir) and returns the columns of documents, the last what training reads.
STAGES = [
    ("language_id", _fresh(langid.stage)),
    ("line_dedup", _fresh(lines.stage)),
    ("minhash_near_dedup", _fresh(minhash.stage)),
    ("mixing", _fresh(mixing.stage)),
    ("byte_bpe", _fresh(bpe.stage)),
]

#: Stages of this pipeline are models, signatures and merges; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name, lasting=True)
    return docs
