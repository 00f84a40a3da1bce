"""What the operators of this folder share: tables, shared storage, small SQL expressions."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"\x20\x09-\x0D"
#: One word of a text, for Java and RE2 patterns alike.
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark from whatever store the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. In local mode (tests, one machine) a temporary one where none is set."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidegauge-"))
    return sc._jsc.sc().getCheckpointDir().get()


class Scratch:
    """What the work within its `with` block leaves behind: written tables and broadcasts. drop() deletes them.

    For a caller that knows when all that reads them has itself been written. Outside of any block tables stay.
    """

    def __init__(self) -> None:
        self.folders: list[str] = []
        self.values: list[Broadcast] = []

    def __enter__(self) -> Scratch:
        self._token = _scratch.set(self)
        return self

    def __exit__(self, *_: object) -> None:
        _scratch.reset(self._token)

    def drop(self, spark: SparkSession) -> None:
        while self.values:
            self.values.pop().destroy()
        while self.folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(self.folders.pop())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_scratch: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


def written(df: DataFrame, tag: str, lasting: bool = False) -> DataFrame:
    """The rows written once as Parquet in the shared folder and read back.

    This cuts the lineage: a lost executor costs the reading of a file, not the steps before it. The folder belongs
    to the Scratch around the call, unless it is to last.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    scratch = _scratch.get()
    if scratch and not lasting:
        scratch.folders.append(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast value, which belongs to the Scratch around the call."""
    shared = spark.sparkContext.broadcast(value)
    scratch = _scratch.get()
    if scratch:
        scratch.values.append(shared)
    return shared


def passed(df: DataFrame, text: str, keep: tuple[str, ...]) -> tuple[DataFrame, str, str]:
    """What a Python function over a text has to be sent: the kept columns and the text, once if it is kept itself;
    the name it has there, and the kept columns' schema."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    if text in keep:
        return df.select(*keep), text, schema
    return df.select(*keep, F.col(text).alias("__text")), "__text", schema


def apart(docs: DataFrame, used: tuple[str, ...] = ("doc_id", "text", "lang", "source", "n_chars")) -> tuple[DataFrame, Callable[[DataFrame], list[Column]]]:
    """The table with the columns that are not used under names that nothing else has, and what gives all their own names back."""
    inner = [n if n in used else f"__kept_{i}" for i, n in enumerate(docs.columns)]
    return docs.toDF(*inner), lambda rows: [rows[i].alias(n) for i, n in zip(inner, docs.columns, strict=True)]


def doc_number(column: str = "doc_id") -> Column:
    """An orderable id in which a null sorts before every other."""
    return F.coalesce(F.col(column).cast("long"), F.lit(-(2**63)))


def words(column: Column) -> Column:
    """How many words a text has; 0 for null."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")
