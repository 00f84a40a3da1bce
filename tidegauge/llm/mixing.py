"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only.

Each source is a queue: its documents in the order of a hash of their ids and texts, MAX_REPEATS times over. It is
served in pieces: a document of PIECE words at most is one, a longer one several, so that no long document holds the
others up. A piece's virtual finish time is the source's words up to its end divided by the source's weight, so that
in the order of finish times every source advances in proportion to its weight; a source whose queue ends leaves its
share to the others. The pieces of all sources are sorted by range of finish times, ties by source, and running sums
of their words along the sorted queue find where the budget is given: pieces before are taken whole, the one at the
cut in part. So a source's words are within a piece of its target, which is the same sharing with no pieces at all.

Nothing later than a piece past the time of that sharing can be taken, and is not sorted. No window spans the
documents of a source: the sums of hash buckets of about BUCKET_DOCS documents are added up first, then the documents
within one bucket, so that a source with a third of all rows is as even as the others. In the same way the sums of
ranges of the sorted queue, RANGE_ROWS pieces or so each, are added up first, one row each, and then the pieces of the
one range that holds the cut. Per-source facts are one row each.

Cases: a null text has size 0 and nothing is taken from it. A null source is a source of its own, after all
others. A null doc_id sorts first; equal rows follow each other in any order. With no words at all every target
is 0. Further columns of the input play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import apart, table, words, written

MAX_REPEATS = 3
BUCKET_DOCS = 2000
#: Words of a document that are served at a time.
PIECE = 256
#: Pieces of the sorted queue to a range.
RANGE_ROWS = 1 << 18
WEIGHTS = (1, 2, 3)


def weigh(sources: DataFrame) -> DataFrame:
    """source and size get a weight: WEIGHTS in turn by code point, null last. One row a source."""
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(turn, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("double"))


def shared_time(sources: DataFrame, budget: int) -> float:
    """The virtual time at which sources (size, weight) that all advance at once have given `budget` words, or all they have."""
    limit = MAX_REPEATS * F.col("size") / F.col("weight")
    every = Window.orderBy("limit", "source")
    ahead = every.rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("limit", "source").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ended = F.coalesce(F.sum(MAX_REPEATS * F.col("size")).over(ahead), F.lit(0))
    each = sources.where("size > 0").withColumn("limit", limit).withColumn("time", (F.lit(budget) - ended) / F.sum("weight").over(rest))
    return each.agg(F.coalesce(F.min(F.when(F.col("time") <= F.col("limit"), F.struct("limit", "time")))["time"], F.max("limit"))).first()[0] or 0.0


def finishing(queue: DataFrame, until: float) -> DataFrame:
    """source, words and finish of every piece of queued() that finishes by then, sorted by range of finish, with the number of the range."""
    copy = queue.where("size > 0").select("source", "before", "size", "source_size", "weight", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1))).alias("round"))
    copy = copy.withColumn("start", F.col("round") * F.col("source_size") + F.col("before")).where(F.col("start") / F.col("weight") <= until)
    piece = copy.select("source", "start", "size", "weight", F.explode(F.expr(f"sequence(0L, (size - 1) div {PIECE})")).alias("piece"))
    end = F.least(F.col("size"), (F.col("piece") + 1) * PIECE)
    piece = piece.select("source", (end - F.col("piece") * PIECE).alias("words"), ((F.col("start") + end) / F.col("weight")).alias("finish")).where(F.col("finish") <= until)
    ranges = queue.agg(F.sum(F.ceil(F.col("size") / PIECE))).first()[0] * MAX_REPEATS // RANGE_ROWS + int(queue.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return piece.repartitionByRange(ranges, "finish").sortWithinPartitions("finish", "source").withColumn("range", F.spark_partition_id())


def served(queue: DataFrame, budget: int, until: float) -> DataFrame:
    """source and the words `served` of it when the sorted queue has given `budget` words; `until` is a time by which it has."""
    pieces = written(finishing(queue, until), "finishing")
    sums = pieces.groupBy("range").agg(F.sum("words").alias("words"))
    sums = sums.withColumn("given", F.sum("words").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    at = sums.where(F.col("given") >= budget).orderBy("range").select("range", (F.col("given") - F.col("words")).alias("before")).first()
    if at is None:  # the budget is more than all queues hold
        return pieces.groupBy("source").agg(F.sum("words").alias("served"))
    along = Window.orderBy("finish", "source").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(budget - at["before"]) - F.coalesce(F.sum("words").over(along), F.lit(0))
    last = pieces.where(F.col("range") == at["range"]).select("source", F.greatest(F.lit(0), F.least(F.col("words"), left)).alias("words"))
    return pieces.where(F.col("range") < at["range"]).select("source", "words").unionAll(last).groupBy("source").agg(F.sum("words").alias("served"))


def queued(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """Each document with source, size, source_size, weight, and `before`: the words of its source's queue ahead of it in the first round."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(" "), F.coalesce(F.col(text), F.lit(""))).cast("binary")).alias("turn"), *carry)
    n = rows.count()
    digits = 1
    while 16**digits * BUCKET_DOCS < n:
        digits += 1
    rows = written(rows.withColumn("bucket", F.substring("turn", 1, digits)), "queue")
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("bucket_before"))
    facts = weigh(rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumnRenamed("source_size", "size")).withColumnRenamed("size", "source_size")
    own = Window.partitionBy("source", "bucket").orderBy("turn", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("own_before", F.coalesce(F.sum("size").over(own), F.lit(0)))
    extra = sums.join(facts, sums["source"].eqNullSafe(facts["source"])).select(sums["source"].alias("s"), sums["bucket"].alias("b"), "bucket_before", "source_size", "weight")
    joined = placed.join(extra, placed["source"].eqNullSafe(extra["s"]) & (placed["bucket"] == extra["b"]))
    return joined.select("doc_id", "source", "turn", "bucket", "size", "source_size", "weight", (F.col("own_before") + F.col("bucket_before")).alias("before"), *carry)


def mix(docs: DataFrame, budget_share: float = 1.0, **columns) -> DataFrame:
    """queued() with target (of the source) and taken (words of the document that the mix takes, all rounds)."""
    queue = written(queued(docs, **columns), "queued")
    sources = queue.groupBy("source").agg(F.sum("size").alias("size"), F.max("weight").alias("weight"))
    words_ = sources.agg(F.sum("size")).first()[0]
    if not words_:
        return queue.withColumn("target", F.lit(0.0)).withColumn("taken", F.lit(0).cast("long")).drop("bucket")
    budget = round(words_ * budget_share)
    time = shared_time(sources, budget)
    given = written(served(queue, budget, time + PIECE / min(WEIGHTS)), "served")
    # a row for each bucket of a source, so that no source's documents meet in one task
    buckets = queue.groupBy("source", "bucket").agg(F.lit(1).alias("one"))
    given = buckets.join(given, buckets["source"].eqNullSafe(given["source"])).select(buckets["source"].alias("s"), buckets["bucket"].alias("b"), "served")
    queue = queue.join(given, queue["source"].eqNullSafe(given["s"]) & (queue["bucket"] == given["b"]), "left").drop("s", "b", "bucket")
    target = F.least((F.lit(MAX_REPEATS) * F.col("source_size")).cast("double"), F.col("weight") * F.lit(time))
    read = [F.greatest(F.lit(0), F.least(F.col("size"), F.coalesce("served", F.lit(0)) - i * F.col("source_size") - F.col("before"))) for i in range(MAX_REPEATS)]
    return queue.withColumn("target", target).withColumn("taken", sum(read, F.lit(0)).cast("long")).drop("served")


def copies(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself in the order of virtual finish times, sorted by range: a row for each copy with `finish`; the last may be a part of its text."""
    each = mixed.where("taken > 0").withColumn("round", F.explode(F.expr("sequence(0L, (taken - 1) div size)")))
    part = F.expr("least(size, taken - round * size)")
    first = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), part.cast("int")), "")
    each = each.withColumn(text, F.when(part < F.col("size"), first).otherwise(F.col(text)))
    return each.withColumn("finish", (F.col("round") * F.col("source_size") + F.col("before") + part) / F.col("weight")).sort("finish", "source", "turn")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document as often as it is taken, the last time perhaps in part; n_chars follows the text.

    The queues hold no texts; a text meets what is taken of it in one shuffle by a hash of its row. Equal rows are
    told apart by their number."""
    docs, back = apart(docs)
    names = docs.columns
    hashed = [F.to_json(F.struct(F.col(n).alias("v"))) if "map<" in kind or kind == "variant" else F.col(n) for n, kind in docs.dtypes]  # maps have no hash
    keyed = docs.withColumn("__row", F.xxhash64(*hashed))
    facts = ["size", "source_size", "weight", "before", "taken", "turn"]
    mixed = mix(keyed, carry=("__row",)).where("taken > 0").groupBy("__row").agg(F.sort_array(F.collect_list(F.struct(*facts))).alias("__each"))
    number = F.row_number().over(Window.partitionBy("__row").orderBy("__row"))
    met = keyed.join(written(mixed, "taken"), "__row").withColumn("__mine", F.get("__each", number - 1)).where("__mine is not null")
    inner = met.select(*(F.col(c).alias(f"in_{c}") for c in names), "__mine.*").withColumn("source", F.col("in_source"))
    out = copies(inner, "in_text").withColumn("in_n_chars", F.length("in_text").cast(docs.schema["n_chars"].dataType))
    out = out.select(*(F.col(f"in_{c}").alias(c) for c in names))
    return out.select(*back(out))


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(concat(coalesce(doc_id::VARCHAR, ''), ' ', coalesce(text, ''))) AS turn FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS size, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight FROM d GROUP BY source
), c(step, time) AS (
  SELECT 0, 0.0::DOUBLE
  UNION ALL
  SELECT step + 1, t FROM (
    SELECT c.step, c.time, CASE WHEN sum(CASE WHEN 3 * s.size / s.weight::DOUBLE > c.time THEN s.weight ELSE 0 END) = 0 THEN c.time
      ELSE ((SELECT sum(size) FROM s) - sum(CASE WHEN 3 * s.size / s.weight::DOUBLE <= c.time THEN 3 * s.size ELSE 0 END)) / sum(CASE WHEN 3 * s.size / s.weight::DOUBLE > c.time THEN s.weight ELSE 0 END)::DOUBLE END AS t
    FROM c, s GROUP BY c.step, c.time) WHERE t > time
), q AS (
  SELECT d.doc_id, d.source, d.turn, d.size, s.size AS source_size, s.weight, least(3.0 * s.size, s.weight * (SELECT max(time) FROM c))::DOUBLE AS target,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.turn, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
), p AS (
  SELECT source, least(256, size - 256 * k) AS words, (r * source_size + before + least(size, 256 * (k + 1))) / weight::DOUBLE AS finish
  FROM (SELECT *, unnest(range(0, (size + 255) // 256)) AS k FROM (SELECT *, unnest([0, 1, 2]) AS r FROM q))
), t AS (
  SELECT source, words, coalesce(sum(words) OVER (ORDER BY finish, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given FROM p
), v AS (
  SELECT source, sum(greatest(0, least(words, (SELECT sum(size) FROM s) - given)))::BIGINT AS served FROM t GROUP BY source
)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, coalesce(served, 0) - before)) + greatest(0, least(size, coalesce(served, 0) - source_size - before)) + greatest(0, least(size, coalesce(served, 0) - 2 * source_size - before)))::BIGINT AS taken
FROM q LEFT JOIN v ON q.source IS NOT DISTINCT FROM v.source"""
