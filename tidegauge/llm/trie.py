"""The prefixes that conversations share, as a trie: one row for every distinct beginning.

Turns lie in columns by their position, WIDTH of them in a row, and GROUP BY ... ROLLUP over these columns aggregates
all prefixes of a row at once; grouping_id says which. A longer conversation goes on in further rows, whose columns
are rolled up under the node of the row before, so that rows of all depths go through one aggregation. A node is
named by 128 bits, two exclusive ors of 64-bit hashes of its turns with their positions. A second ROLLUP adds up what
belongs to subtrees: every node is charged to its smallest member, whose nodes are a tail of its path, and what lies
in that tail above a node is taken off again.

Hot groups: a node that holds a third of all conversations is a row from each task; the ids that end at a node are
range-sorted with all others, joined to texts where they lie, and only these texts meet in one task, which hashes
them as they come.

Cases: without conversations there is no node, not even a root. Rows of a null id belong to no conversation. Null
roles and texts are empty; a null turn comes first; turns with one number come in the order of a hash of role and
text. Equal rows are turns each. Further columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import table, written
from .order import numbered

#: Turns to a row.
WIDTH = 8
#: Ids joined into one text before they are hashed.
CHUNK = 16_384
COLUMNS = [f"t{i}" for i in range(1, WIDTH + 1)]
NODE = ["u1", "u2"]


def turn_id(role: str = "role", text: str = "text"):
    """20 bytes: a digest of role and text, and the code points of the text."""
    r, t = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.unhex(F.concat(F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t)), F.lpad(F.hex(F.length(t).cast("long")), 8, "0")))


def _lane(lane: int, place, turn):
    """64 bits of a turn at a place; 0 of none."""
    place = place.cast("long")
    return F.when(turn.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(place, turn) if lane == 1 else F.xxhash64(turn, place, F.lit("second")))


def blocks(turns: DataFrame) -> DataFrame:
    """conv_id, block, the node (k1, k2) that the block goes on from, and its turns in columns. turns: conv_id, place, turn_id; a null place is no turn."""
    slot = (F.col("place") - 1) % WIDTH + 1
    rows = turns.groupBy("conv_id", F.coalesce(F.floor((F.col("place") - 1) / WIDTH), F.lit(0)).alias("block")).agg(
        *(F.max(F.when(slot == i + 1, F.col("turn_id"))).alias(c) for i, c in enumerate(COLUMNS)), *(F.bit_xor(_lane(i, F.col("place"), F.col("turn_id"))).alias(f"x{i}") for i in (1, 2)), F.count("place").alias("n")
    )
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("conv_id", "block", "n", *COLUMNS, "x1", "x2", *(F.coalesce(F.bit_xor(f"x{i}").over(before), F.lit(0).cast("long")).alias(f"k{i}") for i in (1, 2)))


def rolled(rows: DataFrame, **sums: str) -> DataFrame:
    """Every node of the blocks: its name, its parent's, depth, last turn, and the aggregates asked for."""
    names = ", ".join(COLUMNS)
    made = rows.sparkSession.sql(f"SELECT block, k1, k2, {names}, {WIDTH} - bit_count(grouping_id()) AS level, {', '.join(f'{e} AS {n}' for n, e in sums.items())} FROM {{rows}} GROUP BY block, k1, k2, ROLLUP({names})", rows=rows)
    made = made.withColumn("last", F.expr(f"CASE level {' '.join(f'WHEN {i + 1} THEN {c}' for i, c in enumerate(COLUMNS))} END")).where("last IS NOT NULL OR level = 0 AND block = 0")
    out = {}
    for lane in (1, 2):
        name = F.col(f"k{lane}")
        for i, c in enumerate(COLUMNS):
            name = name.bitwiseXOR(_lane(lane, F.col("block") * WIDTH + i + 1, F.col(c)))
        out[f"u{lane}"] = name
        out[f"p{lane}"] = F.when(F.col("last").isNotNull(), name.bitwiseXOR(_lane(lane, F.col("block") * WIDTH + F.col("level"), F.col("last"))))
    return made.select(*(c.alias(n) for n, c in out.items()), (F.col("block") * WIDTH + F.col("level")).alias("depth"), "last", *sums)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids as texts of some thousand each."""
    node, ids = None, []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([node[1]]), pa.array([ids[0]]), pa.array([",".join(map(str, ids))])], [*NODE, "first", "ids"])

    for batch in batches:
        for a, b, i in zip(*(batch.column(c).to_pylist() for c in (*NODE, "conv_id")), strict=True):
            if ids and (node != (a, b) or len(ids) == CHUNK):
                yield out()
                ids = []
            node = (a, b)
            ids.append(i)
    if ids:
        yield out()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's texts, comma-joined; texts are dropped as they come."""
    node, digest, done = None, None, []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[0][i] for d in done], pa.int64()) for i in (0, 1)] + [pa.array([d[1] for d in done])], [*NODE, "ends_sha256"])

    for batch in batches:
        for a, b, ids in zip(*(batch.column(c) for c in (*NODE, "ids")), strict=True):
            own = (a.as_py(), b.as_py())
            if own == node:
                digest.update(b",")
            else:
                if digest:
                    done.append((node, digest.hexdigest()))
                node, digest = own, hashlib.sha256()
            digest.update(ids.as_buffer())
            if len(done) >= 8192:
                yield out()
                done = []
    if digest:
        done.append((node, digest.hexdigest()))
    if done:
        yield out()


def ends(members: DataFrame) -> DataFrame:
    """For every node (u1, u2) the SHA-256 of the ids that end there, in numeric order."""
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = members.repartitionByRange(n, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(_joined, "u1 long, u2 long, first long, ids string")
    return texts.repartition(n, *NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_hashed, "u1 long, u2 long, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """The nodes of all conversations. turns: conv_id, place (from 1, null for a conversation without turns), turn_id (turn_id())."""
    rows = written(blocks(turns), "blocks")
    size = F.conv(F.hex(F.substring("last", 17, 4)), 16, 10).cast("long")
    nodes = rolled(rows, n_convs="count(*)", conv_id="min(conv_id)").withColumn("saved", F.coalesce((F.col("n_convs") - 1) * size, F.lit(0))).drop("last")
    nodes = written(nodes, "nodes")
    children = nodes.where("p1 is not null").groupBy(F.col("p1").alias("u1"), F.col("p2").alias("u2")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, NODE, "left").fillna(0, ["n_children"]), "nodes")

    charged = nodes.groupBy("conv_id").agg(F.sum("saved").alias("own_saved"), F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("own_leaves")).where("own_saved <> 0 OR own_leaves <> 0")
    under = rolled(rows.join(charged, "conv_id"), all_saved="sum(own_saved)", n_leaves="sum(own_leaves)").select(*NODE, "all_saved", "n_leaves")
    above = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumn("above", F.coalesce(F.sum("saved").over(above), F.lit(0)))

    ended = ends(rows.groupBy("conv_id").agg(F.bit_xor("x1").alias("u1"), F.bit_xor("x2").alias("u2")))
    parents = nodes.select(F.col("u1").alias("p1"), F.col("u2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(under, NODE, "left").join(ended, NODE, "left").join(parents, ["p1", "p2"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(*NODE, "p1", "p2", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"), (F.coalesce("all_saved", F.lit(0)) - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Turns of conversations that begin as the first of their hundred: conv_id, place, turn_id; a null place for those without any."""
    own = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_id().alias("turn_id"))
    own = numbered(own, "conv_id", ["turn", "turn_id"], "turns").select("conv_id", "place", "turn_id")
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).alias("head")
    firsts = own.where("place <= 5").select(F.col("conv_id").alias("base"), F.col("place").alias("place"), "turn_id")
    base = (F.col("conv_id") - F.col("conv_id") % 100).alias("base")
    convs = own.select("conv_id").distinct().select("conv_id", base, head)
    taken = convs.join(firsts, "base").where("place <= head").select("conv_id", "place", "turn_id")
    known = firsts.groupBy("base").agg(F.max("place").alias("known"))
    rest = own.select("*", base, head).where("place > head").join(known, "base", "left")
    moved = F.col("place") - F.col("head") + F.least(F.col("head"), F.coalesce("known", F.lit(0)))
    none = convs.select("conv_id", F.lit(None).cast("long").alias("place"), F.lit(None).cast("binary").alias("turn_id"))
    return taken.union(rest.select("conv_id", moved, "turn_id")).union(none)


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    nodes = trie(rebuilt(table(spark, sf_dir, "conversations")))
    return nodes.select("conv_id", *(F.col(c).cast("long").alias(c) for c in ("depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), "ends_sha256")


#: crc32 of ASCII text, bit by bit.
CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"

OP12_SQL = f"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, unhex(md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')))) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {CRC32.format("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM o)),
a AS (SELECT c.conv_id, 0 AS own, o.i, r, t FROM c JOIN o ON o.conv_id = c.base AND o.i <= c.h UNION ALL SELECT c.conv_id, 1, o.i, r, t FROM c JOIN o ON o.conv_id = c.conv_id AND o.i > c.h),
b AS (SELECT c.conv_id, coalesce(p, []) AS p FROM c LEFT JOIN (SELECT conv_id, list(length(r) || ':' || length(t) || ':' || r || t ORDER BY own, i) AS p FROM a GROUP BY conv_id) USING (conv_id)),
m AS (SELECT conv_id, len(p) AS n, unnest(range(0, len(p) + 1)) AS d, p FROM b),
k AS (SELECT conv_id, n, d, md5(array_to_string(p[1:d], chr(1))) AS node, CASE WHEN d > 0 THEN md5(array_to_string(p[1:d - 1], chr(1))) END AS parent, CASE WHEN d > 0 THEN split_part(p[d], ':', 2)::BIGINT ELSE 0 END AS size FROM m),
g AS (SELECT d, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256 FROM k GROUP BY d, node),
e AS (SELECT g.*, (SELECT count(*) FROM g AS x WHERE x.d = g.d + 1 AND x.parent = g.node) AS n_children FROM g),
s AS (SELECT k.d, k.node, sum(e.saved) AS saved_tokens, count(*) FILTER (WHERE e.n_children = 0) AS n_leaves FROM e JOIN k AS z ON z.conv_id = e.conv_id AND z.d = e.d AND z.node = e.node JOIN k ON k.conv_id = e.conv_id AND k.d <= e.d GROUP BY k.d, k.node)
SELECT e.conv_id, e.d::BIGINT AS depth, (SELECT x.conv_id FROM g AS x WHERE x.d = e.d - 1 AND x.node = e.parent) AS parent_conv_id, e.n_convs, e.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, e.ends_sha256 FROM e JOIN s USING (d, node)
"""
