"""Conversations made well formed by the cheapest edits: an optional system turn, then user and assistant in turn.

The rows of a conversation go through four states (nothing yet, a system turn, a user's, an assistant's). Cost vectors,
what is still to pay from each state to the end, are kept only at checkpoints, every sqrt(n)-th row of a conversation
of n rows (SHORT at least). Tasks turn the rows between two checkpoints into a 4 x 4 table of costs from state to
state; these tables, sqrt(n) of them, give the vectors at the checkpoints from the end backwards. Then each stretch is
worked through again on its own: its vectors are recomputed from the checkpoint behind it, and walking forward from
each state that it may begin in, the ASCII-least edit is taken that the vectors allow without loss. States at the
checkpoints choose among the four walks. So no task holds more than a stretch, and a conversation that has a third
of all rows is worked on by many tasks. Only the digest of a repaired conversation, which has to see its text in
order, is made in one task, row by row.

Edits: K keeps a row, R gives it the role user or assistant (2), D deletes it (3; the only way with rows that are
blank or repeat an earlier one), I inserts an empty turn (2). A row that is not deleted and whose text does not end in
[.!?] costs 1 more.

Cases: an empty table gives an empty result. Null ids are one conversation of their own; null turns come first and
count in no gap; null roles and texts are what the caller makes of them (op13: one space). Rows with one turn number
come in the order of role and of a digest of the text. Equal rows are duplicates. A gap that is no long is null.
Further columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import table, written
from .order import numbered
from .trie import CRC32

#: Rows between checkpoints at least.
SHORT = 64
NEVER = 1 << 60
#: States: nothing yet, after a system turn, after a user's, after an assistant's.
NEW, SYSTEM, USER, ASSISTANT = range(4)
#: Where an inserted or reroled turn leads from each state, and its role.
FORCED = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: What is to pay where all rows are used up.
AFTER = (0, 4, 2, 0)
SPACES = " \t\n\x0b\x0c\r"


def _next(state: int, initial: int) -> int | None:
    """Where keeping a row leads; initials: 0 system, 1 user, 2 assistant, 3 any other."""
    if initial == 0:
        return SYSTEM if state == NEW else None
    return FORCED[state] if initial + 1 == FORCED[state] else None


def _moves() -> list[list[list[tuple[str, int, int]]]]:
    """For each code and state the edits that use up a row, ASCII-least first: letter, cost, next state."""
    out = []
    for code in range(12):
        initial, fault = divmod(code, 3)
        of_state = []
        for q in range(4):
            moves = [("D", 3, q)]
            if fault != 1:
                more = int(fault == 2)
                to = _next(q, initial)
                moves += [("K", more, to)] if to is not None else []
                moves.append(("R", 2 + more, FORCED[q]))
            of_state.append(moves)
        out.append(of_state)
    return out


MOVES = _moves()


def _inserted(v: list[int]) -> list[int]:
    """Costs when turns may be inserted first."""
    u, a = min(v[USER], 2 + v[ASSISTANT]), min(v[ASSISTANT], 2 + v[USER])
    return [min(v[NEW], 2 + u), min(v[SYSTEM], 2 + u), u, a]


def backward(codes: bytes, after: list[int]) -> list[list[int]]:
    """The vectors before each row of a stretch, and the one behind it, which is given."""
    out = [list(after)]
    for code in reversed(codes):
        v = out[-1]
        out.append(_inserted([min(cost + v[to] for _, cost, to in moves) for moves in MOVES[code]]))
    return out[::-1]


def through(codes: bytes) -> list[int]:
    """Costs from each state before a stretch to each behind it, row by row of the table."""
    columns = [backward(codes, [0 if q == end else NEVER for q in range(4)])[0] for end in range(4)]
    return [min(columns[end][start], NEVER) for start in range(4) for end in range(4)]


def walk(vectors: list[list[int]], codes: bytes, state: int, last: bool) -> tuple[str, int]:
    """The ASCII-least edits of a stretch that cost no more than the vectors say, and the state behind it."""
    out, i = [], 0
    while i < len(codes) or last:
        left = vectors[i][state]
        if i == len(codes):
            if not left:
                break
            out.append("I")
            state = FORCED[state]
            continue
        # D, I, K, R: deleting comes first, then an insertion, then what else uses the row up
        moves = [m for m in MOVES[codes[i]][state] if m[1] + vectors[i + 1][m[2]] == left]
        if not (moves and moves[0][0] == "D") and 2 + vectors[i][FORCED[state]] == left:
            out.append("I")
            state = FORCED[state]
            continue
        letter, _, state = moves[0]
        out.append(letter)
        i += 1
    return "".join(out), state


# stretches in tasks


def _decoded(text: str) -> bytes:
    return bytes(b - 97 for b in text.encode())


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each stretch its table of costs, the pairs of adjacent roles that are not legal, and its outer roles."""
    for batch in batches:
        codes = [_decoded(c) for c in batch.column("codes").to_pylist()]
        roles = [np.frombuffer(c, np.uint8) // 3 for c in codes]
        bad = [int((~_legal(r[:-1], r[1:])).sum()) for r in roles]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("stretch"), pa.array([through(c) for c in codes], pa.list_(pa.int64())), pa.array(bad, pa.int64()), pa.array([int(r[0]) for r in roles], pa.int64()), pa.array([int(r[-1]) for r in roles], pa.int64())], ["conv", "stretch", "costs", "illegal", "first", "last"]
        )


def _legal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == 0) & (b == 1) | (a == 1) & (b == 2) | (a == 2) & (b == 1)


def _checkpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each stretch the vector behind it; with the cost of all on the first, and the illegal pairs of the stretch and across its end."""
    for batch in batches:
        rows: dict[str, list] = {n: [] for n in ("conv", "stretch", "after", "ends", "cost", "illegal")}
        for conv, stretches in zip(batch.column("conv").to_pylist(), batch.column("all").to_pylist(), strict=True):
            v = list(AFTER)
            for k in reversed(range(len(stretches))):
                s = stretches[k]
                t = s["costs"]
                rows["after"].append(v)
                v = [min(t[4 * a + b] + v[b] for b in range(4)) for a in range(4)]
                across = k + 1 < len(stretches) and not bool(_legal(np.array(s["last"]), np.array(stretches[k + 1]["first"])))
                for n, value in (("conv", conv), ("stretch", s["stretch"]), ("ends", k + 1 == len(stretches)), ("cost", v[NEW] if k == 0 else None), ("illegal", s["illegal"] + across)):
                    rows[n].append(value)
        types = {"conv": pa.string(), "after": pa.list_(pa.int64()), "ends": pa.bool_()}
        yield pa.RecordBatch.from_arrays([pa.array(v, types.get(n, pa.int64())) for n, v in rows.items()], list(rows))


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each stretch walked through from each state."""
    for batch in batches:
        edits, states = [], []
        for codes, after, ends, k in zip(*(batch.column(c).to_pylist() for c in ("codes", "after", "ends", "stretch")), strict=True):
            codes = _decoded(codes)
            vectors = backward(codes, after)
            made = [walk(vectors, codes, q, ends) if q == NEW or k else ("", NEW) for q in range(4)]
            edits.append([m[0] for m in made])
            states.append([m[1] for m in made])
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("stretch"), pa.array(edits, pa.list_(pa.string())), pa.array(states, pa.list_(pa.int64()))], ["conv", "stretch", "edits", "states"])


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state that each stretch of a conversation begins in."""
    for batch in batches:
        out: list[tuple] = []
        for conv, stretches in zip(batch.column("conv").to_pylist(), batch.column("all").to_pylist(), strict=True):
            state = NEW
            for s in stretches:
                out.append((conv, s["stretch"], state))
                state = s["states"][state]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["conv", "stretch", "state"])


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str | None, str | None]]:
    """Conversation, role and text of each turn after the edits, and a row without role where a conversation ends.

    Rows come by conversation and place, the edits of a stretch before its first row."""
    conv, edits, at, state = None, "", 0, NEW

    def inserted() -> Iterator[tuple[str, str, str]]:
        nonlocal at, state
        while at < len(edits) and edits[at] == "I":
            at, state = at + 1, FORCED[state]
            yield conv, ROLE[state], ""

    for batch in batches:
        for own, stretch, begin, role, text in zip(*(batch.column(c) for c in ("conv", "edits", "state", "role", "text")), strict=True):
            own = own.as_py()
            if own != conv:
                if conv is not None:
                    yield from inserted()
                    yield conv, None, None
                conv = own
            if stretch.is_valid:
                edits, at, state = stretch.as_py(), 0, begin.as_py()
                continue
            yield from inserted()
            letter, at = edits[at], at + 1
            if letter == "R":
                state = FORCED[state]
                yield conv, ROLE[state], text.as_py()
            elif letter == "K":
                state = SYSTEM if role.as_py()[:1] == "s" else FORCED[state]
                yield conv, role.as_py(), text.as_py()
    if conv is not None:
        yield from inserted()
        yield conv, None, None


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, place, size = [], 0, 0
    for conv, role, text in _edited(batches):
        place = place + 1 if role is not None else 0
        if role is not None:
            out.append((conv, place, role, text))
            size += len(text)
        if len(out) == 4096 or size > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["conv", "place", "role", "text"])
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["conv", "place", "role", "text"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, digest, begun = [], hashlib.sha256(), False
    for conv, role, text in _edited(batches):
        if role is None:
            out.append((conv, digest.hexdigest()))
            digest, begun = hashlib.sha256(), False
            if len(out) == 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["conv", "repaired_sha256"])
                out = []
            continue
        digest.update(("\n" if begun else "").encode() + f"{role}:{text}".encode())
        begun = True
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["conv", "repaired_sha256"])


class Repair:
    """The repair of all conversations. rows: conv_id, turn, role and text, the last two never null."""

    def __init__(self, rows: DataFrame, short: int = SHORT) -> None:
        conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
        trimmed = F.rtrim("text", F.lit(SPACES))
        initial = F.coalesce(F.array_position(F.array(*map(F.lit, "sua")), F.substring("role", 1, 1)), F.lit(0)).cast("int")
        rows = rows.select(conv.alias("conv"), F.col("turn").cast("long").alias("turn"), "role", F.unhex(F.md5("text")).alias("digest"), "text", (trimmed == "").alias("empty"), F.right(trimmed, F.lit(1)).isin(".", "!", "?").alias("ended"), F.when(initial == 0, 3).otherwise(initial - 1).alias("initial"))
        self.rows = numbered(rows, "conv", ["turn", "role", "digest"], "turns")

        keys = ["conv", "role", "digest"]
        again = written(self.rows.groupBy(*keys).agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select(*keys, "first"), "again")
        thin = self.rows.select("conv", "turn", "role", "digest", "place", "empty", "ended", "initial").join(again, keys, "left")
        fault = F.when(F.col("empty"), "blank").when(F.col("place") > F.col("first"), "duplicate").when(~F.col("ended"), "truncated")
        thin = thin.select("conv", "turn", "place", "initial", fault.alias("fault"))
        code = F.col("initial") * 3 + F.when(F.col("fault").isin("blank", "duplicate"), 1).when(F.col("fault") == "truncated", 2).otherwise(0)
        faulty = written(thin.withColumn("code", F.char(code + 97)), "faults")

        is_ = lambda name: F.sum(F.when(F.col("fault") == name, 1).otherwise(0)).alias(name)
        turns = faulty.groupBy("conv", "turn").agg(F.count("*").alias("n"), *(is_(n) for n in ("blank", "duplicate", "truncated")))
        gap = F.try_subtract(F.try_add(F.try_subtract(F.max("turn"), F.min("turn")), F.lit(1)), F.count("turn"))
        sums = turns.groupBy("conv").agg(F.sum("n").alias("n"), F.when(F.count("turn") == 0, 0).otherwise(gap).cast("long").alias("gaps"), *(F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")))
        self.counts = written(sums, "counts")
        step = F.greatest(F.lit(short), F.ceil(F.sqrt("n")))
        placed = faulty.join(self.counts.select("conv", step.alias("step")), "conv").withColumn("stretch", F.floor((F.col("place") - 1) / F.col("step")))
        codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda x: x["code"]), "")
        self.codes = written(placed.groupBy("conv", "stretch").agg(codes.alias("codes"), F.min("place").alias("begin")), "codes")

        tables = self.codes.mapInArrow(_tables, "conv string, stretch long, costs array<long>, illegal long, first long, last long")
        points = self._by_conversation(tables, "stretch", "costs", "illegal", "first", "last").mapInArrow(_checkpoints, "conv string, stretch long, after array<long>, ends boolean, cost long, illegal long")
        self.points = written(points, "checkpoints")
        walks = written(self.codes.join(self.points, ["conv", "stretch"]).select("conv", "stretch", "codes", "after", "ends").mapInArrow(_walks, "conv string, stretch long, edits array<string>, states array<long>"), "walks")
        states = self._by_conversation(walks, "stretch", "states").mapInArrow(_chosen, "conv string, stretch long, state long")
        self.edits = written(walks.join(states, ["conv", "stretch"]).join(self.codes.select("conv", "stretch", "begin"), ["conv", "stretch"]).select("conv", "stretch", "begin", "state", F.expr("edits[state]").alias("edits")), "edits")

    @staticmethod
    def _by_conversation(rows: DataFrame, *columns: str) -> DataFrame:
        """conv and all, its stretches in order: as many as the root of its rows."""
        return rows.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("all"))

    def _in_order(self) -> DataFrame:
        none = lambda kind: F.lit(None).cast(kind)
        edits = self.edits.select("conv", F.col("begin").alias("place"), F.lit(0).alias("kind"), "edits", "state", none("string").alias("role"), none("string").alias("text"))
        turns = self.rows.select("conv", "place", F.lit(1).alias("kind"), none("string").alias("edits"), none("long").alias("state"), "role", "text")
        n = int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return edits.unionByName(turns).repartition(n, "conv").sortWithinPartitions("conv", "place", "kind").select("conv", "edits", "state", "role", "text")

    def turns(self) -> DataFrame:
        """conv_id, place, role and text of the repaired conversations."""
        made = self._in_order().mapInArrow(_turns, "conv string, place long, role string, text string")
        return made.select(F.expr("nullif(conv, '')").cast("long").alias("conv_id"), "place", "role", "text")

    def summary(self) -> DataFrame:
        """What was wrong with each conversation that has rows, what it cost, the edits, and a digest of the result."""
        total = self.points.groupBy("conv").agg(F.max("cost").alias("cost"), F.sum("illegal").alias("illegal"))
        audit = self.edits.groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stretch", "edits"))), lambda x: x["edits"]), "").alias("audit"))
        digest = self._in_order().mapInArrow(_digests, "conv string, repaired_sha256 string")
        out = self.counts.join(total, "conv").join(audit, "conv").join(digest, "conv")
        return out.select(F.expr("nullif(conv, '')").cast("long").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with faults by a checksum of conversation and turn; nulls are one space."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20).alias("kind")
    rows = conversations.select("conv_id", "turn", named("role").alias("role"), named("text").alias("text"), kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def op13_structure_repair(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = Repair(damaged(rows)).summary()
    every = rows.select(F.col("conv_id").cast("long").alias("every")).distinct()
    out = every.join(found, F.col("every").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(F.when(F.col("audit").isNotNull(), F.col(c)), F.when(F.col("audit").isNull(), F.lit(0))).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("every").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


#: Forward over the rows of a conversation, the best way to each state by cost and then letters; insertions come before a row.
OP13_SQL = f"""
WITH RECURSIVE k AS (SELECT *, {CRC32.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS again FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, unhex(md5(text)), again) AS i FROM d),
f AS (SELECT *, CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE '-' END AS r,
  CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM o),
c AS (SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
  count(*) FILTER (WHERE before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM (SELECT *, lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM f) GROUP BY conv_id),
j(q, ins, made, q2) AS (VALUES ('0', '', '', '0'), ('0', 'I', E'\nuser:', 'u'), ('0', 'II', E'\nuser:\nassistant:', 'a'), ('s', '', '', 's'), ('s', 'I', E'\nuser:', 'u'), ('s', 'II', E'\nuser:\nassistant:', 'a'), ('u', '', '', 'u'), ('u', 'I', E'\nassistant:', 'a'), ('a', '', '', 'a'), ('a', 'I', E'\nuser:', 'u')),
t(q, x) AS (VALUES ('0', 's'), ('0', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
w AS (
  SELECT conv_id, 0::BIGINT AS i, '0' AS q, row(0::BIGINT, '', '') AS best FROM c
  UNION ALL
  SELECT conv_id, i, q, min(best) FROM (
    SELECT w.conv_id, f.i, e.q3 AS q, row(best[1] + 2 * length(ins) + CASE e.op WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN e.op <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END, best[2] || ins || e.op,
      best[3] || made || CASE e.op WHEN 'D' THEN '' WHEN 'K' THEN E'\n' || f.role || ':' || f.text ELSE E'\n' || CASE e.q3 WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text END) AS best
    FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN j ON j.q = w.q
      JOIN (SELECT DISTINCT q2 AS q, 'D' AS op, '' AS r, q2 AS q3 FROM j UNION ALL SELECT q, 'K', x, x FROM t UNION ALL SELECT q, 'R', '', x FROM t WHERE x <> 's') AS e ON e.q = j.q2 AND (e.op = 'D' OR fault NOT IN ('blank', 'duplicate') AND (e.op = 'R' OR e.r = f.r))
  ) GROUP BY conv_id, i, q
),
z AS (SELECT c.conv_id, min(row(best[1] + 2 * length(ins), best[2] || ins, best[3] || made)) AS best FROM c JOIN w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n JOIN j ON j.q = w.q AND j.q2 IN ('0', 'a') GROUP BY c.conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best[1], 0)::BIGINT AS cost, coalesce(best[2], '') AS audit, sha256(coalesce(substr(best[3], 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id
"""
