"""Removal of long repeated passages by the common-prefix intervals of a sparse enhanced suffix array.

Texts are UTF-8 bytes. In every window of `length` bytes the gram of GRAM bytes with the least hash, the first of
equals, is its anchor: equal windows have equal anchors at equal places, so repeats are sought among anchors only.
The windows of one anchor are neighbours, and what they cover, some 530 bytes, is the anchor's context.

1. Grams that are anchors twice are found with a filter of once-seen and twice-seen hashes; all others are done.
2. Equal contexts of such anchors are counted. All bytes of a context that occurs twice are repeated; one of its
   places stands for it from here on.
3. Of each gram with several contexts, these are sorted by what follows the anchor's start: a suffix array, sparse
   as only anchors are suffixes. A stack scan over the common prefixes of neighbours gives the tree of intervals.
   In an interval of common length r, the members in the order of what precedes the anchor show how far, l, each
   agrees to the left with another: where members differ there (left diversity) a maximal repeat begins. With
   l + r >= length the bytes from l before the anchor to r after its start are repeated.
4. A gram with more than GROUP contexts is not gathered in one task. Its windows are hashed and counted instead,
   hot ones first within each task, and those that occur once are reported; the others are repeated.

Cases: a null or empty text, or one shorter than `length`, loses nothing and can repeat nothing. Rows that share
doc_id and text are copies of each other and lose all. Texts of any length are read in bounded pieces. Further
columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .base import table, written

LENGTH = 400
GRAM = 64
GROUP = 4000
#: Bytes handled at a time.
CHUNK = 1 << 20

_MULT = 0x9E3779B97F4A7C15
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random word for each byte, and the powers of the multiplier and of its inverse modulo 2**64."""
    if not _tables or _tables["up"].size < n:
        size = max(2 * n, 1 << 18)
        for name, base in (("up", _MULT), ("down", pow(_MULT, -1, 1 << 64))):
            powers = np.full(size, base, np.uint64)
            powers[0] = 1
            _tables[name] = np.cumprod(powers, dtype=np.uint64)
        _tables["byte"] = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _tables["byte"], _tables["up"], _tables["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Piece:
    """Texts (or a part of one) laid end to end, with hashes of any stretch of them in constant time."""

    def __init__(self, parts: list[bytes]):
        self.raw = b"".join(parts)
        buffer = np.frombuffer(self.raw, np.uint8)
        self.lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        self.ends = np.cumsum(self.lengths)
        byte, up, self.down = _powers(buffer.size + 1)
        self.prefix = np.zeros(buffer.size + 1, np.uint64)
        np.cumsum(byte[buffer] * up[: buffer.size], out=self.prefix[1:])

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.prefix[stop] - self.prefix[start]) * self.down[start] + (stop - start).astype(np.uint64))

    def anchors(self, length: int, gram: int) -> tuple[np.ndarray, ...]:
        """Of each anchor: part, place of the gram, first and last window start, hash of the gram, hash of the context."""
        n, w = len(self.raw), length - gram + 1
        none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
        if n < length:
            return none
        at = np.arange(n - gram + 1)
        grams = self.hashes(at, at + gram)
        bits = np.uint64(max(1, int(n).bit_length()))
        key = (grams >> bits << bits) | at.astype(np.uint64)
        least, k = key, 1
        while 2 * k <= w:
            least, k = np.minimum(least[: least.size - k], least[k:]), 2 * k
        least = np.minimum(least[: key.size - w + 1], least[w - k : w - k + key.size - w + 1])
        starts = np.arange(least.size)
        part = np.repeat(np.arange(self.ends.size), self.lengths)[: least.size]
        starts = starts[starts + length <= self.ends[part]]
        if not starts.size:
            return none
        place = (least[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1) != 0)
        last = np.append(first[1:], starts.size) - 1
        place, lo, hi = place[first], starts[first], starts[last]
        context = mixed(self.hashes(lo, place) * np.uint64(3) + self.hashes(place, hi + length))
        return part[lo], place, lo, hi, grams[place], context


def pieces(texts: list[str | None], length: int) -> Iterator[tuple[list[int], list[int], Piece]]:
    """Row and offset of each part, and the parts. Parts of a long text overlap so that every window is in just one."""
    rows, offsets, parts, size = [], [], [], 0
    for row, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        for start in range(0, len(raw) - length + 1, CHUNK):
            rows.append(row)
            offsets.append(start)
            parts.append(raw[start : start + CHUNK + length - 1])
            size += len(parts[-1])
            if size >= CHUNK:
                yield rows, offsets, Piece(parts)
                rows, offsets, parts, size = [], [], [], 0
    if rows:
        yield rows, offsets, Piece(parts)


def _rows_of(row: pa.Array, index: np.ndarray) -> pa.Array:
    return row.take(pa.array(index, pa.int64()))


def _suspects(length: int, gram: int, told: sketch.Suspects):
    """A function of batches (row, text): the anchors whose gram may occur twice, without their contexts' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                sub = batch.slice(start, 256)
                for rows, offsets, piece in pieces(sub.column("text").to_pylist(), length):
                    part, place, lo, hi, grams, context = piece.anchors(length, gram)
                    hit = told.hit(grams, np.asarray(rows)[part], sub.column("__hashes"))
                    if hit.any():
                        shift = np.asarray(offsets)[part] - np.append(0, piece.ends)[part]
                        yield pa.RecordBatch.from_arrays(
                            [_rows_of(sub.column("row"), np.asarray(rows)[part[hit]]), pa.array((place + shift)[hit]), pa.array((lo + shift)[hit]), pa.array((hi + shift)[hit]), pa.array(grams[hit].view(np.int64)), pa.array(context[hit].view(np.int64))],
                            ["row", "place", "lo", "hi", "gram", "context"],
                        )

    return run


def _lcp(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Common prefix lengths of rows of two zero-padded byte matrices."""
    differ = a != b
    at = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(at, np.minimum(la, lb))


def _matrix(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, values), np.int64, len(values))
    width = max(1, int(lengths.max(initial=0)))
    return np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8).reshape(len(values), width), lengths


def intervals(lcp: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Common prefix length, first and last suffix of every interval of a sorted list, inner ones before outer ones. lcp[i]: of suffixes i and i + 1."""
    stack: list[tuple[int, int]] = []  # length, first
    for i, value in enumerate([*lcp.tolist(), -1]):
        first = i
        while stack and stack[-1][0] > value:
            size, first = stack.pop()
            yield size, first, i
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def matches(left: list[bytes], right: list[bytes], length: int) -> Iterator[tuple[int, int, int, int]]:
    """Member, bytes before and after its anchor, and number of the repeat, for contexts of one gram sorted by `right`.

    Spans of a member that lie within another of its spans are left out.
    """
    matrix, size = _matrix(right)
    lcp = _lcp(matrix[:-1], size[:-1], matrix[1:], size[1:])
    back = [v[::-1] for v in left]
    order = sorted(range(len(back)), key=back.__getitem__)
    matrix, size = _matrix([back[i] for i in order])
    left_lcp = np.append(_lcp(matrix[:-1], size[:-1], matrix[1:], size[1:]), 0)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    reach = np.full(len(order), -1, np.int64)
    for number, (r, first, last) in enumerate(intervals(lcp)):
        at = np.sort(rank[first : last + 1])
        common = np.minimum.reduceat(left_lcp, at)[:-1]  # of neighbours in the order of what precedes
        best = np.maximum(np.append(common, 0), np.append(0, common))
        member = np.asarray(order)[at]
        new = (best + r >= length) & (best > reach[member])
        for m, b in zip(member[new].tolist(), best[new].tolist(), strict=True):
            reach[m] = b
            yield m, b, r, number


def _scan(length: int):
    """A function of batches (gram, row, place, left, right), sorted by gram and right: the repeated spans."""

    def flush(group: list[tuple], out: list[tuple]) -> None:
        if len(group) > 1:
            for m, before, after, number in matches([g[3] for g in group], [g[4] for g in group], length):
                out.append((group[m][1], group[m][2] - before, group[m][2] + after, (group[m][0] + number * _MULT) % (1 << 63)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for record in zip(*(batch.column(c).to_pylist() for c in ("gram", "row", "place", "left", "right")), strict=True):
                if group and group[0][0] != record[0]:
                    flush(group, out)
                    group = []
                group.append(record)
            if out:
                yield _spans(out)
        out = []
        flush(group, out)
        if out:
            yield _spans(out)

    return run


def _spans(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["row", "start", "stop", "repeat"])


def _windows(length: int):
    """A function of batches (row, place, lo, left, right): two hashes of every window of each context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                sub = batch.slice(begin, 1000)
                piece = Piece([a + b for a, b in zip(sub.column("left").to_pylist(), sub.column("right").to_pylist(), strict=True)])
                n = piece.lengths - length + 1
                which = np.repeat(np.arange(n.size), n)
                into = np.arange(which.size) - np.repeat(np.cumsum(n) - n, n)
                start = np.append(0, piece.ends)[which] + into
                one, two = piece.hashes(start, start + length // 2), piece.hashes(start + length // 2, start + length)
                yield pa.RecordBatch.from_arrays([_rows_of(sub.column("row"), which), pa.array(sub.column("lo").to_numpy()[which] + into), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["row", "start", "one", "two"])

    return run


class Repeats:
    """What is repeated in the documents: the filter and, by row, facts of four kinds (see `facts`)."""

    def __init__(self, docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, gram: int = GRAM, group: int = GROUP):
        self.length, self.gram = length, gram
        self.rows = docs.select(F.xxhash64(F.col(key), F.col(text)).alias("row"), F.col(text).alias("text"))
        size = self.rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

        def grams_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            for start in range(0, batch.num_rows, 256):
                for _, _, piece in pieces(batch.column("text")[start : start + 256].to_pylist(), length):
                    yield piece.anchors(length, gram)[4]

        self.told = sketch.suspected(self.rows, grams_of, size * 2 // (length - gram))
        suspects = self.told.told_only(self.rows).mapInArrow(_suspects(length, gram, self.told), "row long, place long, lo long, hi long, gram long, context long")
        # equal contexts meet here; `first` takes all values from one of them
        contexts = written(suspects.groupBy("gram", "context").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("row", "place", "lo", "hi"))), "contexts")
        several = written(contexts.groupBy("gram").agg(F.count("*").alias("n_contexts")).where("n_contexts > 1"), "grams")
        chosen = contexts.join(several, "gram").select("row", F.struct("place", "lo", "hi", "gram", (F.col("n_contexts") > group).alias("hot"), (F.col("n") == 1).alias("lone")).alias("c"))
        wanted = written(chosen.groupBy("row").agg(F.collect_list("c").alias("c")), "wanted")
        cut = written(wanted.join(sketch.sifted(self.rows, wanted, "row"), "row").mapInArrow(self._cutter(), "gram long, row long, place long, lo long, hot boolean, lone boolean, left binary, right binary"), "cut")
        self.spans = written(cut.where("not hot").select("gram", "row", "place", "left", "right").repartition("gram").sortWithinPartitions("gram", "right").mapInArrow(_scan(length), "row long, start long, stop long, repeat long"), "spans")
        hot = cut.where("hot")
        once = hot.select("row", "lo", "left", "right").mapInArrow(_windows(length), "row long, start long, one long, two long").groupBy("one", "two").agg(F.count("*").alias("n"), F.first("row").alias("row"), F.first("start").alias("start")).where("n = 1")
        kind = lambda df, k, a, b: df.select("row", F.struct(F.lit(k).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b")).alias("fact"))
        #: kind 0: the anchor at a has a context that occurs once, its first window at b; 1: a to b is repeated; 2: the windows of that context count one by one; 3: the window at a occurs once
        #: An anchor at the cut of a long text has a context in each piece: the first window tells them apart.
        self.facts = (
            kind(contexts.where("n = 1"), 0, "place", "lo").unionAll(kind(self.spans, 1, "start", "stop")).unionAll(kind(hot.where("lone"), 2, "place", "lo")).unionAll(kind(once, 3, "start", "start"))
        ).groupBy("row").agg(F.collect_list("fact").alias("facts"))

    def _cutter(self):
        length = self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 64):
                    sub, out = batch.slice(start, 64), []
                    for row, text, cuts in zip(*(sub.column(c).to_pylist() for c in ("row", "text", "c")), strict=True):
                        raw = text.encode("utf-8", "surrogatepass")
                        out += [(c["gram"], row, c["place"], c["lo"], c["hot"], c["lone"], raw[c["lo"] : c["place"]], raw[c["place"] : c["hi"] + length]) for c in cuts]
                    if out:
                        kinds = [pa.int64()] * 4 + [pa.bool_()] * 2 + [pa.binary()] * 2
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["gram", "row", "place", "lo", "hot", "lone", "left", "right"])

        return run

    def removed(self, docs: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """The kept columns, `n_bytes`, the removed runs as `spans` (start and stop), and `kept`, the bytes that remain."""
        length, gram, told = self.length, self.gram, self.told
        source = told.told(docs.select(F.xxhash64(F.col(key), F.col(text)).alias("__row"), F.col(text).alias("__text"), *keep), "__row").join(self.facts.select(F.col("row").alias("__row"), F.col("facts").alias("__facts")), "__row", "left").drop("__row")
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + ["n_bytes long, spans array<struct<start: long, stop: long>>, kept binary"])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin in range(0, batch.num_rows, 256):
                    sub = batch.slice(begin, 256)
                    texts = sub.column("__text").to_pylist()
                    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
                    facts = [np.array([(f["kind"], f["a"], f["b"]) for f in x], np.int64).reshape(-1, 3) if x else None for x in sub.column("__facts").to_pylist()]
                    found: list[list[np.ndarray]] = [[] for _ in texts]
                    for rows, offsets, piece in pieces(texts, length):
                        part, place, lo, hi, grams, _ = piece.anchors(length, gram)
                        hit = told.hit(grams, np.asarray(rows)[part], sub.column("__hashes"))
                        shift = np.asarray(offsets)[part] - np.append(0, piece.ends)[part]
                        which, place, lo, hi = np.asarray(rows)[part[hit]], (place + shift)[hit], (lo + shift)[hit], (hi + shift)[hit]
                        for r in np.unique(which):
                            own, f = which == r, facts[r]
                            p, a, b = place[own], lo[own], hi[own]
                            name = p * length + (p - a)  # of the context: a is less than `length` before p
                            of_kind = lambda k: f[f[:, 0] == k, 1] * length + (f[f[:, 0] == k, 1] - f[f[:, 0] == k, 2])  # noqa: E731, B023
                            again = np.ones(p.size, bool) if f is None else ~np.isin(name, of_kind(0))
                            found[r].append(np.stack([a[again], b[again] + length], axis=1))
                            if f is not None and (f[:, 0] == 2).any():
                                one_by_one = np.isin(name, of_kind(2))
                                starts = np.concatenate([np.arange(x, y + 1) for x, y in zip(a[one_by_one], b[one_by_one], strict=True)] or [np.zeros(0, np.int64)])
                                starts = np.setdiff1d(starts, f[f[:, 0] == 3, 1])
                                found[r].append(np.stack([starts, starts + length], axis=1))
                    spans, kept = [], []
                    for raw, f, own in zip(raws, facts, found, strict=True):
                        if f is not None:
                            own.append(f[f[:, 0] == 1, 1:])
                        merged = union(np.concatenate(own) if own else np.zeros((0, 2), np.int64))
                        spans.append([{"start": a, "stop": b} for a, b in merged])
                        edges = [0, *(x for s in merged for x in s), len(raw)]
                        kept.append(b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
                    yield pa.RecordBatch.from_arrays([*(sub.column(c) for c in keep), pa.array([len(r) for r in raws], pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], [*keep, "n_bytes", "spans", "kept"])

        return source.mapInArrow(run, schema)


def union(spans: np.ndarray) -> list[tuple[int, int]]:
    """Spans that touch or overlap made one, in order."""
    if not len(spans):
        return []
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    stop = np.maximum.accumulate(spans[:, 1])
    first = np.append(True, spans[1:, 0] > stop[:-1])
    return list(zip(spans[first, 0].tolist(), stop[np.append(np.flatnonzero(first)[1:], len(spans)) - 1].tolist(), strict=True))


def op10_repeated_passages(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = Repeats(docs).removed(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Every window of 400 bytes by its hash.
OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, text, encode(coalesce(text, '')) AS b FROM documents
), w AS (
  SELECT doc_id, i, md5(b[i:i + 399]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d)
), r AS (
  SELECT doc_id, i FROM w JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) t USING (h)
), e AS (
  SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r
), g AS (
  SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM e
), p AS (
  SELECT doc_id, span, min(i) AS a, max(i) + 400 AS z FROM g GROUP BY doc_id, span
), k AS (
  SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS gap FROM p
), o AS (
  SELECT k.doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(hex(b[gap:a - 1]), '' ORDER BY a) || hex(any_value(b[k2.last:octet_length(b)])) AS kept
  FROM k JOIN d USING (doc_id) JOIN (SELECT doc_id, max(z) AS last FROM p GROUP BY doc_id) k2 USING (doc_id) GROUP BY k.doc_id
)
SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(CASE WHEN n_spans IS NULL THEN b ELSE unhex(kept) END) AS kept_sha256
FROM d LEFT JOIN o USING (doc_id)"""
