"""Web archives (WARC/1.1): rows are written as records, and archives of any size are read back in splits.

Writing is DataFrame work. Payloads are digested, equal ones of `least` bytes or more are counted, and of these only
the record with the largest id holds the payload; others are revisits that name it. A record is a line of Spark's
text writer whose separator is what ends a record.

Reading finds records by their boundaries. Every task goes through the lines of its splits and emits, for each line
that could begin a record (`WARC/1.1`, header fields, an empty line, a length), the offset of the candidate and that
of its successor. Within a split candidates jump to the end of their chain; the ends of all splits are then joined by
pointer jumping from the start of each file, in a number of rounds that grows with the logarithm of a file's splits.
What is not reached, such as a record quoted in a payload, is none. A header that goes on in the next split is put
together from facts of both. Tasks then read once more, each from the first reached record of its splits on; only
the pieces of records that cross the end of a split are shuffled.

Cases: an empty table is an archive without records. A null payload is empty. Null ids sort before all others; rows
that share the largest id and the payload are all responses, as nothing tells them apart. The kept columns, of any
name and any type that JSON can hold, go with the record in a header field of its own, nulls left out; columns that
are not kept play no part. Repeated rows are records each. Where a chain ends before its file does (damage), the
records up to there are read, and `strict` raises instead. Empty files hold no records. Bytes after a record's length are no part of it, and a payload may
hold anything. Compressed archives are one split each, as Spark reads them. A revisit whose record is not among those
read has no payload and refers to nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import shared_dir, table, written

LEAST = 1000
#: Splits whose facts are broadcast; of more they are joined in a shuffle.
SPLITS = 1_000_000
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The header field that carries the kept columns.
COLUMNS = "X-Columns"

BEGIN = re.compile(rb"WARC/[0-9]+\.[0-9]+\r")
FIELD = re.compile(rb"(?:[!#$%&'*+.^_`|~0-9A-Za-z-]+:|[ \t]).*\r", re.S)
LENGTH = re.compile(rb"content-length:[ \t]*([0-9]+)[ \t]*\r", re.I)


# writing


def _uuid(of: Column) -> Column:
    h = F.md5(of)
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _name(digest: Column, number: Column) -> Column:
    return _uuid(F.concat_ws("|", digest, F.coalesce(number.cast("string"), F.lit(""))))


def _header(*fields: tuple[str, Column]) -> Column:
    """The lines of a header; a field without a value is left out."""
    return F.concat(F.lit("WARC/1.1\r\n"), *(F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")), F.lit("")) for k, v in fields), F.lit("\r\n"))


def records(rows: DataFrame, payload: str, order: str, uri: str | None = None, keep: tuple[str, ...] = (), least: int = LEAST, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """`value`, the text of a record without its end, for every row."""
    own = F.struct(*(F.col(c).alias(c) for c in keep))
    target = F.col(uri).cast("string") if uri else F.lit(None).cast("string")
    rows = rows.select(F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("body"), F.col(order).alias("number"), F.replace(F.replace(target, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("uri"), F.to_json(own).alias("own"))
    rows = rows.withColumns({"digest": F.sha1(F.col("body").cast("binary")), "n": F.octet_length("body")})
    equal = rows.where(F.col("n") >= least).groupBy("digest").agg(F.max("number").alias("first"), F.count("*").alias("times")).where("times > 1").select("digest", "first")
    # known by its size before the join is planned: of few equal payloads nothing is shuffled
    rows = rows.join(written(equal, "equal").withColumn("several", F.lit(True)), "digest", "left")
    again = F.coalesce(F.col("several") & ~F.col("number").eqNullSafe(F.col("first")), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    block = F.when(again, http).otherwise(F.concat(http, F.col("body")))
    header = _header(
        ("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        ("WARC-Record-ID", _name(F.col("digest"), F.col("number"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.col("uri")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Profile", F.when(again, F.lit(PROFILE))),
        ("WARC-Refers-To", F.when(again, _name(F.col("digest"), F.col("first")))),
        (COLUMNS, F.col("own")),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(block).cast("string")),
    )
    return rows.select(F.concat(header, block).alias("value"))


def write(rows: DataFrame, path: str, payload: str, order: str, uri: str | None = None, keep: tuple[str, ...] = (), least: int = LEAST) -> None:
    """An archive file for every task, in the folder `path`."""
    records(rows, payload, order, uri, keep, least).write.option("lineSep", END).text(path)


# reading: lines, candidates, chains


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The bytes between line feeds, in their order within each split."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that belong to one split."""
    file, block = (batch.column(c).to_numpy() for c in ("file", "block"))
    cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


class _Header:
    """A header as its lines come. at: where its record begins, none of the lines that a split begins with."""

    def __init__(self, at: int | None) -> None:
        self.at, self.length = at, None

    def takes(self, line: bytes) -> str:
        """open while the header goes on, closed at its empty line, bad at what is no header."""
        if line == b"\r":
            return "closed"
        if not FIELD.fullmatch(line):
            return "bad"
        found = LENGTH.fullmatch(line)
        if found and self.length is None:
            self.length = int(found[1])
        return "open"


class _Split:
    """What a task finds in one split; offsets count from its first line."""

    def __init__(self, file: int, block: int) -> None:
        self.file, self.block, self.size = file, block, 0
        self.open: _Header | None = _Header(None) if block else None
        self.lead, self.lead_end, self.lead_length = "open" if block else "bad", 0, None
        self.at: list[int] = []
        self.next: list[int] = []

    def take(self, lines: pa.Array) -> None:
        ends = self.size + np.cumsum(pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        begins = np.flatnonzero(pc.starts_with(lines, b"WARC/").to_numpy(zero_copy_only=False))
        i = 0
        while i < len(ends):
            if self.open is None:
                k = np.searchsorted(begins, i)
                if k == len(begins):
                    break
                i = int(begins[k])
                if BEGIN.fullmatch(lines[i].as_py()):
                    self.open = _Header(int(ends[i - 1]) if i else self.size)
                i += 1
                continue
            told = self.open.takes(lines[i].as_py())
            if told != "open":
                self._close(told, int(ends[i]))
                if told == "bad":
                    continue  # the line may begin a record itself
            i += 1
        self.size = int(ends[-1])

    def _close(self, told: str, end: int) -> None:
        head, self.open = self.open, None
        if head.at is None:
            self.lead, self.lead_end, self.lead_length = told, end, head.length
        elif told == "closed" and head.length is not None:
            self.at.append(head.at)
            self.next.append(end + head.length + len(END))

    def rows(self) -> Iterator[dict]:
        """The split's own row, and one for each candidate with the end and the last record of its chain."""
        still = self.open if self.open and self.open.at is not None else None
        if self.open and self.open.at is None:
            self.lead_length = self.open.length
        yield {"file": self.file, "block": self.block, "size": self.size, "lead": self.lead, "lead_end": self.lead_end, "lead_length": self.lead_length, "open_at": still.at if still else None, "open_length": still.length if still else None}
        at, to = np.array(self.at + ([still.at] if still else []), np.int64), np.array(self.next + ([still.at] if still else []), np.int64)
        if not at.size:
            return
        place = np.minimum(np.searchsorted(at, to), at.size - 1)
        jump = np.where((at[place] == to) & (place > np.arange(at.size)), place, np.arange(at.size))
        while True:
            further = jump[jump]
            if (further == jump).all():
                break
            jump = further
        for i in range(len(self.at)):
            last = int(jump[i])
            yield {"file": self.file, "block": self.block, "at": int(at[i]), "exit": int(to[last]), "last": int(at[last])}


_FOUND = "file long, block long, size long, lead string, lead_end long, lead_length long, open_at long, open_length long, at long, exit long, last long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _FOUND.split(", ")]
    types = [pa.string() if n == "lead" else pa.int64() for n in names]

    def told(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        rows = list(rows)
        for k in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows[k : k + 4096]], t) for n, t in zip(names, types, strict=True)], names)

    now: _Split | None = None
    for batch in batches:
        for run in _runs(batch):
            file, block = run.column("file")[0].as_py(), run.column("block")[0].as_py()
            if now is None or (now.file, now.block) != (file, block):
                if now:
                    yield from told(now.rows())
                now = _Split(file, block)
            now.take(run.column("line"))
    if now:
        yield from told(now.rows())


def _stitched(splits: pd.DataFrame) -> pd.DataFrame:
    """Of one file's splits where each begins, and where the record goes on whose header crosses its end."""
    splits = splits.sort_values("block").reset_index(drop=True)
    base = splits["size"].cumsum() - splits["size"]
    out = []
    for k, s in enumerate(splits.itertuples()):
        at = to = None
        if not pd.isna(s.open_at):
            length, j = s.open_length, k + 1
            while j < len(splits):
                length = splits.lead_length[j] if pd.isna(length) else length
                if splits.lead[j] != "open":
                    break
                j += 1
            if j < len(splits) and splits.lead[j] == "closed" and not pd.isna(length):
                at, to = int(base[k] + s.open_at), int(base[j] + splits.lead_end[j] + length + len(END))
        out.append((s.file, s.block, int(base[k]), at, to))
    return pd.DataFrame(out, columns=["file", "block", "base", "open_at", "open_next"]).astype({"open_at": "Int64", "open_next": "Int64"})


def reached(jumps: DataFrame) -> DataFrame:
    """file and at of the candidates that chains from the starts of their files go through.

    jumps: file, at and exit, the candidate behind which a chain goes on. Each round doubles how far both go."""
    found = written(jumps.where("at = 0").select("file", "at"), "reached")
    n = found.count()
    while True:
        step = found.join(jumps, ["file", "at"]).select("file", F.col("exit").alias("at"))
        found = written(found.union(step.join(jumps.select("file", "at"), ["file", "at"], "left_semi")).distinct(), "reached")
        now = found.count()
        if now == n:
            return found
        n = now
        far = jumps.select("file", F.col("at").alias("exit"), F.col("exit").alias("far"))
        jumps = written(jumps.join(far, ["file", "exit"], "left").select("file", "at", F.coalesce("far", "exit").alias("exit")), "jumps")


def _entries(spark: SparkSession, path: str, strict: bool) -> DataFrame:
    """For each split with lines where it begins, its first and last reached record, and the record that goes on into it, with its end."""
    found = written(_lines(spark, path).mapInArrow(_scan, _FOUND), "candidates")
    splits = written(found.where("size is not null").select("file", "block", "size", "lead", "lead_end", "lead_length", "open_at", "open_length").groupBy("file").applyInPandas(_stitched, "file long, block long, base long, open_at long, open_next long"), "splits")
    closed = found.where("size is null").join(splits.select("file", "block", "base"), ["file", "block"]).select("file", "block", *((F.col(c) + F.col("base")).alias(c) for c in ("at", "exit", "last")))
    across = splits.where("open_at is not null").select("file", "block", F.col("open_at").alias("at"), F.col("open_next").alias("exit"), F.col("open_at").alias("last"))
    chains = written(closed.unionByName(across), "chains")
    # chains are entered at the start of a file or where another split's chain ends, and nowhere else
    doors = chains.select("file", F.col("exit").alias("at")).union(chains.where("at = 0").select("file", "at")).distinct()
    jumps = written(chains.select("file", "at", "exit").join(doors, ["file", "at"], "left_semi"), "jumps")
    taken = chains.join(reached(jumps), ["file", "at"], "left_semi")
    if strict:
        sizes = spark.read.format("binaryFile").load(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
        bad = sizes.where("size > 0").join(taken.groupBy("file").agg(F.max("exit").alias("end")), "file", "left").where("coalesce(end, -1) <> size").count()
        if bad:
            raise ValueError(f"the records of {bad} archive files do not reach their ends")
    own = taken.groupBy("file", "block").agg(F.min("at").alias("entry"), F.max("last").alias("last"), F.max("exit").alias("exit"))
    before = "OVER (PARTITION BY file ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return splits.select("file", "block", "base").join(own, ["file", "block"], "left").select("file", "block", "base", "entry", "last", F.expr(f"last_value(last, true) {before}").alias("carry"), F.expr(f"last_value(exit, true) {before}").alias("carry_end"))


# reading: records

RECORD = "type string, record_id string, uri string, refers_to string, digest string, own string, content_type string"
_READ = f"file long, at long, part long, {RECORD}, payload binary, raw binary"


def parsed(raw: bytes) -> dict:
    """Header fields and payload of a record's bytes."""
    head, _, rest = raw.partition(END.encode())
    fields: dict[str, str] = {}
    key = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t"):
            fields[key] = f"{fields.get(key, '')} {line.strip()}"
            continue
        name, _, value = line.partition(":")
        key = name.lower() if name.lower() not in fields else ""
        fields[key] = value.strip()
    block = rest[: int(fields.get("content-length", 0))]
    kind, media = fields.get("warc-type", ""), fields.get("content-type", "")
    payload = None if kind == "revisit" else block.partition(END.encode())[2] if media.startswith("application/http") else block
    digest = fields.get("warc-payload-digest")
    return {"type": kind, "record_id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"), "digest": digest.partition(":")[2] if digest else None, "own": fields.get(COLUMNS.lower()), "content_type": media or None, "payload": payload}


class _Reader:
    """The records of one split, from its first reached one on; pieces of what crosses its ends."""

    def __init__(self, file: int, facts: tuple) -> None:
        self.file, (self.here, self.due, self.last, carry, carry_end) = file, facts
        self.start: int | None = None if self.due == self.here else carry
        self.first = self.here  # where what is held begins
        self.end = carry_end if self.start is not None else None
        self.head: _Header | None = None
        self.held: list[bytes] = []

    def take(self, line: bytes) -> Iterator[dict]:
        here, self.here = self.here, self.here + len(line) + 1
        if self.start is not None and (here >= self.end if self.end is not None else False):
            yield from self.done()
        if self.start is None:
            if here != self.due or here > self.last:
                return
            self.start, self.first, self.head, self.end = here, here, _Header(here), None
        elif self.end is None and self.head.takes(line) == "closed":
            self.end = self.here + (self.head.length or 0) + len(END)
        self.held.append(line)

    def done(self) -> Iterator[dict]:
        """What is held up to a record's end; the next is due there."""
        if self.first == self.start:
            yield {"file": self.file, "at": self.start} | parsed(b"\n".join([*self.held, b""]))
            self.due = self.end
        else:
            yield from self.piece()
        self.start, self.held = None, []

    def piece(self) -> Iterator[dict]:
        if self.held:
            yield {"file": self.file, "at": self.start, "part": self.first, "raw": b"\n".join([*self.held, b""])}

    def rows(self) -> Iterator[dict]:
        if self.start is not None and self.end is not None and self.here >= self.end:
            yield from self.done()
        else:
            yield from self.piece()


def _record_batches(rows: list[dict], schema: str) -> pa.RecordBatch:
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in names], [n for n, _ in names])


def _batched(rows: Iterator[dict], schema: str) -> Iterator[pa.RecordBatch]:
    """Batches of some MB."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 256 + len(r.get("payload") or b"") + len(r.get("raw") or b"")
        if size > 4 << 20:
            yield _record_batches(held, schema)
            held, size = [], 0
    if held:
        yield _record_batches(held, schema)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        now, key = None, None
        for batch in batches:
            for run in _runs(batch):
                own = tuple(run.column(c)[0].as_py() for c in ("file", "block"))
                if own != key:
                    if now:
                        yield from now.rows()
                    key, now = own, _Reader(own[0], tuple(run.column(c)[0].as_py() for c in ("base", "entry", "last", "carry", "carry_end")))
                for line in run.column("line"):
                    yield from now.take(line.as_py())
        if now:
            yield from now.rows()

    return _batched(rows(), _READ)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        for batch in batches:
            for file, at, raw in zip(*(batch.column(c) for c in ("file", "at", "raw")), strict=True):
                yield {"file": file.as_py(), "at": at.as_py()} | parsed(raw.as_py())

    return _batched(rows(), _READ)


def read(spark: SparkSession, path: str, of_payload: dict[str, Callable[[Column], Column]] | None = None, strict: bool = False, splits: int = SPLITS) -> DataFrame:
    """A row for every record of the archives in `path`: path, at (its offset), what its header says, and its payload, or of the payload what is asked for.

    own: the kept columns as JSON. digest: as the header has it, without the name of its algorithm. Revisits have no payload."""
    of_payload = of_payload or {"payload": lambda p: p}
    made = [f(F.col("payload")).alias(n) for n, f in of_payload.items()]
    fields = [x.split()[0] for x in RECORD.split(", ")]
    facts = written(_entries(spark, path, strict), "entries")
    lines = _lines(spark, path)
    if facts.count() <= splits:  # some 50 bytes for each split of files
        joined = lines.join(F.broadcast(facts), ["file", "block"])
    else:
        placed = lines.withColumn("seq", F.monotonically_increasing_id())
        joined = placed.join(facts.hint("shuffle_merge"), ["file", "block"]).sortWithinPartitions("file", "block", "seq")
    scan = joined.select("file", "block", "line", "base", "entry", "last", "carry", "carry_end").mapInArrow(_read, _READ)
    found = written(scan.select("file", "at", "part", *fields, *made, "raw"), "records")
    pieces = found.where("raw is not null").groupBy("file", "at").agg(F.array_sort(F.collect_list(F.struct("part", F.col("raw").cast("string").alias("raw")))).alias("p"))
    across = pieces.select("file", "at", F.array_join("p.raw", "").cast("binary").alias("raw")).mapInArrow(_whole, _READ).select("file", "at", *fields, *made)
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_path").alias("path"))
    out = found.where("raw is null").select("file", "at", *fields, *(F.col(n) for n in of_payload)).unionByName(across)
    return out.join(files, "file").drop("file")


def op11_warc(spark, sf_dir: str) -> DataFrame:
    """All pages as an archive, and what the archive says of each."""
    pages = table(spark, sf_dir, "pages")
    path = f"{shared_dir(spark)}/tables/warc-{uuid.uuid4().hex}"
    write(pages, path, "html", "page_id", "url", ("page_id",))
    return described(read(spark, path, {"n_bytes": F.octet_length, "sha1": F.sha1}), pages.schema["page_id"].dataType.simpleString())


def described(found: DataFrame, number: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of records read with n_bytes and sha1 of their payloads."""
    page = F.from_json("own", f"page_id {number}")["page_id"]
    found = written(found.select(page.alias("page_id"), "type", "record_id", "refers_to", F.coalesce("sha1", "digest").alias("digest"), F.col("n_bytes").cast("long").alias("n_bytes")), "described")
    held = found.where("type <> 'revisit'")
    named = held.groupBy("record_id").agg(F.max("n_bytes").alias("held_bytes"), F.max("page_id").alias("held_id"))
    again = found.where("type = 'revisit'").join(named.withColumnRenamed("record_id", "refers_to"), "refers_to", "left")
    first = held.select("page_id", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast(number).alias("refers_to"))
    return first.unionByName(again.select("page_id", F.col("held_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("held_id").alias("refers_to")))


OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS n, sha1(h) AS s FROM p),
f AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS top FROM d)
SELECT page_id, n AS payload_bytes, s AS payload_digest,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM f
"""
