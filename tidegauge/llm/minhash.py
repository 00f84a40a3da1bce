"""Near-duplicate documents by DartMinHash signatures and banded joining.

A document is the weighted set of its shingles of WORDS words, lower-cased; the weight is how often each occurs.

Signatures. Darts are thrown at the plane of weight and rank, the same ones for a shingle in whatever document: the
plane is cut into cells, and a hash of shingle and cell says how many darts lie in it and where. A document is hit by
the darts within its shingles' weights, and looks only at ranks up to a bound that leaves it about t darts, however
large it is. A dart's hash names a coordinate, and each coordinate keeps its earliest dart. Two documents agree in
a coordinate with the probability of their weighted Jaccard similarity. A document with a coordinate that no dart
has hit looks at twice the ranks. With all weights 1 the same darts give the plain similarity: a document that has
a shingle more than once is signed both ways.

Joining. BANDS bands of ROWS coordinates each are hashed to buckets. Documents with equal weighted sets are one from
here on. In a bucket of FEW members at most each is compared with each. In a larger one the member with the most
company is compared with the others, which a shuffle deals in parts of PART. Pairs are verified by their whole
shingle sets, and links make components. In a larger bucket that then has several components, the members outside of
its largest are compared with all, part by part; a task finds common shingles with an index and returns one link to
each component. So no link between members of a bucket is lost, and no task or table holds a large bucket's pairs.

Documents link when the weighted or the plain Jaccard similarity of their shingles is LEAST or more. A pair at 0.8
of either shares a bucket with probability 0.9998.

Cases: a null or empty text, or one without a word, is a class of its own. A text of fewer words than a shingle is
one shingle. Rows with equal text are one class; so are all rows that share a doc_id and a text. A row is its doc_id and
text: rows that share only a doc_id are different documents. A class is named by its least doc_id, and by the row that
stands for it where several classes have the same one. A null doc_id counts as the smallest number. Further columns of
the input play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .base import apart, doc_number, table, written
from .graph import components
from .lines import row_id
from .repeats import Piece, mixed

WORDS = 5
LEAST = 0.8
BANDS, ROWS = 28, 6
#: Members of a bucket that are all compared with each other.
FEW = 8
#: Members of one bucket that a task compares with a pivot.
PART = 200
#: Members outside of their bucket's largest component that a task compares with such a part.
STRAYS = 100
#: Bytes of text handled at a time.
CHUNK = 1 << 19

#: Ranks are cut at 2**-10, 2**-9, ... 16, and every 16 from there.
LOW, HIGH = -10, 4


def is_word() -> np.ndarray:
    """For each byte whether it belongs to a word: letters and digits, and all bytes of other scripts."""
    byte = np.zeros(256, bool)
    byte[128:] = True
    for low, high in ("09", "az", "AZ"):
        byte[ord(low) : ord(high) + 1] = True
    return byte


def shingled(texts: list[str | None], words: int = WORDS) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, and of each distinct shingle in them: place in that list, hash, weight; ordered by place and hash.

    A text is never split here: what a shingle set is made of must be seen whole."""
    rows: list[int] = []
    parts: list[bytes] = []
    size = 0
    for row, text in enumerate(texts):
        if text:
            rows.append(row)
            parts.append(text.lower().encode("utf-8", "surrogatepass") + b" ")
            size += len(parts[-1])
        if rows and (size >= CHUNK or row + 1 == len(texts)):
            yield rows, *_shingles(parts, words)
            rows, parts, size = [], [], 0


def _shingles(parts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    piece = Piece(parts)
    inside = np.append(is_word()[np.frombuffer(piece.raw, np.uint8)], False)
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
    start, stop = edge[::2], edge[1::2]
    of = np.searchsorted(piece.ends, start, side="right")
    word = piece.hashes(start, stop)
    n = np.bincount(of, minlength=len(parts))
    first = np.repeat(np.cumsum(n) - n, n)
    left = np.repeat(n, n) - (np.arange(of.size) - first)  # words from here to the end of the text
    sum_, factor = np.zeros(of.size, np.uint64), 1
    for k in range(words):
        ahead = np.zeros(of.size, np.uint64)
        ahead[: max(0, of.size - k)] = word[k:]
        sum_ += np.where(left > k, ahead, np.uint64(0)) * np.uint64(factor)
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
    whole = (left >= words) | (np.arange(of.size) == first)
    of, shingle = of[whole], mixed(sum_[whole])
    order = np.lexsort((shingle, of))
    of, shingle = of[order], shingle[order]
    new = np.flatnonzero(np.append(True, (np.diff(of) != 0) | (shingle[1:] != shingle[:-1]))) if of.size else np.zeros(0, np.int64)
    return of[new], shingle[new], np.diff(np.append(new, of.size))


def _hash(x: np.ndarray, *salts: int) -> np.ndarray:
    for s in salts:
        x = mixed((x ^ np.uint64(s & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93))
    return x


@cache
def _poisson(area: float) -> np.ndarray:
    """The distribution function of how many darts lie in a cell of that area."""
    k = np.arange(1, int(area + 12 * area**0.5 + 24))
    return np.exp(np.concatenate([[0.0], np.cumsum(np.log(area) - np.log(k))]) - area).cumsum()


def signatures(of: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, coordinates: int) -> np.ndarray:
    """For each of n documents its earliest dart at each coordinate: rank (high half) and name (low half) of the dart."""
    darts = coordinates * (np.log(coordinates) + 2)
    total = np.bincount(of, weight, n)
    bound = np.divide(darts, total, out=np.zeros(n), where=total > 0)
    sig = np.full(n * coordinates, np.uint64(0xFFFFFFFFFFFFFFFF))
    open_ = total > 0
    while open_.any():
        use = open_[of]
        _throw(of[use], shingle[use], weight[use], bound, coordinates, sig)
        open_ &= (sig.reshape(n, coordinates) == np.uint64(0xFFFFFFFFFFFFFFFF)).any(axis=1)
        bound = np.where(open_, 2 * bound, bound)
    return sig.reshape(n, coordinates)


def _throw(of: np.ndarray, shingle: np.ndarray, weight: np.ndarray, bound: np.ndarray, coordinates: int, sig: np.ndarray) -> None:
    most = bound[of]
    low = 0
    while low < weight.max(initial=0):  # weights from low to low + width
        width = max(1, low)
        tall = weight > low
        f, s, w, m = of[tall], shingle[tall], weight[tall], most[tall]
        cell, begin, end = 0, 0.0, 2.0**LOW
        while f.size:
            u = (_hash(s, low + 1, cell) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            count = np.searchsorted(_poisson(width * (end - begin)), u, side="right")
            hit = np.flatnonzero(count)
            which = np.repeat(hit, count[hit])
            turn = np.arange(which.size) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit])
            dart = _hash(s[which] + turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), low + 1, ~cell)
            rank = begin + (end - begin) * ((dart >> np.uint64(40)).astype(np.float64) + 0.5) * 2.0**-24
            height = low + width * ((dart & np.uint64(0xFFFFFF)).astype(np.float64) + 0.5) * 2.0**-24
            in_ = (rank <= m[which]) & (height < w[which])
            name = _hash(dart[in_], 77)
            at = f[which[in_]] * coordinates + ((name >> np.uint64(32)) % np.uint64(coordinates)).astype(np.int64)
            np.minimum.at(sig, at, rank[in_].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | name & np.uint64(0xFFFFFFFF))
            cell, begin = cell + 1, end
            end = 2 * end if end < 2.0**HIGH else end + 2.0**HIGH
            wide = m > begin
            if not wide.all():
                f, s, w, m = f[wide], s[wide], w[wide], m[wide]
        low = low + width


def signed(rows: DataFrame, words: int, bands: int, per_band: int) -> DataFrame:
    """row, doc, two hashes of the whole weighted set, its size, and the buckets of its bands, weighted and plain, for every text with a word."""

    def banded(of: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        sig = signatures(of, shingle, weight, n, bands * per_band).reshape(n, bands, per_band)
        power = np.cumprod(np.full(per_band, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
        return mixed((sig * power).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                sub = batch.slice(start, 512)
                for which, of, shingle, weight in shingled(sub.column("text").to_pylist(), words):
                    n = len(which)
                    bucket = banded(of, shingle, weight, n)
                    differs = np.bincount(of[weight > 1], minlength=n) > 0
                    use = differs[of]
                    plain = banded((np.cumsum(differs) - 1)[of[use]], shingle[use], np.ones(int(use.sum()), weight.dtype), int(differs.sum()))
                    both, new = np.zeros((n, 2 * bands), np.uint64), np.zeros((n, 2 * bands), bool)
                    both[:, :bands], new[:, :bands] = bucket, True
                    both[differs, bands:], new[differs, bands:] = plain, plain != bucket[differs]
                    wholes = []
                    for salt in (1, 2):
                        whole = np.zeros(n, np.uint64)
                        np.add.at(whole, of, _hash(shingle, salt) * weight.astype(np.uint64))
                        wholes.append(whole.view(np.int64))
                    size = np.bincount(of, weight, n).astype(np.int64)
                    some = np.flatnonzero(size)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(new[some].sum(axis=1))).astype(np.int32)), pa.array(both[some][new[some]].view(np.int64)))
                    mine = pa.array(np.asarray(which, np.int64)[some])
                    yield pa.RecordBatch.from_arrays([sub.column("row").take(mine), sub.column("doc").take(mine), pa.array(wholes[0][some]), pa.array(wholes[1][some]), pa.array(size[some]), lists], ["row", "doc", "whole", "whole2", "size", "buckets"])

    return rows.mapInArrow(run, "row long, doc long, whole long, whole2 long, size long, buckets array<long>")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of plain and weighted Jaccard similarity of two sets of (sorted shingles, weights)."""
    at = np.minimum(np.searchsorted(b[0], a[0]), max(0, b[0].size - 1))
    both = b[0][at] == a[0] if b[0].size else np.zeros(a[0].size, bool)
    plain = int(both.sum())
    least = np.minimum(a[1][both], b[1][at[both]]).sum()
    return max(plain / max(1, a[0].size + b[0].size - plain), least / max(1, a[1].sum() + b[1].sum() - least))


def verified(pairs: DataFrame, texts: DataFrame, words: int, least: float, part: int = PART) -> DataFrame:
    """Those pairs (doc, pivot) whose texts are similar. A pivot's text goes once to each part of its partners."""
    n = written(pairs.groupBy("pivot").agg(F.count("*").alias("n")).select("pivot", F.ceil(F.col("n") / part).cast("int").alias("parts")), "pivots")
    texts_of_docs = pairs.join(n, "pivot").withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")).join(texts, "doc").select("pivot", "part", "doc", "text")
    texts_of_pivots = n.join(texts.withColumnRenamed("doc", "pivot"), "pivot").select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("pivot").alias("doc"), "text")

    def compare(group: pa.Table) -> pa.Table:
        pivot, docs = group.column("pivot")[0].as_py(), group.column("doc").to_pylist()
        sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for which, of, shingle, weight in shingled(group.column("text").to_pylist(), words):
            edges = np.searchsorted(of, np.arange(len(which) + 1))
            for k, row in enumerate(which):
                sets[docs[row]] = shingle[edges[k] : edges[k + 1]], weight[edges[k] : edges[k + 1]]
        alike = [d for d in sets if d != pivot and pivot in sets and similarity(sets[d], sets[pivot]) >= least]
        return pa.table({"u": pa.array(alike, pa.int64()), "v": pa.array([pivot] * len(alike), pa.int64())})

    return texts_of_docs.unionAll(texts_of_pivots).groupBy("pivot", "part").applyInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, least: float = LEAST, bands: int = BANDS, per_band: int = ROWS) -> DataFrame:
    """row (see row_id), and class_doc and class_row, the least doc (see doc_number) of its class and that one's row, for every text with a word; a row for each row."""
    rows = docs.select(row_id(text, key).alias("row"), doc_number(key).alias("doc"), F.col(text).alias("text"))
    marked = written(signed(rows, words, bands, per_band), "signed")
    same = ["whole", "whole2", "size"]
    kinds = marked.groupBy(*same).agg(F.min(F.struct("doc", "row")).alias("least"), F.first("buckets").alias("buckets"))
    kinds = written(kinds.select(*same, "least", F.col("least.row").alias("doc"), "buckets"), "kinds")  # from here on a row stands for its kind as `doc`
    entries = kinds.select("doc", F.posexplode("buckets").alias("band", "bucket"))
    crowds = written(entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "crowds")
    members = written(entries.join(crowds, "bucket"), "members")
    company = written(members.groupBy("doc").agg(F.sum("n").alias("company")), "company")
    members = written(members.join(company, "doc").select("bucket", "band", "doc", "company", "n"), "members")
    texts = written(company.select("doc").join(sketch.sifted(rows.select(F.col("row").alias("doc"), "text"), company, "doc").dropDuplicates(["doc"]), "doc"), "texts")
    mine = members.withColumn("component", F.col("doc"))
    pairs = written(_small(mine.where(F.col("n") <= FEW)).unionAll(_pivots(mine.where(F.col("n") > FEW))).select("doc", F.col("with.doc").alias("pivot")).where("doc <> pivot").distinct(), "pairs")
    links = written(verified(pairs, texts, words, least), "links")
    labels = components(links)
    large = members.where(F.col("n") > FEW).select("bucket", "doc").join(labels, F.col("doc") == F.col("node"), "left").select("bucket", "doc", F.coalesce("component", "doc").alias("component"))
    apart = written(_blocks(written(large, "large"), texts, words, least), "links")
    if not apart.isEmpty():
        labels = components(links.unionAll(apart))
    kinds = written(kinds.join(labels, F.col("doc") == F.col("node"), "left").select(*same, "least", F.coalesce("component", "doc").alias("component")), "classes")
    stands = written(kinds.groupBy("component").agg(F.min("least").alias("stands")), "stands")
    kinds = kinds.join(stands, "component").select(*same, F.col("stands.doc").alias("class_doc"), F.col("stands.row").alias("class_row"))
    return marked.select("row", *same).join(written(kinds, "classes"), same).select("row", "class_doc", "class_row")


def _small(members: DataFrame) -> DataFrame:
    """Every member of a bucket of FEW at most with each smaller one."""
    mates = members.groupBy("bucket").agg(F.collect_list(F.struct("doc", "component")).alias("mates"))
    return members.join(mates, "bucket").select("doc", "component", F.explode("mates").alias("with")).where("with.doc < doc")


def _pivots(members: DataFrame) -> DataFrame:
    """Every member of a bucket with the one that has the most company."""
    top = members.groupBy("bucket").agg(F.max(F.struct("company", F.bitwise_not("doc").alias("minus"), "component")).alias("top"))
    return members.join(top, "bucket").select("doc", "component", F.struct(F.bitwise_not("top.minus").alias("doc"), F.col("top.component").alias("component")).alias("with"))


def _blocks(members: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """Links (u, v) of those that are not in the largest component of their bucket to members of other components.

    Both sides are dealt in parts, and a task takes a part of each: STRAYS of the former and PART of all. It counts
    common shingles with an index from shingles to members, and returns one link to each component, not every pair."""
    counts = members.groupBy("bucket", "component").agg(F.count("*").alias("k"))
    facts = counts.groupBy("bucket").agg(F.sum("k").alias("n"), F.max(F.struct("k", "component")).alias("top")).where("top.k < n")
    facts = written(facts.select("bucket", F.col("top.component").alias("main"), F.ceil((F.col("n") - F.col("top.k")) / STRAYS).cast("int").alias("is"), F.ceil(F.col("n") / PART).cast("int").alias("js")), "facts")
    rows = members.join(facts, "bucket")
    turn = F.xxhash64("doc", "bucket")
    strays = rows.where("component <> main").select("bucket", F.pmod(turn, F.col("is")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("js") - 1)).alias("j"), F.lit(True).alias("stray"), "doc", "component")
    others = rows.select("bucket", F.explode(F.sequence(F.lit(0), F.col("is") - 1)).alias("i"), F.pmod(turn, F.col("js")).cast("int").alias("j"), F.lit(False).alias("stray"), "doc", "component")

    def meet(group: pa.Table) -> pa.Table:
        doc, part, stray = (group.column(c).to_pylist() for c in ("doc", "component", "stray"))
        sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for which, of, shingle, weight in shingled(group.column("text").to_pylist(), words):
            edges = np.searchsorted(of, np.arange(len(which) + 1))
            for k, row in enumerate(which):
                sets[row] = shingle[edges[k] : edges[k + 1]], weight[edges[k] : edges[k + 1]]
        those = [r for r in sets if not stray[r]]
        out: list[tuple[int, int]] = []
        if those:
            every = np.concatenate([sets[r][0] for r in those])
            owner = np.repeat(np.arange(len(those)), [sets[r][0].size for r in those])
            heavy = np.concatenate([sets[r][1] for r in those])
            order = np.argsort(every, kind="stable")
            every, owner, heavy = every[order], owner[order], heavy[order]
            size, mass = np.array([sets[r][0].size for r in those]), np.array([sets[r][1].sum() for r in those])
            for r in (r for r in sets if stray[r]):
                x, w = sets[r]
                a, b = np.searchsorted(every, x), np.searchsorted(every, x, side="right")
                n = b - a
                at = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                both = np.bincount(owner[at], minlength=len(those))
                low = np.bincount(owner[at], np.minimum(heavy[at], np.repeat(w, n)), len(those))
                near = np.maximum(both / (size + x.size - both), low / (mass + w.sum() - low)) >= least
                out += {part[those[k]]: (doc[r], doc[those[k]]) for k in np.flatnonzero(near) if part[those[k]] != part[r]}.values()
        return pa.table({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})

    return strays.unionAll(others).join(texts, "doc").groupBy("bucket", "i", "j").applyInArrow(meet, "u long, v long")


def told(docs: DataFrame, **how) -> DataFrame:
    """doc_id, row, class_id and kept (whether it stands for its class) of every row; a text without a word is its own class."""
    found = written(near_duplicates(docs, **how).distinct(), "told")
    joined = docs.select("doc_id", doc_number("doc_id").alias("doc"), row_id().alias("row")).join(found, "row", "left")
    joined = written(joined.select("doc_id", "row", F.coalesce("class_doc", "doc").alias("class_doc"), F.coalesce("class_row", "row").alias("class_row")), "joined")
    shared = written(joined.groupBy("class_doc").agg(F.min("class_row").alias("a"), F.max("class_row").alias("b")).where("a <> b").select("class_doc", F.lit(True).alias("shared")), "shared")
    named = joined.join(shared, "class_doc", "left") if not shared.isEmpty() else joined.withColumn("shared", F.lit(None).cast("boolean"))
    return named.select("doc_id", "row", F.when(F.col("shared"), F.col("class_row")).otherwise(F.col("class_doc")).alias("class_id"), (F.col("row") == F.col("class_row")).alias("kept"))


def classes(docs: DataFrame, **how) -> DataFrame:
    """doc_id and class_id of every row, and whether it is kept."""
    return told(docs, **how).select("doc_id", "class_id", "kept")


def op3_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of every class, once."""
    docs, back = apart(docs)
    kept = written(told(docs.select("doc_id", "text")).where("kept").select("row"), "kept")
    ids = kept.distinct()
    out = docs.withColumn("__row", row_id()).join(ids.withColumnRenamed("row", "__row"), "__row", "left_semi")
    if kept.count() > ids.count():  # rows that share a doc_id and a text
        out = out.dropDuplicates(["__row"])
    return out.select(*back(out))


#: Links of all pairs that share a shingle, compared exactly, and what they reach.
OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM w WHERE len(w) > 0
), c AS (
  SELECT doc_id, sh, count(*) AS n FROM s GROUP BY doc_id, sh
), z AS (
  SELECT doc_id, count(*) AS plain, sum(n) AS heavy FROM c GROUP BY doc_id
), l AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM c a JOIN c b ON a.sh = b.sh AND a.doc_id <> b.doc_id JOIN z x ON x.doc_id = a.doc_id JOIN z y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.plain, x.heavy, y.plain, y.heavy
  HAVING greatest(count(*) / (x.plain + y.plain - count(*)), sum(least(a.n, b.n)) / (x.heavy + y.heavy - sum(least(a.n, b.n)))) >= 0.8
), r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.v FROM r JOIN l ON r.other = l.u
)
SELECT doc_id, min(other) AS class_id, doc_id = min(other) AS kept FROM r GROUP BY doc_id"""
