"""Language identification by multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, every character that is no letter becomes a space, and all n-grams of 1 to 3
characters are hashed to 2**16 buckets. The model is a matrix of log-probabilities (language x bucket),
fitted from counts and broadcast; batches are scored sparsely in numpy: one look-up per n-gram and a
segmented sum per document.

Cases: a null, empty or letterless text is `und` with score 0. Rows with a null language teach
nothing; an empty one is a language like others. With nothing to learn from, every text is `und`. Repeated rows are scored each by itself; equal
posteriors go to the language that sorts first. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import apart, broadcast, passed, table

UNKNOWN = "und"
#: Rows scored at a time.
ROWS = 512
SIZES = (1, 2, 3)
BUCKETS = 1 << 16
#: Characters hashed at a time; bounds the memory of a task whatever the length of a text.
CHUNK = 1 << 19
#: Bytes of the model at most: with very many languages there are fewer buckets instead.
MODEL_BYTES = 128 << 20
#: Documents of each language to learn from, about; the sample is drawn by a hash of doc_id.
TRAIN_DOCS = 3000

_letter: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _letter
    if _letter is None:
        _letter = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)
    return _letter


def buckets_for(n_langs: int) -> int:
    """As many buckets as MODEL_BYTES allow, a power of two."""
    size = BUCKETS
    while size > 256 and size * n_langs * 8 > MODEL_BYTES:
        size //= 2
    return size


def pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """Groups of about CHUNK characters: row, piece of text, and how many leading characters only give context."""
    rows, parts, context, size = [], [], [], 0
    for row, text in enumerate(texts):
        text = (text or "").lower()
        for start in range(0, len(text), CHUNK):
            back = min(start, max(SIZES) - 1)
            rows.append(row)
            parts.append(text[start - back : start + CHUNK])
            context.append(back)
            size += len(parts[-1])
            if size >= CHUNK:
                yield rows, parts, context
                rows, parts, context, size = [], [], [], 0
    if rows:
        yield rows, parts, context


def hashed(parts: list[str], context: list[int], n_buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the piece and the bucket of every n-gram that has a letter in it; n-grams do not leave their piece."""
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    piece = np.repeat(np.arange(len(parts), dtype=np.int32), lengths)
    into = np.arange(codes.size) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    is_letter = letters()[codes]
    codes = np.where(is_letter, codes, np.uint32(32))
    least = np.repeat(np.asarray(context, np.int64), lengths)
    gram, any_letter = np.zeros(codes.size, np.uint32), np.zeros(codes.size, bool)
    for n in SIZES:
        # an n-gram is named by its last character: the one before it, shifted, and that character
        gram[n - 1 :] = gram[n - 1 :] * np.uint32(0x9E3779B1) + codes[: codes.size - n + 1] + np.uint32(n)
        any_letter[n - 1 :] |= is_letter[: codes.size - n + 1]
        mixed = gram ^ (gram >> np.uint32(15))
        mixed *= np.uint32(0x85EBCA6B)
        mixed ^= mixed >> np.uint32(13)
        keep = any_letter & (into >= np.maximum(least, n - 1))
        yield piece[keep], (mixed[keep] & np.uint32(n_buckets - 1)).astype(np.int64)


def fit(train: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_docs: int = TRAIN_DOCS, alpha: float = 0.5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, log prior of each, and the matrix of log-probabilities (language x bucket).

    max_docs bounds the documents of each language that are learned from: a language with more is sampled by
    a hash of its key. Priors come from all rows. What reaches the driver is bounded by languages x buckets.
    """
    rows = train.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).cast("string").alias("key")).where("lang is not null and text is not null")
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        return [], np.zeros(0), np.zeros((0, BUCKETS))
    n_buckets, at = buckets_for(len(langs)), {x: i for i, x in enumerate(langs)}
    share = rows.sparkSession.createDataFrame([(x, min(1.0, max_docs / totals[x])) for x in langs], "lang string, share double")
    drawn = F.pmod(F.xxhash64(F.coalesce("key", F.lit(""))), F.lit(1 << 30)) < F.col("share") * float(1 << 30)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(at) * n_buckets, np.int64)
        for batch in batches:
            of = np.fromiter((at[x] for x in batch.column("lang").to_pylist()), np.int64, batch.num_rows)
            for i, parts, context in pieces(batch.column("text").to_pylist()):
                for piece, bucket in hashed(parts, context, n_buckets):
                    total += np.bincount(of[np.asarray(i)[piece]] * n_buckets + bucket, minlength=total.size)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], ["cell", "n"])

    cells = rows.join(F.broadcast(share), "lang").where(drawn).select("lang", "text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(langs) * n_buckets)
    counts[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy()
    counts = counts.reshape(len(langs), n_buckets) + alpha
    prior = np.array([totals[x] for x in langs], float)
    return langs, np.log(prior / prior.sum()), np.log(counts / counts.sum(axis=1, keepdims=True))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of each row with lang_pred and score, the posterior probability of that language."""
    shared = broadcast(docs.sparkSession, model)
    source, name, schema = passed(docs, text, keep)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prior, logp = shared.value
        for batch in (b.slice(start, ROWS) for b in batches for start in range(0, b.num_rows, ROWS)):
            n = batch.num_rows
            total, seen = np.zeros((len(langs), n)), np.zeros(n, bool)
            for i, parts, context in pieces(batch.column(name).to_pylist()) if langs else ():
                row = np.asarray(i)
                for piece, bucket in hashed(parts, context, logp.shape[1]):
                    if not piece.size:
                        continue
                    first = np.flatnonzero(np.diff(piece, prepend=-1))
                    into = row[piece[first]]
                    seen[into] = True
                    for k in range(len(langs)):
                        np.add.at(total[k], into, np.add.reduceat(logp[k][bucket], first))
            pred, sure = np.full(n, UNKNOWN, object), np.zeros(n)
            if langs:
                total += prior[:, None]
                best = total.argmax(axis=0)
                post = 1 / np.exp(total - total.max(axis=0)).sum(axis=0)
                pred[seen], sure[seen] = np.array(langs, object)[best[seen]], post[seen]
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(pred, pa.string()), pa.array(sure)], [*keep, "lang_pred", "score"])

    return source.mapInArrow(score, f"{schema}, lang_pred string, score double")


def held_out(key: str = "doc_id") -> F.Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 5, is 0. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def stage(spark, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Drops documents of no language: no letter at all, or a best language that is less likely than not. Further columns may have any names."""
    docs, back = apart(docs)
    model = fit(docs.where(~held_out()))
    told = identify(docs, model, keep=tuple(docs.columns))
    return told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*back(told))
