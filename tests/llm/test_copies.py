"""Near-duplicates, repeated passages and neighbours against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import graph, lines, minhash, neighbours, repeats, sketch, vectors

# MinHash


def plain_classes(texts, least=0.8):
    sets = []
    for t in texts:
        w = re.findall(rb"[0-9a-zA-Z\x80-\xff]+", (t or "").lower().encode())
        sets.append(collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b:
                both = len(a.keys() & b.keys())
                low = sum((a & b).values())
                if max(both / (len(a) + len(b) - both), low / (sum(a.values()) + sum(b.values()) - low)) >= least:
                    x, y = top(i), top(j)
                    root[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(texts))]


def variants(seed=3):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    texts = []
    for n in (6, 12, 60, 60, 200, 200):
        base = [draw.choice(words) for _ in range(n)]
        for _ in range(draw.choice([1, 5, 25])):
            x = list(base)
            for _ in range(draw.randint(0, 5)):
                x[draw.randrange(n)] = draw.choice(words)
            texts.append(" ".join(x))
    passage = " ".join(draw.choice(words) for _ in range(60))
    texts += [passage + " " + " ".join(draw.choice(words) for _ in range(70)) for _ in range(30)]
    return texts


def test_classes_are_those_of_brute_force(spark):
    texts = [*variants(), None, "", "...", "one", "one", "a b c d", "A  b, c d!", "x " * 500, "x " * 450]
    texts += [texts[0], texts[0]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, doc string").select("doc_id", "text")
    told = {r["doc_id"]: r["class_id"] for r in minhash.classes(docs).collect()}
    assert [told[i] for i in range(len(texts))] == plain_classes(texts)


def test_plain_similarity_alone_links(spark):
    draw = random.Random(4)
    texts = []
    for _ in range(4):
        words = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(1004)]
        texts += [" ".join(words), " ".join(words + words[:24] * 100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    told = {r["doc_id"]: r["class_id"] for r in minhash.classes(docs).collect()}
    assert [told[i] for i in range(8)] == plain_classes(texts) == [0, 0, 2, 2, 4, 4, 6, 6]


def test_stage_keeps_one_of_each_class(spark):
    docs = spark.createDataFrame([(1, "some words that are here twice over", "en", "s", 9), (2, "some words that are here twice over", "en", "s", 9), (2, "some words that are here twice over", "en", "s", 9), (3, None, None, None, None), (4, "other", "en", "s", 5), (4, "other", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = minhash.stage(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]
    assert minhash.classes(docs.limit(0).select("doc_id", "text")).count() == 0


def test_rows_that_share_only_an_id_are_different_documents(spark):
    draw = random.Random(5)
    texts = [" ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(30)) for _ in range(6)]
    ids = [None, None, None, None, 7, 7, 7, 8, 9]
    rows = list(zip(ids, [texts[0], texts[1], texts[1], None, texts[2], texts[3], "", texts[3], texts[4]], strict=True))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    told = [tuple(r) for r in minhash.told(docs).select("row", "class_id", "kept").distinct().collect()]
    assert len({c for _, c, _ in told}) == 7 and sum(k for _, _, k in told) == 7
    kept = [(r["doc_id"], r["text"]) for r in minhash.stage(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([(None, texts[0]), (None, texts[1]), (None, None), (7, texts[2]), (7, texts[3]), (7, ""), (9, texts[4])], key=str)


def test_signatures_estimate_the_weighted_similarity():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 300, dtype=np.uint64), rng.integers(0, 2**63, 60, dtype=np.uint64)
    one = np.sort(np.concatenate([a, b[:30]]))
    two = np.sort(np.concatenate([a, b[30:]]))
    wa = {x: 1 + int(x % np.uint64(7)) for x in np.concatenate([a, b]).tolist() for x in [np.uint64(x)]}
    of = np.repeat([0, 1], [one.size, two.size])
    shingle = np.concatenate([one, two])
    weight = np.array([wa[x] for x in shingle])
    sig = minhash.signatures(of, shingle, weight, 2, 2000)
    both = sum(wa[x] for x in a)
    true = both / (both + sum(wa[x] for x in b))
    assert abs((sig[0] == sig[1]).mean() - true) < 0.05
    assert (sig != np.uint64(2**64 - 1)).all()


# repeated passages


def plain_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    n = collections.Counter(r[s : s + length] for r in raws for s in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for s in range(len(r) - length + 1):
            if n[r[s : s + length]] > 1:
                gone[s : s + length] = True
        out.append((len(r), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), np.frombuffer(r, np.uint8)[~gone].tobytes()))
    return out


def told_repeats(docs, **how):
    out = repeats.Repeats(docs, **how).removed(docs)
    return {r["doc_id"]: (r["n_bytes"], sum(s["stop"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])) for r in out.collect()}


@pytest.mark.parametrize("how", [{}, {"group": 2}, {"length": 60, "gram": 20}, {"length": 60, "gram": 20, "group": 3}])
def test_repeats_are_those_of_brute_force(spark, how):
    draw = random.Random(7)
    base = ["".join(draw.choice("ab c\né") for _ in range(draw.randint(300, 900))) for _ in range(5)]
    texts = []
    for _ in range(70):
        t = ""
        for _ in range(draw.randint(0, 4)):
            x = draw.choice(base)
            a = draw.randint(0, len(x))
            t += x[a : draw.randint(a, len(x))] + draw.choice(["", "", "x", "yé"])
        texts.append(t)
    texts += [None, "", "a" * 399, "a" * 400, "b" * 1500, "c" * 401, texts[3], texts[3]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    told = told_repeats(docs, **how)
    assert [told[i] for i in range(len(texts))] == plain_repeats(texts, how.get("length", 400))


def test_long_texts_are_read_in_pieces(monkeypatch):
    draw = random.Random(8)
    text = "".join(draw.choice("ab c") for _ in range(30000))

    def anchors():
        out = []
        for _, offsets, piece in repeats.pieces([text], 400):
            part, place, lo, hi, gram, context = piece.anchors(400, 64)
            shift = np.asarray(offsets)[part] - np.append(0, piece.ends)[part]
            for a, l, h in zip((place + shift).tolist(), (lo + shift).tolist(), (hi + shift).tolist(), strict=True):
                out += [(a, s) for s in range(l, h + 1)]
        return out

    whole = anchors()
    monkeypatch.setattr(repeats, "CHUNK", 1000)
    assert sorted(anchors()) == sorted(whole) and len({s for _, s in whole}) == len(text) - 399


def test_an_edit_near_the_cut_of_a_long_text_costs_no_more(spark):
    draw = random.Random(12)
    cut, rows = repeats.CHUNK, []
    for k, at in enumerate((cut - 1, cut + 399, cut - 1, cut + 399)):
        t = "".join(draw.choices("abcdefgh ", k=cut + 3000))
        rows += [(2 * k, t), (2 * k + 1, t[:at] + "X" + t[at + 1 :])]
    told = told_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [told[i][1:3] for i in range(len(rows))] == [(cut + 2999, 2)] * len(rows)


def test_repeats_of_repeated_rows_and_nothing(spark):
    t = "".join(random.Random(9).choices("abcdef ", k=700))
    docs = spark.createDataFrame([(1, t), (1, t), (2, "short")], "doc_id long, text string")
    told = told_repeats(docs)
    assert told[1][1] == 700 and told[2][1] == 0
    assert told_repeats(docs.limit(0)) == {}


def test_intervals_of_a_suffix_array():
    assert sorted(repeats.intervals(np.array([3, 1, 2]))) == [(1, 0, 3), (2, 2, 3), (3, 0, 1)]


def test_twice_seen_misses_nothing(spark):
    rows = spark.range(4000).selectExpr("id % 3000 as x").repartition(5)
    n = sketch.blocks_for(3000)

    def hashes(batch):
        yield repeats.mixed(batch.column("x").to_numpy().astype(np.uint64))

    bits = np.frombuffer(sketch.twice_seen(rows, hashes, n), np.uint8)
    hit = sketch.test(bits, repeats.mixed(np.arange(3000, dtype=np.uint64)), n)
    assert hit[:1000].all() and hit[1000:].mean() < 0.05


def test_hashes_that_need_a_larger_filter_are_counted(spark, monkeypatch):
    """With BITS at a fraction of the need results stay the same, and so does what is suspected."""
    rng = random.Random(3)
    line = lambda: "".join(rng.choices("abcdefgh ", k=40)) + "x" * 5
    common = [line() for _ in range(5)]
    rows = [(i, "\n".join([line() for _ in range(30)] + common[: i % 6])) for i in range(200)] + [(7, None), (None, "\n".join(common))]
    df = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string").repartition(3)
    asked = {}
    for bits in (sketch.BITS, sketch.BLOCK_BITS // 60):
        monkeypatch.setattr(sketch, "BITS", bits)
        data = df.select(lines.row_id().alias("row"), "doc_id", "text")
        told = sketch.suspected(data, lines.hashes_of(20), 6600)
        assert (told.shared is None) == (bits < sketch.BLOCK_BITS)
        keys = lines.suspects(told.told(data.withColumn("doc", F.col("doc_id"))), 20, told)
        dropped = lines.drop_lines(df).select("doc_id", "text", "__n_dropped").collect()
        found = repeats.Repeats(df, length=60, gram=20).removed(df).select("doc_id", "n_bytes", "kept").collect()
        sifted = sketch.sifted(data.select("row"), data.select("row").limit(9), "row")
        asked[bits] = keys.count(), sorted(map(str, dropped)), sorted(map(str, found))
        assert sifted.count() >= 9
    few, many = asked.values()
    assert few[1:] == many[1:] and many[0] <= few[0] <= 1.1 * many[0]


# vectors


def plain_links(rows, least=0.9):
    def ok(v):
        return v is not None and len(v) and all(z is not None and np.isfinite(z) for z in v) and any(v)

    near = collections.defaultdict(set)
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows):
            if i != j and ok(a) and ok(b) and len(a) == len(b):
                x, y = np.array(a), np.array(b)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= least:
                    near[i].add(j)
    out = {}
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        out[rows[i][0]] = (len(near[i]), min(rows[k][0] for k in seen))
    return out


def some_vectors():
    rng = np.random.default_rng(0)
    base = rng.standard_normal((40, 8))
    x = np.concatenate([base, base[:20] + 0.25 * rng.standard_normal((20, 8)), base[:10] * 3, np.repeat(base[:1], 5, 0)])
    odd = [None, [0.0] * 8, [float("nan")] + [1.0] * 7, [1.0, 2.0], [1.0, 2.0], [], [None] + [1.0] * 7, [float("inf")] + [1.0] * 7]
    return [(i, [float(z) for z in v]) for i, v in enumerate(x)] + [(200 + i, v) for i, v in enumerate(odd)]


@pytest.mark.parametrize("how", [{}, {"tile": 7}, {"blocks": 1}, {"blocks": 8, "tile": 20}])
def test_links_are_those_of_brute_force(spark, how):
    rows = some_vectors()
    df = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<double>, node int")
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df, **how).collect()} == plain_links(rows)


def test_nothing_links_with_nothing(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert vectors.near_duplicates(df.limit(0)).count() == 0
    assert [tuple(r) for r in vectors.near_duplicates(df).collect()] == [(1, 0, 1)]


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 3), (10, 11), (11, 12), (20, 20)] + [(100 + i, 101 + i) for i in range(40)]
    told = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert told == {1: 1, 2: 1, 3: 1, 9: 1, 10: 10, 11: 10, 12: 10} | {100 + i: 100 for i in range(41)}


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 16))
    x[500:520] = x[0]
    rows = [(i, [float(z) for z in v]) for i, v in enumerate(x)] + [(1000, None), (1100, [0.0] * 16), (1200, [float("nan")] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    told = collections.defaultdict(list)
    for r in neighbours.search(df, F.col("vec_id") % 100 == 0).collect():
        told[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(told) == list(range(0, 900, 100))
    hits = 0
    for q, found in told.items():
        far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        true = [i for i in np.lexsort((np.arange(900), far)) if i != q][:10]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and all(abs(far[i] - s) < 1e-12 for _, i, s in found)
        hits += len({i for _, i, _ in found} & set(true))
    assert hits / 90 >= 0.9
    assert [i for _, i, _ in told[0]] == list(range(500, 510))


def test_few_and_no_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["vec_id"]) for r in neighbours.search(df, F.col("vec_id") == 0).collect()] == [(0, 1)]
    assert neighbours.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_digest_of_op10_is_that_of_the_kept_bytes(spark, tmp_path):
    t = "".join(random.Random(9).choices("abcdef ", k=700))
    spark.createDataFrame([(1, t), (2, "x" + t[:500]), (3, "own")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    told = {r["doc_id"]: r for r in repeats.op10_repeated_passages(spark, str(tmp_path)).collect()}
    assert told[1]["n_removed"] == 500 and told[1]["kept_sha256"] == hashlib.sha256(t[500:].encode()).hexdigest() and told[2]["n_removed"] == 500
