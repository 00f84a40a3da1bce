"""Mixing against a plain simulation of the queues."""

import hashlib
import random

from tidegauge.llm import mixing


def plain(rows, most=3, share=1.0):
    """target by the contract (shares by weight, capped and reshared), and taken by serving the queues piece by piece."""
    size = {}
    for _, n, s in rows:
        size[s] = size.get(s, 0) + (n or 0)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    budget = round(sum(size.values()) * share)
    target, open_, left = {}, set(order), budget
    while True:
        rate = sum(weight[s] for s in open_)
        over = {s for s in open_ if rate and left * weight[s] / rate > most * size[s]}
        if not over:
            break
        for s in over:
            target[s] = most * size[s]
        left, open_ = left - sum(target[s] for s in over), open_ - over
    target |= {s: left * weight[s] / rate if rate else 0 for s in open_}
    waiting = []
    for s in order:
        own = sorted((r for r in rows if r[2] == s and r[1]), key=lambda r: hashlib.md5(f"{r[0]} {' '.join(['w'] * r[1])}".encode()).hexdigest())
        at = 0
        for i, n, _ in own * most:
            for k in range(0, n, mixing.PIECE):
                at += min(mixing.PIECE, n - k)
                waiting.append((at / weight[s], (s is not None, s or ""), i, min(mixing.PIECE, n - k)))
    out = {}
    for _, _, i, n in sorted(waiting, key=lambda w: w[:2]):
        take = min(n, budget)
        out[i], budget = out.get(i, 0) + take, budget - take
    return target, out


def frame(spark, rows):
    return spark.createDataFrame([(i, " ".join(["w"] * n) if n is not None else None, s, 5, "t") for i, n, s in rows], "doc_id long, text string, source string, size long, turn string")


def test_mix_is_the_queues(spark):
    draw = random.Random(4)
    rows = [(i, draw.randint(0, 60), draw.choice(["a", "b", "c", "d", "é", None] + ["hot"] * 6)) for i in range(300)] + [(900, 3, "tiny"), (901, 0, "empty")]
    target, taken = plain(rows)
    told = mixing.mix(frame(spark, rows)).collect()
    assert len(told) == len(rows)
    for r in told:
        assert abs(r["target"] - target[r["source"]]) < 1e-6
        assert r["taken"] == taken.get(r["doc_id"], 0) <= 3 * r["size"]


def test_copies_are_what_is_taken(spark):
    rows = [(i, 10 + i, "a" if i % 3 else "b") for i in range(40)]
    mixed = mixing.mix(frame(spark, rows), carry=("text",))
    told = mixing.copies(mixed).collect()
    assert sum(len(r["text"].split()) for r in told) == sum(r["taken"] for r in mixed.collect())
    finish = [r["finish"] for r in told]
    assert finish == sorted(finish)


def test_mixing_cases(spark):
    empty = frame(spark, [(1, 1, "a")]).limit(0)
    assert mixing.mix(empty).count() == 0
    none = mixing.mix(frame(spark, [(1, None, "a"), (2, 0, None)])).collect()
    assert all(r["size"] == r["taken"] == 0 and r["target"] == 0 for r in none)
    same = frame(spark, [(1, 5, "a"), (1, 5, "a"), (2, 7, "b"), (3, 500, "c")])
    a, b = (sorted(map(tuple, mixing.mix(same).select("doc_id", "size", "taken").collect())) for _ in range(2))
    assert a == b and len(a) == 4


def test_stage_returns_documents(spark):
    docs = frame(spark, [(i, 20, "ab"[i % 2]) for i in range(10)]).selectExpr("doc_id", "text", "'en' lang", "source", "length(text) n_chars")
    out = mixing.stage(spark, docs, "")
    assert out.columns == docs.columns and abs(sum(len(r["text"].split()) for r in out.collect()) - 200) <= 2


def test_cut_of_the_sorted_queue(spark, monkeypatch):
    """What is taken is what serving piece by piece gives, wherever the cut lies and however many ranges there are."""
    draw = random.Random(9)
    rows = [(i, draw.randint(1, 900), draw.choice(["a", "b", "c", "d", None] + ["hot"] * 4)) for i in range(300)]
    docs = frame(spark, rows).cache()
    monkeypatch.setattr(mixing, "RANGE_ROWS", 100)
    for share in (0.01, 1.0, 2.5, 3.0, 4.0):
        target, taken = plain(rows, share=share)
        told = mixing.mix(docs, share).collect()
        got = {}
        for r in told:
            assert abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]])
            assert r["taken"] == taken.get(r["doc_id"], 0) <= 3 * r["size"]
            got[r["source"]] = got.get(r["source"], 0) + r["taken"]
        assert all(abs(got[s] - target[s]) <= mixing.PIECE for s in got)
        assert sum(got.values()) == min(round(sum(n for _, n, _ in rows) * share), 3 * sum(n for _, n, _ in rows))


def test_null_ids_do_not_share_a_bucket(spark):
    rows = [(None, i + 1, "a") for i in range(50)]
    assert mixing.queued(frame(spark, rows)).select("turn").distinct().count() == 50


def test_very_long_text_and_clashing_columns(spark):
    docs = frame(spark, [(1, 200_000, "a"), (2, 3, "b"), (3, 3, "b")]).selectExpr("*", "1 target", "2 taken", "3 weight", "4 `range`", "5 finish")
    told = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    target, taken = plain([(1, 200_000, "a"), (2, 3, "b"), (3, 3, "b")])
    assert {i: r["taken"] for i, r in told.items()} == {i: taken.get(i, 0) for i in (1, 2, 3)}
