"""The prefix trie and the repair of conversations against plain versions, and their queries against SQL."""

import functools
import hashlib
import os
import random
import zlib

import pytest

from tidegauge.llm import order, registered, repair, trie

DATA = "/root/testdata/sf0.001"
CHAT = "conv_id long, turn long, role string, text string, place long, block string, codes string"


def chat(spark, rows):
    return spark.createDataFrame([(*r, 7, "b", "c") for r in rows], CHAT)


def turns(n, seed, longest=9):
    r = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(r.choice([1, 2, 3, longest])):
            out.append((c * 3 if c else 0, t if r.random() > 0.1 else None, r.choice(["user", "assistant", "system", "tool", None]), r.choice(["Hi.", "no end", "", None, "same.", " \n", "a!b?"])))
    return out + out[:2] + [(None, 1, "user", "lost."), (107, None, None, None)]


def test_places_of_a_hot_key(spark):
    rows = [(5, i // 2) for i in range(300)] + [(k, 1) for k in range(20) if k != 5]
    random.Random(1).shuffle(rows)
    got = order.numbered(spark.createDataFrame(rows, "k long, t long"), "k", ["t"], "test").collect()
    assert sorted((r["k"], r["place"]) for r in got) == sorted([(5, i + 1) for i in range(300)] + [(k, 1) for k in range(20) if k != 5])
    hot = sorted((r["place"], r["t"]) for r in got if r["k"] == 5)
    assert [t for _, t in hot] == sorted(t for _, t in hot)


def plain_trie(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((t is not None, t or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    path = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        path[c] = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
    nodes = {}
    for c, p in path.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    child = {}
    for n in nodes:
        if n:
            child.setdefault(n[:-1], []).append(n)
    out = []
    for n, members in nodes.items():
        under = [u for u in nodes if u[: len(n)] == n]
        ends = ",".join(map(str, sorted(c for c in members if path[c] == n)))
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), len(child.get(n, [])), sum(u not in child for u in under), sum((len(nodes[u]) - 1) * len(u[-1][1]) for u in under if u), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def test_trie_is_the_plain_one(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 3)
    rows = turns(60, 2, 21)
    chats = chat(spark, rows).write.mode("overwrite")
    folder = os.path.join(str(spark.conf.get("spark.sql.warehouse.dir")).removeprefix("file:"), "trie_test")
    chats.parquet(f"{folder}/conversations.parquet")
    got = sorted(map(tuple, trie.op12_prefix_trie(spark, folder).collect()), key=str)
    assert got == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert trie.trie(trie.rebuilt(chat(spark, []))).count() == 0


def plain_repair(rows):
    """Of one conversation's rows in order: counts, cost, audit, repaired text, by all ways with memory."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {"": "su", "s": "u", "u": "a", "a": "u"}

    @functools.cache
    def best(i, q, inserts):
        ways = [(0, "", "")] if i == len(rows) and q in ("", "a") else []
        if inserts < 3:
            for x in step[q].replace("s", ""):
                c, a, t = best(i, x, inserts + 1)
                ways.append((c + 2, "I" + a, f"\n{'user' if x == 'u' else 'assistant'}:" + t))
        if i < len(rows):
            role, text = rows[i]
            c, a, t = best(i + 1, q, 0)
            ways.append((c + 3, "D" + a, t))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                for x in step[q]:
                    c, a, t = best(i + 1, x, 0)
                    if role[:1] == x:
                        ways.append((c + more, "K" + a, f"\n{role}:{text}" + t))
                    if x != "s":
                        ways.append((c + more + 2, "R" + a, f"\n{'user' if x == 'u' else 'assistant'}:{text}" + t))
        return min(ways, default=(10**6, "", ""))

    cost, audit, out = best(0, "", 0)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(out[1:].encode()).hexdigest()


def grouped(rows):
    out = {}
    for c, t, role, text in rows:
        out.setdefault(c, []).append((t is not None, t or 0, role, hashlib.md5(text.encode()).digest(), text))
    return {c: sorted(v) for c, v in out.items()}


@pytest.mark.parametrize("short", [2, 64])
def test_repair_is_the_plain_one(spark, short):
    rows = [(c, t, role or " ", " " if text is None else text) for c, t, role, text in turns(40, 5, 25)]
    want = []
    for c, v in grouped(rows).items():
        known = [x[1] for x in v if x[0]]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        want.append((c, gaps, *plain_repair([(x[2], x[4]) for x in v])))
    made = repair.Repair(chat(spark, rows).drop("place", "block", "codes"), short)
    got = made.summary()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    texts = {}
    for r in made.turns().orderBy("place").collect():
        texts.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    digest = {r["conv_id"]: r["repaired_sha256"] for r in got.collect()}
    assert all(digest[c] == hashlib.sha256("\n".join(texts.get(c, [])).encode()).hexdigest() for c in digest)


def test_edits_of_all_short_conversations():
    """Every sequence of up to three kinds of rows, in stretches of one row, costs what a plain search says."""
    import itertools

    kind = {0: "system", 1: "user", 2: "assistant", 3: "tool"}
    for n in range(4):
        for codes in itertools.product(range(12), repeat=n):
            rows = [(kind[c // 3], "" if c % 3 == 1 else f"t{i}" + ("." if c % 3 == 0 else "")) for i, c in enumerate(codes)]
            v = [list(repair.AFTER)]
            for c in reversed(codes):
                v.append(repair.backward(bytes([c]), v[-1])[0])
            v, state, out = v[::-1], repair.NEW, ""
            for i, c in enumerate(codes):
                letters, state = repair.walk(repair.backward(bytes([c]), v[i + 1]), bytes([c]), state, i + 1 == n)
                out += letters
            assert (v[0][0], out) == plain_repair(rows)[4:6]


def test_repair_of_nothing(spark, tmp_path):
    assert repair.Repair(repair.damaged(chat(spark, []))).summary().count() == 0
    gone = [(c, 0, "user", "x.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    chat(spark, gone).write.parquet(f"{tmp_path}/conversations.parquet")
    got = repair.op13_structure_repair(spark, str(tmp_path)).collect()
    assert gone and {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())} and len(got) == len(gone)


@pytest.mark.parametrize("name", ["op11_warc", "op12_prefix_trie", "op13_structure_repair"])
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    a, b = registered.queries()[name](spark, DATA).toPandas(), c.sql(registered.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and len(a) == len(b)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    assert all(((a[k] == b[k]) | (a[k].isna() & b[k].isna())).all() for k in cols)
