"""Archives written, read back in splits of any size, and compared with what went in."""

import hashlib
import random

import pytest

from tidegauge.llm import warc

QUOTED = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 7\r\n\r\npayload\r\n\r\n"


@pytest.fixture
def split(spark):
    """Sets the size of splits."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]

    def to(size):
        for k in keys:
            spark.conf.set(k, str(size))

    yield to
    for k, v in zip(keys, before, strict=True):
        spark.conf.set(k, v)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, file string, at long, block string, digest map<string,string>")


def some(n=40, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        kind = r.randrange(6)
        html = {0: None, 1: "", 2: QUOTED * r.randrange(1, 4), 3: "\r\n\r\n" * r.randrange(1, 5), 4: "é" * 1200, 5: "".join(r.choice("ab\n\r ") for _ in range(r.randrange(2500)))}[kind]
        rows.append((i if i % 9 else None, f"http://x/{i}\n{i}" if i % 4 else None, html, "f", i, "b", {"k": "v"}))
    return rows + rows[:3]


def plain(rows):
    top = {}
    for r in rows:
        body = (r[2] or "").encode()
        if len(body) >= 1000:
            top[body] = max(top.get(body, -(10**9)), -(10**9) if r[0] is None else r[0])
    out = []
    for r in rows:
        body = (r[2] or "").encode()
        first = top.get(body)
        again = first is not None and (-(10**9) if r[0] is None else r[0]) != first
        out.append((r[0], len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("size,splits,n", [(251, 1000, 3), (701, 0, 12), (4001, 1000, 40)])
def test_all_records_come_back(spark, split, tmp_path, size, splits, n):
    rows = some(n)
    path = str(tmp_path / "a")
    warc.write(pages(spark, rows).coalesce(2), path, "html", "page_id", "url", ("page_id", "digest"))
    split(size)
    found = warc.read(spark, path, {"n_bytes": warc.F.octet_length, "sha1": warc.F.sha1}, strict=True, splits=splits)
    assert sorted(map(tuple, warc.described(found).collect()), key=str) == plain(rows)


def test_payloads_and_fields(spark, split, tmp_path):
    rows = [(1, "http://x/1", QUOTED, "f", 1, "b", {"k": "v"}), (2, None, "z" * 3000, "f", 1, "b", None)]
    path = str(tmp_path / "a")
    warc.write(pages(spark, rows), path, "html", "page_id", "url", ("page_id", "digest"))
    split(128)
    got = {r["payload"].decode(): r for r in warc.read(spark, path).collect()}
    assert set(got) == {QUOTED, "z" * 3000}
    assert got[QUOTED]["uri"] == "http://x/1" and got[QUOTED]["own"] == '{"page_id":1,"digest":{"k":"v"}}' and got["z" * 3000]["uri"] is None
    assert got[QUOTED]["type"] == "response" and got[QUOTED]["path"].endswith(".txt") and got[QUOTED]["record_id"].startswith("<urn:uuid:")


def test_foreign_bytes(spark, split, tmp_path):
    """Payloads that are no text, folded and repeated header fields, an older version, records that are no responses."""
    body = bytes(range(256)) * 20
    one = b"WARC/1.0\r\nwarc-type: resource\r\nWARC-Target-URI: urn:a\r\n b\r\nContent-Length: %d\r\nContent-Length: 3\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    two = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "x.warc").write_bytes(two + one + two)
    for size in (150, 1 << 20):
        split(size)
        got = sorted(warc.read(spark, str(tmp_path / "x.warc"), strict=True).collect(), key=lambda r: r["at"])
        assert [bytes(r["payload"]) for r in got] == [b"", body, b""] and got[1]["uri"] == "urn:a b" and got[1]["at"] == len(two)


def test_damage(spark, split, tmp_path):
    rec = lambda b: b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % len(b) + b + b"\r\n\r\n"
    (tmp_path / "x.warc").write_bytes(rec(b"one") + rec(b"two") + b"junk\r\n" + rec(b"lost"))
    (tmp_path / "y.warc").write_bytes(b"")
    for size in (40, 1 << 20):
        split(size)
        assert sorted(bytes(r["payload"]) for r in warc.read(spark, str(tmp_path)).collect()) == [b"one", b"two"]
        with pytest.raises(ValueError):
            warc.read(spark, str(tmp_path), strict=True)


def test_no_rows(spark, tmp_path):
    warc.write(pages(spark, []), str(tmp_path / "a"), "html", "page_id", "url", ("page_id",))
    assert warc.read(spark, str(tmp_path / "a")).count() == 0


def test_chains_double(spark):
    """Pointer jumping over a chain of 40 splits, beside one that is never entered."""
    jumps = spark.createDataFrame([(1, i * 10, i * 10 + 10) for i in range(40)] + [(1, 5, 15), (1, 15, 25), (2, 3, 9)], "file long, at long, exit long")
    assert {tuple(r) for r in warc.reached(jumps).collect()} == {(1, i * 10) for i in range(40)}
