"""The stages of the corpus pipeline on a small corpus."""

import random

import corpus_pipeline
from tidegauge.llm import bpe, registered


def test_pipeline(spark, tmp_path):
    draw = random.Random(6)
    words = ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    line = "a line that every document here repeats"
    texts = [" ".join(draw.choice(words) for _ in range(80)) + "\n" + line for _ in range(40)]
    texts += [texts[0], texts[1] + " more", None, "123 456", ""]
    rows = [(i, t, "en", f"src{i % 3}", len(t) if t else None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and "ids" in out.columns
    told = out.collect()
    ids = {r["doc_id"] for r in told}
    assert not ids & {40, 41, 42, 43, 44}
    assert sum(line in r["text"] for r in told if r["doc_id"] < 39) == 0
    encoder = bpe._public(spark)
    assert all(encoder.decode(list(r["ids"])) == r["text"].encode() for r in told)


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "minhash_near_dedup", "mixing", "byte_bpe"]
    assert {q.split("_")[0] for q in registered.queries()} == {"pipeline", *(f"op{i}" for i in range(1, 14))}


def test_odd_input(spark, tmp_path):
    """Columns of names that operators use, a map among them; repeated rows, a very long text, nulls in all columns; and no rows at all."""
    draw = random.Random(8)
    words = ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    texts = [" ".join(draw.choice(words) for _ in range(60)) for _ in range(12)] + [" ".join(draw.choice(words) for _ in range(60_000))]
    more = (0.5, "xx", [1, 2], 7, 8, 9, {"k": "v"}, "r")
    rows = [(i, t, "en", "s", len(t), *more) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None,) * 13, (50, texts[5], None, None, None, *(None,) * 8)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, ids array<int>, row long, lost int, class_id long, turn map<string,string>, __row string"
    for name, data in (("some", rows), ("none", [])):
        spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        if not data:
            assert out == []
            continue
        kept = {r["doc_id"]: r for r in out}
        assert 3 in kept and 12 in kept and len(kept[12]["text"]) == len(texts[12]) and None not in kept
        assert kept[4]["score"] == 0.5 and kept[4]["lang_pred"] == "xx" and kept[4]["turn"] == {"k": "v"} and kept[4]["__row"] == "r" and len(kept[4]["ids"]) > 60
