"""Language ID, line dedup, BPE and HTML extraction against plain versions, and their edge cases."""

import base64
import hashlib
import itertools
import pickle
import random
import sys
import time
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidegauge.llm import bpe, html, langid, lines

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, `row` string"


def docs_of(spark, texts, langs=None):
    rows = [(i, t, (langs or {}).get(i, "en"), "s", len(t or ""), 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS)


# language ID


def corpus(n=240):
    draw = random.Random(5)
    words = {"en": "the of and that with house river morning".split(), "de": "der und nicht schön straße fluß morgen haus".split(), "fr": "le été garçon maison rivière être avec où".split()}
    out, langs = [], {}
    for i in range(n):
        lang = draw.choice(sorted(words))
        langs[i] = lang
        out.append(" ".join(draw.choice(words[lang]) for _ in range(draw.randint(4, 40))))
    return out, langs


def test_language_is_found_in_held_out_documents(spark):
    texts, langs = corpus()
    docs = docs_of(spark, texts, langs)
    model = langid.fit(docs.where(~langid.held_out()))
    told = langid.identify(docs.where(langid.held_out()), model).collect()
    assert told and sum(r["lang_pred"] == langs[r["doc_id"]] for r in told) / len(told) > 0.95
    assert all(0 <= r["score"] <= 1 for r in told)


def test_held_out_is_crc32_of_the_id(spark):
    rows = spark.range(200).select(F.col("id").alias("doc_id")).withColumn("h", langid.held_out()).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_language_edge_cases(spark, monkeypatch):
    texts, langs = corpus()
    docs = docs_of(spark, texts, langs)
    model = langid.fit(docs)
    odd = docs_of(spark, [None, "", "123 ... 456", "\n\n", texts[0], texts[0], texts[1] * 40000])
    told = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert all(told[i]["lang_pred"] == "und" and told[i]["score"] == 0 for i in range(4))
    assert told[4]["lang_pred"] == told[5]["lang_pred"] == langs[0] and told[6]["lang_pred"] == langs[1]
    nothing = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_pieces_of_long_texts_count_every_gram_once(monkeypatch):
    text = "".join(random.Random(1).choices("abc dé", k=5000))

    def grams():
        out = defaultdict(int)
        for _, parts, context in langid.pieces([text]):
            for _, bucket in langid.hashed(parts, context, 1 << 16):
                for b in bucket.tolist():
                    out[b] += 1
        return out

    whole = grams()
    monkeypatch.setattr(langid, "CHUNK", 97)
    assert grams() == whole


def test_language_stage_keeps_columns_and_drops_only_junk(spark):
    texts, langs = corpus()
    docs = docs_of(spark, [*texts, None, "!!! 123"], langs).select("doc_id", "text", "lang", "source", "n_chars")
    kept = langid.stage(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == len(texts)


# lines


def plain_lines(texts, least=20, n_docs=3):
    strip, lower = lines.SPACES, str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    holders = defaultdict(set)
    keys = [[line.strip(strip).translate(lower) for line in (t or "").split("\n")] for t in texts]
    for i, ks in enumerate(keys):
        for k in ks:
            if len(k) >= least:
                holders[k].add(i)
    out = {}
    for i, (t, ks) in enumerate(zip(texts, keys, strict=True)):
        own = (t or "").split("\n")
        keep = [x for x, k in zip(own, ks, strict=True) if not (len(k) >= least and len(holders[k]) >= n_docs and max(holders[k]) != i)]
        out[i] = (len(own), len(own) - len(keep), "\n".join(keep))
    return out


def test_line_dedup_is_exact(spark):
    draw = random.Random(2)
    pool = [f"a line that many documents share {i} é" for i in range(12)] + ["short", "", "\x1c a separator that is no white space here"]
    texts = ["\n".join(draw.choice([" ", "", "\t"]) + (x.upper() if draw.random() < 0.3 else x) for x in draw.choices(pool, k=draw.randint(0, 9))) for _ in range(60)]
    texts += [None, "", "\n\n", "own line of this document only\nshort", "x" * 30000 + "\n" + pool[0]]
    told = {r["doc_id"]: (r["__n_lines"], r["__n_dropped"], r["text"]) for r in lines.drop_lines(docs_of(spark, texts)).collect()}
    assert told == plain_lines(texts)


def test_line_dedup_of_repeated_rows_and_nothing(spark):
    line = "the same line in several documents"
    docs = spark.createDataFrame([(1, line), (1, line), (2, line), (3, line), (3, line), (None, line)], "doc_id long, text string")
    told = sorted((r["doc_id"] or 0, r["text"]) for r in lines.drop_lines(docs).collect())
    assert told == [(0, ""), (1, ""), (1, ""), (2, ""), (3, line), (3, line)]
    first = sorted((r["doc_id"] or 0, r["text"]) for r in lines.drop_lines(docs, keep="first").collect())
    assert first[0] == (0, line) and first[-1] == (3, "")
    assert lines.drop_lines(docs.limit(0)).count() == 0


# BPE


@pytest.fixture(scope="module")
def tokenizer():
    tiktoken = pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return bpe.load(None, path, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_exact(tokenizer):
    table = tokenizer[0].hash
    assert sorted(table.slots) == list(range(table.n))
    assert all(table.get(k) == i for k, i in zip(table.keys, table.slots, strict=True))
    assert table.get(b"no token has these bytes") == -1


def test_encoding_is_the_library_s(tokenizer):
    mine, theirs = tokenizer
    draw = random.Random(3)
    letters = "abcAB  \n\t\r'stre123éßñ中文😀.,!?  ́_<|endoftext|>"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 80))) for _ in range(3000)] + ["", "a" * 5000, " " * 5000, "ab" * 3000 + "!?" * 2000]
    for t in texts:
        ids = mine.encode(t)
        assert ids == theirs.encode_ordinary(t)
        assert mine.decode(ids) == t.encode()


def test_what_was_encoded_is_remembered_within_a_bound_on_its_bytes(tokenizer, monkeypatch):
    mine, theirs = pickle.loads(pickle.dumps(tokenizer[0])), tokenizer[1]
    made = []
    monkeypatch.setattr(bpe.Encoder, "merge", lambda self, piece, f=bpe.Encoder.merge: made.append(piece) or f(self, piece))
    draw = random.Random(4)
    texts = ["".join(" " + "".join(draw.choices("etaoinshr", k=8)) for _ in range(5000)) for _ in range(16)]
    for t in [*texts, *texts]:
        mine.encode(t)
    assert len(made) == len(set(made)) > 70000

    mine = pickle.loads(pickle.dumps(mine))
    monkeypatch.setattr(bpe, "MEMO", 100000)
    text = texts[0] + "".join(" " + "".join(draw.choices("etaoinshr", k=draw.choice([300, 3000, 20000]))) for _ in range(60)) + texts[0]
    assert mine.encode(text) == theirs.encode_ordinary(text) and mine.decode(mine.encode(text)) == text.encode()
    for generation in (mine.memo, mine.memo.older):
        assert 0 < sum(bpe.ENTRY + sys.getsizeof(k) + sys.getsizeof(v) for k, v in generation.items()) <= 100000


def test_bpe_on_rows(spark, tokenizer, monkeypatch):
    texts = [None, "", "Hello wörld", "Hello wörld", "x y " * 3000]
    monkeypatch.setattr(bpe, "CHUNK", 10)
    coded = bpe.encode(docs_of(spark, texts), tokenizer[0], keep=("doc_id", "row"))
    told = {r["doc_id"]: r for r in bpe.decode(coded, tokenizer[0], keep=("doc_id", "ids", "row")).collect()}
    for i, t in enumerate(texts):
        assert list(told[i]["ids"]) == tokenizer[1].encode_ordinary(t or "") and bytes(told[i]["bytes"]) == (t or "").encode() and told[i]["row"] == "x"
    digest = {r["doc_id"]: r for r in bpe.digests(docs_of(spark, texts)).collect()}
    assert digest[2]["ids_sha256"] == hashlib.sha256(" ".join(map(str, told[2]["ids"])).encode()).hexdigest()
    assert digest[0]["n_tokens"] == 0 and digest[0]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.digests(docs_of(spark, texts).limit(0)).count() == 0


# HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad <p>no</p> -->
<div class="ad">Buy this now, it is very cheap and you will like it a lot, so buy it now.</div><div class="cookie-notice">We use cookies to make this page better for you, so please agree to it now.</div>
<article><h1>Head &amp; line</h1><p>First para<b>graph</b> is <a href=x>linked</a>.<br>It goes&nbsp;on.<p>Second.</p><form><input><p>Mail</p></form><div id="comments"><p>A reader says things about the article which are quite long.</p></div></article>
<aside>Read also this other article that is interesting in many ways for readers.</aside><footer>&copy; site</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == "Head & line First paragraph is linked. It goes on. Second."


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("<nav>menu</nav>", ""), ("<p>tiny", "tiny"), ("<article><p>One.<p>Two.", "One. Two."), ("a < b and c", "a < b and c"), ("<article>&lt;p&gt; &#233;</article>", "<p> é"), ("<article><p>kept <span class='ad'>gone</span>too</article>", "kept too")])
def test_main_text_cases(page, text):
    assert html.main_text(page) == text


def test_a_named_article_keeps_its_short_lines():
    long = "A paragraph of the article, which is long enough for a surge of its own, and then has some more to say."
    page = f"<article><section><p>{long}</p></section><section><p>Short.</p></section><div class='ad'><p>Buy</p></div><p>End.</p><table><tr><td>a</td><td>1</td></tr><tr><td>b</td><td>2</td></tr></table></article>"
    assert html.main_text(page) == f"{long} Short. End. a 1 b 2"


def test_pages_without_an_article_keep_what_lies_between_surge_and_dive():
    body = "".join(f"<p>Paragraph {i} of the text, which is long enough for a surge of its own, and then some.</p>" for i in range(4))
    page = f"<div><ul>{'<li><a href=x>Link</a></li>' * 6}</ul></div><div>{body}</div><div><a href=y>More</a></div><div></div><div></div><p>end</p>"
    assert html.main_text(page).startswith("Paragraph 0") and html.main_text(page).endswith("some.") and "Link" not in html.main_text(page)


@pytest.mark.parametrize(
    ("part", "text"),
    [
        ('<div class="social-history">A.</div>', "A."),
        ('<div class="article-header"><h1>A</h1></div>', "A"),
        ('<section id="search"><p>A.</p></section>', "A."),
        ('<p class="notice-period">A.</p>', "A."),
        ('<div class="no-sidebar">A.</div>', "A."),
        ("<p>If <math><mi>x</mi><mo>=</mo><mn>1</mn></math>.</p>", "If x=1."),
        ('<p>A <img alt=5" src=a.png>b.</p>', "A b."),
        ('<p title="a > b">A.</p>', "A."),
        ("<svg viewBox='0 0 1 1'/><p>A.</p>", "A."),
        ("<div></div>" * 9 + "<p>A.</p>", "A."),
        ('<div class="ad-banner">x</div>' * 9 + "<p>A.</p>", "A."),
        *((f'<div class="{c}">x</div>', "") for c in ("ad", "ad-300x250", "adBanner", "site-footer", "cookie-notice", "pop-up", "newsletter_signup", "related-posts", "post comments", "social-share", "comment-form")),
        ('<div id="comments"><p>x</p></div>', ""),
        ("<aside>x</aside><form>x</form><nav>x</nav>", ""),
    ],
)
def test_parts_of_an_article(part, text):
    assert html.main_text(f"<body><nav>Menu</nav><article><p>First.</p>{part}</article><footer>x</footer></body>") == f"First. {text}".strip()


def test_empty_blocks_are_no_dive():
    long = "This is one long line of an article that no element names, with more text than surges. " * 2
    assert html.main_text(f"<body><div>{long}</div>{'<div></div>' * 4}<p>The end.</p></body>").endswith("The end.")


def test_surge_and_dive_by_definition():
    """The runs are those of a plain reading of the rule, for lengths of all sorts."""
    rng = random.Random(3)
    for _ in range(300):
        lengths = [rng.choice([0, 0, 0, 5, 40, 200]) for _ in range(rng.randrange(0, 25))]
        for surge in (0, 86):
            sums = [sum(lengths[i : i + 3]) for i in range(len(lengths))]
            groups = [[i for i, _ in g] for live, g in itertools.groupby(enumerate(sums), lambda x: x[1] > 0) if live]
            chosen = [g for g in groups if max(sums[i] for i in g) > surge] or sorted(groups, key=lambda g: -sum(lengths[i] for i in g))[:1]
            assert html.kept(lengths, surge=surge) == [(g[0], g[-1] + 1) for g in chosen]


def test_broken_pages_take_linear_time():
    start = time.monotonic()
    for page in ("<a title=" * 50_000, '<p a="x" ' * 50_000, "<article>" + "<b " * 50_000, "<div class='" * 50_000 + "x", "<" * 200_000):
        html.main_text(page)
    assert time.monotonic() - start < 60


def test_extraction_of_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, "t"), (2, None, None, "t"), (None, "v", "<article>" + "<p>word</p>" * 20000, "t")], "page_id long, url string, html string, text string")
    told = html.extract(pages).collect()
    assert sorted(len(r["text"]) for r in told) == [0, 0, 58, 20000 * 5 - 1]
    assert html.extract(pages.limit(0)).count() == 0
