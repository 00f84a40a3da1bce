"""Secrets in texts: broad patterns find candidates, and a random forest removes the false ones.

Everything is DataFrame and SQL functions and MLlib, which run in the JVM. A text is split at white space; words
that look like a key, or that something like `password=` assigns, are candidates with their neighbours, and so is
every further match in a word. A candidate's features are its length, its character classes and how often they
change, the mean log-probability of its character transitions, how much of it is words of a dictionary and how much
of a placeholder, whether it stands in a path or an address, and what the words around it say. The dictionary and the
transitions are learned from all texts that are scanned (`learn`): a word belongs to the dictionary if it is at least
LEAST_SHARE of all words, which bounds the dictionary at 1 / LEAST_SHARE words whatever the size of the corpus. The
forest learns from labelled findings: real shapes of keys with what surrounds them, and what is mistaken for them
(hashes of commits and files, identifiers, addresses, numbers, placeholders, long words), with VOCABULARY words of
the dictionary for the prose in them.

Cases: a null or empty text has no findings. Of an empty table nothing is learned: no word is of the dictionary, and all transitions are alike. Repeated rows have their findings each. A text of any length is
scanned whole. The same key twice in a text is two findings. Further columns of the input play no part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import SPACE, table, written

# The words by which keys, other long strings and placeholders are known.
KEYWORDS = "password|passwd|passphrase|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|auth[_-]?key|private[_-]?key|client[_-]?secret|credentials?|bearer"
OTHERS = "commit|sha1|sha256|sha512|md5|checksum|digest|hash|revision|rev|etag|uuid|guid|id|isbn|doi|order|invoice|ref|reference|build|version|phone|card|account|url|file|path|image|page"
PLACEHOLDERS = "example|sample|dummy|test|fake|placeholder|changeme|change|your|insert|replace|todo|xxxx|redacted|null|none|default|password|secret|token|here|value|key|user|name|admin|data|file|page|image|index|version|report|session|server|config"
#: Strings whose beginning tells what they are.
PREFIXED = r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|(?<![A-Za-z])sk-[A-Za-z0-9_-]{20,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}|glpat-[A-Za-z0-9_-]{20}"

RUN = r"[A-Za-z0-9+/_\-]"
#: What stands for a match that has been taken.
MARK = "\x01"
LONG = rf"(?<!{RUN})(?=[A-Za-z+/_\-]*+[0-9]){RUN}{{16,}}={{0,2}}"
#: An assigned value goes on to a quote, white space or the next assignment, whatever punctuation it holds.
END = rf"(?=[{SPACE}\"'\x01]|\z|[&;,|][\"']?[A-Za-z_][A-Za-z0-9_.\-]*[\"']?[:=]|[^A-Za-z0-9](?:{KEYWORDS})[\"']?[:=])"
ASSIGNED = rf"(?i)(?:{KEYWORDS})[\"']?[:=]+[\"']?([^{SPACE}\"'\x01]+?){END}"
#: What may stand around an assigned value without being of it, and the least length of what is left.
NOISE = r"^[(\[{<*]+|(?<![%#$&;,.*|)\]}>])[%#$&;,.*|)\]}>]++\z"
LEAST = 6
#: Texts that may hold a candidate; nothing that makes one is left out.
ANY = rf"{PREFIXED}|{LONG}|(?i:{KEYWORDS})[\"']?[{SPACE}:=]*[:=]"

FEATURES = ["length", "digits", "uppers", "changes", "distinct", "hex", "transitions", "vowels", "dictionary", "words", "prefixed", "path", "address", "assigned", "keyword", "other", "dashes"]
FINDINGS = 6000

#: Symbols of transitions: letters without case, any digit as 0, all else as the last.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0-"
#: A word is of the dictionary if it is this share of all words of the texts, and more than once there.
LEAST_SHARE = 1e-5
#: Parts of a value that may be words.
PART = r"\p{Lu}?\p{Ll}{2,}|\p{Lu}{3,}"
#: How many words of the dictionary, drawn by a hash, the labelled findings are made with.
VOCABULARY = 500
#: What the words of a finding are drawn by: two for each of its words, five for prose.
SALTS = tuple(a + b for a in "123upqwxyef" for b in "ab") + tuple(f"s{i}" for i in range(5))
SYLLABLES = ("the", "ing", "ed", "tion", "re", "an", "on", "er", "que", "ment", "sch", "lich", "cion", "ado", "ver", "ion")


@dataclass
class Language:
    """What the texts say of their words: the dictionary (`word`), a log-probability for each two symbols in order, and words to make findings with."""

    dictionary: DataFrame
    transitions: list[float]
    vocabulary: tuple[str, ...]


def symbols(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]", "0"), "[^a-z0]", "-")


def learn(docs: DataFrame, text: str = "text") -> Language:
    """The language of all the texts. Words are runs of letters and digits, and of letters alone in the dictionary; only counts of words are shuffled, and only sums over pairs of symbols leave Spark."""
    every = docs.select(F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+")).alias("word")).where("word <> ''")
    counts = written(every.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    dictionary = written(counts.where((F.col("n") > 1) & (F.col("n") >= LEAST_SHARE * total) & F.col("word").rlike(r"^\p{L}{3,}\z")).select("word"), "dictionary")
    symbol = symbols(F.col("word"))
    pairs = counts.withColumn("symbols", symbol).where("length(symbols) > 1").select("n", F.explode(F.expr("transform(sequence(1, length(symbols) - 1), i -> substring(symbols, i, 2))")).alias("pair"))
    seen = {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()}  # one row for each two symbols at most
    after = {a: sum(seen.get(a + b, 0) for b in SYMBOLS) for a in SYMBOLS}
    transitions = [math.log((seen.get(a + b, 0) + 1) / (after[a] + len(SYMBOLS))) for a in SYMBOLS for b in SYMBOLS]
    drawn = dictionary.where(r"word rlike '^[a-z]{3,12}$'").orderBy(F.xxhash64("word"), "word").limit(VOCABULARY)
    return Language(dictionary, transitions, tuple(r["word"] for r in drawn.collect()))


def covered(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """value and `dictionary`, the share of its characters in words of the dictionary, for each different value that has any."""
    parts = found.select("value").distinct().select("value", F.explode(F.regexp_extract_all("value", F.lit(PART), F.lit(0))).alias("part"))
    known = parts.withColumn("word", F.lower("part")).join(dictionary, "word")
    return known.groupBy("value").agg((F.sum(F.length("part")) / F.length("value")).alias("dictionary"))


def is_spaced(before2: Column, before: Column, own: Column) -> Column:
    """Whether the words before say that this one is the value of a keyword."""
    return (F.length(own) >= 8) & before.rlike(r"^[:=]+$|[:=]$") & F.concat_ws(" ", before2, before).rlike(rf"(?i)(?:{KEYWORDS})[\"']?[ :=]*$")


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, word (its number in the text), value, and the words around: before3, before2, before, own, after. A word has a row for each match.

    around: of its own word what tells of this match, without the keys of others in it."""
    words = F.split(F.col("text"), rf"[{SPACE}]+", -1)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").rlike(ANY))

    def is_candidate(i: Column) -> Column:
        word = lambda k: F.coalesce(F.get("words", i - k), F.lit(""))
        return (F.length(word(0)) >= 8) & (word(0).rlike(PREFIXED) | word(0).rlike(LONG) | word(0).rlike(ASSIGNED) | is_spaced(word(2), word(1), word(0)))

    rows = rows.withColumn("words", words)
    rows = rows.select("doc_id", "words", F.explode(F.filter(F.sequence(F.lit(0), F.size("words") - 1), is_candidate)).alias("word"))
    at = lambda k: F.coalesce(F.get("words", F.col("word") + k), F.lit(""))
    rows = rows.select("doc_id", F.col("word").cast("long").alias("word"), at(-3).alias("before3"), at(-2).alias("before2"), at(-1).alias("before"), at(0).alias("own"), at(1).alias("after"))
    # a pattern's matches leave a mark, so that the next one finds no part of them again
    every = lambda of, pattern, group=0: F.regexp_extract_all(of, F.lit(pattern), F.lit(group))
    rows = rows.withColumn("spaced", is_spaced(F.col("before2"), F.col("before"), F.col("own")))
    rows = rows.withColumn("left", F.when(F.col("spaced"), F.concat(F.lit("token="), "own")).otherwise(F.col("own")))
    rows = rows.withColumn("known", every(F.col("left"), PREFIXED)).withColumn("left", F.regexp_replace("left", PREFIXED, MARK))
    rows = rows.withColumn("values", every(F.col("left"), ASSIGNED, 1)).withColumn("wholes", every(F.col("left"), ASSIGNED)).withColumn("left", F.regexp_replace("left", ASSIGNED, MARK))
    found = lambda value, around: F.struct(value.alias("value"), around.alias("around"))
    all_ = F.concat(
        F.transform("known", lambda v: found(v, F.col("own"))),
        F.zip_with("values", "wholes", lambda v, whole: found(F.regexp_replace(v, NOISE, ""), F.when(F.col("spaced"), F.col("own")).otherwise(whole))),
        F.transform(every(F.col("left"), LONG), lambda v: found(v, F.col("left"))),
    )
    rows = rows.withColumn("found", F.filter(all_, lambda f: F.length(f["value"]) >= LEAST))
    rest = F.coalesce(F.nullif(F.regexp_extract("own", "[^\"']{6,}", 0), F.lit("")), F.col("own"))
    rows = rows.withColumn("found", F.when((F.size("found") == 0) & F.col("spaced"), F.array(found(rest, F.col("own")))).otherwise(F.col("found")))
    rows = rows.select("doc_id", "word", "before3", "before2", "before", "own", "after", F.explode("found").alias("found"))
    return rows.select("doc_id", "word", "found.value", "before3", "before2", "before", "found.around", "own", "after")


def features(found: DataFrame, language: Language | None = None) -> DataFrame:
    """The candidates with FEATURES, all doubles. Without a language no word is known and all transitions are alike."""
    if language:
        found = found.join(covered(found, language.dictionary), "value", "left")
    else:
        found = found.withColumn("dictionary", F.lit(0.0))
    table_ = F.array(*map(F.lit, language.transitions if language else [0.0] * len(SYMBOLS) ** 2))
    place = lambda k: F.instr(F.lit(SYMBOLS), F.substring(symbols(F.col("value")), k, F.lit(1))) - 1
    steps = F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda k: F.element_at(table_, (place(k) * len(SYMBOLS) + place(k + 1) + 1).cast("int")))
    v, around = F.col("value"), F.col("around")
    n = F.length("value").cast("double")
    share = lambda pattern, of=v: F.regexp_count(of, F.lit(pattern)) / n
    near = F.concat_ws(" ", "before3", "before2", "before")
    left = F.regexp_replace(F.lower(v), f"{PLACEHOLDERS}", "")
    made = {
        "length": n,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "changes": share("(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "hex": v.rlike("^[0-9a-f]+$|^[0-9A-F]+$").cast("double"),
        "transitions": F.when(n > 1, F.aggregate(steps, F.lit(0.0), lambda a, b: a + b) / (n - 1)),
        "vowels": share("[aeiouAEIOU]"),
        "dictionary": F.col("dictionary"),
        "words": 1 - F.length(left) / n,
        "prefixed": v.rlike(f"^(?:{PREFIXED})$").cast("double"),
        "path": around.rlike(r"^[./~]|/[A-Za-z0-9._-]+/|\.[A-Za-z]{2,4}$").cast("double"),
        "address": around.rlike(r"://|@|^www\.").cast("double"),
        "assigned": (around.rlike(r"[:=][\"']?" + RUN) | F.col("before").rlike("[:=]$")).cast("double"),
        "keyword": (near.rlike(rf"(?i)(?:{KEYWORDS})") | around.rlike(rf"(?i)(?:{KEYWORDS})[\"']?[:=]")).cast("double"),
        "other": (near.rlike(rf"(?i)(?:^|[^a-z])(?:{OTHERS})[\"']?[ :=#]*$") | around.rlike(rf"(?i)^(?:{OTHERS})[\"']?[:=#]")).cast("double"),
        "dashes": share("[-_/.]"),
    }
    return found.withColumns({k: F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in made.items()})


def drawn_words(spark: SparkSession, n: int, vocabulary: tuple[str, ...]) -> DataFrame:
    """n ids with `syllables`, a word of the vocabulary for each of SALTS, drawn by a hash."""
    words = spark.range(len(vocabulary)).select(F.col("id").alias("place"), F.element_at(F.split(F.lit(" ".join(vocabulary)), " "), (F.col("id") + 1).cast("int")).alias("word"))
    ids = spark.range(n, numPartitions=2).select("id", F.explode(F.array(*map(F.lit, SALTS))).alias("salt"))
    met = ids.withColumn("place", F.pmod(F.xxhash64("id", "salt"), F.lit(len(vocabulary)))).join(words, "place")
    return met.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("salt", "word"))).alias("syllables"))


def labelled_findings(spark: SparkSession, n: int = FINDINGS, vocabulary: tuple[str, ...] = ()) -> DataFrame:
    """n findings with label 1 (a secret) or 0, as scans of code and text have them; the same ones every time.

    Their prose is words of the vocabulary, where one is given, and of syllables else."""
    rows = written(drawn_words(spark, n, vocabulary or SYLLABLES), "drawn")
    draw = lambda salt, many: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(many)).cast("int")
    of = lambda salt, *choices: F.element_at(F.array(*map(F.lit, choices)), draw(salt, len(choices)) + 1)
    hexes = F.concat(*(F.md5(F.concat(F.col("id").cast("string"), F.lit(f"h{i}")).cast("binary")) for i in range(2)))
    mixed = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.col("id").cast("string"), F.lit("m")).cast("binary"), 256))), "[+/=\\r\\n]", "")
    upper = F.translate(F.upper(mixed), "0189", "QXYZ")
    size = lambda salt, *choices: of(salt, *choices)
    cut = lambda s, k: F.substring(s, 1, k)
    syllable = lambda salt: F.element_at("syllables", F.lit(salt))
    prose = F.concat(*(syllable(f"s{i}") for i in range(5)))
    word = lambda salt: F.concat(syllable(salt + "a"), syllable(salt + "b"))
    secret = of("key", "password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "client_secret", "auth_key", "Token", "PASSWORD")
    kinds = [  # label, before3, before2, before, word (with the value in it), value
        (1, word("1"), word("2"), word("3"), F.concat(secret, F.lit("="), hexes_cut := cut(hexes, size("l1", 16, 18, 20, 24, 32, 40))), hexes_cut),
        (1, word("1"), secret, F.lit("="), F.concat(F.lit('"'), hexes_cut, F.lit('"')), hexes_cut),
        (1, word("1"), secret, F.lit("="), F.concat(F.lit('"'), m := cut(mixed, size("l2", 20, 24, 32, 40)), F.lit('"')), m),
        (1, word("1"), word("2"), F.concat(secret, F.lit(":")), m, m),
        (1, word("1"), word("2"), word("3"), F.concat(F.lit("AKIA"), cut(upper, 16)), F.concat(F.lit("AKIA"), cut(upper, 16))),
        (1, word("1"), word("2"), word("3"), F.concat(F.lit("ghp_"), cut(F.concat(mixed, mixed), 36)), F.concat(F.lit("ghp_"), cut(F.concat(mixed, mixed), 36))),
        (1, word("1"), word("2"), word("3"), F.concat(secret, F.lit("="), short := cut(mixed, size("l3", 10, 12, 14))), short),
        (0, word("1"), of("o", "commit", "revision", "rev"), word("3"), cut(hexes, 40), cut(hexes, 40)),
        (0, word("1"), word("2"), of("o", "commit", "sha256:", "md5", "checksum", "digest", "sha1", "etag", "uuid", "build"), cut(hexes, size("l4", 32, 40, 64)), cut(hexes, size("l4", 32, 40, 64))),
        (0, word("1"), of("o", "id", "uuid", "order", "ref"), F.lit("="), F.concat_ws("-", cut(hexes, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12)), F.concat_ws("-", cut(hexes, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12))),
        (0, word("1"), word("2"), word("3"), F.concat(prose, draw("n", 2000)), F.concat(prose, draw("n", 2000))),
        (0, word("1"), word("2"), word("3"), cut(F.translate(hexes, "abcdef", "012345"), size("l5", 16, 19)), cut(F.translate(hexes, "abcdef", "012345"), size("l5", 16, 19))),
        (0, word("1"), word("2"), word("3"), F.concat(F.lit("https://"), word("u"), F.lit(".example.com/"), p := F.concat(word("p"), F.lit("/"), cut(hexes, 12), F.lit("/"), word("q"), draw("n", 900))), p),
        (0, word("1"), of("o", "file", "path", "image", "page"), word("3"), F.concat(F.lit("/"), p, F.lit(".png")), F.concat(F.lit("/"), p)),
        (0, word("1"), word("2"), word("3"), F.concat(secret, F.lit("="), h := of("ph", "changeme123", "your-token-here-1", "example_password_1", "xxxxxxxx00000000", "placeholder123", "test-secret-key-1", "dummy_value_2024", "REPLACE_WITH_KEY1")), h),
        (0, word("1"), secret, F.lit("="), F.concat(F.lit('"'), h, F.lit('"')), h),
        (0, word("1"), secret, F.lit(":"), F.concat(prose, F.lit(".")), prose),
        (0, word("1"), word("2"), word("3"), F.concat(w := F.concat(word("w"), F.lit("-"), word("x"), F.lit("-"), draw("n", 3000), F.lit("-"), word("y")), F.lit(",")), w),
        (0, word("1"), word("2"), word("3"), F.concat(e := F.concat(word("e"), F.lit("_"), word("f"), draw("n", 99)), F.lit("@mail.example.com")), e),
    ]
    kind = draw("kind", len(kinds))
    pick = lambda k: F.element_at(F.array(*((F.lit(x[k]) if k == 0 else x[k].cast("string")) for x in kinds)), kind + 1)
    junk = of("junk", "", "", "", "", "###", "%%%", "$$$", "***", "&&&", ",", ".")
    names = ["label", "before3", "before2", "before", "around", "value"]
    out = rows.select("id", *(pick(i).alias(x) for i, x in enumerate(names)), F.lit("").alias("after"))
    return out.withColumn("label", F.col("label").cast("double")).withColumn("around", F.concat("around", junk)).withColumn("before", F.concat("before", F.when(F.col("before") == "=", "").otherwise(of("j2", "", "", "###", "%%%"))))


def fit(findings: DataFrame, trees: int = 40, depth: int = 8, language: Language | None = None) -> RandomForestClassificationModel:
    """The forest, from candidates with an id and a label. Findings are few beside the texts, and so is the model.

    They are put in order, so that the same findings give the same forest."""
    ordered = features(findings, language).repartition(2, "id").sortWithinPartitions("id")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(ordered).select("label", "features")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, seed=7, featureSubsetStrategy="sqrt").fit(rows)


def scan(docs: DataFrame, model: RandomForestClassificationModel, key: str = "doc_id", text: str = "text", language: Language | None = None) -> DataFrame:
    """Every candidate with `score`, the share of the forest that takes it for a secret, and its `rule`."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(written(candidates(docs, key, text), "candidates"), language))
    rule = F.when(F.col("prefixed") == 1, "prefix").when(F.col("keyword") == 1, "assignment").otherwise("long string")
    return model.transform(rows).select("doc_id", "word", rule.alias("rule"), "value", F.concat_ws(" ", "before3", "before2", "before", "own", "after").alias("context"), vector_to_array("probability")[1].alias("score"))


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    language = learn(docs)
    findings = written(labelled_findings(spark, vocabulary=language.vocabulary), "findings")
    found = scan(docs, fit(findings, language=language), language=language)
    return found.where("score >= 0.5").select("doc_id", "word", "rule", "value", "score")
