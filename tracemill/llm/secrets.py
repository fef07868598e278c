"""Secret scans with a random forest for false-positive removal, in DataFrame and SQL functions only.

A first pass takes every long run of token characters in a word as a candidate, and shorter ones beside a keyword or an
assignment. Features of a candidate (length, character transitions,
coverage by a dictionary of the corpus's own words and the likelihood of its letter pairs, path shape, neighbouring words) go to a random forest that was trained from
labelled findings; what it rejects is removed.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import WS_CLASS, cut, small_side

#: A candidate has this many token characters in a row, or SHORT_LENGTH beside a keyword or an assignment.
MIN_LENGTH = 16
SHORT_LENGTH = 6
#: An equals sign belongs to a run only as padding at its end.
RUN = rf"[A-Za-z0-9+/_\-.~]{{{SHORT_LENGTH},}}(?:={{1,2}}(?![A-Za-z0-9+/_=\-.~]))?"
CANDIDATE = rf"[A-Za-z0-9+/_\-.~]{{{MIN_LENGTH},}}"
#: Labelled findings made by rule when none are given.
FINDINGS = 4_000
TREES, DEPTH, SEED = 20, 8, 7

#: A word of the dictionary stands in at least this many documents, or in BASE_WORDS.
MIN_DOCUMENTS = 5
#: Words that labelled findings are made of, the first of the dictionary by hash.
SAMPLE_WORDS = 400
#: The dictionary's share that needs no corpus.
BASE_WORDS = (
    "about after again also always and another because been before being between both could down each even every example find first for found from good great group hand have help here high home house "
    "into just know large last letter light like line little long made make many more most mother move much must name need never next night number only open other over own page paper part people place "
    "point read right river said same school second sentence should show small some something sound state still story study such take tell than that their them then there these thing think this three "
    "through time together turn under until very want water well were what when where which while white with without word work world would write year your aber alle auch bitte dann dass der die diese "
    "durch einheit freiheit haben heute immer jetzt kann mehr nicht noch oder schon sein sich sind viel wenn werden wieder zeit alors autre avec beaucoup cette chose comme dans elle encore entre faire "
    "jour leur mais maison meme monde nous parce petit peut plus pour quand quelle sans sont tout tres vous algo antes casa como cuando desde donde ella ellos entonces esta este hacer hasta mismo mucho "
    "mundo nada nosotros otro para pero porque puede siempre sobre solo tiempo todo una verdad vida"
).split()
KEYWORDS = "token|secret|password|passwd|pwd|api_?key|apikey|access_?key|private_?key|credential|auth|bearer|client_?secret"
#: Words beside fingerprints of public things: revisions, checksums and ids are no secrets.
PUBLIC = "commit|revision|rev|sha-?(?:1|256|512)?|md5|etag|checksum|digest|hash|integrity|fingerprint|blob|uuid|guid|[a-z_]*id"
#: A value assigned to a keyword is taken whole, up to a quote, a separator or a bracket; in an address up to the next parameter.
VALUE = r"[^\s\"'`,;<>(){}\[\]]"
ASSIGNED = rf"(?i)(?<=(?:{KEYWORDS})[\"'`]{{0,1}}[=:]{{1,2}}[\"'`]{{0,1}}){VALUE}{{{SHORT_LENGTH},}}"
LED = rf"(?i)(?:{KEYWORDS})[\"'`]?\s*[=:]{{1,2}}$"
#: What makes a short run a candidate: a keyword, or an assignment, in its word before it or in the two words before.
BESIDE = rf"(?i){KEYWORDS}|[=:]"

FEATURES = ("length", "transitions", "digits", "upper", "coverage", "pairs", "repeats", "distinct", "slashes", "dots", "keyword_near", "assigned", "quoted", "address", "symbols", "public_near", "fingerprint")


def _runs(word: Column, led: Column) -> Column:
    """The runs of a word in order: text and start from 0. A run is not found before its place, as shorter ones do not hold it.

    Values assigned to a keyword come whole, in the word itself or, where the words before end in such an assignment (``led``), from its start.
    """
    inside = F.when(F.contains(word, F.lit("://")), F.regexp_extract_all(word, F.lit(f"(?:{ASSIGNED.replace(VALUE, VALUE[:-1] + '&]')})|{RUN}"), 0)).otherwise(F.regexp_extract_all(word, F.lit(f"(?:{ASSIGNED})|{RUN}"), 0))
    found = F.when(led & ~F.contains(word, F.lit("://")), F.regexp_extract_all(word, F.lit(rf"(?:(?<=^[\"'`]{{0,1}}){VALUE}{{{SHORT_LENGTH},}})|(?:{ASSIGNED})|{RUN}"), 0)).otherwise(inside)
    none = F.array().cast("array<struct<run:string,start:int>>")
    step = lambda acc, r: (lambda at: F.struct((at + F.length(r)).alias("at"), F.concat(acc["out"], F.array(F.struct(r.alias("run"), (at - 1).alias("start")))).alias("out")))(
        F.call_function("locate", r, word, acc["at"])
    )
    return F.aggregate(found, F.struct(F.lit(1).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def _exploded(rows: DataFrame) -> DataFrame:
    """A row per run of ``word`` that is long, or short beside a keyword or an assignment: candidate, char_pos, prefix, suffix."""
    rows = rows.select("*", F.explode(_runs(F.col("word"), F.rlike(F.concat_ws(" ", "before2", "before"), F.lit(LED)))).alias("r")).select("*", F.col("r.run").alias("candidate"), F.col("r.start").cast("long").alias("char_pos")).drop("r")
    rows = rows.withColumn("prefix", F.expr("substring(word, 1, cast(char_pos AS int))"))
    rows = rows.withColumn("suffix", F.expr("substring(word, cast(char_pos AS int) + length(candidate) + 1)"))
    beside = F.rlike(F.concat_ws(" ", "before2", "before", "prefix"), F.lit(BESIDE))
    return rows.where(((F.length("candidate") >= MIN_LENGTH) & F.rlike("candidate", F.lit(CANDIDATE))) | beside)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, word_pos, char_pos, candidate, what the word has around it, the word and the two words before it and the one after."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, f"{WS_CLASS}+"), lambda w: w != "")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.rlike(text, F.lit(BESIDE)).alias("marks"), F.when(F.rlike(text, F.lit(CANDIDATE)) | F.rlike(text, F.lit(BESIDE)), words).alias("w")).where("w IS NOT NULL")
    marked = F.when(F.col("marks"), F.transform("w", lambda x: F.rlike(x, F.lit(BESIDE))))
    rows = rows.withColumn("m", marked)
    mark = lambda i: F.coalesce(F.get("m", i), F.lit(False))
    short = lambda x, i: F.col("marks") & (mark(i) | mark(i - 1) | mark(i - 2)) & F.rlike(x, F.lit(f"{VALUE}{{{SHORT_LENGTH},}}"))
    spots = F.transform("w", lambda x, i: F.when((F.length(x) >= SHORT_LENGTH) & (((F.length(x) >= MIN_LENGTH) & F.rlike(x, F.lit(CANDIDATE))) | short(x, i)), i))
    rows = rows.select("id", "w", F.explode(F.filter(spots, lambda i: i.isNotNull())).alias("i"))
    at = lambda k: F.coalesce(F.get("w", F.col("i") + k), F.lit(""))
    rows = rows.select("id", F.col("i").cast("long").alias("word_pos"), at(0).alias("word"), at(-1).alias("before"), at(-2).alias("before2"), at(1).alias("after"))
    return _exploded(rows)


def _share(pattern: str, c: Column) -> Column:
    return F.regexp_count(c, F.lit(pattern)) / F.length(c)


class Language(NamedTuple):
    words: DataFrame  # word, one row each
    pairs: dict[str, float]  # log2 probability of the letter pairs a-z that words have
    sample: list[str]


def language(docs: DataFrame, text_col: str = "text") -> Language:
    """The dictionary of all documents and the letter pairs of its words; at most 676 pairs and SAMPLE_WORDS words come to the driver."""
    spark = docs.sparkSession
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    runs = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(r"\p{L}{3,24}"), 0))).alias("word"))
    own = runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_DOCUMENTS).select("word")
    base = spark.createDataFrame([(w,) for w in BASE_WORDS], "word string")
    words = cut(own.unionByName(base).distinct(), "secret-words")
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("pair"))
    counts = pairs.where(F.rlike("pair", F.lit("^[a-z]{2}$"))).groupBy("pair").agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["n"] for r in counts) + 676
    sample = words.where(F.rlike("word", F.lit("^[a-z]{3,12}$"))).orderBy(F.md5("word"), "word").limit(SAMPLE_WORDS).collect()
    return Language(words, {r["pair"]: math.log2((r["n"] + 1) / total) for r in counts} | {"": math.log2(1 / total)}, [r["word"] for r in sample])


def _covered(found: DataFrame, words: DataFrame) -> DataFrame:
    """(key, covered): how many characters of each distinct candidate lie in words of the dictionary; none, no row."""
    c = F.col("candidate")
    distinct = found.select(F.unhex(F.md5(c)).alias("key"), "candidate").distinct()
    pieces = F.concat(F.regexp_extract_all(c, F.lit(r"\p{L}+"), 0), F.filter(F.regexp_extract_all(c, F.lit("[A-Z]?[a-z]+|[A-Z]+"), 0), lambda x: ~F.array_contains(F.regexp_extract_all(c, F.lit(r"\p{L}+"), 0), x)))
    parts = distinct.select("key", F.explode(F.filter(F.transform(pieces, F.lower), lambda x: F.length(x) >= 3)).alias("word"))
    return parts.join(words, "word").groupBy("key").agg(F.sum(F.length("word")).alias("covered"))


def with_features(found: DataFrame, known: Language) -> DataFrame:
    """The columns of FEATURES for candidates with prefix, suffix, before and before2."""
    covered = small_side(cut(_covered(found, known.words), "secret-covered"))
    found = found.join(covered.withColumnRenamed("key", "_key"), F.unhex(F.md5("candidate")) == F.col("_key"), "left").drop("_key")
    c, around = F.col("candidate"), F.lower(F.concat_ws(" ", "before2", "before", "prefix"))
    near = F.concat(F.expr("right(prefix, 1)"), c, F.expr("left(suffix, 1)"))
    changes = F.regexp_count(c, F.lit("(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]|(?<=[a-z])[A-Z]"))
    table = F.create_map(*[F.lit(x) for pair in known.pairs.items() for x in pair])
    both = F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(F.lower(c), i, F.lit(2)))
    scores = F.transform(F.filter(both, lambda x: F.rlike(x, F.lit("^[a-z]{2}$"))), lambda x: F.coalesce(F.try_element_at(table, x), F.lit(known.pairs[""])))
    columns = {
        "length": F.length(c).cast("double"),
        "transitions": changes / F.length(c),
        "digits": _share("[0-9]", c),
        "upper": _share("[A-Z]", c),
        "coverage": F.least(F.lit(1.0), F.coalesce("covered", F.lit(0)) / F.length(c)),
        "pairs": F.coalesce(F.try_divide(F.aggregate(scores, F.lit(0.0), lambda s, x: s + x), F.size(scores).cast("double")), F.lit(-9.4)),
        "repeats": 1 - F.size(F.array_distinct(both)) / F.greatest(F.lit(1), F.length(c) - 1),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.length(c),
        "slashes": _share("[/]", c),
        "dots": _share("[.]", c),
        "keyword_near": F.rlike(around, F.lit(KEYWORDS)).cast("double"),
        "assigned": ((F.rlike("before", F.lit("[=:]$")) & ~F.rlike("prefix", F.lit("[A-Za-z0-9]"))) | F.rlike("prefix", F.lit("[=:][\"'`]?$"))).cast("double"),
        "address": F.rlike(near, F.lit("@|^:?//|[A-Za-z][.](com|net|org|io|html?)")).cast("double"),
        "quoted": F.rlike(F.concat(F.expr("right(prefix, 1)"), F.expr("left(suffix, 1)")), F.lit("[\"'`]")).cast("double"),
    }
    named = F.concat_ws(" ", F.lower("before2"), F.lower("before"), F.lower("prefix"))
    columns |= {
        "symbols": _share(r"[^A-Za-z0-9+/_\-.~=]", c),
        "public_near": F.rlike(named, F.lit(rf"(?:^|[^a-z0-9])(?:{PUBLIC})[\"'`]?[^a-z0-9]*(?: |$)[^a-z0-9]*$|(?:^|[^a-z0-9])(?:{PUBLIC})[\"'`]?\s*[=:(#]?\s*(?:is )?[\"'`(]*$")).cast("double"),
        "fingerprint": F.when(F.rlike(c, F.lit(r"^(?:[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}|[0-9A-F]{8}-(?:[0-9A-F]{4}-){3}[0-9A-F]{12})$")), 2.0).when(F.rlike(c, F.lit(r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})$")), 1.0).otherwise(0.0),
    }
    return found.withColumns(columns)


def labelled_findings(spark: SparkSession, words: list[str], n: int = FINDINGS) -> DataFrame:
    """``n`` labelled findings by rule, half of them secrets: candidate, word, before, before2, after, label.

    Secrets: hex, base-64 and prefixed keys in assignments, headers and plain prose. Others: long words, paths,
    hosts, mail addresses, repeated placeholders, and fingerprints: revisions, checksums and ids beside the words that name
    them. A fourth is short: mixed keys, some with signs, and words with digits against plain words, numbers, dates and
    file names, each after a keyword or an assignment.
    """
    h = lambda salt: F.sha2(F.concat_ws(":", F.lit(salt), F.col("id")), 256)
    groups = F.array(*[F.lit(w) for w in words])
    letters = lambda salt, k, by="": F.array_join(
        F.transform(F.sequence(F.lit(1), k), lambda j: F.element_at(groups, (F.pmod(F.xxhash64(F.lit(salt), F.col("id"), j), F.lit(len(words))) + 1).cast("int"))), by
    )
    b64 = F.regexp_replace(F.base64(F.unhex(h("b"))), "[=\r\n]", "")
    size = (F.pmod(F.xxhash64("id"), F.lit(25)) + 20).cast("int")
    pick = lambda k: F.pmod(F.xxhash64(F.lit("p"), F.col("id")), F.lit(k))
    secret = F.when(pick(4) == 0, F.substring(h("a"), 1, 40)).when(pick(4) == 1, F.substring(b64, F.lit(1), size)).when(pick(4) == 2, F.upper(F.substring(h("c"), 1, 40)))
    secret = secret.otherwise(F.concat(F.element_at(F.array(*[F.lit(x) for x in ("AKIA", "ghp_", "sk-", "xoxb-")]), (pick(16) / 4).cast("int") + 1), F.substring(b64, F.lit(1), size)))
    many = F.pmod(F.xxhash64("id"), F.lit(4)).cast("int") + 3
    path = F.concat(F.lit("https://"), letters("h", F.lit(1)), F.lit(".example.com/"), letters("i", F.lit(2), "-"), F.lit("/"), letters("j", F.lit(2), "/"))
    host = F.concat(letters("k", F.lit(1)), pick(10).cast("string"), F.lit(".example."), F.element_at(F.array(F.lit("com"), F.lit("net"), F.lit("org")), (pick(3) + 1).cast("int")))
    mail = F.concat(letters("m", F.lit(1)), F.lit("."), pick(100).cast("string"), F.lit("@"), host)
    unit = F.repeat(F.substring(b64, F.lit(1), (pick(3) + 1).cast("int")), 12)
    number = F.translate(F.substring(h("d"), F.lit(1), size), "abcdef", "012345")
    other = F.when(pick(7) == 0, letters("w", many)).when(pick(7) == 1, letters("w", many, "-")).when(pick(7) == 2, F.when(pick(2) == 0, letters("w", many, "_")).otherwise(number)).when(pick(7) == 3, path).when(pick(7) == 4, mail).when(pick(7) == 5, host).otherwise(F.when(pick(3) == 0, F.rpad(F.lit(""), size, F.substring(h("x"), 1, 1))).otherwise(unit))
    key = F.element_at(F.array(*[F.lit(k) for k in ("token", "secret", "password", "api_key", "TOKEN", "Bearer", "access_key")]), (pick(7) + 1).cast("int"))
    prose = letters("q", F.lit(1))
    rows = spark.range(0, n, 1, 4).withColumn("label", (F.col("id") % 2).cast("double"))
    in_prose = F.when(F.col("label") == 1, pick(5) == 4).otherwise(F.lit(True))
    few = pick(10).cast("int") + SHORT_LENGTH
    sign = F.element_at(F.array(*[F.lit(x) for x in ("", "&", "#", "@", "$", "%", "!", "")]), (F.pmod(F.xxhash64(F.lit("g"), F.col("id")), F.lit(8)) + 1).cast("int"))
    mixed = F.concat(F.substring(b64, F.lit(1), few - 2), sign, F.substring(h("n"), 1, 2))
    typed = F.concat(letters("s", F.lit(1)), F.element_at(F.array(*[F.lit(x) for x in ("", "-", "_")]), (pick(3) + 1).cast("int")), F.pmod(F.xxhash64(F.lit("t"), F.col("id")), F.lit(9000)) + 1000, F.when(pick(5) < 3, letters("u", F.lit(1))).otherwise(F.lit("")))
    day = F.concat(F.lit(2000) + pick(30), F.lit("-"), F.lpad((pick(12) + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((pick(28) + 1).cast("string"), 2, "0"))
    plain = F.when(pick(9) <= 4, letters("v", (pick(2) + 1).cast("int"))).when(pick(9) == 5, day).when(pick(9) == 6, F.repeat((pick(90) + 10).cast("string"), 3))
    plain = plain.when(pick(9) == 7, F.concat(letters("y", F.lit(1)), F.lit("."), letters("z", F.lit(1)))).otherwise(F.initcap(letters("v", (pick(2) + 1).cast("int"))))
    short = F.pmod(F.xxhash64(F.lit("short"), F.col("id")), F.lit(4)) == 0
    secret, other = F.when(short, F.when(pick(2) == 0, mixed).otherwise(typed)).otherwise(secret), F.when(short, plain).otherwise(other)
    # Fingerprints of public things, beside the words for them; ids stand bare too.
    digest = F.element_at(F.array(F.substring(h("e"), 1, 40), F.substring(h("e"), 1, 32), h("e"), F.upper(F.substring(h("e"), 1, 40))), (pick(4) + 1).cast("int"))
    uuid = F.concat_ws("-", F.substring(h("f"), 1, 8), F.substring(h("f"), 9, 4), F.substring(h("f"), 13, 4), F.substring(h("f"), 17, 4), F.substring(h("f"), 21, 12))
    public = (F.col("label") == 0) & ~short & (F.pmod(F.xxhash64(F.lit("public"), F.col("id")), F.lit(3)) == 0)
    is_id = F.pmod(F.xxhash64(F.lit("uuid"), F.col("id")), F.lit(3)) == 0
    named = F.element_at(F.array(*[F.lit(x) for x in ("commit", "revision", "sha256", "sha1:", "md5", "etag", "ETag:", "checksum", "digest", "hash", "fingerprint:", "blob")]), (pick(12) + 1).cast("int"))
    numbered = F.element_at(F.array(*[F.lit(x) for x in ("id", "uuid", "user_id", "request_id", "id:", "session_id")]), (pick(6) + 1).cast("int"))
    beside = F.when(is_id, F.when(pick(2) == 0, letters("q", F.lit(1))).otherwise(numbered)).otherwise(named)
    joined = F.when(public & ~is_id & (pick(4) == 3), F.lit("sha256:")).otherwise(F.lit(""))
    value = F.when(F.col("label") == 1, secret).when(public, F.when(is_id, uuid).otherwise(digest)).otherwise(other)
    rows = rows.withColumn("value", value).withColumn("prose", F.when(F.col("label") == 1, in_prose & ~short).otherwise(public | ~short | (pick(2) == 0))).withColumns({"public": public, "beside": beside, "joined": joined})
    rows = rows.select(
        "label",
        F.when(F.col("prose"), F.concat("joined", "value", F.when(pick(3) == 0, F.lit(".")).otherwise(F.lit("")))).otherwise(F.concat(F.lit('"'), "value", F.lit('"'))).alias("word"),
        F.when(F.col("public"), F.col("beside")).when(F.col("prose") & short, key).when(F.col("prose"), prose).otherwise(F.lit("=")).alias("before"),
        F.when(F.col("prose"), prose).otherwise(key).alias("before2"),
        prose.alias("after"),
    )
    return _exploded(rows)


def train(findings: DataFrame, known: Language, seed: int = SEED) -> RandomForestClassificationModel:
    """A random forest over FEATURES; ``findings`` has the columns of ``labelled_findings``."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(findings, known))
    return RandomForestClassifier(labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=seed).fit(rows.select("label", "features"))


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, word_pos, char_pos, secret, probability of every candidate that the forest takes for a secret.

    Whole texts are scanned; every run of token characters of a word is looked at by itself, ``char_pos`` is its start in
    the word. Runs under MIN_LENGTH count only beside a keyword or an assignment, those under SHORT_LENGTH never. Null and empty
    texts give none. Repeated rows give their findings each; null ids pass through; other columns are ignored.
    """
    known = language(docs, text_col)
    model = train(cut(labelled_findings(docs.sparkSession, known.sample), "secret-findings") if findings is None else findings, known)
    found = with_features(cut(candidates(docs, id_col, text_col), "secret-candidates"), known)
    scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found))
    scored = scored.withColumn("p", vector_to_array("probability")[1]).where("p >= 0.5")
    return scored.select(F.col("id").alias(id_col), "word_pos", "char_pos", F.col("candidate").alias("secret"), F.round("p", 6).alias("probability"))
