"""Spelling variants by a trie self-join: active nodes within distance one travel down a vocabulary trie.

The trie is a table of nodes (prefix, parent, last character), dealt out by prefix. At every level a pair of nodes at
distance one starts where two siblings differ or where a node meets its own parent (an inserted character), and travels
on to the children of both that carry the same character. Pairs whose two nodes end words are the answer. A node has at
most as many children as the alphabet has letters, so no join has a hot key, and a signature of what lies below a node
drops pairs that have no common ending ahead of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import cut, small_side

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[a-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT = 6, 5
#: One run in so many loses a character.
SLIP = 199
#: A form stands at least this many times as often as its word.
FORM_RATIO = 5
#: Levels of the trie; what two words share beyond them is met by hashes of the words less one character.
LEVELS = 24
#: Rows of a trie level, of about 60 bytes, up to which it is broadcast; a larger one is joined by shuffles.
LEVEL_ROWS = 200_000
#: Endings of words are told apart by so many characters.
ENDING = 3
_PRIME, _BASE = 2**61 - 1, 1_000_003


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the runs of letters of all texts, slips included, of MIN_LENGTH or more and MIN_COUNT occurrences or more.

    Null texts have no runs; a null id counts as an empty one in the slip's hash.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.translate(F.col(text_col), UPPER, LOWER).alias("text"))
    runs = rows.select("id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= MIN_LENGTH)  # a slip only shortens
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(h % SLIP == 0, slipped).otherwise(F.col("run"))
    counted = runs.select(word.alias("word")).where(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= MIN_COUNT)


def _trie(vocabulary: DataFrame) -> DataFrame:
    """(depth, node, parent, ch, ends, tails): all prefixes up to LEVELS; ``tails`` has a bit per (length, last characters) of what is below."""
    depths = vocabulary.select("word", F.length("word").alias("size")).withColumn("depth", F.explode(F.sequence(F.lit(1), F.least("size", F.lit(LEVELS)))))
    left = F.col("size") - F.col("depth")
    ending = F.when(left == 0, F.lit("")).otherwise(F.right("word", F.least(left, F.lit(ENDING))))
    bit = F.expr("shiftleft(1L, CAST(pmod(hash(left_, ending), 64) AS INT))")
    rows = depths.select("depth", F.substring("word", F.lit(1), F.col("depth")).alias("node"), (left == 0).alias("ends"), left.alias("left_"), ending.alias("ending"))
    nodes = rows.groupBy("depth", "node").agg(F.max("ends").alias("ends"), F.bit_or(bit).alias("tails"))
    parent = F.substring("node", F.lit(1), F.col("depth") - 1)
    return nodes.select("depth", "node", parent.alias("parent"), F.right("node", F.lit(1)).alias("ch"), "ends", "tails")


def _meet(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b) != 0


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(a, b): every unordered pair of the distinct words at distance exactly one, once.

    ``vocabulary`` has a column ``word`` without nulls or repeats. A pair is found at its first difference: two
    siblings, or a node and its parent where the inserted character is the last of its run, so no pair comes twice.
    """
    vocabulary = cut(vocabulary.select("word"), "spelling-words")
    trie = cut(_trie(vocabulary).repartitionByRange("depth", "node").sortWithinPartitions("depth"), "spelling-trie")
    deepest = trie.agg(F.max("depth")).first()[0] or 0
    level = lambda k: small_side(trie.where(F.col("depth") == k).drop("depth"), LEVEL_ROWS)
    named = lambda df, s: df.select(*[F.col(c).alias(c + s) for c in df.columns])
    emitted, active = [], None
    upper = None  # the level above
    for k in range(1, deepest + 1):
        here = level(k)
        x, y = named(here, "_x"), named(here, "_y")
        keep = [F.col("node_x").alias("x"), F.col("node_y").alias("y")]
        flags = [(F.col("ends_x") & F.col("ends_y")).alias("both"), F.lit(False).alias("inserted"), F.lit(None).cast("string").alias("skip")]
        made = x.join(y, (F.col("parent_x") == F.col("parent_y")) & (F.col("ch_x") < F.col("ch_y")) & _meet(F.col("tails_x"), F.col("tails_y"))).select(*keep, *flags)
        inserted = [F.lit(True).alias("inserted"), F.col("ch_x").alias("skip")]
        if upper is None:
            made = made.unionByName(x.select(F.col("node_x").alias("x"), F.lit("").alias("y"), F.lit(False).alias("both"), *inserted))
        else:
            z = named(upper, "_y")
            own = x.join(z, (F.col("parent_x") == F.col("node_y")) & _meet(F.col("tails_x"), F.col("tails_y")))
            made = made.unionByName(own.select(*keep, flags[0], *inserted))
            # Both sides go on by the same character; after an insertion the shorter side is a level behind.
            on = (F.col("y") == F.col("parent_y")) & (F.col("ch_x") == F.col("ch_y")) & _meet(F.col("tails_x"), F.col("tails_y"))
            grown = active.join(x, (F.col("x") == F.col("parent_x")) & (F.col("skip").isNull() | (F.col("ch_x") != F.col("skip"))))
            for kind, other in ((False, y), (True, z)):
                went = grown.where(F.col("inserted") == kind).join(other, on)
                made = made.unionByName(went.select(*keep, flags[0], F.lit(kind).alias("inserted"), F.lit(None).cast("string").alias("skip")))
        active = cut(made, f"spelling-level{k}")
        emitted.append(active.where("both").select(F.col("x").alias("a"), F.col("y").alias("b")))
        upper = here
    if deepest == LEVELS:
        emitted += _below(vocabulary, active)
    if not emitted:
        return vocabulary.select(F.col("word").alias("a"), F.col("word").alias("b")).limit(0)
    out = emitted[0]
    for more in emitted[1:]:
        out = out.unionByName(more)
    return out


def _below(vocabulary: DataFrame, active: DataFrame) -> list[DataFrame]:
    """Pairs of words that go on below the last level: those that differed above it, and those that share it whole."""
    long = vocabulary.where(F.length("word") > LEVELS).select("word", F.substring("word", 1, LEVELS).alias("head"), F.expr(f"substring(word, {LEVELS + 1})").alias("rest"))
    going = active.join(long, F.col("x") == F.col("head")).where(F.col("skip").isNull() | ~F.startswith("rest", F.col("skip")))
    ended = going.select(F.col("word").alias("a"), F.concat("y", "rest").alias("b")).join(vocabulary, F.col("b") == F.col("word"), "left_semi")
    # Words that share LEVELS characters: numbered, so that rows of long words stay small.
    shared = vocabulary.where(F.length("word") >= LEVELS).withColumn("head", F.substring("word", 1, LEVELS))
    heads = shared.groupBy("head").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("head")
    deep = cut(shared.join(heads, "head").select("word", F.monotonically_increasing_id().alias("w")), "spelling-deep")
    keys = cut(deep.mapInArrow(_less_one, "w long, at int, run_end boolean, key long"), "spelling-less-one")
    one, two = (keys.where("at >= 0").select("at", "key", F.col("w").alias(w)) for w in "ab")
    replaced = one.join(two, ["at", "key"]).where("a < b").select("a", "b")
    whole = keys.where("at < 0").select("key", F.col("w").alias("b"))
    shorter = keys.where("run_end").select("key", F.col("w").alias("a")).join(whole, "key").select("a", "b")
    pairs = replaced.unionByName(shorter)
    a, b = (deep.select(F.col("w").alias(w), F.col("word").alias(f"word_{w}")) for w in "ab")
    told = pairs.join(a, "a").join(b, "b")
    # Equal hashes are no proof: the words are compared behind their first difference.
    both = F.least(F.length("word_a"), F.length("word_b"))
    told = told.withColumn("from_", F.array(F.lit(LEVELS), both)).withColumn("from_", _first_difference("word_a", "word_b", "from_"))
    tail = lambda c, longer: F.expr(f"substring({c}, from_ + {2 if longer else 1})")
    size = F.length("word_a") - F.length("word_b")
    fits = F.when(size == 0, tail("word_a", True) == tail("word_b", True)).when(size == 1, tail("word_a", True) == tail("word_b", False)).otherwise(False)
    return [ended, told.where(fits).select(F.col("word_a").alias("a"), F.col("word_b").alias("b"))]


def _first_difference(a: str, b: str, at: str) -> Column:
    """How many characters two strings share, by halving the array (known to be shared, known end); 32 halvings reach any length."""
    step = lambda s, _: F.when(
        F.substring(F.col(a), F.lit(1), F.ceil((s[0] + s[1]) / 2).cast("int")) == F.substring(F.col(b), F.lit(1), F.ceil((s[0] + s[1]) / 2).cast("int")),
        F.array(F.ceil((s[0] + s[1]) / 2).cast("int"), s[1]),
    ).otherwise(F.array(s[0], (F.ceil((s[0] + s[1]) / 2) - 1).cast("int")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.col(at), lambda s, i: F.when(s[0] >= s[1], s).otherwise(step(s, i)), lambda s: s[0])


def _less_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word its own hash (at -1) and that of the word less each character from LEVELS on, in time linear in its length."""
    schema = pa.schema([("w", pa.int64()), ("at", pa.int32()), ("run_end", pa.bool_()), ("key", pa.int64())])
    for batch in batches:
        for word, w in zip(batch.column(0), batch.column(1), strict=True):
            codes = [ord(c) for c in word.as_py()]
            before = [0]
            for c in codes:
                before.append((before[-1] * _BASE + c) % _PRIME)
            ats, ends, keys, after, power = [-1], [False], [before[-1]], 0, 1
            for i in range(len(codes) - 1, LEVELS - 1, -1):
                ats.append(i)
                ends.append(i + 1 == len(codes) or codes[i] != codes[i + 1])
                keys.append((before[i] * power + after) % _PRIME)
                after, power = (codes[i] * power + after) % _PRIME, power * _BASE % _PRIME
            yield pa.RecordBatch.from_arrays([pa.array([w.as_py()] * len(ats), pa.int64()), pa.array(ats, pa.int32()), pa.array(ends), pa.array(keys, pa.int64())], schema=schema)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of all words that have a form, each round twice as far along; a form is more frequent, so chains end."""
    at = cut(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts.

    Null and empty texts have no words; repeated rows and ids count each; of equally frequent near words the first in
    code-point order is the form; other columns are ignored; an empty table gives an empty result.
    """
    vocabulary = cut(words(docs, id_col, text_col), "spelling-vocabulary")
    pairs = cut(near_pairs(vocabulary), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    near = both.join(vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").join(vocabulary, "word")
    best = F.min(F.when(F.col("other_n") >= FORM_RATIO * F.col("n"), F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))))
    found = cut(near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")).select("word", "n_near", "best.form", (-F.col("best.less")).alias("form_n")), "spelling-forms")
    roots = _roots(found.where("form IS NOT NULL"))
    out = vocabulary.join(found, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


#: The same rows: the hash of slips byte by byte, and near words by the words less one character.
ORACLE_SQL = f"""WITH RECURSIVE tbl AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
d AS (SELECT id, run, count(*) AS m FROM runs WHERE length(run) >= {MIN_LENGTH} GROUP BY ALL),
b AS (SELECT run, m, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 + (unicode(c) >> 6))::BIGINT, (128 + (unicode(c) & 63))::BIGINT] END)) AS bytes FROM d),
h AS (SELECT run, m, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM b, tbl),
w AS (SELECT CASE WHEN h % {SLIP} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, m FROM h),
v AS (SELECT word, sum(m)::BIGINT AS n FROM w WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(m) >= {MIN_COUNT}),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
 UNION SELECT a.word, a.n, v.word, v.n FROM less a JOIN v ON a.rest = v.word UNION SELECT v.word, v.n, a.word, a.n FROM less a JOIN v ON a.rest = v.word),
f AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -other_n, form := other)) FILTER (other_n >= {FORM_RATIO} * n) AS best FROM near GROUP BY word),
k AS (SELECT v.word, v.n, coalesce(f.n_near, 0) AS n_near, f.best.form AS form, -f.best.less AS form_n FROM v LEFT JOIN f USING (word)),
r AS (SELECT word, word AS at FROM k UNION ALL SELECT r.word, k.form FROM r JOIN k ON r.at = k.word WHERE k.form IS NOT NULL)
SELECT k.word, k.form, r.at AS root, k.n, k.n_near, k.form_n FROM k JOIN r ON r.word = k.word JOIN k e ON e.word = r.at WHERE e.form IS NULL"""
