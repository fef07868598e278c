"""Searches over puzzles as tables: partial assignments of symbols, one row each, grown by joins with what fits a template.

A word of symbols and a partial assignment make a template: known symbols as their values, the others as marks in the
order in which they first stand there. The words that fit it are those with the same template under the same open
places, so one equality join finds them all, equal symbols get equal values and unlike ones unlike values. Assignments
are never cut short: those that agree on all that later words ask for are one row with their number, so what is stored
is what still matters, and answers are counted without being written out.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import parse, solve
from tracemill.sources.files import cut, spread

#: Pairs of one cipher's partial answers and candidates that a task looks at before they are parted further.
PAIRS = 1_000_000
#: Rows of template tables, of about 50 bytes, up to which they are broadcast.
BROADCAST_ROWS = 200_000
#: Marks of open places, none of which is a digit or a letter.
MARKS = "".join(chr(0xE000 + k) for k in range(64))
#: Operations on two numbers of two digits (fixed values); results are the digits of numbers from 0 to 9999.
OPERATIONS = (("add", "l + r"), ("abs_diff", "abs(l - r)"), ("mul", "l * r"), ("concat", "l * 100 + r"), ("rev_concat", "r * 100 + l"))


def small(df: DataFrame) -> DataFrame:
    """Broadcast hint if the table, cut before, has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def letters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def _open_template(values: Column, open_: Column) -> Column:
    """The values with a mark in place of each whose place is open, one mark per distinct value."""
    distinct = F.array_distinct(F.filter(F.zip_with(values, open_, lambda v, o: F.when(o, v)), lambda x: x.isNotNull()))
    mark = lambda v: F.substring(F.lit(MARKS), F.array_position(distinct, v).cast("int"), F.lit(1))
    return F.array_join(F.zip_with(values, open_, lambda v, o: F.when(o, mark(v)).otherwise(v)), "")


def _open_places(word: Column, known: Column) -> Column:
    """Per place of a word, an array of (s, lit), whether its symbol is neither a literal nor known."""
    return F.transform(word, lambda x: ~x["lit"] & ~F.map_contains_key(known, x["s"]))


def _told(word: Column, known: Column) -> Column:
    return F.transform(word, lambda x: F.when(x["lit"], x["s"]).otherwise(F.coalesce(F.try_element_at(known, x["s"]), x["s"])))


def _templates(states: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """States with ``template``, ``open`` and ``new`` (the distinct unknown symbols), and the facts under the open places that the states have.

    ``states`` has word and known, ``facts`` text; only sizes and open places that occur are made, so the second table has
    at most as many rows as facts times kinds of open places.
    """
    open_ = _open_places(F.col("word"), F.col("known"))
    states = states.withColumn("open_", open_).withColumn("template", _open_template(_told(F.col("word"), F.col("known")), F.col("open_")))
    states = states.withColumn("new", F.array_distinct(F.filter(F.zip_with("word", "open_", lambda x, o: F.when(o, x["s"])), lambda x: x.isNotNull())))
    kinds = cut(states.select("open_", F.size("open_").alias("size")).distinct(), "search-kinds")
    made = facts.withColumn("values_", letters(F.col("text"))).join(small(kinds), F.size("values_") == F.col("size"))
    made = made.withColumn("ftemplate", F.concat(_open_template(F.col("values_"), F.col("open_")), _shape("open_")))
    values = F.array_distinct(F.filter(F.zip_with("values_", "open_", lambda v, o: F.when(o, v)), lambda x: x.isNotNull()))
    made = made.withColumn("values", values).drop("values_", "open_", "size", "text")
    return states.withColumn("template", F.concat("template", _shape("open_"))).drop("open_"), cut(made, "search-templates")


def _shape(open_: str) -> Column:
    return F.concat(F.lit("|"), F.array_join(F.transform(open_, lambda o: F.when(o, ".").otherwise("#")), ""))


def _grown(states: DataFrame, facts: DataFrame, nodes: int | None, fits: Column) -> tuple[DataFrame, DataFrame | None]:
    """The states' children over ``facts``, and, if ``nodes`` is given, the keys left out as they would have more than that.

    States keep their columns, ``known`` extended; facts add theirs. No child takes a value of ``known`` or ``used`` again.
    ``fits`` is a further condition over both.
    """
    states, made = _templates(states, facts)
    made, over = small(made), None
    if nodes is not None:
        counts = small(cut(made.groupBy("ftemplate").agg(F.count(F.lit(1)).alias("m")), "search-counts"))
        most = states.join(counts, F.col("template") == F.col("ftemplate")).groupBy("key").agg(F.sum(F.col("m") * F.col("n")).alias("m"))
        over = cut(most.where(F.col("m") > nodes).select("key"), "search-open")
        states = states.join(small(over), "key", "left_anti")
    # A row of few bytes meets many facts, so the states are dealt to all tasks whatever their size.
    grown = spread(states, "key", "known", "used").join(made, F.col("template") == F.col("ftemplate"))
    grown = grown.where(fits & ~F.arrays_overlap(F.concat(F.map_values("known"), "used"), F.col("values")))
    return grown.withColumn("known", F.map_concat("known", F.map_from_arrays("new", "values"))).drop("template", "ftemplate", "new", "values", "word"), over


def _merged(states: DataFrame) -> DataFrame:
    """States (key, known, ops, used, n) that agree on all that is still asked for, as one with their number.

    Of ``known`` and ``ops`` only what the columns ``ahead`` and ``signs`` name stays; the values of other symbols go to ``used``,
    where it no longer matters which symbol has which.
    """
    later = lambda s: F.array_contains("ahead", s)
    known, ops = F.map_entries("known"), F.map_entries("ops")
    gone = F.transform(F.filter(known, lambda e: ~later(e["key"])), lambda e: e["value"])
    states = states.select(
        "key", F.array_sort(F.filter(known, lambda e: later(e["key"]))).alias("known"), F.array_sort(F.filter(ops, lambda e: F.array_contains("signs", e["key"]))).alias("ops"),
        F.array_sort(F.concat("used", gone)).alias("used"), "n",
    )
    merged = states.groupBy("key", "known", "ops", "used").agg(F.sum("n").alias("n"))
    return merged.select("key", F.map_from_entries("known").alias("known"), F.map_from_entries("ops").alias("ops"), "used", "n")


def _facts(spark: SparkSession) -> DataFrame:
    """(text, op, result): two digits, two digits and the digits of the result, for every operation; 50,000 rows."""
    pairs = spark.range(10_000).select(F.expr("id div 100 AS l"), F.expr("id % 100 AS r"))
    made = pairs.select("l", "r", F.explode(F.array(*[F.struct(F.lit(name).alias("op"), F.expr(sql).alias("v")) for name, sql in OPERATIONS])).alias("o"))
    digits = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    made = made.where("o.v BETWEEN 0 AND 9999").select(digits("l").alias("lt"), digits("r").alias("rt"), "o.op", F.col("o.v").cast("string").alias("result"))
    return cut(made.select(F.concat("lt", "rt").alias("operands"), "op", "result"), "search-facts")


def _symbols(text: Column, digits_are_literal_from: int) -> Column:
    """(s, lit) of every character; digits stand for themselves from a place on."""
    return F.transform(letters(text), lambda x, i: F.struct(x.alias("s"), ((i >= digits_are_literal_from) & F.rlike(x, F.lit("[0-9]"))).alias("lit")))


def _renamed(words: Column, seen: Column) -> Column:
    """Words of (s, lit) with a mark in place of every symbol that is not a literal, by its place among ``seen``."""
    mark = lambda x: F.substring(F.lit(MARKS), F.array_position(seen, x["s"]).cast("int"), F.lit(1))
    return F.transform(words, lambda w: F.transform(w, lambda x: F.struct(F.when(x["lit"], x["s"]).otherwise(mark(x)).alias("s"), x["lit"].alias("lit"))))


def _puzzles(rows: DataFrame) -> DataFrame:
    """``rows`` (key, examples, q) with symbols and operators renamed in the order in which they first stand there.

    Which symbols stand for the digits is of no matter to the search: prompts that differ by names alone become equal.
    """
    asked = _symbols(F.concat(F.substring("q", 1, 2), F.substring("q", 4, 2)), 5)
    rows = rows.withColumn("words", F.concat(F.transform("examples", lambda e: e["word"]), F.array(asked)))
    rows = rows.withColumn("signs", F.concat(F.transform("examples", lambda e: e["sign"]), F.array(F.substring("q", 3, 1))))
    rows = rows.withColumn("seen", F.array_distinct(F.transform(F.filter(F.flatten("words"), lambda x: ~x["lit"]), lambda x: x["s"])))
    rows = rows.withColumn("met", F.array_distinct("signs"))
    fits = (F.size("seen") <= len(MARKS)) & (F.size("met") <= len(MARKS))
    words = F.when(fits, _renamed(F.col("words"), F.col("seen"))).otherwise(F.col("words"))
    sign = lambda x: F.substring(F.lit(MARKS), F.array_position("met", x).cast("int"), F.lit(1))
    signs = F.when(fits, F.transform("signs", sign)).otherwise(F.col("signs"))
    rows = rows.select("key", words.alias("words"), signs.alias("signs"))
    n = F.size("words") - 1
    examples = F.zip_with(F.slice("words", F.lit(1), n), F.slice("signs", F.lit(1), n), lambda w, x: F.struct(w.alias("word"), x.alias("sign")))
    return rows.select("key", examples.alias("examples"), F.element_at("words", -1).alias("qword"), F.element_at("signs", -1).alias("qsign"))


def cryptarithms(df: DataFrame, key: str, prompt: Column, nodes: int | None = None) -> DataFrame:
    """(key, answer, status, solutions, answers) of prompts whose digits and operators are hidden behind symbols.

    Lines 'xyOzw = result' of five and one to four characters are the examples, 'result for: xyOzw' asks. Symbols stand for
    distinct digits, operator symbols for one of OPERATIONS each; digits in a result stand for themselves. All
    assignments that keep all examples are found, the most constrained example first; symbols and operators that stand
    in the question alone are tried too. The answer is the result that most assignments give: status 'ok', or 'tie' without
    an answer if two results are given equally often; 'none' if no assignment is left, 'unparsed' without examples or a
    question. The search is whole; only a caller who gives ``nodes`` has puzzles left 'open' of which a step would make more
    assignments. ``key`` must be unique. Prompts that are equal but for the names of their symbols are searched once.
    """
    spark = df.sparkSession
    lines = F.transform(F.split(prompt, "\n"), parse.strip)
    matched = F.filter(lines, lambda x: F.rlike(x, F.lit(r"^\S{5}\s*=\s*\S{1,4}$")))
    part = lambda x, k: F.regexp_extract(x, r"^(\S{5})\s*=\s*(\S{1,4})$", k)
    word = lambda x: F.concat(F.substring(part(x, 1), 1, 2), F.substring(part(x, 1), 4, 2), part(x, 2))
    examples = F.transform(matched, lambda x: F.struct(_symbols(word(x), 4).alias("word"), F.substring(part(x, 1), 3, 1).alias("sign")))
    asked = F.nullif(F.regexp_extract(prompt, r"(?i)Now,\s+determine\s+the\s+result\s+for:\s*(\S{5})(?!\S)", 1), F.lit(""))
    rows = cut(df.select(F.col(key).alias("key"), examples.alias("examples"), asked.alias("q")), "search-prompts")
    facts = _facts(spark)
    whole = facts.select(F.concat("operands", "result").alias("text"), "op")
    # Examples by the number of facts of their form, the fewest first.
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    named = cut(_puzzles(rows.where((F.size("examples") > 0) & F.col("q").isNotNull())), "search-named")
    puzzle = ["examples", "qword", "qsign"]
    parsed = cut(named.groupBy(*puzzle).agg(F.min("key").alias("key")), "search-puzzles")  # a puzzle goes by the smallest of its keys
    forms = parsed.select("key", F.posexplode("examples").alias("i", "e")).select("key", "i", F.col("e.word").alias("word"), "e.sign", none.alias("known"))
    forms, made = _templates(forms, whole)
    counts = small(cut(made.groupBy("ftemplate").agg(F.count(F.lit(1)).alias("m")), "search-forms"))
    ranked = forms.join(counts, F.col("template") == F.col("ftemplate"), "left").groupBy("key")
    ordered = ranked.agg(F.array_sort(F.collect_list(F.struct(F.coalesce("m", F.lit(0)).alias("m"), "i", "word", "sign"))).alias("steps"))
    steps = cut(ordered.join(parsed.select("key", "qword", "qsign"), "key"), "search-steps")
    states = cut(steps.select("key", none.alias("known"), none.alias("ops"), F.array().cast("array<string>").alias("used"), F.lit(1).cast("long").alias("n")), "search-start")
    longest = steps.agg(F.max(F.size("steps"))).first()[0] or 0
    steps = small(steps)
    sign_fits = F.coalesce(F.try_element_at("ops", F.col("sign")) == F.col("op"), F.lit(True))
    learnt = F.when(F.map_contains_key("ops", F.col("sign")), F.col("ops")).otherwise(F.map_concat("ops", F.map_from_arrays(F.array("sign"), F.array("op"))))
    left_open: list[DataFrame] = []
    for k in range(longest):
        left = f"slice(steps, {k + 2}, size(steps))"
        ahead = F.expr(f"transform(filter(concat(flatten({left}.word), qword), x -> NOT x.lit), x -> x.s)")
        step = steps.where(F.size("steps") > k).select("key", F.expr(f"steps[{k}].word").alias("word"), F.expr(f"steps[{k}].sign").alias("sign"), ahead.alias("ahead"), F.expr(f"concat({left}.sign, array(qsign))").alias("signs"))
        done = states.join(steps.where(F.size("steps") <= k).select("key"), "key", "left_semi")
        grown, over = _grown(states.join(step, "key"), whole, nodes, sign_fits)
        left_open.append(over)
        states = cut(_merged(grown.withColumn("ops", learnt)).unionByName(done), f"search-step{k}")
    last = states.join(steps.select("key", F.col("qword").alias("word"), F.col("qsign").alias("sign")), "key")
    grown, over = _grown(last, facts.select(F.col("operands").alias("text"), "op", "result"), nodes, sign_fits)
    left_open.append(over)
    votes = cut(grown.groupBy("key", "result").agg(F.sum("n").alias("n")), "search-votes")
    best = F.max(F.struct("n", "result"))
    told = votes.groupBy("key").agg(best.alias("best"), F.sum("n").alias("solutions"), F.count(F.lit(1)).alias("answers"))
    tied = votes.join(told.select("key", F.col("best.n").alias("n")), ["key", "n"]).groupBy("key").agg((F.count(F.lit(1)) > 1).alias("tied"))
    opened = _union(x if x is not None else parsed.select("key").limit(0) for x in left_open).distinct().withColumn("is_open", F.lit(True))
    found = cut(parsed.join(told.join(tied, "key"), "key", "left").join(opened, "key", "left").withColumnRenamed("key", "first").drop(*puzzle), "search-found")
    of = named.join(parsed.select(*puzzle, F.col("key").alias("first")), puzzle).select("key", "first")
    out = rows.join(of.join(small(found), "first"), "key", "left")
    status = F.when((F.size("examples") == 0) | F.col("q").isNull(), "unparsed").when(F.col("is_open"), "open").when(F.col("best").isNull(), "none").when(F.col("tied"), "tie").otherwise("ok")
    out = out.withColumn("status", status)
    counted = lambda c: F.when(F.col("status").isin("ok", "tie"), F.col(c)).otherwise(F.lit(0)).cast("long").alias(c)
    return out.select(F.col("key").alias(key), F.when(F.col("status") == "ok", F.col("best.result")).alias("answer"), "status", counted("solutions"), counted("answers"))


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    out = None
    for frame in frames:
        out = frame if out is None else out.unionByName(frame)
    return out


# --- ciphers


def _arc_consistent(candidates: DataFrame) -> tuple[DataFrame, int]:
    """Candidates (key, w, pairs, plain) whose letters all words of their key that share them support, and the rounds it took.

    A plain letter of a cipher letter stays if every word with that letter has a candidate for it; a letter with one plain
    letter left takes it from the others. The rounds end when none goes: a key's table has at most a row per two letters.
    """
    words = candidates.select("key", "w", F.explode("pairs.c").alias("c")).distinct().groupBy("key", "c").agg(F.count(F.lit(1)).alias("words"))
    words = cut(words, "search-words")
    n, rounds = candidates.count(), 0
    while True:
        rounds += 1
        domain = candidates.select("key", "w", F.explode("pairs").alias("z")).select("key", "w", "z.c", "z.p").distinct().groupBy("key", "c", "p").agg(F.count(F.lit(1)).alias("n"))
        kept = domain.join(words, ["key", "c"]).where(F.col("n") == F.col("words")).select("key", "c", "p")
        by_letter = kept.groupBy("key", "c").agg(F.collect_set("p").alias("ps"))
        per_key = by_letter.groupBy("key").agg(F.collect_list(F.struct("c", "ps")).alias("letters"))
        forced = F.transform(F.filter("letters", lambda x: F.size(x["ps"]) == 1), lambda x: F.struct(x["c"].alias("c"), x["ps"][0].alias("p")))
        allowed = F.flatten(F.transform("letters", lambda x: F.transform(x["ps"], lambda p: F.struct(x["c"].alias("c"), p.alias("p")))))
        free = per_key.select("key", "letters", forced.alias("forced")).select("key", "forced", allowed.alias("allowed"))
        free = free.select("key", F.filter("allowed", lambda a: ~F.exists("forced", lambda f: (f["p"] == a["p"]) & (f["c"] != a["c"]))).alias("allowed"))
        candidates = cut(candidates.join(free, "key").where(F.forall("pairs", lambda z: F.array_contains("allowed", z))).drop("allowed"), "search-arcs")
        left = candidates.count()
        if left == n:
            return candidates, rounds
        n = left


def _combined(needed: DataFrame, candidates: DataFrame, nodes: int | None) -> tuple[DataFrame, DataFrame, int]:
    """(key, n, t0, t1, ...) of every cipher with an answer, the keys left open, and the largest number of words.

    ``needed`` has the words of a cipher in ``order``, (m, w, new): its candidates, its place and its unknown letters. ``n`` is the
    number of ways in which candidates of all words go together, t the ids of those taken if there is but one. After a
    word, ways that are alike in the letters of the words to come and in the plain letters used are one row; so are the
    candidates alike in them before they are joined.
    """
    pairs = "array<struct<c:string,p:string>>"
    among = lambda x, s: F.filter(x, lambda z: F.array_contains(s, z["c"]))
    apart = lambda x, s: F.filter(x, lambda z: ~F.array_contains(s, z["c"]))
    plain = lambda x: F.transform(x, lambda z: z["p"])
    letters_of = lambda at, n: F.expr(f"array_distinct(flatten(slice(order, {at}, {n}).new))")
    states = needed.select("key", F.array().cast(pairs).alias("known"), F.array().cast("array<string>").alias("used"), F.lit(1).cast("long").alias("n"))
    longest = needed.agg(F.max(F.size("order"))).first()[0] or 0
    left_open = needed.select("key").limit(0)
    for k in range(longest):
        step = needed.where(F.size("order") > k).select("key", F.expr(f"order[{k}].w").alias("w"), F.expr(f"order[{k}].m").alias("m"), F.expr(f"order[{k}].new").alias("new"), letters_of(1, k).alias("met"), letters_of(k + 2, "size(order)").alias("ahead"))
        done = states.join(needed.where(F.size("order") <= k).select("key"), "key", "left_semi")
        going = states.join(step.select("key", "new", "ahead"), "key")
        sizes = cut(states.groupBy("key").agg(F.count(F.lit(1)).alias("s"), F.sum("n").alias("n")).join(step.select("key", "m"), "key"), "search-sizes")
        if nodes is not None:
            over = cut(sizes.where(F.col("n") * F.col("m") > nodes).select("key"), "search-over")
            left_open, going = left_open.unionByName(over), going.join(small(over), "key", "left_anti")
        # Of a cipher with many pairs the states are dealt to parts, and every part has all candidates.
        parts = F.least("s", F.ceil(F.col("s") * F.col("m") / PAIRS)).cast("int")
        wide = small(cut(sizes.select("key", parts.alias("parts")).where("parts > 1"), "search-wide"))
        going = going.join(wide, "key", "left").withColumn("part", F.coalesce(F.pmod(F.hash("known", "used"), "parts"), F.lit(0)))
        going = going.withColumn("shared", F.array_sort(among("known", F.col("new")))).drop("new", "parts")
        fresh = apart("pairs", F.col("met"))
        alike = candidates.join(step.select("key", "w", "met", "ahead"), ["key", "w"]).select(
            "key", "id", F.array_sort(among("pairs", F.col("met"))).alias("shared"), F.array_sort(among(fresh, F.col("ahead"))).alias("fresh"), F.array_sort(plain(apart(fresh, F.col("ahead")))).alias("gone"),
        )
        alike = alike.groupBy("key", "shared", "fresh", "gone").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias(f"t{k}"))
        alike = alike.join(wide, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        # A row of few bytes meets many candidates, so both sides are dealt to all tasks whatever their size.
        at = ["key", "shared", "part"]
        grown = spread(going, *at).join(spread(alike, *at), at).where(~F.arrays_overlap(F.concat(plain("fresh"), "gone"), F.concat(plain("known"), "used")))
        used = F.when(F.size("ahead") > 0, F.array_sort(F.concat("used", plain(apart("known", F.col("ahead"))), "gone"))).otherwise(F.array().cast("array<string>"))
        ways = grown.select("key", F.array_sort(F.concat(among("known", F.col("ahead")), "fresh")).alias("known"), used.alias("used"), (F.col("n") * F.col("m")).alias("n"), *[f"t{j}" for j in range(k + 1)])
        states = ways.groupBy("key", "known", "used").agg(F.sum("n").alias("n"), *[F.min(f"t{j}").alias(f"t{j}") for j in range(k + 1)])
        states = cut(states.unionByName(done.withColumn(f"t{k}", F.lit(None).cast("long"))), f"search-words{k}")
    return states.drop("known", "used"), left_open, longest


def cipher_words(df: DataFrame, key: str, prompt: Column, vocabulary: DataFrame, nodes: int | None = None) -> DataFrame:
    """(key, answer, status, answers) of substitution ciphers; what the examples leave unknown comes from a vocabulary.

    ``vocabulary`` has a column word of distinct words. A prompt's examples must give a map that is one to one both ways
    ('conflict' otherwise). If it knows all letters of the question, the status is 'mapped'. Else every word with unknown
    letters takes the vocabulary's words that fit its length, pattern and known letters; words whose letters other words
    do not support are taken out until none goes, and what is left is combined, the word with the fewest first. A single
    answer is 'recovered'; several are 'ambiguous', none is 'none', both without an answer. All combinations count: those
    alike in the letters that later words ask for are one row with their number. Only a caller who gives ``nodes`` has
    ciphers left 'open' of which a step would make more. 'unparsed' without examples or a question. ``key`` must be unique.
    Equal prompts are solved once.
    """
    given = cut(df.select(F.col(key).alias("of"), prompt.alias("prompt")), "search-given")
    first = cut(given.groupBy("prompt").agg(F.min("of").alias("key")), "search-prompts")  # a prompt goes by the smallest of its keys
    pairs, q = parse.arrows(F.col("prompt")), parse.asked(F.col("prompt"), "decrypt")
    letter = lambda x: F.rlike(x, F.lit(r"^\p{L}$"))
    met = F.flatten(F.transform(pairs, lambda e: F.arrays_zip(letters(e["x"]).alias("c"), letters(e["y"]).alias("p"))))
    even = F.forall(pairs, lambda e: F.length(e["x"]) == F.length(e["y"])) & F.forall(met, lambda z: (z["c"] == " ") == (z["p"] == " "))
    rows = first.select("key", q.alias("q"), F.size(pairs).alias("n"), even.alias("even"), F.array_distinct(F.filter(met, lambda z: letter(z["c"]) & letter(z["p"]))).alias("met"))
    one = F.coalesce(F.col("even") & solve.consistent_both_ways(F.col("met")), F.lit(False))
    rows = rows.withColumn("good", one & (F.col("n") > 0) & F.col("q").isNotNull())
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    known = F.when(F.col("good"), F.map_from_entries("met")).otherwise(none)
    word = lambda w: F.transform(letters(w), lambda x: F.struct(x.alias("s"), (~letter(x)).alias("lit")))
    rows = rows.withColumn("known", known).withColumn("words", F.when(F.col("good"), F.transform(F.split("q", " "), word)))
    rows = cut(rows.drop("met", "even"), "search-ciphers")
    # Candidates of every word with an unknown letter.
    each = spread(rows.where("good"), "key").select("key", "known", F.posexplode("words").alias("w", "word"))
    asked = each.where(F.exists(_open_places(F.col("word"), F.col("known")), lambda o: o))
    states, made = _templates(asked, spread(vocabulary.select("word")).select(F.col("word").alias("text"), F.col("word").alias("plain")))
    fits = states.join(small(made), F.col("template") == F.col("ftemplate")).where(~F.arrays_overlap(F.map_values("known"), F.col("values")))
    pairs_ = F.arrays_zip(F.col("new").alias("c"), F.col("values").alias("p"))
    candidates = cut(fits.select("key", "w", pairs_.alias("pairs"), "plain", F.monotonically_increasing_id().alias("id")), "search-candidates")
    candidates, _ = _arc_consistent(candidates)
    per_word = candidates.groupBy("key", "w").agg(F.count(F.lit(1)).alias("m"))
    needed = states.select("key", "w", "new").join(per_word, ["key", "w"], "left").groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("m", F.lit(0)).alias("m"), "w", "new"))).alias("order"))
    needed = cut(needed, "search-order")
    found, left_open, longest = _combined(needed, candidates, nodes)
    # The words of a single answer are looked up, the others are but counted.
    taken = found.where("n = 1").select("key", F.explode(F.array(*[f"t{k}" for k in range(longest)], F.lit(None).cast("long"))).alias("id")).where("id IS NOT NULL")
    chosen = taken.join(candidates.select("key", "id", "w", "plain"), ["key", "id"]).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct(F.col("w").cast("string"), "plain"))).alias("chosen"))
    single = chosen.join(rows.select("key", "words", F.col("known").alias("map")), "key")
    text = F.array_join(F.transform("words", lambda x, i: F.coalesce(F.try_element_at("chosen", i.cast("string")), F.array_join(_told(x, F.col("map")), ""))), " ")
    told = found.select("key", F.col("n").alias("answers")).join(single.select("key", text.alias("text")), "key", "left")
    opened = left_open.distinct().withColumn("is_open", F.lit(True))
    out = rows.join(told, "key", "left").join(opened, "key", "left").join(needed.select("key", F.lit(True).alias("short")), "key", "left")
    direct = F.array_join(F.transform("words", lambda x: F.array_join(_told(x, F.col("known")), "")), " ")
    status = (
        F.when((F.col("n") == 0) | F.col("q").isNull(), "unparsed").when(~F.col("good"), "conflict").when(F.col("short").isNull(), "mapped")
        .when(F.col("is_open"), "open").when(F.col("answers").isNull(), "none").when(F.col("answers") > 1, "ambiguous").otherwise("recovered")
    )
    out = out.withColumn("status", status)
    answer = F.when(F.col("status") == "mapped", direct).when(F.col("status") == "recovered", F.col("text"))
    answers = F.when(F.col("status") == "mapped", 1).when(F.col("status") != "open", F.coalesce("answers", F.lit(0))).otherwise(0)
    solved = cut(out.select("key", answer.alias("answer"), "status", answers.cast("long").alias("answers")), "search-solved")
    told = first.join(solved, "key").withColumnRenamed("prompt", "asked")
    return given.join(told, F.col("prompt").eqNullSafe(F.col("asked"))).select(F.col("of").alias(key), "answer", "status", "answers")
