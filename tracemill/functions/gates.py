"""Boolean functions of a byte, one per output bit: truth columns are bits of longs, and every gate is tried by bit operations.

The examples of a prompt are the bits of words of WORD bits: bit e of an input's word is that input in example e. A gate
of up to four inputs is then one bit operation for all examples of a word, and it fits an output bit if the words agree.
"""

from __future__ import annotations

import re
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import parse
from tracemill.functions.puzzle import GATES
from tracemill.sources.files import cut

#: Examples a word holds; the bit above them is the question's.
WORD = 62
#: A byte has so many values, so no more examples can be distinct.
WORDS = -(-256 // WORD)
_PRODUCTS = [[c for k, c in enumerate("abcd") if p >> k & 1] for p in range(16)]


def _sum_of_products(sql: str) -> tuple[int, ...]:
    """The products of a, b, c and d (by their bits in 0 to 15) whose exclusive sum is the gate."""
    one = [eval(sql, {c: p >> k & 1 for k, c in enumerate("abcd")}) & 1 for p in range(16)]  # noqa: S307  the library's own table
    for k in range(4):
        one = [x ^ (one[p ^ (1 << k)] if p >> k & 1 else 0) for p, x in enumerate(one)]
    return tuple(p for p in range(16) if one[p])


def candidates() -> list[tuple[str, tuple[int, ...], tuple[int, ...]]]:
    """Every gate in the order in which it is tried, the simplest first: name, inputs, and the products that add up to it.

    Constants; each input and its negation; all pairs, each gate followed by its negation; all triples; all quadruples.
    """
    not_ = lambda products: tuple(sorted({0} ^ set(products)))
    out = [("CONST_0", (), ()), ("CONST_1", (), (0,))]
    for i in range(8):
        out += [(f"b[{i}]", (i,), (1,)), (f"NOT_b[{i}]", (i,), (0, 1))]
    made = {name: _sum_of_products(sql) for name, _, sql in GATES}
    for n in (2, 3, 4):
        for at in combinations(range(8), n):
            for name in (g for g, arity, _ in GATES if arity == n):
                shown = f"{name}({','.join(f'b[{i}]' for i in at)})"
                out.append((shown, at, made[name]))
                if n == 2:
                    out.append((f"NOT_{shown}", at, not_(made[name])))
    return out


def _gate_sql(word: dict[str, str]) -> str:
    """The gate's output word: the exclusive sum of the products of its inputs' words that its masks p0 to p15 let through."""
    return "(" + " ^ ".join("(" + " & ".join([f"p{p}", *(word[c] for c in product)]) + ")" for p, product in enumerate(_PRODUCTS)) + ")"


def _byte(c: Column) -> Column:
    return F.conv(F.when(F.rlike(c, F.lit("^[01]{8}$")), c), 2, 10).cast("int")


def _words(values: str, question: str) -> str:
    """Per word the eight columns of the bytes ``values``, bit 0 the leftmost of a byte; the question's bit is bit WORD of word 0."""
    bit = lambda x, i: f"(shiftright({x}, 7 - {i}) & 1)"
    column = f"aggregate(slice({values}, w * {WORD} + 1, {WORD}), struct(0L AS s, 0 AS e), (z, x) -> struct(z.s | shiftleft(CAST({bit('x', 'i')} AS BIGINT), z.e) AS s, z.e + 1 AS e), z -> z.s)"
    asked = f"IF(w = 0, shiftleft(CAST({bit(question, 'i')} AS BIGINT), {WORD}), 0L)" if question else "0L"
    return f"transform(sequence(0, {WORDS - 1}), w -> transform(sequence(0, 7), i -> {column} | {asked}))"


def per_bit(df: DataFrame, key: str, prompt: Column) -> DataFrame:
    """(key, rules, answer): per output bit the first gate that all examples keep; no answer if a bit has none, or without examples.

    ``key`` must be unique. All gates are tried on all examples of every row; what fits is combined before it is shuffled.
    """
    pairs = F.array_distinct(F.filter(F.transform(parse.arrows(prompt), lambda e: F.struct(_byte(e["x"]).alias("x"), _byte(e["y"]).alias("y"))), lambda e: e["x"].isNotNull() & e["y"].isNotNull()))
    rows = df.select(F.col(key).alias("key"), pairs.alias("pairs"), _byte(parse.asked(prompt, "output for")).alias("q"))
    # Written down, as the words below look into these arrays again and again.
    rows = cut(rows.select("key", F.size("pairs").alias("n"), F.transform("pairs", lambda e: e["x"]).alias("xs"), F.transform("pairs", lambda e: e["y"]).alias("ys"), "q", F.sha2(F.to_json(F.struct("pairs", "q")), 256).alias("same")), "gate-examples")
    # Equal examples and questions, told by a SHA-256 of them, are solved once, by the smallest of their keys.
    firsts = cut(rows.groupBy("same").agg(F.min("key").alias("first")), "gate-firsts")
    rows = rows.join(firsts, "same")
    bits = rows.where("n > 0 AND q IS NOT NULL AND key <=> first")
    bits = bits.select("key", "n", F.expr(_words("xs", "q")).alias("ins"), F.expr(_words("ys", "")).alias("outs"))
    # Which outputs a word of the first WORD examples fits, as bits: one look-up for a gate, however many outputs there are.
    hits = "map_from_arrays(array_distinct(outs[0]), transform(array_distinct(outs[0]), x -> aggregate(sequence(0, 7), 0, (s, j) -> s | IF(outs[0][j] = x, shiftleft(1, j), 0))))"
    bits = cut(bits.select("key", "n", "ins", "outs", F.expr("ins[0]").alias("in0"), F.expr(hits).alias("fits"), F.expr(f"IF(n >= {WORD}, shiftleft(1L, {WORD}) - 1, shiftleft(1L, n) - 1)").alias("mask")), "gate-words")
    listed = candidates()
    masks = [f"p{p}" for p in range(16)]
    rows_ = [(o, name, *(*at, 0, 0, 0, 0)[:4], *(-1 if p in products else 0 for p in range(16))) for o, (name, at, products) in enumerate(listed)]
    gates = df.sparkSession.createDataFrame(rows_, "o int, name string, i0 int, i1 int, i2 int, i3 int, " + ", ".join(f"{m} long" for m in masks))
    tried = bits.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(len(listed) - 1)))).join(F.broadcast(gates), "o")  # a fixed table
    tried = tried.select("*", *[F.expr(f"in0[i{k}]").alias(c) for k, c in enumerate("abcd")]).withColumn("f", F.expr(_gate_sql({c: c for c in "abcd"})))
    fits = tried.withColumn("hits", F.expr("try_element_at(fits, f & mask)")).where("hits IS NOT NULL")
    bit = fits.select("key", "n", "ins", "outs", "o", "name", "i0", "i1", "i2", "i3", *masks, "f", F.explode(F.expr("filter(sequence(0, 7), j -> shiftright(hits, j) & 1 = 1)")).alias("j"))
    # Examples beyond the first word are looked at for what fits it only.
    later = _gate_sql({c: f"ins[w][i{k}]" for k, c in enumerate("abcd")})
    later = f"(n <= {WORD} OR forall(sequence(1, {WORDS - 1}), w -> (({later} ^ outs[w][j]) & IF(n >= (w + 1) * {WORD}, shiftleft(1L, {WORD}) - 1, shiftleft(1L, greatest(n - w * {WORD}, 0)) - 1)) = 0))"
    first = bit.where(F.expr(later)).groupBy("key", "j").agg(F.min(F.struct("o", "name", F.expr(f"shiftright(f, {WORD}) & 1").alias("v"))).alias("m"))
    told = first.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("j", "m.name", "m.v"))).alias("bits"))
    answer = F.when(F.size("bits") == 8, F.array_join(F.transform("bits", lambda b: b["v"].cast("string")), ""))
    named = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.coalesce(F.try_element_at(F.filter("bits", lambda b: b["j"] == j), F.lit(1))["name"], F.lit("unknown")))
    posed = rows.select("key", "first", ((F.col("n") > 0) & F.col("q").isNotNull()).alias("posed"))
    told = cut(told.withColumnRenamed("key", "first"), "gate-told")
    return posed.join(told, "first", "left").select(F.col("key").alias(key), F.when(F.col("posed"), named).alias("rules"), answer.alias("answer"))
