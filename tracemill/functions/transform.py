"""Equation transformations: a character map, or a rule per operator at a fixed place, learnt from a prompt's own examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import parse
from tracemill.functions.puzzle import numeric_operations

#: Characters that may be operators (fixed values).
OPERATORS = "+-*/|^<>?!@#$%&~':;,="
#: Whole numbers longer than this are no operands of the numeric rules.
DIGITS = 9
#: Confidence of an answer by how it was found (fixed values).
WHOLE_MAP, BY_OPERATOR, PARTIAL_MAP = 1.0, 0.9, 0.3


def _letters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def examples(c: Column) -> Column:
    """(x, y) of the lines with a left and a right side between the heading of the examples and the question."""
    body = F.regexp_extract(c, r"(?is)below are a few examples[^\n]*\n(.*)$", 1)
    lines = F.transform(F.split(body, "\n"), parse.strip)
    end = F.array_position(F.transform(lines, lambda x: F.contains(F.lower(x), F.lit("now, determine"))), True)
    lines = F.when(end > 0, F.slice(lines, F.lit(1), F.greatest(F.lit(0), end.cast("int") - 1))).otherwise(lines)

    def sides(line: Column) -> Column:
        at, wide = F.instr(line, " = "), F.instr(line, " = ") > 0
        at = F.when(wide, at).otherwise(F.instr(line, "="))
        left, right = F.substring(line, F.lit(1), at - 1), F.substring(line, at + F.when(wide, 3).otherwise(1), F.length(line))
        return F.when(at > 0, F.struct(parse.strip(left).alias("x"), parse.strip(right).alias("y")))

    return F.filter(F.transform(lines, sides), lambda e: e.isNotNull() & (e["x"] != "") & (e["y"] != ""))


def question(c: Column) -> Column:
    return F.nullif(parse.strip(F.regexp_extract(c, r"(?imd)determine the result for:[^\S\n]*(.+)$", 1)), F.lit(""))


def _met(pairs: Column) -> Column:
    """(c, p) of all characters that meet in pairs of equal length, in order."""
    same = F.filter(pairs, lambda e: F.length(e["x"]) == F.length(e["y"]))
    return F.flatten(F.transform(same, lambda e: F.arrays_zip(_letters(e["x"]).alias("c"), _letters(e["y"]).alias("p"))))


def _first_images(met: Column, keys: Column) -> Column:
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(met, lambda z: z["c"] == k), 1)["p"]))


def mapped(table: Column, text: Column, unknown: str) -> Column:
    return F.array_join(F.transform(_letters(text), lambda ch: F.coalesce(F.try_element_at(table, ch), F.lit(unknown))), "")


def operator_place(lefts: Column) -> Column:
    """Place, from 1, of the operator in left sides of one length: the first inner one with operator characters only, else the most varied one."""
    n = F.length(F.try_element_at(lefts, F.lit(1)))
    at = lambda i: F.transform(lefts, lambda x: F.substring(x, i, F.lit(1)))
    inner = F.when(n > 2, F.sequence(F.lit(2), n - 1)).otherwise(F.array().cast("array<int>"))
    signs = F.try_element_at(F.filter(inner, lambda i: F.forall(at(i), lambda x: F.instr(F.lit(OPERATORS), x) > 0)), F.lit(1))
    spread = F.transform(F.sequence(F.lit(1), n), lambda i: F.size(F.array_distinct(at(i))))
    varied = F.array_position(spread, F.array_max(spread)).cast("int")
    varied = F.when((F.array_max(spread) > 1) & (varied > 1) & (varied < n), varied)
    return F.when(F.size(F.array_distinct(F.transform(lefts, F.length))) == 1, F.coalesce(signs, varied))


def _characterwise(left: Column, right: Column, calc) -> Column:
    codes = F.zip_with(_letters(left), _letters(right), lambda a, b: F.char(calc(F.ascii(a), F.ascii(b))))
    plain = F.rlike(F.concat(left, right), F.lit(r"^[\x00-\x7f]*$"))
    return F.when((F.length(left) == F.length(right)) & plain, F.array_join(codes, ""))


def rule_results(left: Column, op: Column, right: Column) -> Column:
    """(name, result) of all rules in the order in which they are tried: the numeric ones where both sides are numbers, else those on texts."""
    number = lambda x: F.rlike(x, F.lit("^[0-9]{1,%d}$" % DIGITS))  # noqa: E731, UP031
    both = number(left) & number(right)
    whole = lambda x: F.when(both, x).cast("long")
    numeric = F.transform(numeric_operations(whole(left), whole(right)), lambda r: F.struct(r["op"].alias("name"), r["result"].cast("string").alias("result")))
    back = F.reverse
    differ = F.array_join(F.filter(F.zip_with(_letters(left), _letters(right), lambda a, b: F.when(~a.eqNullSafe(b) & a.isNotNull() & b.isNotNull(), a)), lambda x: x.isNotNull()), "")
    texts = (
        ("delete_op", F.concat(left, right)),
        ("concat_ba", F.concat(right, left)),
        ("keep_left", left),
        ("keep_right", right),
        ("concat_rev_left_right", F.concat(back(left), right)),
        ("concat_left_rev_right", F.concat(left, back(right))),
        ("concat_rev_both", F.concat(back(left), back(right))),
        ("op_left_right", F.concat(op, left, right)),
        ("op_right_left", F.concat(op, right, left)),
        ("sym_diff_op", F.concat(op, differ)),
        ("zip_xor", _characterwise(left, right, lambda a, b: a.bitwiseXOR(b))),
        ("zip_and", _characterwise(left, right, lambda a, b: a.bitwiseAND(b))),
        ("zip_or", _characterwise(left, right, lambda a, b: a.bitwiseOR(b))),
        ("zip_add_mod", _characterwise(left, right, lambda a, b: (a + b) % 128)),
        ("zip_sub_mod", _characterwise(left, right, lambda a, b: F.pmod(a - b, F.lit(128)))),
    )
    return F.concat(numeric, F.array(*[F.struct(F.lit(name).alias("name"), x.alias("result")) for name, x in texts]))


def equation_transform(df: DataFrame, prompt: Column) -> DataFrame:
    """``df`` with answer, confidence and rule of an equation prompt; the answer is null where nothing fits.

    A character map that all examples keep and that knows the whole question comes first; then the first rule that all
    examples with the question's operator keep; then the known part of the map alone, with little confidence. Numeric rules
    count only if all those examples have numbers on both sides. Steps are columns, so that no expression is built twice.
    """
    c, kept = F.col, df.columns
    df = df.withColumns({"_pairs": examples(prompt), "_q": question(prompt)})
    df = df.withColumn("_met", _met(c("_pairs"))).withColumn("_keys", F.array_distinct(F.transform("_met", lambda z: z["c"])))
    df = df.withColumns({"_table": _first_images(c("_met"), c("_keys")), "_lefts": F.transform("_pairs", lambda e: e["x"])})
    df = df.withColumn("_place", F.when(F.length(F.try_element_at("_lefts", F.lit(1))) == F.length("_q"), operator_place(c("_lefts"))))
    at = lambda x: F.substring(x, c("_place"), F.lit(1))
    parts = lambda x: [F.substring(x, F.lit(1), c("_place") - 1).alias("l"), at(x).alias("o"), F.substring(x, c("_place") + 1, F.length(x)).alias("r")]
    same = F.filter("_pairs", lambda e: at(e["x"]) == at(c("_q")))
    df = df.withColumns({"_same": F.transform(same, lambda e: F.struct(*parts(e["x"]), e["y"].alias("y"))), "_asked": F.struct(*parts(c("_q")))})
    tried = lambda z: rule_results(z["l"], z["o"], z["r"])
    df = df.withColumns({"_tried": F.transform("_same", lambda z: F.struct(tried(z).alias("rules"), z["y"].alias("y"))), "_asked": tried(c("_asked"))})
    fits = F.filter(F.sequence(F.lit(1), F.size("_asked")), lambda i: F.forall("_tried", lambda m: F.coalesce(F.element_at(m["rules"], i)["result"] == m["y"], F.lit(False))))
    df = df.withColumn("_rule", F.when((F.size("_same") > 0) & c("_place").isNotNull(), F.try_element_at(F.transform(fits, lambda i: F.element_at("_asked", i)), F.lit(1))))
    sized = F.forall("_pairs", lambda e: (F.length(e["x"]) == F.length(e["y"])) & (mapped(c("_table"), e["x"], "\x00") == e["y"]))
    whole = sized & F.forall(_letters(c("_q")), lambda ch: F.map_contains_key("_table", ch)) & (F.size("_keys") > 0)
    df = df.withColumns({"_whole": whole, "_part": F.nullif(mapped(c("_table"), c("_q"), ""), F.lit(""))})
    out = lambda answer, confidence, name: F.struct(answer.alias("answer"), F.lit(confidence).alias("confidence"), name.alias("rule"))
    asks = c("_q").isNotNull() & (F.size("_pairs") > 0)
    told = (
        F.when(asks & c("_whole"), out(c("_part"), WHOLE_MAP, F.lit("character map")))
        .when(asks & (F.coalesce(c("_rule.result"), F.lit("")) != ""), out(c("_rule.result"), BY_OPERATOR, c("_rule.name")))
        .when(asks & c("_part").isNotNull(), out(c("_part"), PARTIAL_MAP, F.lit("part of the map")))
        .otherwise(out(F.lit(None).cast("string"), 0.0, F.lit(None).cast("string")))
    )
    df = df.withColumn("_told", told)
    return df.select(*kept, "_told.answer", "_told.confidence", "_told.rule")
