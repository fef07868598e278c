"""Solvers of the puzzle families as expressions over the parsed examples: prompt in, answer out (null where it abstains)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import parse
from tracemill.functions.parse import let
from tracemill.functions.puzzle import from_roman, to_roman


def _mean(values: Column) -> Column:
    return let(values, lambda v: F.try_divide(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), F.size(v).cast("double")))


def _lower_median(values: Column) -> Column:
    return let(F.array_sort(values), lambda v: F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")))


def _two_places(x: Column) -> Column:
    """Two decimals of the number's exact binary value, ties to even; Spark's own formats round its shortest decimal form instead.

    x * 100 is p + e exactly, e from a split of x into two halves whose products with 100 are exact. Null of null.
    """

    def split(y: Column) -> Column:
        return F.struct(y.alias("y"), (y * 100.0).alias("p"), (y * 134217729.0 - (y * 134217729.0 - y)).alias("high"))

    def over(s: Column) -> Column:
        low = F.floor(s["p"])
        return F.struct(low.alias("low"), ((s["p"] - (low + 0.5)) + ((s["high"] * 100.0 - s["p"]) + (s["y"] - s["high"]) * 100.0)).alias("over"))

    def cents(s: Column) -> Column:
        return (s["low"] + F.when((s["over"] > 0) | ((s["over"] == 0) & (s["low"] % 2 == 1)), 1).otherwise(0)).cast("long")

    def shown(v: Column, c: Column) -> Column:
        return F.concat(F.when((v < 0) & (c > 0), "-").otherwise(""), F.floor(c / 100).cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))

    return let(x, lambda v: let(let(let(F.abs(v), split), over), lambda s: let(cents(s), lambda c: shown(v, c))))


def _square(x: Column) -> Column:
    return let(x, lambda v: v * v)


def _cut(x: Column, places: int) -> Column:
    """Decimals beyond ``places`` are cut, not rounded."""
    return F.floor(x * 10**places) / 10**places


def gravity(prompt: Column) -> Column:
    """Falling distance from the mean of 2 d / t^2 over the examples."""
    g = _mean(F.transform(parse.falls(prompt), lambda e: 2.0 * e["y"].cast("double") / (e["x"].cast("double") * e["x"].cast("double"))))
    return _two_places(0.5 * g * _square(parse.asked_time(prompt).cast("double")))


def gravity_by_median(prompt: Column) -> Column:
    """Falling distance from the lower median of d / t^2, cut to three decimals, as the traced solver has it."""
    k = _lower_median(F.transform(parse.falls(prompt), lambda e: _cut(e["y"].cast("double") / (e["x"].cast("double") * e["x"].cast("double")), 3)))
    return _two_places(k * _square(parse.asked_time(prompt).cast("double")))


def conversion(prompt: Column, median: bool = False) -> Column:
    """Converted measurement from the mean (or the lower median) of the examples' ratios."""
    ratios = F.transform(parse.conversions(prompt), lambda e: e["y"].cast("double") / e["x"].cast("double"))
    factor = _lower_median(ratios) if median else _mean(ratios)
    return _two_places(factor * parse.asked_length(prompt).cast("double"))


def numeral(prompt: Column) -> Column:
    """(answer, confidence): roman or decimal, in the direction of the first example; 0.5 if an example is not standard."""
    examples, q = parse.arrows(prompt), parse.asked_number(prompt)
    whole, roman = (lambda c: F.rlike(c, F.lit("^[0-9]+$"))), (lambda c: F.rlike(c, F.lit("(?i)^[IVXLCDM]+$")))
    first = F.try_element_at(examples, F.lit(1))
    to, back = whole(first["x"]) & roman(first["y"]), roman(first["x"]) & whole(first["y"])
    number = F.when(whole(q), q.try_cast("int"))
    answer = F.when(back, F.when(roman(q), from_roman(F.upper(q)).cast("string"))).otherwise(to_roman(number))
    odd = F.exists(examples, lambda e: whole(e["x"]) & ~(F.upper(e["y"]) == to_roman(F.when(whole(e["x"]), e["x"].try_cast("int")))))
    confidence = F.when(to & odd, 0.5).when(to | back, 1.0).otherwise(0.7)
    has = first.isNotNull() & answer.isNotNull()
    return F.struct(F.when(has, answer).alias("answer"), F.when(has, confidence).otherwise(0.0).alias("confidence"))


def letter_map(prompt: Column) -> Column:
    """(c, p) of every letter in word pairs of equal count and length, in order of the prompt."""
    words = F.flatten(F.transform(F.filter(parse.arrows(prompt), lambda e: F.size(F.split(e["x"], r"\s+")) == F.size(F.split(e["y"], r"\s+"))), lambda e: F.arrays_zip(F.split(e["x"], r"\s+").alias("x"), F.split(e["y"], r"\s+").alias("y"))))
    same = F.filter(words, lambda w: F.length(w["x"]) == F.length(w["y"]))
    return F.flatten(F.transform(same, lambda w: F.arrays_zip(F.split(w["x"], "").alias("c"), F.split(w["y"], "").alias("p"))))


def cipher(prompt: Column) -> Column:
    """(answer, unmapped, conflicts): the question through the letter map, '?' for letters without one; the first pair of a letter counts."""

    def told(pairs: Column, keys: Column, table: Column, asked: Column) -> Column:
        text = F.transform(asked, lambda ch: F.when(ch == " ", ch).otherwise(F.coalesce(F.try_element_at(table, ch), F.lit("?"))))
        conflicts = F.size(F.array_distinct(F.filter(pairs, lambda z: z["p"] != table[z["c"]])))
        unmapped = F.size(F.array_distinct(F.filter(asked, lambda ch: (ch != " ") & ~F.array_contains(keys, ch))))
        return F.struct(F.array_join(text, "").alias("answer"), unmapped.alias("unmapped"), conflicts.alias("conflicts"))

    def mapped(pairs: Column, keys: Column) -> Column:
        table = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda z: z["c"] == k), 1)["p"]))
        return let(table, lambda t: let(F.split(parse.asked(prompt, "decrypt"), ""), lambda q: told(pairs, keys, t, q)))

    return let(letter_map(prompt), lambda pairs: let(F.array_distinct(F.transform(pairs, lambda z: z["c"])), lambda keys: mapped(pairs, keys)))


def consistent_both_ways(pairs: Column) -> Column:
    """Whether a letter map is a bijection: as many distinct pairs as distinct letters on either side."""
    return let(F.array_distinct(pairs), lambda v: (F.size(v) == F.size(F.array_distinct(F.transform(v, lambda z: z["c"])))) & (F.size(v) == F.size(F.array_distinct(F.transform(v, lambda z: z["p"])))))


def _bits(c: Column) -> Column:
    return F.conv(F.when(F.rlike(c, F.lit("^[01]{8}$")), c), 2, 10).cast("int")


#: Rules over a byte, the simplest first: name, kind, and rotations or shifts i and j.
BYTE_RULES: tuple[tuple[str, str, int, int], ...] = (
    ("identity", "rol", 0, 0),
    ("not", "not", 0, 0),
    *((f"rol{k}", "rol", k, 0) for k in range(1, 8)),
    *((f"shl{k}", "shl", k, 0) for k in range(1, 8)),
    *((f"shr{k}", "shr", k, 0) for k in range(1, 8)),
    *((f"not_rol{k}", "not", k, 0) for k in range(1, 8)),
    *((f"rol{i}_xor_rol{j}", "two", i, j) for i in range(8) for j in range(i + 1, 8)),
)


def _byte_sql(x: str) -> str:
    """The rule r over a byte."""
    rol = lambda k: f"((shiftleft({x}, r.{k}) | shiftright({x}, 8 - r.{k})) & 255)"
    return f"CASE r.kind WHEN 'rol' THEN {rol('i')} WHEN 'not' THEN 255 - {rol('i')} WHEN 'shl' THEN shiftleft({x}, r.i) & 255 WHEN 'shr' THEN shiftright({x}, r.i) ELSE {rol('i')} ^ {rol('j')} END"


def byte_rule(df: DataFrame, prompt: Column) -> DataFrame:
    """``df`` with rule and answer: the first rule, and then the first with a constant mask on top, that all examples keep."""
    rules = ", ".join(f"named_struct('name', '{n}{'_mask' * m}', 'kind', '{k}', 'i', {i}, 'j', {j}, 'masked', {str(bool(m)).lower()})" for m in (0, 1) for n, k, i, j in BYTE_RULES)
    pairs = F.transform(parse.arrows(prompt), lambda e: F.struct(_bits(e["x"]).alias("x"), _bits(e["y"]).alias("y")))
    df = df.withColumn("_examples", pairs).withColumn("_q", _bits(parse.asked(prompt, "output for")))
    mask = f"IF(r.masked, ({_byte_sql('_examples[0].x')}) ^ _examples[0].y, 0)"
    kept = F.expr(f"try_element_at(filter(array({rules}), r -> forall(_examples, e -> (({_byte_sql('e.x')}) ^ {mask}) = e.y)), 1)")
    df = df.withColumn("_rule", F.when(F.size("_examples") > 0, kept))
    answer = F.expr(f"transform(array(_rule), r -> ({_byte_sql('_q')}) ^ {mask})[0]")
    return df.withColumn("rule", F.col("_rule.name")).withColumn("answer", F.lpad(F.bin(answer.cast("long")), 8, "0")).drop("_examples", "_q", "_rule")


#: Operations on two numbers, tried in this order; a and b are numbers, sa and sb their digits (fixed values).
COMMON = (
    ("concatenation", "concat(sa, sb)"), ("reverse concatenation", "concat(sb, sa)"), ("addition", "a + b"), ("absolute difference", "abs(a - b)"),
    ("negated absolute difference", "-abs(a - b)"), ("subtraction (a-b)", "a - b"), ("reverse subtraction (b-a)", "b - a"), ("multiplication", "a * b"),
)
#: Operations tried after those (fixed values); x1 and x2 are the digits of a, y1 and y2 those of b.
RARE = (
    ("multiply+1", "a * b + 1"), ("multiply-1", "a * b - 1"), ("add+1", "a + b + 1"), ("add-1", "a + b - 1"), ("sub+1", "a - b + 1"), ("sub-1", "a - b - 1"),
    ("max mod min", "try_mod(greatest(a, b), least(a, b))"), ("integer division (a/b)", "a div nullif(b, 0)"), ("modulo (a mod b)", "try_mod(a, b)"),
    ("reverse division (b/a)", "b div nullif(a, 0)"), ("reverse modulo (b mod a)", "try_mod(b, a)"),
    ("digit absolute diff", "concat(abs(x1 - y1), abs(x2 - y2))"), ("digit add mod10", "concat((x1 + y1) % 10, (x2 + y2) % 10)"), ("digit sub mod10", "concat(pmod(x1 - y1, 10), pmod(x2 - y2, 10))"),
    ("cross multiply", "x1 * y1 + x2 * y2"), ("cross multiply rev", "x1 * y2 + x2 * y1"), ("digit multiply", "concat(x1 * y1, x2 * y2)"), ("digit multiply rev", "concat(x1 * y2, x2 * y1)"),
    ("digit sum diff", "(x1 + x2) - (y1 + y2)"), ("digit sum sum", "(x1 + x2) + (y1 + y2)"), ("digit product diff", "x1 * x2 - y1 * y2"), ("digit product sum", "x1 * x2 + y1 * y2"), ("determinant", "x1 * y2 - x2 * y1"),
    ("abs determinant", "abs(x1 * y2 - x2 * y1)"),
)


def _operands(e: str) -> dict[str, str]:
    """SQL of the operands of the struct ``e`` (a, op, b as strings) under the names that the operations use."""
    two = f"length({e}.a) = 2 AND length({e}.b) = 2"
    digit = lambda side, k: f"(CASE WHEN {two} THEN CAST(substring({e}.{side}, {k}, 1) AS BIGINT) END)"
    return {"sa": f"{e}.a", "sb": f"{e}.b", "a": f"CAST({e}.a AS BIGINT)", "b": f"CAST({e}.b AS BIGINT)", "x1": digit("a", 1), "x2": digit("a", 2), "y1": digit("b", 1), "y2": digit("b", 2)}


def _operation_sqls(names: dict[str, str]) -> list[tuple[str, str]]:
    """Name and SQL of every operation; its result is a string, null where undefined."""
    fill = lambda sql: re.sub(r"\b(sa|sb|a|b|x1|x2|y1|y2)\b", lambda m: names[m[1]], sql)
    return [(name, f"CAST({fill(sql)} AS STRING)") for name, sql in (*COMMON, *RARE)]


def operation_results(e: str) -> Column:
    """All operations on the struct column ``e`` (a, op, b as strings): an array of (name, result), null where undefined."""
    return F.expr("array(" + ", ".join(f"named_struct('name', '{name}', 'result', {sql})" for name, sql in _operation_sqls(_operands(e))) + ")")


def operation_texts(a: str, b: str) -> str:
    """SQL of the results of all operations on two strings, an array in their order, where the operands are read once."""
    operands = ", ".join(f"{sql} AS {n}" for n, sql in _operands("e").items())
    results = ", ".join(sql for _, sql in _operation_sqls({n: f"v.{n}" for n in _operands("e")}))
    return f"transform(transform(array(struct({a} AS a, {b} AS b)), e -> struct({operands})), v -> array({results}))[0]"


def with_operation_hits(df: DataFrame, e: str, y: str, hits: str) -> DataFrame:
    """``df`` with ``hits``, a long with a bit for every operation on the struct column ``e``, in their order, whose result is the string ``y``.

    The filter of nothing is a function that whole-stage code leaves out: in one method the operations are too long to be compiled.
    """
    kept, names = df.columns, {n: f"_op_{n}" for n in _operands(e)}
    df = df.select("*", *[F.expr(sql).alias(names[n]) for n, sql in _operands(e).items()])
    bits = [f"IF({sql} <=> {y}, {1 << j}L, 0L)" for j, (_, sql) in enumerate(_operation_sqls(names))]
    return df.select(*kept, F.expr(f"IF({y} IS NULL, 0L, {' | '.join(bits)}) | size(filter(array({y}), x -> false))").alias(hits))


def concatenation(prompt: Column) -> Column:
    """(rule, answer) of two-symbol words joined by an operator: forward if all examples are so, else reverse if all are, else forward."""
    examples = F.transform(parse.equations(prompt), lambda e: F.struct(F.substring(e["x"], 1, 2).alias("l"), F.substring(e["x"], 4, 2).alias("r"), e["y"].alias("y")))
    q = parse.asked(prompt, "result for")
    left, right = F.substring(q, 1, 2), F.substring(q, 4, 2)
    forward = F.forall(examples, lambda e: e["y"] == F.concat(e["l"], e["r"]))
    reverse = F.forall(examples, lambda e: e["y"] == F.concat(e["r"], e["l"]))
    out = lambda name, x, y: F.struct(F.lit(name).alias("rule"), F.concat(x, y).alias("answer"))
    return F.when(forward & (F.size(examples) > 0), out("forward", left, right)).when(reverse & (F.size(examples) > 0), out("reverse", right, left)).otherwise(out("default", left, right))
