"""Queries of the search solvers: prompts are made of table rows, the SQL searches in its own way or knows how they were made."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.functions import gates, puzzle, transform
from tracemill.operators import equations, search
from tracemill.plans.registry import query
from tracemill.plans.solving import DUCK_GATES, DUCK_OPS
from tracemill.sources.files import cut, spread

#: Examples of a gate prompt; they fill one word of the solver and part of the next.
GATE_EXAMPLES = 120
_FORMS = len(DUCK_GATES) + 4  # the gates, two constants, an input as it is, and one negated


@query(f"""WITH x AS (SELECT p_partkey, p_partkey % {_FORMS} AS form, p_partkey % 31 = 30 AS five, (({GATE_EXAMPLES} * 37 + p_partkey * 11) % 256)::INT AS x FROM part),
v AS (SELECT *, (j * 3 + p_partkey) % 5 AS i FROM x, range(8) r(j)),
b AS (SELECT p_partkey, form, five, j, (x >> (7 - i::INT)) & 1 = 1 AS a, (x >> (6 - i::INT)) & 1 = 1 AS b, (x >> (5 - i::INT)) & 1 = 1 AS c, (x >> (4 - i::INT)) & 1 = 1 AS d FROM v)
SELECT p_partkey, CASE WHEN any_value(five) THEN NULL ELSE string_agg(CASE WHEN CASE form {" ".join(f"WHEN {k} THEN {g}" for k, g in enumerate(DUCK_GATES))} WHEN {len(DUCK_GATES)} THEN false WHEN {len(DUCK_GATES) + 1} THEN true WHEN {len(DUCK_GATES) + 2} THEN a ELSE NOT a END THEN '1' ELSE '0' END, '' ORDER BY j) END AS answer,
CASE WHEN any_value(five) THEN 0 ELSE 8 END AS told FROM b GROUP BY p_partkey""")
def solve_gates(t):
    """Output bits are gates of one to four inputs, which the solver finds from examples; a parity of five inputs it cannot."""
    bit = lambda x, i: f"(shiftright({x}, 7 - ({i})) & 1)"
    i = "((j * 3 + p_partkey) % 5)"
    word = {"a": bit("x", i), "b": bit("x", f"{i} + 1"), "c": bit("x", f"{i} + 2"), "d": bit("x", f"{i} + 3")}
    fill = lambda sql: "".join(word.get(ch, ch) for ch in sql)
    n = len(puzzle.GATES)
    form = f"p_partkey % {_FORMS}"
    made = f"CASE {form} {' '.join(f'WHEN {k} THEN {fill(sql)}' for k, (_, _, sql) in enumerate(puzzle.GATES))} WHEN {n} THEN 0 WHEN {n + 1} THEN 1 WHEN {n + 2} THEN {word['a']} ELSE 1 - {word['a']} END"
    five = " ^ ".join(bit("x", f"(j + {k}) % 8") for k in range(5))
    made = f"CASE WHEN p_partkey % 31 = 30 THEN {five} ELSE {made} END"
    shown = "concat(lpad(bin(x), 8, '0'), ' -> ', array_join(transform(sequence(0, 7), j -> CAST(" + made + " AS STRING)), ''))"
    value = lambda e: f"CAST(({e} * 37 + p_partkey * 11) % 256 AS INT)"
    lines = F.expr(f"transform(transform(sequence(0, {GATE_EXAMPLES - 1}), e -> {value('e')}), x -> {shown})")
    prompt = F.concat(F.lit("A secret bit manipulation rule transforms 8-bit binary numbers.\n"), F.array_join(lines, "\n"), F.lit("\nNow, determine the output for: "), F.lpad(F.bin(F.expr(value(str(GATE_EXAMPLES))).cast("long")), 8, "0"))
    rows = cut(spread(t("part").select("p_partkey")).select("p_partkey", prompt.alias("prompt")), "gate-prompts")
    solved = gates.per_bit(rows, "p_partkey", F.col("prompt"))
    return solved.select("p_partkey", "answer", F.size(F.filter("rules", lambda r: r != "unknown")).alias("told"))


#: Numeric and text rules by DuckDB over l, o, r, and a, b for the numbers; in the order of the library.
_REV = "reverse({0}::VARCHAR)::BIGINT"
_SUM = "list_sum(list_transform(string_split({0}::VARCHAR, ''), lambda x: x::BIGINT))"
DUCK_NUMERIC = (
    ("sub", "a - b"), ("sub_abs", "abs(a - b)"), ("add", "a + b"), ("mul", "a * b"), ("rev_a_mul_rev_b_then_rev", f"reverse(({_REV.format('a')} * {_REV.format('b')})::VARCHAR)::BIGINT"),
    ("rev_a_sub_rev_b", f"{_REV.format('a')} - {_REV.format('b')}"), ("rev_a_add_rev_b", f"{_REV.format('a')} + {_REV.format('b')}"),
    ("digit_sum_sub", f"{_SUM.format('a')} - {_SUM.format('b')}"), ("digit_sum_add", f"{_SUM.format('a')} + {_SUM.format('b')}"), ("digit_sum_mul", f"{_SUM.format('a')} * {_SUM.format('b')}"),
    ("concat_ab", "(a::VARCHAR || b)::BIGINT"), ("concat_ba", "(b::VARCHAR || a)::BIGINT"), ("mod", "a % b"), ("floor_div", "a // b"),
)
DUCK_TEXT = (
    ("delete_op", "l || r"), ("concat_ba", "r || l"), ("keep_left", "l"), ("keep_right", "r"), ("concat_rev_left_right", "reverse(l) || r"), ("concat_left_rev_right", "l || reverse(r)"), ("concat_rev_both", "reverse(l) || reverse(r)"),
    ("op_left_right", "o || l || r"), ("op_right_left", "o || r || l"), ("sym_diff_op", "o || CASE WHEN l[1] <> r[1] THEN l[1] ELSE '' END || CASE WHEN l[2] <> r[2] THEN l[2] ELSE '' END"),
    ("zip_xor", "chr(xor(ascii(l[1]), ascii(r[1]))) || chr(xor(ascii(l[2]), ascii(r[2])))"), ("zip_and", "chr(ascii(l[1]) & ascii(r[1])) || chr(ascii(l[2]) & ascii(r[2]))"),
    ("zip_or", "chr(ascii(l[1]) | ascii(r[1])) || chr(ascii(l[2]) | ascii(r[2]))"), ("zip_add_mod", "chr((ascii(l[1]) + ascii(r[1])) % 128) || chr((ascii(l[2]) + ascii(r[2])) % 128)"),
)
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
# Operands of example e (0 to 2) and of the question (3), in both dialects: numbers of two digits and pairs of letters.
_A, _B = "CAST((p_partkey * (37 + 12 * e) + 29 * e) % 90 + 10 AS BIGINT)", "CAST((p_partkey * (53 + 10 * e) + 41 * e + 7) % 90 + 10 AS BIGINT)"
_AT = lambda k, m, c: f"substr('{_LETTERS}', CAST((p_partkey * {k} + e * {m} + {c}) % 26 AS INT) + 1, 1)"
_L, _R = f"{_AT(3, 5, 0)} || {_AT(7, 9, 4)}", f"{_AT(5, 3, 2)} || {_AT(11, 7, 9)}"
_SHIFTED = _LETTERS[11:] + _LETTERS[:11]


@query(f"""WITH e AS (SELECT p_partkey, p_partkey % 5 AS kind, p_partkey // 5 AS turn, e, {_A} AS a, {_B} AS b, {_L} AS l, '?' AS o, {_R} AS r FROM part, range(4) x(e)),
n AS (SELECT *, [{", ".join(f"struct_pack(name := '{n}', v := ({s})::VARCHAR)" for n, s in DUCK_NUMERIC)}] AS rs FROM e WHERE kind = 1),
x AS (SELECT *, [{", ".join(f"struct_pack(name := '{n}', v := {s})" for n, s in DUCK_TEXT)}] AS rs FROM e WHERE kind = 2),
u AS (SELECT p_partkey, e, k, rs[k] AS m, rs[(turn % {len(DUCK_NUMERIC)} + 1)::INT].v AS y FROM n, range(1, {len(DUCK_NUMERIC) + 1}) z(k) UNION ALL SELECT p_partkey, e, k, rs[k], rs[(turn % 13 + 1 + (turn % 13 >= 10)::INT)::INT].v FROM x, range(1, {len(DUCK_TEXT) + 1}) z(k)),
f AS (SELECT p_partkey, k, bool_and(coalesce(m.v = y, false)) FILTER (e < 3) AS fits, max(m) FILTER (e = 3) AS q FROM u GROUP BY ALL),
g AS (SELECT p_partkey, arg_min(q, k) AS q FROM f WHERE fits GROUP BY ALL),
w AS (SELECT p_partkey, kind, string_agg(l || r, '' ORDER BY e) FILTER (e < 3) AS seen, any_value(l || r) FILTER (e = 0) AS first FROM e GROUP BY ALL)
SELECT p_partkey, CASE kind WHEN 0 THEN translate(reverse(first), '{_LETTERS}', '{_SHIFTED}') WHEN 3 THEN translate(first, '{_LETTERS}', '{_SHIFTED}') WHEN 4 THEN NULL ELSE q.v END AS answer,
CASE kind WHEN 0 THEN 1.0 WHEN 3 THEN 0.3 WHEN 4 THEN 0.0 ELSE 0.9 END::DOUBLE AS confidence, CASE kind WHEN 0 THEN 'character map' WHEN 3 THEN 'part of the map' WHEN 4 THEN NULL ELSE q.name END AS rule FROM w LEFT JOIN g USING (p_partkey)""")
def solve_transforms(t):
    """By turns: a character map, a numeric rule, a rule on texts, a map that knows part of the question, and none at all."""
    parts = t("part").select("p_partkey", F.expr("p_partkey % 5").alias("kind"), F.expr("p_partkey div 5").alias("turn"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("e"))
    e = parts.withColumns({"a": F.expr(_A), "b": F.expr(_B), "l": F.expr(_L), "r": F.expr(_R)})
    numbers, texts = transform.rule_results(F.col("a").cast("string"), F.lit("?"), F.col("b").cast("string")), transform.rule_results(F.col("l"), F.lit("?"), F.col("r"))
    y = lambda rules, at: F.element_at(rules, at.cast("int"))["result"]
    own = F.col("turn") % 13 + F.when(F.col("turn") % 13 >= 10, 1).otherwise(0)  # not the exclusive or, whose characters are line breaks and such
    whole = F.concat("l", "r")
    numeric = F.concat(F.col("a").cast("string"), F.lit("?"), F.col("b").cast("string"))
    left = F.when(F.col("kind") == 1, numeric).when(F.col("kind") == 2, F.concat("l", F.lit("?"), "r")).otherwise(whole)
    right = F.when(F.col("kind") == 1, y(numbers, F.col("turn") % len(DUCK_NUMERIC) + 1)).when(F.col("kind") == 2, y(texts, own + 1 + len(DUCK_NUMERIC)))
    right = right.when(F.col("kind") == 4, F.concat(whole, F.lit("!"), whole)).otherwise(F.translate(whole, _LETTERS, _SHIFTED))
    made = e.groupBy("p_partkey", "kind").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("e") < 3, F.struct("e", F.concat(left, F.lit(" = "), right).alias("line"))))), lambda x: x["line"]), "\n").alias("lines"),
        F.max(F.when(F.col("e") == 3, left)).alias("last"), F.max(F.when(F.col("e") == 0, whole)).alias("first"),
    )
    q = F.when(F.col("kind") == 0, F.reverse("first")).when(F.col("kind") == 3, F.concat("first", F.lit("99"))).when(F.col("kind") == 4, F.lit("??")).otherwise(F.col("last"))
    prompt = F.concat(F.lit("A secret set of transformation rules is applied to equations. Below are a few examples:\n"), "lines", F.lit("\nNow, determine the result for: "), q)
    return transform.equation_transform(made.select("p_partkey", prompt.alias("prompt")), F.col("prompt")).drop("prompt")


# Lines of an order by number: the first is the question, every third has another operator, and outputs are made in seven ways.
_LINES = """SELECT k, i, a, b, CASE WHEN i = 1 AND k % 17 = 0 THEN '#' WHEN i % 3 = 0 THEN '*' ELSE '+' END AS op FROM (SELECT l_orderkey AS k, (l_partkey % 90 + 10)::BIGINT AS a, (l_suppkey * 7 % 90 + 10)::BIGINT AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem)"""
_BACK = lambda c: f"CASE WHEN ({c}) LIKE '-%' THEN '-' || reverse(substr(({c}), 2)) ELSE reverse({c}) END"
_TURNED = "SELECT *, reverse(a::VARCHAR) AS sa, reverse(b::VARCHAR) AS sb FROM e"
_OPS = DUCK_OPS.replace("a::VARCHAR", "sa").replace("b::VARCHAR", "sb").replace("|| b)", "|| sb)").replace("|| a)", "|| sa)")


def _stage_rows() -> str:
    runs = equations.stages(equations.REVERSALS)
    return ", ".join(f"({o + k}, {first + k + 1}, {str(x).lower()}, {str(y).lower()})" for o, first, n, x, y in runs for k in range(n))


@query(f"""WITH e AS ({_LINES}),
y AS (SELECT *, CASE WHEN op = '*' THEN (a * b)::VARCHAR ELSE CASE k % 7 WHEN 0 THEN (a * b + 1)::VARCHAR WHEN 1 THEN {_BACK("(a - b)::VARCHAR")} WHEN 2 THEN CASE WHEN a < b THEN (b - a)::VARCHAR || '+' ELSE (a - b)::VARCHAR END
 WHEN 3 THEN reverse((reverse(a::VARCHAR)::BIGINT + reverse(b::VARCHAR)::BIGINT)::VARCHAR) WHEN 4 THEN b::VARCHAR || a WHEN 5 THEN CASE WHEN a < b THEN '+' || (b - a) ELSE (a - b)::VARCHAR END ELSE (a * 1000 + b * 3)::VARCHAR END END AS y FROM e),
c AS (SELECT k, op, count(*) AS n, min(i) AS first, bool_or(y LIKE '-%' AND length(y) > 1) AS minus, bool_or(right(y, 1) = op AND length(y) > 1) AS after, bool_or(left(y, 1) = op AND length(y) > 1) AS before FROM y WHERE i > 1 GROUP BY ALL),
q AS (SELECT e.k, e.a AS qa, e.b AS qb, e.op AS qop, arg_min(c.op, (CASE WHEN c.op = e.op THEN 0 ELSE 1 END, -c.n, c.first)) AS op FROM e JOIN c USING (k) WHERE e.i = 1 GROUP BY ALL),
p AS (SELECT q.*, qop <> q.op AS unseen, CASE WHEN minus THEN 'prefix' WHEN after THEN 'suffix' WHEN before THEN 'prefix' ELSE 'plain' END AS fmt, CASE WHEN minus THEN '-' WHEN after OR before THEN q.op END AS sign FROM q JOIN c ON c.k = q.k AND c.op = q.op),
x AS (SELECT p.k, y.i, y.a, y.b, CASE WHEN fmt = 'suffix' AND right(y, 1) = sign AND length(y) > 1 THEN '-' || left(y, -1) WHEN fmt = 'prefix' AND left(y, 1) = sign AND length(y) > 1 THEN '-' || substr(y, 2) ELSE y END AS want FROM p JOIN y ON y.k = p.k AND y.op = p.op AND y.i > 1
 UNION ALL SELECT k, 1, qa, qb, NULL FROM p),
s AS (SELECT k, i, want, a::VARCHAR AS wa, b::VARCHAR AS wb, a, b, a::VARCHAR AS sa, b::VARCHAR AS sb, false AS turned FROM x UNION ALL SELECT k, i, want, a::VARCHAR, b::VARCHAR, reverse(a::VARCHAR)::BIGINT, reverse(b::VARCHAR)::BIGINT, reverse(a::VARCHAR), reverse(b::VARCHAR), true FROM x),
r AS (SELECT k, i, want, wa, wb, turned, list_transform({_OPS}, lambda z: z) AS rs FROM s),
g AS (SELECT r.k, r.i, r.want, wa, wb, t.o, t.ro, t.rr, rs[t.c].name AS name, CASE WHEN t.rr THEN {_BACK("rs[t.c].r")} ELSE rs[t.c].r END AS got FROM r JOIN (VALUES {_stage_rows()}) t(o, c, ro, rr) ON r.turned = t.ro),
m AS (SELECT k, o, name, ro, rr, min(struct_pack(i := i, a := wa, b := wb, got := got, want := want)) FILTER (i > 1 AND NOT coalesce(got = want, false)) AS miss, max(got) FILTER (i = 1) AS answer FROM g GROUP BY ALL),
f AS (SELECT k, min(o) FILTER (miss IS NULL) AS o FROM m GROUP BY k),
l AS (SELECT m.k, count(*) AS n_rejected, md5(string_agg(name || ':' || miss.a || ',' || miss.b || '=' || coalesce(miss.got, 'none') || '/' || miss.want, ';' ORDER BY m.o)) AS log FROM m JOIN f USING (k) WHERE miss IS NOT NULL AND (f.o IS NULL OR m.o < f.o) GROUP BY m.k)
SELECT p.k, m.name AS rule, m.ro AS reversed_operands, m.rr AS reversed_result, fmt, unseen, CASE WHEN m.name IS NULL THEN NULL WHEN unseen THEN abs(qa - qb)::VARCHAR WHEN m.answer LIKE '-%' AND fmt = 'suffix' THEN substr(m.answer, 2) || sign WHEN m.answer LIKE '-%' AND fmt = 'prefix' THEN sign || substr(m.answer, 2) ELSE m.answer END AS answer,
coalesce(n_rejected, 0) AS n_rejected, coalesce(log, md5('')) AS log FROM p JOIN f USING (k) LEFT JOIN m ON m.k = f.k AND m.o = f.o LEFT JOIN l ON l.k = p.k""")
def solve_equations(t):
    """Every order's lines as examples of one or two operators: the rule, how it is turned, its sign's place, and all rejections before it."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    n = t("lineitem").select(F.col("l_orderkey").alias("k"), place.alias("i"), F.expr("l_partkey % 90 + 10").alias("na"), F.expr("l_suppkey * 7 % 90 + 10").alias("nb"))
    op = F.when((F.col("i") == 1) & (F.col("k") % 17 == 0), "#").when(F.col("i") % 3 == 0, "*").otherwise("+")
    a, b, k = F.col("na"), F.col("nb"), F.col("k") % 7
    flip = lambda c: F.reverse(c.cast("string")).cast("long")
    apart = F.abs(a - b).cast("string")
    y = (
        F.when(k == 0, (a * b + 1).cast("string")).when(k == 1, equations.back((a - b).cast("string"))).when(k == 2, F.when(a < b, F.concat(apart, F.lit("+"))).otherwise(apart))
        .when(k == 3, F.reverse((flip(a) + flip(b)).cast("string"))).when(k == 4, F.concat(b, a)).when(k == 5, F.when(a < b, F.concat(F.lit("+"), apart)).otherwise(apart)).otherwise((a * 1000 + b * 3).cast("string"))
    )
    lines = n.select(F.col("k").alias("key"), "i", a.cast("string").alias("a"), op.alias("op"), b.cast("string").alias("b"), F.when(op == "*", (a * b).cast("string")).otherwise(y).alias("y"), (F.col("i") == 1).alias("asked"))
    solved = equations.solved(lines)
    told = F.transform("rejected", lambda x: F.concat(x["name"], F.lit(":"), x["a"], F.lit(","), x["b"], F.lit("="), F.coalesce(x["got"], F.lit("none")), F.lit("/"), x["want"]))
    return solved.select(F.col("key").alias("k"), "rule", "reversed_operands", "reversed_result", "fmt", "unseen", "answer", F.size("rejected").alias("n_rejected"), F.md5(F.array_join(told, ";")).alias("log"))


_SYMBOLS = "!@$%^&~?:;"


@query()
def solve_cryptarithms(t):
    """Three equations a part, digits behind symbols and two operators behind two more; the whole search has no SQL."""
    e = t("part").select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("e"))
    e = e.withColumns({"l": F.expr("(p_partkey * (37 + 12 * e) + 29 * e) % 90 + 10"), "r": F.expr("(p_partkey * (53 + 10 * e) + 41 * e + 7) % 90 + 10")})
    e = e.withColumn("first", F.expr("e <> 1"))
    kind = F.when(F.col("first"), F.col("p_partkey") % 3).otherwise(F.expr("p_partkey div 3 % 2 + 3"))
    value = F.when(kind == 0, F.expr("l + r")).when(kind == 1, F.expr("l * r")).when(kind == 2, F.expr("abs(l - r)")).when(kind == 3, F.expr("l * 100 + r")).otherwise(F.expr("r * 100 + l"))
    turn = F.concat(F.substring(F.lit(_SYMBOLS), (F.col("p_partkey") % 10 + 1).cast("int"), F.lit(10)), F.substring(F.lit(_SYMBOLS), F.lit(1), (F.col("p_partkey") % 10).cast("int")))
    hidden = lambda c: F.call_function("translate", c.cast("string"), F.lit("0123456789"), turn)
    sign = F.when((F.col("e") == 3) & (F.col("p_partkey") % 23 == 0), "|").when(F.col("first"), "{").otherwise("}")
    left = F.concat(hidden(F.col("l")), sign, hidden(F.col("r")))
    made = e.groupBy("p_partkey").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("e") < 3, F.struct("e", F.concat(left, F.lit(" = "), hidden(value)).alias("line"))))), lambda x: x["line"]), "\n").alias("lines"), F.max(F.when(F.col("e") == 3, left)).alias("q")
    )
    prompt = F.concat(F.lit("In Alice's Wonderland, a secret set of transformation rules is applied to equations. Below are a few examples:\n"), "lines", F.lit("\nNow, determine the result for: "), "q")
    return search.cryptarithms(made, "p_partkey", prompt)


#: Words of the cipher's vocabulary stand in so many documents.
CIPHER_DOCUMENTS = 3
_PERMUTED = "qwertyuiopasdfghjklzxcvbnm"
_VOCABULARY = f"""v AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS at, count(*) OVER () AS n FROM (SELECT word FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents)
 WHERE regexp_full_match(word, '[a-z]{{5,8}}') GROUP BY word HAVING count(*) >= {CIPHER_DOCUMENTS}))"""


@query(f"""WITH {_VOCABULARY},
c AS (SELECT c_custkey AS k, (c_custkey * 7919 + 13) % n AS i1, (c_custkey * 104729 + 7) % n AS i2, (c_custkey * 15485863 + 3) % n AS i3, (c_custkey * 32452843 + 11) % n AS i4 FROM customer, (SELECT DISTINCT n FROM v)),
w AS (SELECT k, a.word || CASE WHEN k % 3 = 0 THEN '' ELSE b.word END AS told, c.word AS q1, d.word AS q2 FROM c JOIN v a ON a.at = i1 JOIN v b ON b.at = i2 JOIN v c ON c.at = i3 JOIN v d ON d.at = i4),
q AS (SELECT k, told, unnest([1, 2]) AS s, unnest([q1, q2]) AS q FROM w),
m AS (SELECT k, told, s, q, translate(q, list_aggregate(list_distinct(string_split(told, '')), 'string_agg', ''), repeat('.', len(list_distinct(string_split(told, ''))))) <> repeat('.', length(q)) AS unknown FROM q),
p AS (SELECT word, length(word) AS size, list_transform(string_split(word, ''), lambda x: list_position(string_split(word, ''), x)) AS pat, string_split(word, '') AS ls FROM v),
x AS (SELECT m.k, m.s, p.word AS plain, list_transform(list_zip(string_split(m.q, ''), p.ls), lambda z: struct_pack(c := z[1], p := z[2])) AS z FROM m JOIN p ON p.size = length(m.q)
  AND p.pat = list_transform(string_split(m.q, ''), lambda y: list_position(string_split(m.q, ''), y)) AND m.unknown
 WHERE len(list_filter(list_zip(string_split(m.q, ''), p.ls), lambda z: (contains(m.told, z[1]) OR contains(m.told, z[2])) AND z[1] <> z[2])) = 0),
a1 AS (SELECT * FROM x WHERE s = 1), a2 AS (SELECT * FROM x WHERE s = 2),
u AS (SELECT k, bool_or(unknown) AS any_unknown, bool_or(unknown) FILTER (s = 1) AS u1, bool_or(unknown) FILTER (s = 2) AS u2, max(q) FILTER (s = 1) AS q1, max(q) FILTER (s = 2) AS q2 FROM m GROUP BY k),
f AS (SELECT u.k, a1.plain || ' ' || a2.plain AS text FROM u JOIN a1 USING (k) JOIN a2 USING (k) WHERE u1 AND u2 AND len(list_filter(a1.z, lambda i: len(list_filter(a2.z, lambda j: (i.c = j.c) <> (i.p = j.p))) > 0)) = 0
 UNION ALL SELECT u.k, a1.plain || ' ' || q2 FROM u JOIN a1 USING (k) WHERE u1 AND NOT u2 UNION ALL SELECT u.k, q1 || ' ' || a2.plain FROM u JOIN a2 USING (k) WHERE u2 AND NOT u1),
n AS (SELECT k, count(DISTINCT text) AS answers, min(text) AS text FROM f GROUP BY k)
SELECT u.k AS c_custkey, CASE WHEN NOT any_unknown THEN q1 || ' ' || q2 WHEN answers = 1 THEN text END AS answer, CASE WHEN NOT any_unknown THEN 'mapped' WHEN answers = 1 THEN 'recovered' ELSE 'ambiguous' END AS status,
CASE WHEN any_unknown THEN answers ELSE 1 END AS answers FROM u LEFT JOIN n USING (k)""")
def solve_ciphers_by_words(t):
    """One or two words of the corpus's vocabulary decrypt two others; letters that they leave unknown come from the vocabulary."""
    found = t("documents").select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))).alias("word")).where(F.rlike("word", F.lit("^[a-z]{5,8}$")))
    vocabulary = cut(found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= CIPHER_DOCUMENTS).select("word"), "cipher-vocabulary")
    numbered = cut(_numbered(vocabulary), "cipher-numbered")
    n = numbered.count()
    rows = spread(t("customer").select("c_custkey")).select(F.col("c_custkey").alias("k"), *[((F.col("c_custkey") * a + b) % n).alias(f"i{j}") for j, (a, b) in enumerate(((7919, 13), (104729, 7), (15485863, 3), (32452843, 11)))])
    for j in range(4):
        rows = rows.join(search.small(numbered.select(F.col("at").alias(f"i{j}"), F.col("word").alias(f"w{j}"))), f"i{j}")
    hide = lambda c: F.translate(c, _LETTERS, _PERMUTED)
    told = F.concat("w0", F.when(F.col("k") % 3 == 0, "").otherwise(F.col("w1")))
    prompt = F.concat(F.lit("Secret encryption rules.\n"), hide(told), F.lit(" -> "), told, F.lit("\nNow, decrypt the following text: "), hide(F.concat_ws(" ", "w2", "w3")))
    return search.cipher_words(rows.select(F.col("k").alias("c_custkey"), prompt.alias("prompt")), "c_custkey", F.col("prompt"), vocabulary)


def _numbered(words):
    """(word, at): places in the order of words, counted by their first letters."""
    counts = words.groupBy(F.left("word", F.lit(2)).alias("head")).agg(F.count(F.lit(1)).alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("head", before.alias("before")))  # 676 heads at most
    inside = F.row_number().over(Window.partitionBy("head").orderBy("word")) - 1
    return words.withColumn("head", F.left("word", F.lit(2))).withColumn("in_", inside).join(offsets, "head").select("word", (F.col("in_") + F.col("before")).alias("at"))
