"""Queries over boxes, traces, answers, prompt classes and string tools; fixture texts stand around whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import boxed, classify, compare, longhand, text
from tracemill.plans.cases import cases_sql, values_sql, with_cases
from tracemill.plans.registry import query
from tracemill.sources.files import spread

BOXES = [
    (r"a \boxed{1} b \boxed{2}",), (r"\boxed{\frac{1}{2}} end",), (r"open \boxed{12",), (r"\boxed{}",), ("no box",),
    (r"<think>x</think> \boxed{a{b}c} then \boxed{ 9 }",), (r"\boxed{x} </think> tail",), (r"esc \boxed{a\}b} and \boxed{c{d{e}}}",), (r"\boxed{out \boxed{in}} rest \boxed{",),
]
MARK = r"\boxed{"
#: Walks every fixture character by character: kind 0 plainly, kind 1 minding escapes, kind 2 from the last box on.
WALK = rf"""WITH RECURSIVE c AS {values_sql(BOXES, "a")},
s AS (SELECT k, 0 AS kind, a FROM c UNION ALL SELECT k, 1, a FROM c UNION ALL SELECT k, 2, '{MARK}' || string_split(a, '{MARK}')[-1] FROM c WHERE contains(a, '{MARK}')),
w AS (SELECT k, kind, a, 1 AS i, 0 AS depth, 0 AS start, []::VARCHAR[] AS boxes, '' AS outside FROM s
UNION ALL SELECT k, kind, a,
CASE WHEN depth = 0 AND substr(a, i, 7) = '{MARK}' THEN i + 7 WHEN depth > 0 AND kind = 1 AND substr(a, i, 1) = '\' THEN i + 2 ELSE i + 1 END,
CASE WHEN depth = 0 THEN (substr(a, i, 7) = '{MARK}')::INT WHEN kind = 1 AND substr(a, i, 1) = '\' THEN depth WHEN substr(a, i, 1) = '{{' THEN depth + 1 WHEN substr(a, i, 1) = '}}' THEN depth - 1 ELSE depth END,
CASE WHEN depth = 0 AND substr(a, i, 7) = '{MARK}' THEN i + 7 ELSE start END,
CASE WHEN depth = 1 AND substr(a, i, 1) = '}}' THEN list_append(boxes, substr(a, start, i - start)) ELSE boxes END,
CASE WHEN depth = 0 AND substr(a, i, 7) <> '{MARK}' THEN outside || substr(a, i, 1) ELSE outside END FROM w WHERE i <= length(a)),
f AS (SELECT k, max(CASE WHEN kind = 0 THEN outside END) AS outside, max(CASE WHEN kind = 1 THEN boxes END) AS boxes,
max(CASE WHEN kind = 2 THEN coalesce(boxes[1], left(substr(a, 8), length(a) - 8)) END) AS last_or_cut FROM w WHERE i > length(a) GROUP BY k)"""


def _boxes(t):
    own = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.col("a"))
    return with_cases(t("documents").select("doc_id", "text"), "doc_id", BOXES, "a").select("doc_id", own.alias("trace"))


@query(rf"""{WALK}, d AS (SELECT doc_id, coalesce(text, '') || chr(10) || a AS trace, f.* FROM documents JOIN c ON doc_id % {len(BOXES)} = c.k JOIN f ON f.k = c.k)
SELECT doc_id, list_aggregate(boxes, 'string_agg', '|') AS all_closed, length(coalesce(text, '')) + 1 + length(outside) AS n_without, right(coalesce(text, '') || chr(10) || outside, 60) AS without, last_or_cut FROM
(SELECT d.*, documents.text FROM d JOIN documents USING (doc_id))""")
def box_walks(t):
    """All closed boxes, the text without boxes (its length and end) and the last box, cut if it is open."""
    c = F.col("trace")
    out = boxed.without_boxes(c)
    listed = boxed.all_closed(c)
    joined = F.when(F.size(listed) > 0, F.array_join(listed, "|"))
    return _boxes(t).select("doc_id", joined.alias("all_closed"), F.length(out).cast("long").alias("n_without"), F.substring(out, -60, 60).alias("without"), boxed.last_or_cut(c).alias("last_or_cut"))


@query(rf"""WITH d AS (SELECT doc_id, coalesce(text, '') || chr(10) || a AS x FROM {cases_sql("documents", "doc_id", BOXES, "a")}),
e AS (SELECT *, regexp_extract_all(x, '\\boxed\{{([^{{}}]*)\}}', 1) AS flat, regexp_extract_all(x, '\\boxed\{{((?:[^{{}}]|\{{[^{{}}]*\}})*)\}}', 1) AS nested, regexp_extract_all(x, '\\boxed\{{[^{{}}]*\}}') AS whole FROM d)
SELECT doc_id, flat[-1] AS last_closed_flat, trim(coalesce(flat[1], string_split(x, chr(10))[-1])) AS first_or_line, trim(nested[1]) AS first_nested,
CASE WHEN len(whole) > 0 THEN length(x) - length(string_split(x, whole[-1])[-1]) - length(whole[-1]) END AS span_start,
contains(x, '</think>') AND contains(x, '\boxed{{') AND strpos(x, '</think>') < length(x) - length(string_split(x, '\boxed{{')[-1]) - 6 AS ordered FROM e""")
def box_patterns(t):
    c = F.col("trace")
    return _boxes(t).select("doc_id", boxed.last_closed_flat(c).alias("last_closed_flat"), boxed.first_flat_or_line(c).alias("first_or_line"), boxed.first_nested(c).alias("first_nested"), boxed.answer_span(c)["start"].alias("span_start"), boxed.think_before_box(c).alias("ordered"))


SAYINGS = [("The final answer is: 3.14\nmore",), ("final answer: first\nFinal answer : second",), ("Just a number -100 in text",), ("plain words\n last line \n\n",), (r"\boxed{}  The final answer is: 7",), (r"x \boxed{4} \boxed{ }",), (None,), ("",)]


@query(rf"""WITH d AS (SELECT doc_id, CASE WHEN a IS NULL THEN NULL ELSE regexp_replace(coalesce(text, ''), '[0-9:]', '', 'g') || chr(10) || a END AS x FROM {cases_sql("documents", "doc_id", SAYINGS, "a")}),
e AS (SELECT *, regexp_extract_all(x, '\\boxed\{{([^}}]*)(?:\}}|$)', 1) AS b, regexp_extract_all(x, '(?i)the final answer is:\s*([^\n]+)', 1) AS s1, regexp_extract_all(x, '(?i)final answer is:\s*([^\n]+)', 1) AS s2,
regexp_extract_all(x, '(?i)final answer\s*[:：]\s*([^\n]+)', 1) AS s3, regexp_extract_all(x, '-?[0-9]+(?:\.[0-9]+)?') AS n, list_filter(list_transform(string_split(x, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13))), lambda l: l <> '') AS l FROM d)
SELECT doc_id, CASE WHEN x IS NULL THEN 'NOT_FOUND' WHEN len(b) > 0 THEN trim(coalesce(list_filter(b, lambda v: trim(v) <> '')[-1], b[-1])) WHEN len(s1) > 0 THEN trim(s1[-1]) WHEN len(s2) > 0 THEN trim(s2[-1])
WHEN len(s3) > 0 THEN trim(s3[-1]) WHEN len(n) > 0 THEN n[-1] ELSE coalesce(l[-1], 'NOT_FOUND') END AS answer FROM e""")
def answer_fallbacks(t):
    """Box, stated answer, last number, last line, NOT_FOUND; the documents' own digits and colons are taken out so that all steps occur."""
    d = with_cases(t("documents").select("doc_id", "text"), "doc_id", SAYINGS, "a")
    x = F.when(F.col("a").isNotNull(), F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), "[0-9:]", ""), F.lit("\n"), F.col("a")))
    return d.select("doc_id", boxed.with_fallbacks(x).alias("answer"))


MARKUP = [
    (r"\(a \leq b\) and $$c \times d$$ \to \left( \frac{1}{2} \right) ~ \text{ok} \alpha x",), (r"The answer in \boxed{–} is \boxed{x}. \[y \neq z\] \pm \rightarrow \Rightarrow q",),
    ("one\n\n\n\n\ntwo\t\t  three \n four\nso the answer is:",), ("I will now put the result in \\boxed{}\nkept\nThe answer therefore is \\boxed{5} here\n```python\ncode\n```\nend",), ("<think>inner part</think> after <think>x</think> }.:=-",),
]
STRIP = r"'^\s+|\s+$', '', 'g'"


def _replaces(x: str, pairs) -> str:
    for old, new in pairs:
        x = f"replace({x}, '{old}', {'chr(10)' if new == chr(10) else repr(new)})"
    return x


@query(rf"""WITH d AS (SELECT doc_id, coalesce(text, '') || chr(10) || a AS x FROM {cases_sql("documents", "doc_id", MARKUP, "a")}),
e AS (SELECT *, {_replaces(r"regexp_replace(" + _replaces("x", [(r"\(", ""), (r"\)", ""), (r"\[", chr(10)), (r"\]", chr(10)), ("$$", ""), ("$", "")]) + r", '\\frac\{([^{}]*)\}\{([^{}]*)\}', '(\1)/(\2)', 'g')",
[(r"\times", "*"), (r"\cdot", "*"), (r"\div", "/"), (r"\approx", "~="), (r"\leq", "<="), (r"\geq", ">="), (r"\neq", "!="), (r"\pm", "+/-"), (r"\to", "->"), (r"\rightarrow", "->"), (r"\Rightarrow", "=>")])} AS y FROM d),
g AS (SELECT *, regexp_replace(replace(regexp_replace(regexp_replace(y, '\\text\{{([^{{}}]*)\}}', '\1', 'g'), '\\[a-zA-Z]+\s?', '', 'g'), '\', ''), '[ \t]+', ' ', 'g') AS z FROM e),
h AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(z, ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), {STRIP}) AS u FROM g)
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(u, '(?im)\n[^\n]{{0,40}}?(?:answer|result|output|is)\s*[:=]?\s*$', '', 'g'), '[\s}}:=.\-]+$', ''), {STRIP})) AS plain,
md5(regexp_replace(x, 'The answer in \\boxed\{{[^}}]*\}} is (\\boxed\{{[^}}]*\}})', 'The answer is \1', 'g')) AS fixed, regexp_extract(x, '(?s)<think>(.*?)</think>', 1) AS inner_think,
md5(regexp_replace(regexp_replace(x, '(?im)^.*I will (now )?(put|return) .*\\boxed\{{\}}.*$', '', 'g'), '(?im)^.*The answer .*\\boxed.*$', '', 'g')) AS unclaimed,
md5(regexp_replace(x, '(?m)^```[a-zA-Z]*\n?', '', 'g')) AS unfenced, md5(replace(replace(x, '<think>', ''), '</think>', '')) AS untagged FROM h""")
def clean_traces(t):
    d = with_cases(t("documents").select("doc_id", "text"), "doc_id", MARKUP, "a")
    x = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.col("a"))
    made = {"plain": text.plain_latex(x), "fixed": text.fix_claim(x), "unclaimed": text.drop_claim_lines(x), "unfenced": text.strip_fences(x), "untagged": text.drop_think_tags(x)}
    return d.select("doc_id", *[F.md5(v).alias(k) for k, v in made.items()], text.inside_think(x).alias("inner_think"))


PAIRS = [
    ("42", "42", "other"), ("9.81", "9.80", "gravity"), ("9.81", "10.0", "gravity"), ("00101010", "42", "bit"), ("0xFF", "255", "base"), ("ff", "255", "base"), ("0b11", "3", "bit"), ("17", "15", "base"),
    ("HELLO", "hel lo", "cipher"), ("it's", "its", "cipher"), ("24.6401", "24.64", "other"), (" xlvii\t", "XLVII", "other"), ("00011011", "11011", "other"), ("10011001", "10011000", "other"),
    ("1,000", "1000.5", "equation"), (r"\text{5 meters}", "5 m", "unit"), ("$3.14$", "about 3.15", "unit"), ("}38", "38", "equation"), ("the answer 12 fits", "12", "other"), ("abc", "abd", "other"), ("", "", "other"), (None, "1", "other"),
]
NUM = r"'^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$'"


def _num(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, {NUM}) THEN TRY_CAST(regexp_replace({x}, {STRIP}) AS DOUBLE) END"


def _ints(x: str) -> str:
    one = lambda b, p, d: f"CASE WHEN regexp_full_match({x}, '({p})?{d}+') THEN list_sum(list_transform(range(1, length(regexp_replace({x}, '^({p})', '')) + 1), lambda i: (strpos('0123456789abcdef', substr(regexp_replace({x}, '^({p})', ''), i, 1)) - 1) * pow({b}, length(regexp_replace({x}, '^({p})', '')) - i))) END"
    return f"list_filter([{one(2, '0b', '[01]')}, {one(8, '0o', '[0-7]')}, {one(10, 'q', '[0-9]')}, {one(16, '0x', '[0-9a-f]')}], lambda v: v IS NOT NULL)"


SQUEEZE = "translate(lower(regexp_replace({x}, '^\\s+|\\s+$', '', 'g')), ' ,', '')"
LATEX_PLAIN = r"trim(regexp_replace(regexp_replace(translate(regexp_replace(regexp_replace(replace(trim(coalesce({x}, '')), '$', ''), '\\text\s*\{{([^{{}}]*)\}}', '\1', 'g'), '\\mathrm\s*\{{([^{{}}]*)\}}', '\1', 'g'), '{{}}\', ''), '(?i)\bmeters?\b|\bm\b', '', 'g'), '\s+', ' ', 'g'))"
EDGE = r"lower(regexp_replace(regexp_replace({x}, '^[^A-Za-z0-9]+', ''), '[^A-Za-z0-9]+$', ''))"
_p, _g = "(coalesce(p, '') || p_size)", "(g || p_size)"


@query(rf"""WITH d AS (SELECT p_partkey, p_partkey % {len(PAIRS)} AS k, p, g, kind FROM {cases_sql("part", "p_partkey", PAIRS, "p, g, kind")}),
e AS (SELECT *, {_num("p")} AS a, {_num("g")} AS b, {_num("replace(p, ',', '')")} AS ac, {_num("replace(g, ',', '')")} AS bc, {SQUEEZE.format(x="p")} AS sp, {SQUEEZE.format(x="g")} AS sg, lower(regexp_replace(p, {STRIP})) AS lp, lower(regexp_replace(g, {STRIP})) AS lg,
TRY_CAST(regexp_extract(p, '-?[0-9]+(?:\.[0-9]+)?') AS DOUBLE) AS n1, TRY_CAST(regexp_extract(g, '-?[0-9]+(?:\.[0-9]+)?') AS DOUBLE) AS n2, {EDGE.format(x="p")} AS ep, {EDGE.format(x="g")} AS eg FROM d),
f AS (SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN abs(a - b) <= greatest(0.01::DOUBLE * greatest(abs(a), abs(b)), 1e-5::DOUBLE) ELSE lp = lg END AS metric FROM e)
SELECT p_partkey, CASE WHEN regexp_full_match(lg, '[01]+') THEN lp = lg ELSE metric END AS official, metric, coalesce(sp = sg, false) AS squeezed,
coalesce(sp = sg, false) OR coalesce(CASE WHEN kind IN ('bit', 'base') THEN list_has_any({_ints("sp")}, {_ints("sg")}) WHEN kind = 'cipher' THEN replace(sp, '''', '') = replace(sg, '''', '')
ELSE abs(ac - bc) <= greatest(0.01::DOUBLE * greatest(1, abs(bc)), 1e-4::DOUBLE) END, false) AS by_type,
lower({LATEX_PLAIN.format(x="p")}) = lower({LATEX_PLAIN.format(x="g")}) OR coalesce(abs(n1 - n2) <= 0.015::DOUBLE, false) AS latex, coalesce(ep = eg OR (eg <> '' AND contains(ep, eg)), false) AS loose FROM f""")
def answer_comparators(t):
    """All comparators side by side over pairs of answers."""
    p, g = F.col("p"), F.col("g")
    d = with_cases(t("part").select("p_partkey"), "p_partkey", PAIRS, "p, g, kind")
    same = F.coalesce(text.norm_answer(p) == text.norm_answer(g), F.lit(False))
    return d.select("p_partkey", compare.official(p, g).alias("official"), compare.official(p, g, binary=False).alias("metric"), same.alias("squeezed"), compare.by_type(p, g, F.col("kind")).alias("by_type"), compare.latex_equal(p, g).alias("latex"), compare.loose(p, g).alias("loose"))


HEADS = [
    ("In Alice's Wonderland, a secret bit manipulation rule transforms 8-bit binary numbers.", None), ("In Alice's Wonderland, the gravitational constant has been secretly changed.", None),
    ("In Alice's Wonderland, numbers are secretly converted into a different numeral system.", None), ("In Alice's Wonderland, a secret unit conversion is applied to measurements. 10 m becomes 25", None),
    ("In Alice's Wonderland, secret encryption rules are used on text.", None), ("A secret set of transformation rules is applied to equations. Examples: 12+34 = 46", None),
    ("A secret set of transformation rules is applied to equations. Examples: `ab` = `!c`", None), ("Convert 14 to roman, a Roman number puzzle", "known_type"), ("What is the next term of the sequence?", None), ("Is this riddle true or false?", None), ("", None),
]


def _keywords(groups, default: str, x: str = "lower(x)") -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({x}, '{w}')" for w in words) + f" THEN '{name}'" for name, words in groups) + f" ELSE '{default}' END"


def _patterns(rules, default: str, flags: str) -> str:
    fixed = lambda p: p.replace("(?=", "(?:").replace("'", "''")
    return "CASE " + " ".join(f"WHEN regexp_matches(x, '{flags}{fixed(p)}') THEN '{name}'" for p, name in rules) + f" ELSE '{default}' END"


@query(rf"""WITH d AS (SELECT doc_id, a || chr(10) || coalesce(text, '') AS x, b FROM {cases_sql("documents", "doc_id", HEADS, "a, b")})
SELECT doc_id, {_keywords(classify.FAMILIES, "other")} AS family, coalesce(b::VARCHAR, {_keywords(classify.MERGE_FAMILIES, "?")}) AS merge_part, regexp_matches(left(string_split(lower(x), 'examples:')[-1], 140), '[0-9]') AS has_digit,
{_keywords(classify.SOLVER_FAMILIES, "unknown")} AS solver, {_keywords(classify.TEMPLATE_FAMILIES, "unknown")} AS template, {_patterns(classify.PUZZLES, "Unknown", "(?i)")} AS puzzle, {_patterns(classify.PROMPT_KINDS, "mixed-template", "(?is)")} AS kind,
regexp_matches(x, '(?i)\b(roman numeral|roman-numeral|convert.*roman|roman.*convert|to roman|from roman|numeral.*roman)\b') AS roman FROM d""")
def prompt_classes(t):
    """Seven rule sets over prompts; the merging one is shown by its parts, ``merge_part`` and ``has_digit``."""
    d = with_cases(t("documents").select("doc_id", "text"), "doc_id", HEADS, "a, b").withColumn("x", F.concat("a", F.lit("\n"), F.coalesce("text", F.lit(""))))
    x, merged = F.col("x"), classify.merge_family(F.col("x"), F.col("b"))
    part = F.when(merged.isin("equation_numeric_deduce", "cryptarithm_deduce", "other"), "?").otherwise(merged)
    digit = F.rlike(F.substring(F.substring_index(F.lower(x), "examples:", -1), 1, 140), F.lit("[0-9]"))
    return d.select("doc_id", classify.family(x).alias("family"), part.alias("merge_part"), digit.alias("has_digit"), classify.solver_family(x).alias("solver"), classify.template_family(x).alias("template"), classify.puzzle_kind(x).alias("puzzle"), classify.prompt_kind(x).alias("kind"), classify.asks_roman(x).alias("roman"))


@query(rf"""WITH d AS (SELECT doc_id, a || chr(10) || coalesce(text, '') AS x, b FROM {cases_sql("documents", "doc_id", HEADS, "a, b")}), m AS (SELECT x, b::VARCHAR AS b, {_keywords(classify.MERGE_FAMILIES, "")} AS own,
contains(lower(x), 'transformation rule') OR contains(lower(x), 'equation') AS eq, regexp_matches(left(string_split(lower(x), 'examples:')[-1], 140), '[0-9]') AS digit FROM d)
SELECT coalesce(b, CASE WHEN own <> '' THEN own WHEN eq THEN CASE WHEN digit THEN 'equation_numeric_deduce' ELSE 'cryptarithm_deduce' END ELSE 'other' END) AS family, count(*) AS n FROM m GROUP BY ALL""")
def merge_family_counts(t):
    d = with_cases(t("documents").select("doc_id", "text"), "doc_id", HEADS, "a, b")
    x = F.concat("a", F.lit("\n"), F.coalesce("text", F.lit("")))
    return d.groupBy(classify.merge_family(x, F.col("b")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


ERRORS = [("429", "slow down"), (None, "Rate limit reached"), ("400", "bad"), ("503", "busy"), ("408", "late"), (None, "Connection reset"), ("401", "no key"), (None, None), ("404", "error 502 upstream")]


@query(rf"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN a = '429' OR contains(lower(b), '429') OR contains(lower(b), 'rate limit') THEN 'rate_limit' WHEN a = '400' THEN 'bad_request'
WHEN a::INT >= 500 OR a = '408' OR regexp_matches(lower(b), 'timeout|timed out|connection|50[324]') THEN 'transient' ELSE 'other' END AS kind FROM {cases_sql("events", "event_id", ERRORS, "a, b")}) GROUP BY ALL""")
def error_kinds(t):
    d = with_cases(t("events").select("event_id"), "event_id", ERRORS, "a, b")
    return d.groupBy(classify.error_kind(F.col("a").cast("int"), F.col("b")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


ABC = "qwertyuiopasdfghjklzxcvbnm"


@query(rf"""WITH d AS (SELECT *, split_part(c_name, '#', 1) AS head, c_custkey::VARCHAR AS n FROM customer)
SELECT c_custkey, trim(lower(regexp_replace(c_name, '\s+', ' ', 'g'))) AS collapsed, regexp_replace(regexp_replace('##' || c_name || '!)', '^[^A-Za-z0-9]+', ''), '[^A-Za-z0-9]+$', '') AS ends, CASE WHEN contains(c_name, '#') THEN substr(c_name, strpos(c_name, '#') + 1) END AS tail,
string_split(c_mktsegment, 'E')[-1] AS after_last, translate(c_name, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz') AS swapped, regexp_replace(c_name, '[aeiouAEIOU]', '', 'g') AS consonants,
reverse(c_name) AS reversed, repeat('0', greatest(0, 6 - length(n))) || n AS filled, CASE WHEN length(n) >= 4 THEN n ELSE rpad(n, 4, ' ') END AS justified, translate(lower(c_mktsegment), 'abcdefghijklmnopqrstuvwxyz', '{ABC}') AS cipher,
translate(lower(c_mktsegment), 'abcdefghijklmnopqrstuvwxyz', 'defghijklmnopqrstuvwxyzabc') AS shifted, '\\' || '\{{' || n || '\}}' AS escaped,
(SELECT string_agg(((ascii(substr(c_mktsegment, i, 1)) + ascii(substr(reverse(c_mktsegment), i, 1))) % 128)::VARCHAR, '.' ORDER BY i) FROM range(1, length(c_mktsegment) + 1) r(i)) AS summed,
(SELECT string_agg(list_position(list_distinct_ordered, substr(lower(c_mktsegment), i, 1))::VARCHAR, '.' ORDER BY i) FROM range(1, length(c_mktsegment) + 1) r(i)) AS pattern,
n || '-' || md5(n)[:4] AS key, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE n END, ''), left(md5(n), 16)) AS id
FROM (SELECT *, list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(lower(c_mktsegment), ''), lambda x: [x])), lambda acc, x: CASE WHEN list_contains(acc, x[1]) THEN acc ELSE list_concat(acc, x) END) AS list_distinct_ordered FROM d)""")
def string_tools(t):
    name, seg, n = F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey").cast("string")
    low = F.lower(seg)
    return t("customer").select(
        "c_custkey", text.collapse(name).alias("collapsed"), text.strip_ends(F.concat(F.lit("##"), name, F.lit("!)"))).alias("ends"), text.after_first(name, "#").alias("tail"), text.after_last(seg, "E").alias("after_last"),
        text.swapcase(name).alias("swapped"), text.drop_vowels(name).alias("consonants"), F.reverse(name).alias("reversed"), text.zfill(n, 6).alias("filled"), text.ljust(n, 4).alias("justified"),
        text.substitute(low, ABC).alias("cipher"), text.caesar(low, 3).alias("shifted"), text.escape_box(F.concat(F.lit("\\{"), n, F.lit("}"))).alias("escaped"),
        F.array_join(F.transform(text.zip_chars(seg, F.reverse(seg), "add"), lambda x: x.cast("string")), ".").alias("summed"), text.pattern_of(low).alias("pattern"),
        F.concat_ws("-", n, F.substring(F.md5(n), 1, 4)).alias("key"), F.coalesce(F.nullif(F.when(F.col("c_custkey") % 3 == 0, "").otherwise(n), F.lit("")), F.substring(F.md5(n), 1, 16)).alias("id"),
    )


@query(r"""SELECT doc_id, length(text) // 3 AS thirds, floor(length(text) / 3.5)::BIGINT AS tokens, round((length(coalesce(lang, '')) + length(text)) / 3.0::DOUBLE + 300, 4) AS sequence, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS words,
least(length(text) / 100::DOUBLE, 5) + contains(lower(text), 'step')::INT + contains(lower(text), 'therefore')::INT - 2 * contains(lower(text), 'guess')::INT - contains(lower(text), 'maybe')::INT AS score,
CASE WHEN text IS NULL THEN 'missing' WHEN regexp_full_match(text, '\s*') THEN 'blank' WHEN length(text) < 30 THEN 'short' WHEN floor(length(text) / 3.5) > 3000 THEN 'long' WHEN regexp_matches(text, '[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]') THEN 'emoji'
WHEN contains(text, chr(13)) THEN 'crlf' END AS reason FROM documents""")
def text_gates(t):
    """Token estimates, trace score and the reason a row would go: missing, blank, short, over the token cap, emoji, CRLF."""
    c = F.col("text")
    low = classify.drop_reason([("missing", c.isNull()), ("blank", text.strip(c) == ""), ("short", F.length(c) < 30), ("long", text.est_tokens(c) > 3000), ("emoji", text.has_emoji(c)), ("crlf", F.contains(c, F.lit("\r")))])
    return t("documents").select("doc_id", text.est_tokens(c, 3).alias("thirds"), text.est_tokens(c).alias("tokens"), F.round(text.est_sequence_tokens(F.coalesce("lang", F.lit("")), c), 4).alias("sequence"), text.n_words(c).alias("words"), text.cot_score(c).alias("score"), low.alias("reason"))


@query(r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE text END AS cot, coalesce(lang, '?') AS answer FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5('<think>' || chr(10) || CASE WHEN regexp_full_match(cot, '\s*') THEN 'Work through the problem step by step.' ELSE regexp_replace(cot, '^\s+|\s+$', '', 'g') END || chr(10) || '</think>' || chr(10) || chr(10) || '\boxed{' || answer || '}') AS target,
true AS round_trips, 1 AS boxes FROM d""")
def training_targets(t):
    """Targets of whole documents, with the checks of the training set: the box gives its answer back, and there is one box."""
    d = t("documents").where("text IS NOT NULL").select("doc_id", F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.col("text")).alias("cot"), F.coalesce("lang", F.lit("?")).alias("answer"))
    made = boxed.target(F.col("cot"), F.col("answer"))
    return d.select("doc_id", F.md5(made).alias("target"), (boxed.last_balanced(boxed.with_box(F.col("answer"))) == F.col("answer")).alias("round_trips"), F.regexp_count(made, F.lit(r"\\boxed\{")).alias("boxes"))


@query("""WITH p AS (SELECT p_partkey, ((p_partkey * 7919 + 12345) * 1000 + p_partkey % 1000)::HUGEINT AS a, (p_size * 100 + p_partkey * 37 % 100)::HUGEINT AS b FROM part)
SELECT p_partkey, (a * b // 100000)::VARCHAR || '.' || lpad((a * b % 100000)::VARCHAR, 5, '0') AS product, (a * 100 // b // 1000)::VARCHAR || '.' || lpad((a * 100 // b % 1000)::VARCHAR, 3, '0') AS quotient,
2 * length(replace(b::VARCHAR, '0', '')) - 1 AS multiplied, length((a * 100 // b)::VARCHAR) AS divided FROM p""")
def longhand_arithmetic(t):
    """Products and quotients of decimals, digit by digit, with the lines that the working takes."""
    a = F.concat(F.expr("CAST(p_partkey * 7919 + 12345 AS STRING)"), F.lit("."), F.lpad(F.expr("CAST(p_partkey % 1000 AS STRING)"), 3, "0"))
    b = F.concat(F.col("p_size").cast("string"), F.lit("."), F.lpad(F.expr("CAST(p_partkey * 37 % 100 AS STRING)"), 2, "0"))
    rows = spread(t("part").select("p_partkey", "p_size")).select("p_partkey", a.alias("a"), b.alias("b"))
    made = longhand.long_division(longhand.long_multiplication(rows, "a", "b").withColumn("multiplied", F.size("working")).drop("working"), "a", "b")
    return made.select("p_partkey", "product", "quotient", "multiplied", F.size("working").alias("divided"))
