"""Two-operand equations: every operation on operands and results, each as it stands or reversed, until one keeps all examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.solve import COMMON, RARE, operation_results, operation_texts, with_operation_hits
from tracemill.operators.search import BROADCAST_ROWS
from tracemill.sources.files import cut, spread

#: (reversed operands, reversed result) in the order in which they are tried (fixed values); common operations go before rare ones.
REVERSALS = ((True, True), (False, False), (True, False), (False, True))
AS_IT_STANDS = ((False, False),)


def back(c: Column) -> Column:
    """Reversed, with a minus sign kept in front."""
    return F.when(F.startswith(c, F.lit("-")), F.concat(F.lit("-"), F.reverse(F.substring(c, F.lit(2), F.length(c))))).otherwise(F.reverse(c))


def _signs(examples: DataFrame) -> DataFrame:
    """(key, op, fmt, sign): where the outputs of an operator carry the sign of a negative number, and which character it is."""
    y, op, long = F.col("y"), F.col("op"), F.length("y") > 1
    has = lambda cond: F.coalesce(F.max(cond & long), F.lit(False))
    minus = op != "-"
    seen = examples.groupBy("key", "op").agg(
        has(minus & F.endswith(y, F.lit("-"))).alias("a"), has(minus & F.startswith(y, F.lit("-"))).alias("b"), has(F.endswith(y, op)).alias("c"), has(F.startswith(y, op)).alias("d"),
        F.count(F.lit(1)).alias("n"), F.min("i").alias("first"),
    )
    fmt = F.when(F.col("a"), "suffix").when(F.col("b"), "prefix").when(F.col("c"), "suffix").when(F.col("d"), "prefix").otherwise("plain")
    sign = F.when(F.col("a") | F.col("b"), F.lit("-")).when(F.col("c") | F.col("d"), op)
    return seen.select("key", "op", fmt.alias("fmt"), sign.alias("sign"), "n", "first")


def stages(reversals: tuple[tuple[bool, bool], ...]) -> list[tuple[int, int, int, bool, bool]]:
    """(first order, first operation, operations, reversed operands, reversed result) of every run of candidates, as they are tried."""
    out, o = [], 0
    for first, group in ((0, COMMON), (len(COMMON), RARE)):
        for operands, result in reversals:
            out.append((o, first, len(group), operands, result))
            o += len(group)
    return out


def _misses(df: DataFrame) -> DataFrame:
    """``df`` (a, b and want among its columns) with ``miss``, four longs with a bit for every operation that does not give ``want``, as it stands or turned."""
    kept = df.columns
    turned = F.struct(F.reverse("a").alias("a"), F.reverse("b").alias("b"))
    # A result reversed is the wanted one if it is that one reversed; what does not come back by reversing twice no result gives.
    flipped = F.when(back(back(F.col("want"))) == F.col("want"), back(F.col("want")))
    df = df.select("*", flipped.alias("_back"), F.struct("a", "b").alias("_same"), turned.alias("_turned"))
    for k, (operands, result) in enumerate((x, y) for x in (False, True) for y in (False, True)):
        df = with_operation_hits(df, "_turned" if operands else "_same", "_back" if result else "want", f"_h{k}")
    every = (1 << len(COMMON) + len(RARE)) - 1
    return df.select(*kept, F.array(*[F.bitwise_not(F.col(f"_h{k}")).bitwiseAND(F.lit(every).cast("long")) for k in range(4)]).alias("miss"))


def _with_misses(e: DataFrame, examples: DataFrame) -> DataFrame:
    """``e`` with ``miss``, worked out once for equal lines if few are unlike, as operands of two digits are; else line by line.

    What a line wants is its example's y or, where a sign stands behind or before, that with a minus in front.
    """
    y, long = F.col("y"), F.length("y") > 1
    signed = lambda f: long & (f(y, F.lit("-")) | f(y, F.col("op")))
    after = F.when(signed(F.endswith), F.concat(F.lit("-"), F.left("y", F.length("y") - 1)))
    before = F.when(signed(F.startswith), F.concat(F.lit("-"), F.substring(y, F.lit(2), F.length("y"))))
    unlike = examples.select("a", "b", F.explode(F.array_compact(F.array(y, after, before))).alias("want")).distinct().limit(BROADCAST_ROWS + 1)
    unlike = cut(unlike, "equation-lines")
    if unlike.count() > BROADCAST_ROWS:
        return _misses(e)
    known = cut(_misses(spread(unlike)), "equation-misses").select(*[F.col(c).alias(f"_{c}") for c in ("a", "b", "want")], "miss")
    same = F.col("a").eqNullSafe(F.col("_a")) & F.col("b").eqNullSafe(F.col("_b")) & F.col("want").eqNullSafe(F.col("_want"))
    return e.join(F.broadcast(known), same).drop("_a", "_b", "_want")


#: Lines of a key that are put together before the key's; what is left of them is a line per first miss.
_CHUNK = 64
_NEW = "zip_with(s.seen, x.miss, (p, q) -> q & ~p)"
#: Of lines in order, those that miss a candidate as the first, their bits cut down to these.
_FIRST = f"""aggregate(array_sort(ls), struct(array(0L, 0L, 0L, 0L) AS seen, slice(ls, 1, 0) AS out), (s, x) -> struct(zip_with(s.seen, x.miss, (p, q) -> p | q) AS seen,
 IF(exists({_NEW}, v -> v <> 0), concat(s.out, array(struct(x.i AS i, x.a AS a, x.b AS b, x.want AS want, x.op AS op, {_NEW} AS miss))), s.out) AS out), s -> s.out)"""


def solved(lines: DataFrame, reversals: tuple[tuple[bool, bool], ...] = REVERSALS) -> DataFrame:
    """One row per key that has a question: rule, reversed flags, format, answer, and the log of what was rejected before.

    ``lines`` has key, i, a, op, b (strings) and y, whatever stands as y in the question, the one line of a key with ``asked`` true. The examples of
    the question's operator decide; if it stands in none, those of the most frequent one (the first, of equals) do, and the
    question takes the absolute difference. ``rejected`` lists, in the order tried, (name, a, b, got, want) of the first
    example that each candidate missed. Without a rule the answer is null. An
    example is shuffled as four longs with a bit per candidate that it misses; of a key's examples only those that are
    the first to miss one are kept, and candidates are written out for these alone, within the key's row: each in its turn
    looks up its line and that line's result.
    """
    asked = lines.where("asked").select("key", F.col("a").alias("qa"), F.col("op").alias("qop"), F.col("b").alias("qb"))
    examples = lines.where("NOT asked AND y IS NOT NULL").select("key", "i", "a", "op", "b", "y")
    signs = _signs(examples)
    pick = signs.join(asked, "key").groupBy("key", "qa", "qop", "qb").agg(F.min(F.struct((F.col("op") != F.col("qop")).alias("other"), (-F.col("n")).alias("less"), "first", "op", "fmt", "sign")).alias("m"))
    pick = pick.select("key", "qa", "qop", "qb", F.col("m.op").alias("op"), F.col("m.other").alias("unseen"), "m.fmt", "m.sign")
    e = examples.join(pick.withColumnRenamed("op", "_pop"), "key").where(F.col("op") == F.col("_pop"))
    signed = F.when(F.col("sign").isNull(), F.col("y"))
    signed = signed.when((F.col("fmt") == "suffix") & F.endswith("y", F.col("sign")) & (F.length("y") > 1), F.concat(F.lit("-"), F.left("y", F.length("y") - 1)))
    signed = signed.when((F.col("fmt") == "prefix") & F.startswith("y", F.col("sign")) & (F.length("y") > 1), F.concat(F.lit("-"), F.substring(F.col("y"), F.lit(2), F.length("y")))).otherwise(F.col("y"))
    e = e.withColumn("want", signed)
    e = _with_misses(e.select("key", "i", "a", "op", "b", "want"), examples)
    turns = [(operands, result) for operands in (False, True) for result in (False, True)]
    line = F.struct("i", "a", "b", "want", "op", "miss")
    chunks = e.groupBy("key", F.floor(F.col("i") / _CHUNK).alias("_chunk")).agg(F.collect_list(line).alias("ls")).select("key", F.expr(_FIRST).alias("ls"))
    # Joined before candidates are written out, so that no long row is sorted.
    per = pick.join(chunks.groupBy("key").agg(F.flatten(F.collect_list("ls")).alias("ls")).select("key", F.expr(_FIRST).alias("ls")), "key", "left")
    # What a function over all candidates reads is bound outside of it: the optimizer would put a column's expression inside, to be worked out for each.
    missed = "aggregate(ls, array(0L, 0L, 0L, 0L), (s, x) -> zip_with(s, x.miss, (p, q) -> p | q))"
    listed = [(o + k, name, operands, result, turns.index((operands, result)), first + k) for o, first, n, operands, result in stages(reversals) for k, (name, _) in enumerate((*COMMON, *RARE)[first : first + n])]
    n = len(listed)
    listed = "array(" + ", ".join(f"struct({o} AS o, '{name}' AS name, {str(ro).lower()} AS ro, {str(rr).lower()} AS rr, {c} AS c, {j} AS j)" for o, name, ro, rr, c, j in listed) + ")"
    per = per.withColumn("rule", F.expr(f"transform(array({missed}), m -> try_element_at(filter({listed}, r -> shiftright(m[r.c], r.j) & 1 = 0), 1))[0]"))
    texts = f"struct(x.a AS a, x.b AS b, x.want AS want, x.miss AS miss, {operation_texts('x.a', 'x.b')} AS same, {operation_texts('reverse(x.a)', 'reverse(x.b)')} AS turned)"
    line = "filter(v, x -> shiftright(x.miss[r.c], r.j) & 1 = 1)[0]"
    got = "transform(array(IF(r.ro, x.turned[r.j], x.same[r.j])), g -> IF(r.rr, IF(startswith(g, '-'), concat('-', reverse(substring(g, 2))), reverse(g)), g))[0]"
    rejected = f"transform(array({line}), x -> struct(r.name AS name, x.a AS a, x.b AS b, {got} AS got, x.want AS want))[0]"
    rejected = F.expr(f"transform(array(transform(ls, x -> {texts})), v -> transform(slice({listed}, 1, coalesce(rule.o, {n})), r -> {rejected}))[0]")
    out = per.withColumn("rejected", rejected).withColumns({"_name": F.col("rule.name"), "_ro": F.col("rule.ro"), "_rr": F.col("rule.rr")}).drop("rule")
    turned = F.col("_ro")
    out = out.withColumn("_q", F.struct(F.when(turned, F.reverse("qa")).otherwise(F.col("qa")).alias("a"), F.col("qop").alias("op"), F.when(turned, F.reverse("qb")).otherwise(F.col("qb")).alias("b")))
    out = out.withColumn("_r", operation_results("_q"))
    raw = F.try_element_at(F.filter("_r", lambda r: r["name"] == F.col("_name")), F.lit(1))["result"]
    raw = F.when(F.col("_rr"), back(raw)).otherwise(raw)
    negative, size = F.startswith(raw, F.lit("-")), F.substring(raw, F.lit(2), F.length(raw))
    made = F.when(negative & (F.col("fmt") == "suffix"), F.concat(size, "sign")).when(negative & (F.col("fmt") == "prefix"), F.concat("sign", size)).otherwise(raw)
    apart = F.abs(F.col("qa").cast("decimal(38,0)") - F.col("qb").cast("decimal(38,0)")).cast("string")
    answer = F.when(F.col("_name").isNull(), F.lit(None)).when(F.col("unseen"), apart).otherwise(made)
    return out.select("key", F.col("_name").alias("rule"), turned.alias("reversed_operands"), F.col("_rr").alias("reversed_result"), "fmt", "unseen", answer.alias("answer"), "rejected")
