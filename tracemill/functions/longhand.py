"""Long multiplication and division of decimals of any length, digit by digit with carries, and the lines of the working."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"^[0-9]+(?:\.[0-9]+)?$"
#: Digits that a divisor may have, so that ten times a remainder fits a decimal.
DIVISOR_DIGITS = 36


def _places(c: Column) -> Column:
    return F.when(F.contains(c, F.lit(".")), F.length(F.substring_index(c, ".", -1))).otherwise(0)


def _digits(c: Column) -> Column:
    """The digits of a decimal, the last first, without its point and leading zeros."""
    bare = F.ltrim(F.replace(c, F.lit("."), F.lit("")), F.lit("0"))
    return F.transform(F.filter(F.split(F.reverse(bare), ""), lambda x: x != ""), lambda x: x.cast("int"))


def _carried(sums: Column) -> Column:
    """Digits of a column of sums: what is over nine goes on to the next."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("carry"))

    def step(s: Column, x: Column) -> Column:
        t = x + s["carry"]
        return F.struct(F.concat(s["out"], F.array((t % 10).cast("int"))).alias("out"), F.floor(t / 10).cast("int").alias("carry"))

    return F.aggregate(sums, start, step, lambda s: F.concat(s["out"], F.filter(F.array((s["carry"] % 10).cast("int"), F.floor(s["carry"] / 10).cast("int")), lambda x: x > 0)))


def _shown(digits: Column, places: Column) -> Column:
    """A decimal of so many places, with a zero at least before the point."""
    text = F.lpad(F.array_join(F.transform(F.reverse(digits), lambda x: x.cast("string")), ""), F.greatest(F.size(digits), places + 1), F.lit("0"))
    return F.when(places == 0, text).otherwise(F.concat(F.substring(text, F.lit(1), F.length(text) - places), F.lit("."), F.substring(text, F.length(text) - places + 1, places)))


def long_multiplication(df: DataFrame, a: str, b: str) -> DataFrame:
    """``df`` with ``product``, exact, and ``working``: a line per digit of ``b`` that is not 0, the last first, then a line per sum.

    Both are strings of decimals without a sign; anything else gives nulls. The steps are columns of their own.
    """
    kept, c = df.columns, F.col
    valid = F.rlike(c(a), F.lit(NUMBER)) & F.rlike(c(b), F.lit(NUMBER))
    df = df.withColumns({"_a": _digits(F.when(valid, c(a))), "_b": _digits(F.when(valid, c(b))), "_pb": _places(c(b)), "_p": _places(c(a)) + _places(c(b))})
    zeros = lambda n: F.array_repeat(F.lit(0), n)
    parts = F.transform("_b", lambda d, i: F.struct(d.alias("d"), F.concat(zeros(i), F.array(d)).alias("by"), F.concat(zeros(i), _carried(F.transform("_a", lambda x: x * d))).alias("digits")))
    df = df.withColumn("_parts", F.filter(parts, lambda x: x["d"] > 0))

    def added(x: Column, y: Column) -> Column:
        return _carried(F.zip_with(x, y, lambda p, q: F.coalesce(p, F.lit(0)) + F.coalesce(q, F.lit(0))))

    none = F.array().cast("array<array<int>>")
    df = df.withColumn("_sums", F.aggregate("_parts", none, lambda s, x: F.concat(s, F.array(F.when(F.size(s) == 0, x["digits"]).otherwise(added(F.element_at(s, -1), x["digits"]))))))
    # A factor of 0 leaves its parts without digits.
    first = F.transform("_parts", lambda x: F.concat(c(a), F.lit(" * "), _shown(x["by"], c("_pb")), F.lit(" = "), _shown(x["digits"], c("_p"))))
    more = F.filter(F.transform("_parts", lambda x, i: F.when(i > 0, F.concat(_shown(F.get("_sums", i - 1), c("_p")), F.lit(" + "), _shown(x["digits"], c("_p")), F.lit(" = "), _shown(F.get("_sums", i), c("_p"))))), lambda x: x.isNotNull())
    total = F.coalesce(F.try_element_at("_sums", F.lit(-1)), F.array().cast("array<int>"))
    return df.select(*kept, F.when(valid, _shown(total, c("_p"))).alias("product"), F.when(valid, F.concat(first, more)).alias("working"))


def long_division(df: DataFrame, a: str, b: str, places: int = 3) -> DataFrame:
    """``df`` with ``quotient``, cut to ``places`` decimals, and ``working``: a line per digit brought down, from the first that the divisor goes into.

    The dividend may have any length, the divisor DIVISOR_DIGITS digits once both are whole numbers; else, by 0, and for
    anything that is no decimal without a sign the results are null.
    """
    kept, c = df.columns, F.col
    valid = F.rlike(c(a), F.lit(NUMBER)) & F.rlike(c(b), F.lit(NUMBER))
    scale = F.greatest(_places(c(a)), _places(c(b)))
    whole = lambda x: F.ltrim(F.concat(F.replace(c(x), F.lit("."), F.lit("")), F.repeat(F.lit("0"), scale - _places(c(x)))), F.lit("0"))
    df = df.withColumns({"_n": F.when(valid, F.concat(F.when(whole(a) == "", F.lit("0")).otherwise(whole(a)), F.lit("0" * places))), "_den": F.when(valid, whole(b))})
    df = df.withColumn("_d", F.when(F.length("_den").between(1, DIVISOR_DIGITS), c("_den")).cast("decimal(38,0)"))
    big = lambda x: x.cast("decimal(38,0)")
    start = F.struct(big(F.lit(0)).alias("r"), F.lit("").alias("q"), F.array().cast("array<string>").alias("lines"))

    def step(s: Column, x: Column) -> Column:
        t = big(s["r"] * 10 + x.cast("decimal(1,0)"))
        times = F.call_function("div", t, c("_d"))
        rest = big(t - times * c("_d"))
        line = F.concat(t.cast("string"), F.lit(" / "), c("_d").cast("string"), F.lit(" = "), times.cast("string"), F.lit(" rest "), rest.cast("string"))
        begun = (s["q"] != "") | (times > 0)
        return F.struct(rest.alias("r"), F.when(begun, F.concat(s["q"], times.cast("string"))).otherwise("").alias("q"), F.when(begun, F.concat(s["lines"], F.array(line))).otherwise(s["lines"]).alias("lines"))

    df = df.withColumn("_s", F.when(c("_d").isNotNull(), F.aggregate(F.filter(F.split("_n", ""), lambda x: x != ""), start, step)))
    text = F.lpad(c("_s.q"), F.greatest(F.length("_s.q"), F.lit(places + 1)), F.lit("0"))
    quotient = F.concat(F.substring(text, F.lit(1), F.length(text) - places), F.lit("." if places else ""), F.right(text, F.lit(places)) if places else F.lit(""))
    return df.select(*kept, quotient.alias("quotient"), c("_s.lines").alias("working"))
