"""Prompts as examples and a query: the grammars of the puzzle families (Column -> Column)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions.text import strip


def let(x: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of ``x``, which is worked out once however often ``made`` uses it."""
    return F.transform(F.array(x), made)[0]


def _pairs(c: Column, pattern: str) -> Column:
    """An array of (x, y): the two groups of every match."""
    x, y = (F.transform(F.regexp_extract_all(c, F.lit(pattern), k), strip) for k in (1, 2))
    return F.zip_with(x, y, lambda a, b: F.struct(a.alias("x"), b.alias("y")))


def arrows(c: Column) -> Column:
    """Lines 'input -> output'; the first arrow of a line divides it."""
    return _pairs(c, r"(?md)^(.*?) -> (.*)$")


def equations(c: Column) -> Column:
    """Lines 'left = right'."""
    return _pairs(c, r"(?md)^([^\n=]*?) = (.*)$")


def falls(c: Column) -> Column:
    """Times and distances of 'For t = 1.5s, distance = 11.03 m'."""
    return _pairs(c, r"(?i)For\s+t\s*=\s*([0-9.]+)\s*s,\s*distance\s*=\s*([0-9.]+)\s*m")


def conversions(c: Column) -> Column:
    """Measurements of '10.0 m becomes 25.00'."""
    return _pairs(c, r"(?i)([0-9.]+)\s*m\s+becomes\s+([0-9.]+)")


def asked(c: Column, phrase: str) -> Column:
    """What the last line that begins with 'Now' and has the phrase asks for, after its colon; null without one."""
    found = F.regexp_extract_all(c, F.lit(rf"(?imd)^Now,[^\n]*{phrase}[^\n:]*:(.*)$"), 1)
    return strip(F.try_element_at(found, F.lit(-1)))


def asked_time(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?i)determine the falling distance for\s+t\s*=\s*([0-9.]+)\s*s", 1), F.lit(""))


def asked_length(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?i)convert the following measurement:\s*([0-9.]+)\s*m", 1), F.lit(""))


def asked_number(c: Column) -> Column:
    """The number of a numeral question, in words 'write the number' or after a colon."""
    named = F.nullif(F.regexp_extract(c, r"(?i)write the number\s+(\S+)\s+in the Wonderland numeral system", 1), F.lit(""))
    other = F.nullif(F.regexp_extract(c, r"(?imd)determine\s+.*?:\s*(\S+)\s*$", 1), F.lit(""))
    return F.regexp_replace(F.coalesce(named, other), r"\.+$", "")


def operands(c: Column) -> Column:
    """A two-operand expression as (a, op, b): digits, one sign that is no digit, digits; null otherwise."""
    part = lambda k: F.regexp_extract(c, r"^([0-9]+)([^0-9\s])([0-9]+)$", k)
    return F.when(part(2) != "", F.struct(part(1).alias("a"), part(2).alias("op"), part(3).alias("b")))
