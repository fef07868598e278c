"""Answer comparators (Column, Column -> boolean Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions.text import norm_answer, plain_answer, strip

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def number(c: Column) -> Column:
    """The number that a string spells, else null; never what only one engine would read as one."""
    t = strip(c)
    return F.when(F.rlike(t, F.lit(NUMBER)), t.try_cast("double"))


def official(pred: Column, gold: Column, binary: bool = True) -> Column:
    """Binary strings strictly (unless ``binary`` is off), numbers within 1e-2 relative or 1e-5, else lower-case equal."""
    p, g = strip(pred), strip(gold)
    a, b = number(p), number(g)
    close = F.abs(a - b) <= F.greatest(0.01 * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-5))
    out = F.when(a.isNotNull() & b.isNotNull(), close).otherwise(F.lower(p) == F.lower(g))
    return F.when(F.rlike(g, F.lit("^[01]+$")), p == g).otherwise(out) if binary else out


def tolerant(pred: Column, gold: Column) -> Column:
    """Normalised equal, or within 1e-6, or within 1 % of the gold; a null gold is never met."""
    a, b = number(F.regexp_replace(pred, ",", "")), number(F.regexp_replace(gold, ",", ""))
    d = F.abs(a - b)
    return F.coalesce((norm_answer(pred) == norm_answer(gold)) | (d <= 1e-6) | (d <= 0.01 * F.abs(b)), F.lit(False))


def lower_or_near(pred: Column, gold: Column) -> Column:
    """Lower-case equal, or within 1e-2 * max(1, |gold|)."""
    a, b = number(pred), number(gold)
    near = F.abs(a - b) <= 0.01 * F.greatest(F.lit(1.0), F.abs(b))
    return F.coalesce((F.lower(strip(pred)) == F.lower(strip(gold))) | near, F.lit(False))


#: Digits and optional prefix of the bases in which an integer may be written (fixed values).
BASES = ((2, "0b", "[01]"), (8, "0o", "[0-7]"), (10, "", "[0-9]"), (16, "0x", "[0-9a-f]"))


def integer_values(c: Column) -> Column:
    """The values that a string has as an integer of base 2, 8, 10 or 16 (up to 60 bits), as an array."""
    t = _squeezed(c)
    negative = F.rlike(t, F.lit("^-"))
    found = []
    for base, prefix, digits in BASES:
        own = F.regexp_extract(t, f"^[+-]?(?:{prefix})?({digits}{{1,60}})$", 1)
        value = F.when((own != "") & (F.length(F.ltrim(own, F.lit("0"))) <= int(60 / {2: 1, 8: 3, 10: 3.4, 16: 4}[base])), F.conv(own, base, 10).cast("long"))
        found.append(F.when(negative, -value).otherwise(value))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _squeezed(c: Column) -> Column:
    """Stripped, lower case, without spaces and commas."""
    return F.translate(F.lower(strip(c)), " ,", "")


def by_type(pred: Column, gold: Column, kind: Column) -> Column:
    """Equal once squeezed; else bits across bases, ciphers without apostrophes, all other kinds by tolerance."""
    p, g = _squeezed(pred), _squeezed(gold)
    a, b = number(F.replace(pred, F.lit(","), F.lit(""))), number(F.replace(gold, F.lit(","), F.lit("")))
    numeric = F.abs(a - b) <= F.greatest(0.01 * F.greatest(F.lit(1.0), F.abs(b)), F.lit(1e-4))
    whole = F.arrays_overlap(integer_values(pred), integer_values(gold))
    cipher = F.translate(p, "'", "") == F.translate(g, "'", "")
    other = F.when(kind.isin("bit", "base"), whole).when(kind == "cipher", cipher).otherwise(numeric)
    return F.coalesce((p == g) | F.coalesce(other, F.lit(False)), F.lit(False))


def latex_equal(pred: Column, gold: Column) -> Column:
    """Equal as plain answers, or first numbers within 0.015."""
    first = lambda c: F.try_element_at(F.regexp_extract_all(c, F.lit(r"-?[0-9]+(?:\.[0-9]+)?"), 0), F.lit(1)).cast("double")
    return (plain_answer(pred) == plain_answer(gold)) | F.coalesce(F.abs(first(pred) - first(gold)) <= 0.015, F.lit(False))


def loose(pred: Column, gold: Column) -> Column:
    """Equal after trimming all but letters and digits, else one contains the other."""
    p, g = (F.lower(F.regexp_replace(c, r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")) for c in (pred, gold))
    return F.coalesce((p == g) | ((g != "") & F.contains(p, g)), F.lit(False))
