"""Arithmetic of the puzzle families and of sampled rollouts: roman numerals, bits, rewards, token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Roman digits of thousands, hundreds, tens and units (fixed values).
_ROMAN = (
    ("", "M", "MM", "MMM"),
    ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"),
    ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"),
    ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"),
)


def to_roman(n: Column) -> Column:
    """Roman numeral of 1 to 3999."""
    digits = [F.floor(n / 1000), F.pmod(F.floor(n / 100), F.lit(10)), F.pmod(F.floor(n / 10), F.lit(10)), F.pmod(n, F.lit(10))]
    parts = [F.element_at(F.array(*[F.lit(x) for x in table]), d.cast("int") + 1) for table, d in zip(_ROMAN, digits, strict=True)]
    return F.when((n >= 1) & (n <= 3999), F.concat(*parts))


def from_roman(c: Column) -> Column:
    """Value of a roman numeral: a sign before a greater one counts negative."""
    value = lambda x: F.element_at(F.create_map(*[F.lit(y) for p in zip("IVXLCDM", (1, 5, 10, 50, 100, 500, 1000), strict=True) for y in p]), x)
    signs = F.transform(F.reverse(F.split(c, "")), value)
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))
    return F.aggregate(signs, start, lambda s, v: F.struct((s["sum"] + F.when(v < s["last"], -v).otherwise(v)).alias("sum"), v.alias("last")))["sum"]


def rotate_left(x: Column, k: int) -> Column:
    """8-bit rotation."""
    return (F.shiftleft(x, k).bitwiseOR(F.shiftright(x, 8 - k))).bitwiseAND(F.lit(255))


def bits8(x: Column) -> Column:
    return F.lpad(F.bin(x.cast("long")), 8, "0")


def combined_reward(correct: Column, formatted: Column, has_answer: Column) -> Column:
    """2.5 correct in format, 2.0 correct, -0.5 wrong answer, -1.0 no answer."""
    return F.when(correct & formatted, 2.5).when(correct, 2.0).when(has_answer, -0.5).otherwise(-1.0)


def overlong_penalty(length: Column, soft: int, hard: int) -> Column:
    """0 up to ``soft``, then linear to -1 at ``hard``."""
    return -F.greatest(F.lit(0.0), F.least(F.lit(1.0), (length - soft) / float(hard - soft)))


def curriculum_weight(pass_rate: Column, floor: float = 0.1) -> Column:
    return F.greatest(F.lit(floor), 1 - pass_rate)


def mask_prefix(ids: Column, n: Column, mask: int = -100) -> Column:
    """Labels: the first n ids masked."""
    return F.transform(ids, lambda x, i: F.when(i < n, F.lit(mask)).otherwise(x))


def pad_right(ids: Column, to: int, pad: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(to) - F.size(ids))))


def topk_mean(losses: Column, k: int) -> Column:
    """Mean of the k largest losses."""
    top = F.slice(F.sort_array(losses, asc=False), 1, k)
    return F.try_divide(F.aggregate(top, F.lit(0.0), lambda s, x: s + x), F.size(top).cast("double"))


def rotate_right(x: Column, k: int) -> Column:
    return rotate_left(x, 8 - k)


def shift_left(x: Column, k: int) -> Column:
    return F.shiftleft(x, k).bitwiseAND(F.lit(255))


def in_base(n: Column, base: int) -> Column:
    """Digits of a whole number in base 2, 8, 10 or 16, lower case."""
    return F.lower(F.conv(n.cast("string"), 10, base))


#: Boolean gates over 0 and 1 (fixed values): name, number of inputs, SQL over a, b, c, d.
GATES = (
    ("AND", 2, "a & b"), ("OR", 2, "a | b"), ("XOR", 2, "a ^ b"), ("NAND", 2, "1 - (a & b)"), ("NOR", 2, "1 - (a | b)"),
    ("XNOR", 2, "1 - (a ^ b)"), ("A_AND_NOT_B", 2, "a & (1 - b)"), ("NOT_A_AND_B", 2, "(1 - a) & b"),
    ("A_OR_NOT_B", 2, "a | (1 - b)"), ("NOT_A_OR_B", 2, "(1 - a) | b"),
    ("MAJ", 3, "(a & b) | (a & c) | (b & c)"), ("CHO", 3, "(a & b) | ((1 - a) & c)"), ("PAR3", 3, "a ^ b ^ c"),
    ("AO", 3, "(a & b) | c"), ("OA", 3, "(a | b) & c"), ("AX", 3, "(a & b) ^ c"), ("OX", 3, "(a | b) ^ c"), ("XA", 3, "(a ^ b) & c"),
    ("XO", 3, "(a ^ b) | c"), ("NOT_MAJ", 3, "1 - ((a & b) | (a & c) | (b & c))"), ("NOT_PAR3", 3, "1 - (a ^ b ^ c)"),
    ("PAR4", 4, "a ^ b ^ c ^ d"), ("NOT_PAR4", 4, "1 - (a ^ b ^ c ^ d)"), ("AOA", 4, "((a & b) | c) & d"),
    ("OAO", 4, "((a | b) & c) | d"), ("AXA", 4, "((a & b) ^ c) & d"), ("XXXX", 4, "a ^ b ^ c ^ d"),
)


def gate_outputs() -> Column:
    """All gates over the columns a, b, c, d: an array of (name, output)."""
    return F.array(*[F.struct(F.lit(name).alias("name"), F.expr(sql).cast("int").alias("output")) for name, _, sql in GATES])


def next_term(terms: Column) -> Column:
    """The next term of an array of five: arithmetic, geometric, each the sum of two before, or squares in a row; else null.

    Sums and products are decimals, as those of longs may be beyond a long; a term beyond a long is null.
    """
    t = [F.get(terms, F.lit(i)).cast("decimal(19,0)") for i in range(5)]
    arithmetic = (t[1] - t[0] == t[2] - t[1]) & (t[2] - t[1] == t[3] - t[2]) & (t[3] - t[2] == t[4] - t[3])
    geometric = (t[0] != 0) & (t[1] * t[1] == t[0] * t[2]) & (t[2] * t[2] == t[1] * t[3]) & (t[3] * t[3] == t[2] * t[4]) & ((t[4] * t[1]) % F.when(t[0] != 0, t[0]) == 0)
    summed = (t[2] == t[0] + t[1]) & (t[3] == t[1] + t[2]) & (t[4] == t[2] + t[3])
    roots = [F.round(F.sqrt(F.when(x >= 0, x).cast("double"))).cast("decimal(19,0)") for x in t]
    squares = (roots[0] * roots[0] == t[0]) & (roots[4] * roots[4] == t[4])
    for i in range(1, 5):
        squares = squares & (roots[i] == roots[i - 1] + 1) & (roots[i] * roots[i] == t[i])
    whole = lambda x: x.cast("decimal(38,0)")
    out = F.when(arithmetic, whole(t[4] + t[1] - t[0])).when(geometric, whole(F.try_divide(t[4] * t[1], F.when(t[0] != 0, t[0])))).when(summed, whole(t[3] + t[4]))
    return out.when(squares, whole((roots[4] + 1) * (roots[4] + 1))).try_cast("long")


def format_reward(closed: Column, ordered: Column) -> Column:
    """0.5 for a closed box, 0.3 more if the thought ends before it."""
    return F.when(closed, 0.5).otherwise(0.0) + F.when(closed & ordered, 0.3).otherwise(0.0)


def environment_reward(correct: Column, formatted: Column) -> Column:
    return correct.cast("double") + 0.2 * formatted.cast("double")


def mean_loss(losses: Column) -> Column:
    return F.try_divide(F.aggregate(losses, F.lit(0.0), lambda s, x: s + x), F.size(losses).cast("double"))


def minmax_loss(losses: Column) -> Column:
    """The largest loss: minimising it minimises the worst token."""
    return F.array_max(losses)


def blended_loss(losses: Column, k: int, share: float) -> Column:
    """``share`` of the mean and the rest of the mean of the k largest."""
    return share * mean_loss(losses) + (1 - share) * topk_mean(losses, k)


def attention_mask(ids: Column, to: int) -> Column:
    """1 for every id, 0 for the padding up to a length."""
    return pad_right(F.transform(ids, lambda _: F.lit(1)), to, 0)


def numeric_operations(a: Column, b: Column) -> Column:
    """Name and result of every numeric operation on two whole numbers from 0 to 10**9; by 0, rest and quotient are null."""

    def flip(x: Column) -> Column:
        return F.reverse(x.cast("string")).cast("long")

    def digit_sum(x: Column) -> Column:
        return F.aggregate(F.split(x.cast("string"), ""), F.lit(0).cast("long"), lambda s, d: s + F.when(d == "", 0).otherwise(d).cast("long"))

    def joined(x: Column, y: Column) -> Column:
        return F.concat(x.cast("string"), y.cast("string")).cast("decimal(38,0)")

    a, b = a.cast("long"), b.cast("long")
    made = (
        ("sub", a - b),
        ("sub_abs", F.abs(a - b)),
        ("add", a + b),
        ("mul", a * b),
        ("rev_a_mul_rev_b_then_rev", F.reverse((flip(a) * flip(b)).cast("string"))),
        ("rev_a_sub_rev_b", flip(a) - flip(b)),
        ("rev_a_add_rev_b", flip(a) + flip(b)),
        ("digit_sum_sub", digit_sum(a) - digit_sum(b)),
        ("digit_sum_add", digit_sum(a) + digit_sum(b)),
        ("digit_sum_mul", digit_sum(a) * digit_sum(b)),
        ("concat_ab", joined(a, b)),
        ("concat_ba", joined(b, a)),
        ("mod", F.when(b != 0, F.pmod(a, F.when(b != 0, b)))),
        ("floor_div", F.when(b != 0, F.floor(a / F.when(b != 0, b)))),
    )
    return F.array(*[F.struct(F.lit(n).alias("op"), x.cast("decimal(38,0)").alias("result")) for n, x in made])
