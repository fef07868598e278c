r"""Answers in ``\boxed{...}``: the variants differ in which box they take and what an unclosed one gives."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions.text import strip

MARK = "\\boxed{"


def _tail_last(c: Column) -> Column:
    return F.when(F.contains(c, F.lit(MARK)), F.substring_index(c, MARK, -1))


def _tail_first(c: Column) -> Column:
    at = F.instr(c, MARK)
    return F.when(at > 0, F.substring(c, at + len(MARK), F.length(c)))


def _close(tail: Column) -> Column:
    """Position before the brace that closes the box that ``tail`` continues; -1 if none does."""
    start = F.struct(F.lit(1).alias("d"), F.lit(0).alias("i"), F.lit(-1).alias("e"))

    def step(s: Column, ch: Column) -> Column:
        depth = s["d"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)
        open_ = s["e"] < 0
        return F.struct(
            F.when(open_, depth).otherwise(s["d"]).alias("d"),
            (s["i"] + 1).alias("i"),
            F.when(open_ & (depth == 0), s["i"]).otherwise(s["e"]).alias("e"),
        )

    return F.aggregate(F.split(tail, ""), start, step)["e"]


def _inside(tail: Column, unclosed: Column) -> Column:
    end = _close(tail)
    return F.when(end >= 0, F.substring(tail, F.lit(1), end)).when(tail.isNotNull(), unclosed)


def last_balanced(c: Column) -> Column:
    """Content of the last box; null if it is unclosed or there is none."""
    return _inside(_tail_last(c), F.lit(None).cast("string"))


def first_balanced(c: Column) -> Column:
    """Content of the first box; null if it is unclosed."""
    return _inside(_tail_first(c), F.lit(None).cast("string"))


def first_or_tail(c: Column) -> Column:
    """Content of the first box; the rest of the text if it is unclosed."""
    tail = _tail_first(c)
    return _inside(tail, tail)


def last_or_cut(c: Column) -> Column:
    """Content of the last box; the rest without its last character if it is unclosed."""
    tail = _tail_last(c)
    return _inside(tail, F.substring(tail, F.lit(1), F.length(tail) - 1))


def last_flat(c: Column) -> Column:
    r"""Last non-empty ``\boxed{`` run up to a brace or the end, else the last one, else empty."""
    found = F.regexp_extract_all(c, F.lit(r"\\boxed\{([^}]*)(?:\}|$)"), 1)
    full = F.filter(found, lambda x: F.trim(x) != "")
    pick = F.when(F.size(full) > 0, F.element_at(full, -1)).when(F.size(found) > 0, F.element_at(found, -1))
    return F.trim(F.coalesce(pick, F.lit("")))


def last_closed_flat(c: Column) -> Column:
    """Last box without braces inside; null if there is none."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(r"\\boxed\{([^{}]*)\}"), 1), F.lit(-1))


def first_flat_or_line(c: Column) -> Column:
    """First flat box, else the last line."""
    box = F.try_element_at(F.regexp_extract_all(c, F.lit(r"\\boxed\{([^{}]*)\}"), 1), F.lit(1))
    return F.trim(F.coalesce(box, F.substring_index(F.rtrim(c), "\n", -1)))


#: Phrases before an answer without a box, the first that occurs counts; patterns are fixed values.
SAID = (r"The final answer is:\s*([^\n]+)", r"Final answer is:\s*([^\n]+)", r"Final answer\s*[:：]\s*([^\n]+)")


def with_fallbacks(c: Column) -> Column:
    """The last flat box if there is one, even an empty one; else the last stated final answer, the last number, the last
    line that is not blank, or NOT_FOUND, also for null."""
    said = [strip(F.try_element_at(F.regexp_extract_all(c, F.lit("(?i)" + p), 1), F.lit(-1))) for p in SAID]
    number = F.try_element_at(F.regexp_extract_all(c, F.lit(r"-?[0-9]+(?:\.[0-9]+)?"), 0), F.lit(-1))
    line = F.try_element_at(F.filter(F.transform(F.split(c, "\r\n|[\n\r]"), strip), lambda x: x != ""), F.lit(-1))
    boxed_one = F.when(F.contains(c, F.lit(MARK)), last_flat(c))
    return F.coalesce(boxed_one, *said, number, line, F.lit("NOT_FOUND"))


def first_nested(c: Column) -> Column:
    r"""Content of the first closed box with braces at most one level deep, ``\\boxed`` too; null without one.

    Possessive, so a long box takes no stack: what one step takes can never be a later step's closing brace.
    """
    return strip(F.try_element_at(F.regexp_extract_all(c, F.lit(r"\\boxed\{((?:[^{}]++|\{[^{}]*+\})*+)\}"), 1), F.lit(1)))


def answer_span(c: Column) -> Column:
    """0-based start and end of the last closed flat box, null without one."""
    box = F.try_element_at(F.regexp_extract_all(c, F.lit(r"\\boxed\{[^{}]*\}"), 0), F.lit(-1))
    start = F.length(c) - F.length(F.call_function("substring_index", c, box, F.lit(-1))) - F.length(box)
    return F.when(box.isNotNull(), F.struct(start.cast("long").alias("start"), (start + F.length(box)).cast("long").alias("end")))


def with_box(answer: Column) -> Column:
    return F.concat(F.lit(MARK), answer, F.lit("}"))


def target(trace: Column, answer: Column, default: str = "Work through the problem step by step.") -> Column:
    """Training target: the trace (or a default for an empty one) between think tags, then the boxed answer."""
    own = strip(F.coalesce(trace, F.lit("")))
    return F.concat(F.lit("<think>\n"), F.when(own == "", default).otherwise(own), F.lit("\n</think>\n\n"), with_box(answer))


def well_formed(c: Column) -> Column:
    """A box follows the last closing think tag."""
    return F.contains(c, F.lit("</think>")) & F.contains(F.substring_index(c, "</think>", -1), F.lit(MARK))


def think_before_box(c: Column) -> Column:
    """The first closing think tag stands before the last box."""
    think = F.instr(c, "</think>")
    last = F.length(c) - F.length(F.substring_index(c, MARK, -1)) - len(MARK) + 1
    return (think > 0) & F.contains(c, F.lit(MARK)) & (think < last)


def _scan(text: str, keep: bool) -> list[str]:
    """The closed boxes' contents (keep), or the text around all boxes (an unclosed one takes the rest)."""
    out, at = [], 0
    while True:
        start = text.find(MARK, at)
        if start < 0:
            return out if keep else [*out, text[at:]]
        if not keep:
            out.append(text[at:start])
        depth, i = 1, start + len(MARK)
        while i < len(text) and depth:
            if text[i] == "\\" and keep:
                i += 1
            elif text[i] in "{}":
                depth += 1 if text[i] == "{" else -1
            i += 1
        if depth:
            return out
        if keep:
            out.append(text[start + len(MARK) : i - 1])
        at = i


@F.pandas_udf(T.ArrayType(T.StringType()))
def all_closed(c: pd.Series) -> pd.Series:
    """Contents of all closed boxes; an escaped brace does not count."""
    return c.map(lambda x: None if x is None else _scan(x, True))


@F.pandas_udf(T.StringType())
def without_boxes(c: pd.Series) -> pd.Series:
    """The text without its boxes."""
    return c.map(lambda x: None if x is None else "".join(_scan(x, False)))
