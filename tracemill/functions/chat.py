"""Chat rows from problems and solutions: prompt templates by category, one adapter for sources of unlike columns, caps."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.text import strip


def templated(problem: Column, category: Column, templates: Mapping[str, str], default: str) -> Column:
    """The template of the row's category, or the one of ``default``, with the stripped problem for ``{problem}``."""
    table = F.create_map(*[F.lit(x) for pair in templates.items() for x in pair])
    return F.replace(F.coalesce(F.try_element_at(table, category), F.lit(templates[default])), F.lit("{problem}"), strip(problem))


def thought_and_box(cot: Column, answer: Column) -> Column:
    """The reasoning without its own tags, closed, and the answer, taken out of any flat box, in a box of its own."""
    bare = strip(F.regexp_replace(answer, r"\\boxed\{([^}]*)\}", "$1"))
    return F.concat(F.lit("<think>\n"), strip(F.regexp_replace(cot, "</?think>", "")), F.lit("\n</think>\n\\boxed{"), bare, F.lit("}"))


@dataclass(frozen=True)
class Adapter:
    """How a source names its columns (the first filled one counts), and what its rows need.

    Without answer columns the answer is the first flat box of the solution. Rows without a solution get ``opening`` and
    their answer for it, or go if it is None; rows with one of fewer than ``least`` characters go.
    """

    source: str
    problem: tuple[str, ...]
    solution: tuple[str, ...]
    answer: tuple[str, ...] = ()
    opening: str | None = None
    least: int = 0
    category: str | None = None


def _first_filled(df: DataFrame, names: tuple[str, ...]) -> Column:
    found = [F.col(n).cast("string") for n in names if n in df.columns]
    return F.coalesce(*[F.when(c != "", c) for c in found], F.lit(""))


def adapt(df: DataFrame, how: Adapter, category: Column, templates: Mapping[str, str], default: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(source, category, messages) and the columns to keep; ``category`` is worked out of the column ``problem``."""
    rows = df.select(*keep, _first_filled(df, how.problem).alias("problem"), _first_filled(df, how.solution).alias("solution"), _first_filled(df, how.answer).alias("answer"))
    solution = F.col("solution")
    answer = F.col("answer") if how.answer else F.regexp_extract(solution, r"\\boxed\{([^}]*)\}", 1)
    rows = rows.where("problem <> ''").where((solution == "") | (F.length(strip(solution)) >= how.least))
    cot = solution
    if how.opening is None:
        rows = rows.where("solution <> ''")
    else:
        cot = F.when(solution != "", solution).otherwise(F.concat(F.lit(how.opening + "\nAnswer: "), F.col("answer")))
    kind = category if how.category is None else F.lit(how.category)

    def said(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    made = F.array(said("user", templated(F.col("problem"), kind, templates, default)), said("assistant", thought_and_box(cot, answer)))
    return rows.select(*keep, F.lit(how.source).alias("source"), kind.alias("category"), made.alias("messages"))


def cap_tokens(df: DataFrame, ids: str, labels: str, most: int, drop: bool, mask: int = -100) -> DataFrame:
    """Rows with a label that is not masked; of longer ones than ``most`` tokens none, or their first ``most``.

    A cut row whose kept labels are all masked goes as well, as there is nothing left to learn from it.
    """
    learns = F.exists(F.col(labels), lambda x: x != mask)
    rows = df.where(learns)
    if drop:
        return rows.where(F.size(ids) <= most)
    return rows.withColumns({ids: F.slice(ids, 1, most), labels: F.slice(labels, 1, most)}).where(learns)
