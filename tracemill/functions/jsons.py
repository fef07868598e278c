"""JSON inside texts: the first balanced object, its fields, and tables as text (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions.boxed import _close
from tracemill.functions.text import has_emoji, strip


def first_object(c: Column) -> Column:
    """The text from the first opening brace to the brace that closes it; null if none does. Braces in strings count too."""
    at = F.instr(c, "{")
    tail = F.when(at > 0, F.substring(c, at + 1, F.length(c)))
    end = _close(tail)
    return F.when(end >= 0, F.substring(c, at, end + 2))


def checked_trace(raw: Column, answer: Column) -> Column:
    """The field ``cot`` of the first object of a reply, if it is sound: think tags, a last line that is a box, the answer inside, no emoji."""
    unfenced = F.regexp_replace(F.regexp_replace(strip(raw), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    cot = strip(F.get_json_object(first_object(unfenced), "$.cot"))
    lines = F.filter(F.transform(F.split(cot, "\r\n|[\n\r]"), strip), lambda x: x != "")
    last = F.try_element_at(lines, F.lit(-1))
    sound = F.contains(cot, F.lit("<think>")) & F.contains(cot, F.lit("</think>")) & F.startswith(last, F.lit("\\boxed{")) & F.endswith(last, F.lit("}"))
    return F.when(sound & F.contains(cot, strip(F.coalesce(answer, F.lit("")))) & ~has_emoji(cot), cot)


def table_text(header: Column, rows: Column, most: int = 8) -> Column:
    """A table as lines of cells between bars, the header first, at most ``most`` rows."""
    line = lambda cells: F.array_join(cells, " | ")
    return F.array_join(F.concat(F.array(line(header)), F.transform(F.slice(rows, 1, most), line)), "\n")
