"""Ordered rules: the first that matches names the class."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions.text import strip

#: Substrings of the puzzle families, the first family with a hit wins (fixed values).
FAMILIES = (
    ("bit_manipulation", ("bit manipulation", "8-bit")),
    ("gravity", ("gravit", "falling")),
    ("numeral", ("numeral system",)),
    ("unit_conversion", ("unit conversion", "m becomes")),
    ("cipher", ("encrypt", "decrypt", "cipher")),
    ("equation", ("transformation rule", "equation")),
)
#: The families in the order of the merging rules, where equations split by the digits of their examples (fixed values).
MERGE_FAMILIES = (
    ("cipher", ("encrypt", "decrypt", "cipher")),
    ("bit_manipulation", ("bit manipulation", "8-bit")),
    ("numeral", ("numeral system",)),
    ("unit_conversion", ("unit conversion",)),
    ("gravity", ("gravit",)),
)
#: Keywords of the solver registry (fixed values).
SOLVER_FAMILIES = (
    ("bit_manipulation", ("bit manipulation", "8-bit binary", "bit shifts", "xor")),
    ("gravity", ("gravitational constant", "falling distance", "d = 0.5*g*t")),
    ("unit_conversion", ("unit conversion", "secret unit conversion")),
    ("cipher", ("secret encryption", "encryption rules", "decrypt the following")),
    ("numeral", ("numeral system", "different numeral system", "wonderland numeral system")),
    ("equation", ("transformation rules", "secret set of transformation", "determine the result for")),
)
#: Template phrases of the families (fixed values).
TEMPLATE_FAMILIES = (
    ("bit_manipulation", ("secret bit manipulation rule transforms 8-bit binary numbers", "bit manipulation")),
    ("cipher", ("secret encryption rules are used on text", "decrypt the following text")),
    ("equation_numeric", ("secret set of transformation rules is applied to equations",)),
    ("numeral", ("numbers are secretly converted into a different numeral system", "wonderland numeral")),
    ("gravity", ("gravitational constant has been secretly changed", "gravitational")),
    ("unit_conversion", ("secret unit conversion is applied to measurements", "unit conversion")),
)
#: Patterns of the puzzle kinds, case aside (fixed values).
PUZZLES = (
    ("numeral system|base[- ]?[0-9]|number.*convert|radix|secret number", "Number Base Conversion"),
    ("gravit|gravity|falling|free.?fall|acceleration due to", "Gravitational Constant"),
    ("transformation rule|equation.*transform|secret.*rule.*equation|rule.*applied.*equation", "Equation Transformation"),
    ("encrypt|cipher|secret.*code.*letter|coded.*message|secret.*text", "Text Encryption"),
    ("bit.?manipul|binary|8.?bit|bitwise|bit.*transform", "Bit Manipulation"),
    ("unit.?conver|measurement|becomes.*[0-9]|secret.*conver.*measur", "Unit Conversion"),
)
#: Kinds of prompts by pattern, case aside and over line ends (fixed values).
PROMPT_KINDS = (
    (r"(?:\bbit\s*m[ai]n[ip]*u?l?ation\b|\bbit\s*wis?e\b|\bbit\s*shift\b|\bbit\s*rotat\w*|\bxor\b|\bxnor\b|\b8[-\s]?bit\b|\bbinary\s+numbers?\b|\bmajority\s+function\b|\bchoice\s+function\b)", "binary-transform"),
    (r"(?:\broma+n\s+numeral\w*|\broma+n\b(?=[^.]{0,80}\bnumber\b)|\bnumeral\s+system\b|\bwonderland\s+numeral\b)", "roman-numeral"),
    (r"(?:\b(?:en|de)\s*c?rypt\w*|\b(?:en|de)\s*cod\w*|\bcaes[ae]r\b|\bciph[ae]r\w*|\bsubstitut\w*|\bsecret\s+encryption\b)", "encoding-decoding"),
    (r"(?:transformation\s+rules?[^.\n]{0,80}equations?|`[^`\n]*[!@#$%^&*()\[\]{}<>'\"\\][^`\n]*`\s*=\s*`?|\bsymbolic\s+(?:rule|mapping|transform)\w*)", "mapping-symbolic"),
    (r"(?:\bgravitation\w*|\bunit\s+conversion\b|\bd\s*=\s*0?\.5\s*\*\s*g\s*\*\s*t\s*\^?\s*2|\bmeasurement\w*\s+(?:is\s+)?(?:secretly\s+)?(?:applied|converted)|\bm\s+becomes\s+\d|\bsecret\s+formula\b|\bsecretly\s+(?:changed|converted))", "numeric-rule"),
    (r"(?:\bsequence\b|\bnext\s+(?:term|number|element|value)\b|\bcontinue\s+the\s+(?:pattern|sequence)\b|\barithmetic\s+progression\b|\bgeometric\s+progression\b|\bnth\s+term\b)", "sequence-rule"),
    (r"(?:\banagram\w*|\bpalindrom\w*|\breverse\s+the\s+(?:string|text|word)|\bstring\s+(?:transform|manipulation)\w*|\bcase\s+(?:swap|flip)\b)", "string-transform"),
    (r"(?:\blogic\s+puzzle\w*|\briddle\w*|\btrue\s+or\s+false\b|\byes\s+or\s+no\b|\bknights?\s+and\s+knaves\b)", "logic-short-answer"),
    (r"(?:\btable\b|\bgrid\b|\bmatrix\b|\brows?\s+and\s+columns?\b|\bcell\s+at\s+row\b)", "table-like-rule"),
)
#: Whether a prompt asks for roman numerals (fixed value).
ROMAN = r"(?i)\b(roman numeral|roman-numeral|convert.*roman|roman.*convert|to roman|from roman|numeral.*roman)\b"
#: Answer types by full match (fixed values).
ANSWER_TYPES = ((r"^[01]+$", "binary"), (r"^-?[0-9]+(\.[0-9]+)?$", "numeric"), (r"^[IVXLCDM]+$", "roman"), (r"^[A-Za-z]+(?: [A-Za-z]+)*$", "english_phrase"))
#: Signs of an error in its message, after its status (fixed values).
TRANSIENT = ("timeout", "timed out", "connection", "503", "502", "504")


def first_match(c: Column, rules: Sequence[tuple[str, str]], default: str, regex: bool = True) -> Column:
    """Class of the first rule whose pattern (or substring) the column has; null text gives the default."""
    out = None
    for pattern, name in rules:
        hit = F.rlike(c, F.lit(pattern)) if regex else F.contains(c, F.lit(pattern))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(default)


def first_keyword(c: Column, groups: Sequence[tuple[str, tuple[str, ...]]], default: str) -> Column:
    """The first group one of whose words the column holds, lower case."""
    low, out = F.lower(c), None
    for name, words in groups:
        hit = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def family(c: Column) -> Column:
    return first_keyword(c, FAMILIES, "other")


def merge_family(c: Column, known: Column) -> Column:
    """The family looked up before, else by keywords; equations whose examples begin without digits are cryptarithms."""
    body = F.substring(F.substring_index(F.lower(c), "examples:", -1), 1, 140)
    equation = F.when(F.rlike(body, F.lit("[0-9]")), "equation_numeric_deduce").otherwise("cryptarithm_deduce")
    is_equation = F.contains(F.lower(c), F.lit("transformation rule")) | F.contains(F.lower(c), F.lit("equation"))
    own = first_keyword(c, MERGE_FAMILIES, "")
    return F.coalesce(known, F.when(own != "", own).when(is_equation, equation).otherwise("other"))


def solver_family(c: Column) -> Column:
    return first_keyword(c, SOLVER_FAMILIES, "unknown")


def template_family(c: Column) -> Column:
    return first_keyword(F.coalesce(c, F.lit("")), TEMPLATE_FAMILIES, "unknown")


def puzzle_kind(c: Column) -> Column:
    return first_match(F.coalesce(c, F.lit("")), [("(?i)" + p, name) for p, name in PUZZLES], "Unknown")


def prompt_kind(c: Column) -> Column:
    return first_match(F.coalesce(c, F.lit("")), [("(?is)" + p, name) for p, name in PROMPT_KINDS], "mixed-template")


def asks_roman(c: Column) -> Column:
    return F.rlike(c, F.lit(ROMAN))


def answer_type(c: Column) -> Column:
    return first_match(strip(c), ANSWER_TYPES, "other")


def error_kind(status: Column, message: Column) -> Column:
    """rate_limit, bad_request, transient or other of a failed call."""
    low = F.lower(F.coalesce(message, F.lit("")))
    limited = F.coalesce(status == 429, F.lit(False)) | F.contains(low, F.lit("429")) | F.contains(low, F.lit("rate limit"))
    passing = F.coalesce((status >= 500) | (status == 408), F.lit(False))
    for sign in TRANSIENT:
        passing = passing | F.contains(low, F.lit(sign))
    return F.when(limited, "rate_limit").when(status == 400, "bad_request").when(passing, "transient").otherwise("other")


def top_score(scores: Sequence[tuple[str, Column]], default: str) -> Column:
    """Name of the highest positive score; the first named wins ties."""
    best = F.greatest(*[s for _, s in scores])
    out = F.when(best <= 0, default)
    for name, s in scores:
        out = out.when(s == best, name)
    return out.otherwise(default)


def drop_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first failing rule; null for rows that pass all."""
    out = None
    for name, fails in rules:
        fails = F.coalesce(fails, F.lit(True))
        out = F.when(fails, name) if out is None else out.when(fails, name)
    return out


#: Marker and symbols of the equation family (fixed values).
ASKS_RESULT = "now, determine the result for:"
SYMBOLS = "!@#$%^&*()_+-=[]{}|;:'\",.<>/?`~\\"


def task_family(c: Column) -> Column:
    """Task by words of the whole prompt; an equation is symbolic if a symbol stands after the last marker, as written."""
    low = F.lower(c)

    def has(*words: str) -> Column:
        return reduce(or_, [F.contains(low, F.lit(w)) for w in words])

    asked = F.substring_index(c, ASKS_RESULT, -1)
    symbolic = F.translate(asked, SYMBOLS, "") != asked
    equation = has("alice") & has("wonderland") & has("equations")
    return (
        F.when(equation & symbolic, "equation_symbolic")
        .when(equation, "equation_numeric")
        .when(has("roman"), "numeral")
        .when(has("cipher", "encrypted", "decrypt"), "cipher")
        .when(has("gravity", "planet", "mass"), "gravity")
        .when(has("convert") & has("unit", "meter", "gram", "liter"), "unit_conversion")
        .when(has("bit", "binary"), "bit_manipulation")
        .otherwise("other")
    )


def matched(mode: str, answer: Column, boxed: Column) -> Column:
    """Whether a row counts as right by its answer, its box, both or either; a null verdict counts as wrong."""
    answer, boxed = F.coalesce(answer, F.lit(False)), F.coalesce(boxed, F.lit(False))
    modes = {"both": answer & boxed, "answer": answer, "boxed": boxed, "either": answer | boxed}
    if mode not in modes:
        raise ValueError(f"mode must be one of {', '.join(modes)}, not {mode!r}")
    return modes[mode]
