"""Personal data in texts: regular expressions propose spans, checksums confirm them, words nearby move their scores.

Emails, IP addresses, card and phone numbers are reported whenever their rule holds. Account numbers and social security
numbers are added where their score, moved by the words around them, reaches ACCEPT. Every pattern takes time
linear in the text, whatever it holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds that need no score, in the order of their report; the others follow by start too.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn")
#: What a confirmed span scores by itself, and what words near it add or take, once for all of them.
START = {"email": 0.8, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.3}
CONTEXT_STEP, ACCEPT = 0.3, 0.5
#: Code points before and after a span in which words count.
BEFORE, AFTER = 40, 20

#: Words that speak for a kind, lower case, in English, French, German and Spanish.
FOR = {
    "email": "email e-mail mail contact courriel kontakt correo",
    "ip": "ip address host server adresse serveur dirección servidor",
    "card": "card credit visa mastercard amex carte karte kreditkarte tarjeta",
    "phone": "phone tel telephone call mobile fax téléphone appeler telefon anruf handy teléfono llamar móvil",
    "iban": "iban account bank compte banque konto cuenta banco",
    "ssn": "ssn social security",
}
#: Words that speak against every kind: numbers beside them count, order or name things, not people.
AGAINST = "version build order invoice ticket isbn sku serial example sample"

# Local parts and domains of emails; the run before each @ is found by walking back from it.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Possessive forms: each takes what the greedy one does, without trying shorter runs. A number of under 12 digits is no card, whatever follows.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){11,}+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]++")
DIGIT = re.compile(r"[0-9]")
#: Lengths of account numbers by country (fixed values of the public registry).
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}
IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
IBAN_REST = {cc: re.compile(rf"(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for cc, n in IBAN_LENGTHS.items()}
#: Whole runs of digits and hyphens, less the areas, groups and serials that are never given out.
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
WORD = re.compile(r"[A-Za-zÀ-ÿ]+(?:-[A-Za-zÀ-ÿ]+)?")
FOR_SETS = {kind: frozenset(words.split()) for kind, words in FOR.items()}
AGAINST_SET = frozenset(AGAINST.split())


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Every second digit from the right is doubled, its digits summed; the whole must be a multiple of ten."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def mod97(account: str) -> bool:
    """The account number with its head moved to the end and letters as 10 to 35 leaves 1 modulo 97."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        body = m[0].rstrip(" ().-")
        if 9 <= sum(c.isdigit() for c in body) <= 15:
            yield m.start(), m.start() + len(body)


def _base(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four kinds that need no score, by start, then kind in the order of BASE."""
    out = [("email", s, e) for s, e in _emails(text)]
    if DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        out += [("phone", s, e) for s, e in _phones(text)]
    return sorted(out, key=lambda s: (s[1], BASE.index(s[0])))


def _added(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """Proposals of the other kinds. Account numbers may hold digits that pass as a card; the other kind overlaps no base span."""
    for m in IBAN_HEAD.finditer(text):
        rest = IBAN_REST.get(m[0][:2])
        if rest and (tail := rest.match(text, m.end())) and mod97((m[0] + tail[0]).replace(" ", "")):
            yield "iban", m.start(), tail.end()
    at = 0
    for m in SSN.finditer(text):
        while at < len(base) and base[at][2] <= m.start():
            at += 1
        if all(s >= m.end() or e <= m.start() for _, s, e in base[at : at + len(BASE)]):
            yield "ssn", m.start(), m.end()


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = {w.lower() for w in WORD.findall(text[max(0, start - BEFORE) : start])} | {w.lower() for w in WORD.findall(text[end : end + AFTER])}
    moved = START[kind] + CONTEXT_STEP * (not near.isdisjoint(FOR_SETS[kind])) - CONTEXT_STEP * (not near.isdisjoint(AGAINST_SET))
    return round(min(1.0, moved), 3)


def spans(text: str) -> list[Span]:
    """All personal data of a text by start, then kind in the order of BASE and ADDED; code points, end exclusive."""
    base = _base(text)
    out = [Span(k, s, e, _score(text, k, s, e)) for k, s, e in base]
    if DIGIT.search(text):
        out += [x for k, s, e in _added(text, base) if (x := Span(k, s, e, _score(text, k, s, e))).score >= ACCEPT]
    return sorted(out, key=lambda x: (x.start, (*BASE, *ADDED).index(x.kind)))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``spans``, an array of (kind, start, end, score), of every row.

    Whole texts are read; null and empty ones have no spans. Null and repeated ids are kept as they are, a row each;
    other columns are ignored, whatever their names; an empty table gives an empty result. Rows are independent of one
    another: no shuffle, and no key can be hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[s._asdict() for s in spans(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, SPANS)], names=["id", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, spans array<struct<kind: string, start: int, end: int, score: double>>")
    return out.withColumnRenamed("id", id_col)


def written(found: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans, comma-joined; of the given kinds only, if any are."""
    if kinds is not None:
        found = F.filter(found, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def masked(text: Column, found: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the one that starts first counts."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(
        F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("<"), s["kind"], F.lit(">")).alias("out"), s["end"].alias("at"))
    )
    return F.aggregate(found, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def _sql_words(words: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words.split()) + "]"


_AT = "rid, t, unnest(ps[:-2]) AS p, unnest(ms) AS m, unnest(range(len(ms))) AS i"
_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"[0-9-]+",
    "iban": r"[A-Za-z0-9]+",
}
_MATCHES = " UNION ALL ".join(f"SELECT '{k}' AS kind, rid, t, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS ps FROM d WHERE regexp_matches(t, '{p}')" for k, p in _PATTERNS.items() if k != "iban")
#: The same rows: places from the pieces between matches, checksums digit by digit.
ORACLE_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
ms AS ({_MATCHES} UNION ALL SELECT 'iban', rid, t, regexp_extract_all(t, '{_PATTERNS["iban"]}'), string_split_regex(t, '{_PATTERNS["iban"]}') FROM d WHERE regexp_matches(t, '[A-Z]{{2}}[0-9]{{2}}')),
e AS (SELECT kind, {_AT} FROM ms),
q AS (SELECT kind, rid, t, m, (sum(length(p) + length(m)) OVER (PARTITION BY kind, rid ORDER BY i) - length(m))::BIGINT AS s, regexp_replace(m, '[^0-9]', '', 'g') AS digits FROM e),
ib AS (SELECT rid, t, s, regexp_extract(substr(t, s + 1), '^(' || x.pat || ')(?:[^A-Za-z0-9]|$)', 1) AS m FROM q JOIN (SELECT unnest([{", ".join(f"'{c}'" for c in IBAN_LENGTHS)}]) AS cc,
 unnest([{", ".join(f"'{c}[0-9]{{2}}(?:{chr(92)}x20?[A-Z0-9]){{{n - 4}}}'" for c, n in IBAN_LENGTHS.items())}]) AS pat) x ON left(m, 2) = x.cc WHERE kind = 'iban' AND regexp_matches(m, '^[A-Z]{{2}}[0-9]{{2}}')),
ic AS (SELECT rid, t, s, m, replace(m, ' ', '') AS c FROM ib WHERE m <> ''),
ok AS (SELECT kind, rid, t, s, s + length(m) AS e FROM q WHERE CASE kind WHEN 'email' THEN true WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
  WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR right('000' || x, 3)::INT > 255)) = 0
  WHEN 'card' THEN length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, least(length(digits), 19) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(digits, -i, 1)::INT ELSE substr(digits, -i, 1)::INT * 2 - CASE WHEN substr(digits, -i, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0 END
 UNION ALL SELECT 'iban', rid, t, s, s + length(m) FROM ic WHERE list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(c, 5) || left(c, 4), ''), lambda x: unicode(x)::BIGINT)), lambda r, u: CASE WHEN u < 65 THEN (r * 10 + u - 48) % 97 ELSE (r * 100 + u - 55) % 97 END) = 1),
added AS (SELECT kind, rid, t, s, s + length(m) AS e FROM q WHERE kind = 'ssn' AND regexp_matches(m, '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$') AND NOT regexp_matches(m, '^(000|666|9)|-00-|0000$')
  AND NOT EXISTS (SELECT 1 FROM ok WHERE ok.rid = q.rid AND ok.kind <> 'iban' AND ok.s < q.s + length(q.m) AND q.s < ok.e)),
w AS (SELECT *, list_concat(regexp_extract_all(lower(substr(t, greatest(s - {BEFORE}, 0) + 1, least(s, {BEFORE}))), '[a-zÀ-ÿ]+(?:-[a-zÀ-ÿ]+)?'), regexp_extract_all(lower(substr(t, e + 1, {AFTER})), '[a-zÀ-ÿ]+(?:-[a-zÀ-ÿ]+)?')) AS near
 FROM (SELECT * FROM ok UNION ALL SELECT * FROM added)),
z AS (SELECT rid, kind, s, e, list_position(['{"', '".join((*BASE, *ADDED))}'], kind) AS o FROM w WHERE o <= {len(BASE)} OR
 CASE kind WHEN 'iban' THEN {START["iban"]} ELSE {START["ssn"]} END + CASE WHEN list_has_any(near, CASE kind WHEN 'iban' THEN {_sql_words(FOR["iban"])} ELSE {_sql_words(FOR["ssn"])} END) THEN {CONTEXT_STEP} ELSE 0 END
 - CASE WHEN list_has_any(near, {_sql_words(AGAINST)}) THEN {CONTEXT_STEP} ELSE 0 END >= {ACCEPT}),
g AS (SELECT rid, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (o <= {len(BASE)}) AS base, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)} FROM z GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)"""
