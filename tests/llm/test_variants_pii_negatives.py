"""Spelling variants, personal data and hard negatives against plain versions and their SQL."""

import random
import re
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracemill.llm import negatives, pii, queries, spelling

# --- spelling variants


def near(a, b):
    """Whether one inserted, deleted or replaced character makes one of the other."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def vocabularies():
    rng = random.Random(4)
    short = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(300)}
    stem = "".join(rng.choice("ab") for _ in range(40))
    deep = {stem, stem + "a", stem[:-1], *(stem[:i] + c + stem[i + 1 :] for i in range(0, 40, 3) for c in "abc"), *(stem[:i] + stem[i + 1 :] for i in range(40))}
    runs = {"a" * n for n in range(6, 60, 1)} | {"a" * n + "b" for n in range(20, 40, 2)} | {"a" * 24 + "b" * n for n in range(5)}
    edge = {"".join(rng.choice("ab") for _ in range(24)) + tail for tail in ("", "a", "b", "ab") for _ in range(10)}
    return {"many": short | deep | runs | edge, "none": set(), "one": {"letter"}}


@pytest.mark.parametrize("name", list(vocabularies()))
def test_near_pairs_by_brute_force(spark, name):
    words = sorted(vocabularies()[name])
    got = spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    want = sorted((a, b) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b))
    assert sorted(tuple(sorted(r)) for r in got) == want


def test_very_long_words(spark):
    rng = random.Random(6)
    word = "".join(rng.choice("ab") for _ in range(50_000))
    same = "a" * 30_000
    words = [word, word[:40_000] + "c" + word[40_001:], word[:-1], same, same + "a", same[:-2]]
    got = spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    assert {frozenset(r) for r in got} == {frozenset(words[:2]), frozenset((words[0], words[2])), frozenset(words[3:5])} and len(got) == 3


def duck(sql, **tables):
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table)
    made = con.execute(sql)
    names = [d[0] for d in made.description]
    return names, sorted(map(str, made.fetchall()))


def test_variants_against_sql(spark):
    rng = random.Random(9)
    base = ["letter", "latter", "lettre", "étage", "étages", "Stages", "stage", "wording", "wordings", "mañana", "aaaaaaa", "abc"]
    data = [(i, " ".join(rng.choices(base, [2 ** (len(base) - k) for k in range(len(base))], k=60)) + ",Letter×÷x_9") for i in range(60)]
    data += [(None, "letter letters letters"), (None, None), (70, ""), (71, None), (5, "lettar " * 5), (5, "lettar " * 5), (72, "letter" * 3000), (73, "planet " * 300), (74, "planets " * 50), (75, "planetss " * 8)] + [(80 + i, "hmm" + "m" * 300) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in data], "doc_id long, text string, word string, n string, run string").repartition(3)
    names, want = duck(spelling.ORACLE_SQL, documents=pa.table({"doc_id": pa.array([d[0] for d in data], pa.int64()), "text": [d[1] for d in data]}))
    made = spelling.variants(docs)
    assert sorted(made.columns) == sorted(names)
    got = made.select(*names).collect()
    assert sorted(str(tuple(r)) for r in got) == want
    told = {r["word"]: r for r in got}
    assert told["letter"]["n_near"] and any(r["root"] not in (r["form"], r["word"]) for r in got) and any(len(w) > 300 for w in told)
    assert spelling.variants(docs.limit(0)).count() == 0


# --- personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(d) if i % 2 == 0 else int(d) * 2 - 9 * (int(d) > 4) for i, d in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), order, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


@pytest.mark.parametrize("letters", ["a.@-_ 0123+()1é٣", "0123456789 -.+", "a@.", "0 -"])
def test_base_spans_by_plain_patterns(letters):
    rng = random.Random(letters)
    for _ in range(10_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert pii._base(text) == plain_base(text), text


@pytest.mark.parametrize("text", ["a" * 10**6, "1" * 10**6, "1 " * 500_000, "+1" + " " * 10**6, "@" * 10**6, "a@b" * 300_000, "1." * 500_000, ("1" * 1000 + ".") * 1000, "DE89" * 250_000, "123-45-6789 " * 80_000])
def test_long_texts_take_linear_time(text):
    began = time.time()
    pii.spans(text)
    assert time.time() - began < 10


def test_checksums_and_context():
    kinds = lambda t: [(s.kind, t[s.start : s.end]) for s in pii.spans(t)]
    assert kinds("pay DE89 3704 0044 0532 0130 00 now") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("pay DE89370400440532013000, GB82WEST12345698765432") == [("iban", "DE89370400440532013000"), ("iban", "GB82WEST12345698765432")]
    assert kinds("pay DE88 3704 0044 0532 0130 00 now") == [] and kinds("xDE89370400440532013000") == [] and kinds("DE89370400440532013000x") == []
    assert kinds("her SSN is 123-45-6789.") == [("ssn", "123-45-6789")] and kinds("see 123-45-6789.") == [] and kinds("SSN 000-45-6789, 666-45-6789, 900-45-6789, 123-00-6789") == []
    assert kinds("order SSN 123-45-6789") == []  # a word for it and one against
    assert kinds("card 4111 1111 1111 1111") == [("card", "4111 1111 1111 1111")] and kinds("card 4111 1111 1111 1112") == []
    score = {t: pii.spans(t)[0].score for t in ("host 10.0.0.1", "x 10.0.0.1", "version 10.0.0.1")}
    assert score["host 10.0.0.1"] > score["x 10.0.0.1"] > score["version 10.0.0.1"]


def pii_rows():
    rng = random.Random(12)
    parts = ["call +1 (017) 555-7713", "a.b@mail.example.com,", "10.20.30.40", "4111-1111-1111-1111", "DE89 3704 0044 0532 0130 00", "compte FR1420041010050500013M02606", "ssn: 123-45-6789", "123-45-6789", "order", "mañana", "x@y", "999.1.1.1", "4111111111111112", "sécurité"]
    return [(i, " ".join(rng.choices(parts, k=rng.randint(1, 12)))) for i in range(200)] + [(None, None), (None, "10.1.1.1"), (3, "10.1.1.1"), (3, "10.1.1.1"), (900, ""), (901, "ü" * 50_000 + " a@b.c")]


def test_pii_against_sql_and_masks(spark, tmp_path):
    rows = pii_rows()
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, Spans string, id string").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    made = queries.op12_pii(spark, str(tmp_path))
    names, want = duck(pii.ORACLE_SQL, documents=pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]}))
    assert sorted(made.columns) == sorted(names) and sorted(str(tuple(r)) for r in made.select(*names).collect()) == want
    found = pii.find(docs)
    assert found.columns == ["doc_id", "spans"] and pii.find(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "mail a@b.co or +1 (017) 555-7713!")], "doc_id long, text string")
    told = one.join(pii.find(one), "doc_id").select(pii.masked(F.col("text"), F.col("spans")).alias("m"))
    assert told.first()["m"] == "mail <email> or <phone>!"


# --- hard negatives


def vectors():
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 9).astype(np.float32)], int(rng.integers(0, 4))) for i in range(0, 1500, 5)]
    centre = rng.normal(0, 0.3, 9)
    rows += [(int(i), [float(x) for x in (centre + rng.normal(0, 0.004, 9)).astype(np.float32)], int(i % 2)) for i in range(2000, 2300, 4)]  # near copies
    rows += [(i, rows[3][1], rows[3][2]) for i in (700, 700, 701, 1400, 2100)]  # equal vectors, repeated ids
    nan, inf = float("nan"), float("inf")
    odd = [(None, rows[0][1], 1), (800, None, 1), (900, rows[1][1], None), (1000, [0.1, None], 2), (1100, [nan] * 9, 2), (1200, [inf, 0.0], 1), (1300, [], 1), (1301, [0.5, -0.5], 3), (-100, rows[2][1], 0), (1600, [0.0] * 9, 2)]
    return rows + odd


SCHEMA = "vec_id long, embedding array<float>, label int, ID string, row string, rest string"


@pytest.mark.parametrize(("a_pass", "sample", "centroids"), [(8192, 4096, 256), (3, 20, 4)])
def test_negatives_against_sql(spark, monkeypatch, a_pass, sample, centroids):
    for name, value in (("ANCHORS_A_PASS", a_pass), ("SAMPLE", sample), ("CENTROIDS", centroids), ("ROW_BLOCK", 50), ("ANCHOR_BLOCK", 7), ("PAIR_BLOCK", 11)):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors()
    table = pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": pa.array([r[2] for r in rows], pa.int32())})
    names, want = duck(negatives.ORACLE_SQL, embeddings=table)
    made = negatives.mine(spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).repartition(4))
    assert sorted(made.columns) == sorted(names) and sorted(str(tuple(r)) for r in made.select(*names).collect()) == want and len(want) > 100


def test_negatives_of_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.mine(empty).count() == 0
    assert negatives.mine(spark.createDataFrame([(1, [0.1], 1, "", "", ""), (100, [], 1, "", "", ""), (200, None, 1, "", "", "")], SCHEMA)).count() == 0


def test_bounds_hold_and_rule_out_most_pairs():
    rng = np.random.default_rng(8)
    rows = (rng.normal(0, 0.125, (4000, 64)) * 256).astype(np.int64)
    books = negatives.fit_codebooks(rows[:1000])
    codes, rest = negatives.encode(rows, books)
    anchors, labels = rows[:50], rng.integers(0, 5, 4000)
    true = rows @ anchors.T
    told = negatives.table_scores(anchors, codes, books)
    assert (np.abs(true - told) <= rest[:, None] * np.sqrt((anchors**2).sum(1))[None, :] + 1e-6).all()
    best = negatives.Best(50, 5)
    scan = negatives.Scan(books, anchors, labels[:50], np.arange(50), [(i, -negatives.NEVER, negatives.NEVER) for i in range(50)], True, 5)
    counts = np.zeros(2)
    for lo in range(0, 4000, 1000):
        at = slice(lo, lo + 1000)
        counts += scan.block(best, slice(0, 50), np.arange(4000)[at], np.arange(4000)[at], labels[at], rows[at], codes[at], rest[at])
    assert counts[1] < counts[0] / 4
    for i in range(50):
        want = sorted((-int(true[r, i]), r, r) for r in range(4000) if r != i and labels[r] == labels[i])[:5]
        assert best.rows[i] == want
