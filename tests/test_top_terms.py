"""Terms by weight: equal to SQL over blocks, repeated and null ids, and short and long accents; no row per document and term is shuffled."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tracemill import plans
from tracemill.functions import text
from tracemill.operators import profile


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("terms"))
    words = ["alpha", "Été", "naïve", "beta", "Straße", "ünd", "x1", "gamma"]
    rows = [(None if i % 13 == 0 else i // 2 if i % 7 == 0 else i, (None, "fr", "de", "en")[i % 4] if i != 5 else "rare", " ".join(words[(i * 3 + j * j) % 8] for j in range(i % 11))) for i in range(120)]
    spark.createDataFrame([*rows, (500, "en", None)], "doc_id long, lang string, text string").write.parquet(at + "/documents.parquet")
    return at


def test_agrees_with_sql_in_many_blocks_and_when_the_share_is_too_high(spark, folder, monkeypatch):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = sorted(con.execute(plans.ORACLE_SQL["tfidf_ngram_terms"]).fetchall())
    for chars, share in ((100, 0.001), (1000, 0.9)):
        monkeypatch.setattr(profile, "BLOCK_CHARS", chars)
        monkeypatch.setattr(profile, "TERM_SHARE", share)
        got = sorted(map(tuple, plans.QUERIES["tfidf_ngram_terms"](spark, folder).collect()))
        assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=2e-8)


def test_shuffles_a_row_a_document_and_rows_of_many_terms(spark, folder, monkeypatch):
    made, cut = {}, profile.cut
    monkeypatch.setattr(profile, "cut", lambda df, name: made.setdefault(name, df) and cut(df, name))
    monkeypatch.setattr(profile, "BLOCK_CHARS", 1000)
    plans.QUERIES["tfidf_ngram_terms"](spark, folder)
    plan = made["term-means"]._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]
    # Documents for both steps, packed terms to and fro; sums of the frequent terms alone are a row per term.
    assert sum("REPARTITION_BY_NUM" in line for line in sent) == 4 and sum("hashpartitioning" in line for line in sent) == 1


def test_short_accents_are_stripped_alike(spark):
    rows = [("".join(map(chr, range(0x80, 0x530))),), ("‑’",), ("plain",), ("½ ﬁ 가",), (None,), ("",), *[(chr(c),) for c in range(0x80, 0x530)]]
    df = spark.createDataFrame(rows, "t string").select("t", text.has_short_accents(F.col("t")).alias("short"), text.strip_accents(F.col("t")).alias("a"), text.strip_short_accents(F.col("t")).alias("b"))
    got = {r["t"]: r for r in df.collect()}
    assert all(r["a"] == r["b"] for r in got.values() if r["short"])
    assert got["plain"]["short"] and got["‑’"]["short"] and got["é"]["short"] and not got["½ ﬁ 가"]["short"]


def test_ascii_is_not_held_against_every_range(spark):
    assert "{10ffff}&&[^" in str(text.has_short_accents(F.col("t")))


def test_documents_are_measured_in_one_pass(spark, folder, monkeypatch):
    made, cut = [], profile.cut
    monkeypatch.setattr(profile, "cut", lambda df, name: made.append((name, df.columns)) or cut(df, name))
    plans.QUERIES["tfidf_ngram_terms"](spark, folder)
    assert ("term-groups", ["by", "docs", "chars"]) in made
