"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tracemill import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([r[i] for i in order] for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_oracle(spark, duck, name):
    made = plans.QUERIES[name](spark, SF)
    got = rows_of(made.columns, [tuple(r) for r in made.collect()])
    want = duck.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    want = rows_of(names, want.fetchall())
    assert sorted(made.columns) == sorted(names) and len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9)) for x, y in zip(a, b, strict=True)), (a, b)


def test_versions_share_the_whole_normalised_text(spark, tmp_path):
    head = "same words at the start " * 5
    rows = [(0, head + "one"), (1, head + "two"), (2, "A  Text\n"), (3, "a text"), (4, None), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [r["n"] for r in plans.QUERIES["having_two_versions"](spark, str(tmp_path)).collect()] == [2]


def test_tfidf_takes_accents_and_pairs(spark, tmp_path):
    rows = [(i, "fr", "Réélu été ünd 4a" if i < 3 else f"autre mot{i}") for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["term"]: r["score"] for r in plans.QUERIES["tfidf_ngram_terms"](spark, str(tmp_path)).collect()}
    # Each of the 3 documents has 7 equal terms, each of the others one that is frequent enough.
    assert set(got) == {"reelu", "ete", "und", "4a", "reelu ete", "ete und", "und 4a", "autre"}
    assert all(math.isclose(v, 0.5 if k == "autre" else 0.5 / math.sqrt(7), abs_tol=1e-7) for k, v in got.items())
