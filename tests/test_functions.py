"""Golden cases of the scalar libraries."""

import pytest
from pyspark.sql import functions as F

from tracemill.functions import boxed, compare, puzzle, text
from tracemill.operators import profile, rank

BOX = "\\boxed{"
CASES = [
    (f"a {BOX}1}} b {BOX}2}}", "2", "1", "2"),
    (BOX + "\\frac{1}{2}}", "\\frac{1}{2}", "\\frac{1}{2}", "\\frac{1"),
    (BOX + "12", None, "12", "12"),
    (BOX + "}", "", "", ""),
    ("no box", None, None, ""),
]


def test_boxed_variants(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string").orderBy("i")
    c = F.col("t")
    rows = df.select(boxed.last_balanced(c), boxed.first_or_tail(c), boxed.last_flat(c)).collect()
    assert [tuple(r) for r in rows] == [c[1:] for c in CASES]
    more = df.select(boxed.all_closed(c).alias("a"), boxed.without_boxes(c).alias("w")).collect()
    assert more[0]["a"] == ["1", "2"] and more[0]["w"] == "a  b "
    assert more[2]["a"] == [] and more[2]["w"] == ""


@pytest.mark.parametrize(
    ("pred", "gold", "binary", "want"),
    [
        ("24.6401", "24.64", True, True),
        ("xlvii", "XLVII", True, True),
        ("00011011", "11011", True, False),
        ("00011011", "11011", False, True),
        ("10011001", "10011000", True, False),
        ("10011001", "10011000", False, True),
        ("3d", "3", True, False),
    ],
)
def test_official(spark, pred, gold, binary, want):
    row = spark.createDataFrame([(pred, gold)], "p string, g string").select(compare.official(F.col("p"), F.col("g"), binary)).first()
    assert row[0] is want


@pytest.mark.parametrize(
    ("pred", "gold", "kind", "want"),
    [("42", "42", "other", True), ("9.81", "9.80", "gravity", True), ("9.81", "10.0", "gravity", False), ("00101010", "42", "bit", True), ("0xFF", "255", "bit", True), ("HELLO", "hello", "cipher", True)],
)
def test_by_type(spark, pred, gold, kind, want):
    row = spark.createDataFrame([(pred, gold, kind)], "p string, g string, k string").select(compare.by_type(F.col("p"), F.col("g"), F.col("k"))).first()
    assert row[0] is want


def test_text_and_puzzles(spark):
    df = spark.createDataFrame([(" A b\n", "aab")], "t string, w string")
    row = df.select(text.norm(F.col("t")), text.norm(text.norm(F.col("t"))), text.strip(F.col("t")), text.pattern_of(F.col("w")), text.caesar(F.col("w"), 3)).first()
    assert tuple(row) == ("ab", "ab", "A b", "1.1.2", "dde")
    numbers = spark.range(1, 4000).select("id", puzzle.to_roman(F.col("id")).alias("r"))
    assert numbers.where(puzzle.from_roman(F.col("r")) != F.col("id")).isEmpty()


def test_rank_ties_do_not_depend_on_partitioning(spark):
    rows = spark.createDataFrame([(i % 3, i // 7, i) for i in range(100)], "g int, v int, i int")
    picks = [sorted(map(tuple, rank.cap_per_group(rows.repartition(n), ["g"], [F.col("v"), F.col("i")], 4).collect())) for n in (1, 8)]
    assert picks[0] == picks[1] and len(picks[0]) == 12
    batches = rank.stratified_batches(rows, "g", [F.col("i")], 10).groupBy("batch").count().collect()
    assert {r["count"] for r in batches} == {10}
    assert rank.upsample(rows, ["g"], [F.col("i")], 50).count() == 150


def test_ranks_by_parts_equal_ranks_by_window(spark, monkeypatch):
    rows = spark.createDataFrame([(None if i % 3 == 2 else i % 3, i // 7, i) for i in range(200)], "g int, v int, i int")
    key = rank.seeded(F.col("v").cast("string"))
    plain, parts = (sorted(map(str, rank.placed(rows, ["g"], o, k).select("g", "i", "_pos", "_size").collect())) for o, k in (([key, F.col("i")], None), ([F.col("i")], key)))
    assert plain == parts and len(plain) == 200
    turned = [sorted(map(str, rank.upsample(rows, ["g"], [F.col("i")], n, key).groupBy("g").agg(F.count("i"), F.max("variation")).collect())) for n in (50, 150)]
    assert turned == [sorted(f"Row(g={g}, count(i)={n}, max(variation)={v})" for g in (None, 0, 1)) for n, v in ((50, 0), (150, 2))]
    whole = sorted(map(str, rank.cap_per_group(rows, ["g"], [F.col("v"), F.col("i")], 20).collect()))
    monkeypatch.setattr(rank, "GROUP_LIMIT", 10)
    assert sorted(map(str, rank.cap_per_group(rows, ["g"], [F.col("v"), F.col("i")], 20).collect())) == whole and len(whole) == 60
    assert rank.placed(rows.limit(0), ["g"], [F.col("i")], key).count() == 0


def test_mode_abstains_on_ties(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, profile.mode_or_abstain(rows, "k", "v").collect())) == [(1, None, 1), (2, "a", 2)]
