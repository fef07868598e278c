"""State files, path discovery, canonical columns, key pools, retries and edge rows of the text functions."""

import math

import pytest
from pyspark.sql import functions as F

from tracemill.functions import boxed, classify, compare, jsons, parse, solve, text
from tracemill.operators import pick
from tracemill.sources import files, sinks
from tracemill.streaming import limits


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_paths_and_state(spark, tmp_path):
    a, b = tmp_path / "aa" / "train.csv", tmp_path / "b" / "deep" / "train.csv"
    for p in (a, b):
        p.parent.mkdir(parents=True)
        p.write_text("x")
    assert files.first_path(spark, [str(tmp_path / "no"), str(b)]) == str(b)
    assert files.first_path(spark, [], f"{tmp_path}/*/train.csv").endswith("/aa/train.csv")
    assert files.first_path(spark, [], f"{tmp_path}/none/*.csv") is None
    state = str(tmp_path / "state.json")
    for n in (1, 2):
        sinks.write_state(spark, state, {"done": n})
    assert sinks.read_state(spark, state) == {"done": 2} and sinks.read_state(spark, state + "-none") is None
    assert files.union_present(spark, [str(tmp_path / "no")], spark.read.json) is None


def test_keys_in_order():
    assert files.parse_keys("# k\nAPI_A=x\nexport API_B=\"y\"\nAPI_C=x\nOTHER=z\nAPI_D=\n", "API_") == ["x", "y"]


def test_csv_keeps_hard_fields(spark, tmp_path):
    rows = [("00101", 'a "quoted"\nline, and comma'), ("1", None), ("2", ""), ("3", "\\ back"), (None, "é 中 😀")]
    df = spark.createDataFrame(rows, "id string, t string")
    sinks.write_csv(df, str(tmp_path / "c"), ["id", "t"])
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(map(tuple, files.scan_csv(spark, str(tmp_path / "c")).collect()), key=key) == sorted(rows, key=key)


def test_strict_scan_fails(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        files.scan_jsonl(spark, str(tmp_path / "x.jsonl"), "a long").collect()
    assert files.scan_jsonl(spark, str(tmp_path / "x.jsonl"), "a long", strict=False).count() == 1


def test_canonical_columns(spark):
    df = spark.createDataFrame([("q", "r", 3)], "Question string, response string, extra int")
    out = pick.canonical(df, {"prompt": ["question"], "cot": ["generated_cot", "response"], "label": ["category"]}, {"label": "none"})
    assert out.columns == ["prompt", "cot", "label"] and tuple(out.first()) == ("q", "r", "none")
    assert pick.first_column(df, ["nope"]) is None


def test_limits_pool_and_retries():
    cooling, recent, until = limits.limited([0, 1, 2, 3, 40, 41], [], -math.inf, 10, 3, 30)
    assert cooling == [False, False, False, True, False, False] and recent == [40, 41] and until == 32
    now = [0.0]
    pool = limits.KeyPool(["a", "b", "a"], lambda: now[0], 30)
    assert [pool.next(), pool.next(), pool.next()] == ["a", "b", "a"]
    pool.limited("b")
    assert pool.next() == "a"
    pool.limited("a")
    assert pool.next() is None
    now[0] = 31
    assert pool.next() is not None
    slept, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise TimeoutError("timed out")
        return "ok"

    kind = lambda e: "transient" if "timed out" in str(e) else "other"
    assert limits.retried(call, 5, kind, slept.append, 1, 3) == "ok" and slept == [1, 2, 3]
    with pytest.raises(ValueError):
        limits.retried(lambda: (_ for _ in ()).throw(ValueError("no")), 5, kind, slept.append)


@pytest.mark.parametrize(
    ("raw", "want"),
    [("The final answer is: 3.14", "3.14"), ("Just a number 100 in text", "100"), (None, "NOT_FOUND"), ("\\boxed{}", ""), ("final answer 7\nlast 8", "8"), ("Final answer: a\nFinal answer: b", "b"), ("", "NOT_FOUND")],
)
def test_fallbacks(spark, raw, want):
    assert value(spark, boxed.with_fallbacks(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(
    ("pred", "gold", "binary", "plain"),
    [("10011000", "10011000", True, True), ("10011001", "10011000", False, True), ("24.6401", "24.64", True, True), ("xlvii\n", " XLVII", True, True), ("00011011", "11011", False, True), ("\u00a042", "42", True, True)],
)
def test_official(spark, pred, gold, binary, plain):
    assert value(spark, compare.official(F.lit(pred), F.lit(gold))) is binary
    assert value(spark, compare.official(F.lit(pred), F.lit(gold), binary=False)) is plain


def test_cleaner_keeps_longer_commands(spark):
    out = value(spark, text.plain_latex(F.lit("$a \\leq b$ \\left(\\frac{1}{2}\\right) \\to c")))
    assert out == "a <= b ((1)/(2)) -> c"


def test_classes_of_nulls(spark):
    for f in (classify.template_family, classify.puzzle_kind, classify.prompt_kind):
        assert value(spark, f(F.lit(None).cast("string"))) in ("unknown", "Unknown", "mixed-template")


def test_objects_in_text(spark):
    assert value(spark, jsons.first_object(F.lit('x {"a": {"b": 1}} {"c": 2}'))) == '{"a": {"b": 1}}'
    assert value(spark, jsons.first_object(F.lit('x {"a": 1'))) is None and value(spark, jsons.first_object(F.lit("none"))) is None


def test_solvers_abstain(spark):
    empty = F.lit("no examples here")
    assert value(spark, solve.gravity(empty)) is None and value(spark, solve.conversion(empty)) is None and value(spark, solve.numeral(empty))["answer"] is None
    assert value(spark, F.size(parse.arrows(empty))) == 0
    made = solve.byte_rule(spark.range(1).select(empty.alias("p")), F.col("p")).first()
    assert made["rule"] is None and made["answer"] is None


def test_two_places_round_the_binary_value(spark):
    values = [18.775, 0.125, 0.375, 2.675, 1.005, 0.0, 12.0, 99.995, -1.237, 1234.565]
    got = [r["v"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").orderBy("i").select(solve._two_places(F.col("x")).alias("v")).collect()]
    assert got == [f"{x:.2f}" for x in values]


def test_state_of_a_writer_that_ends_early(spark, tmp_path, monkeypatch):
    """Killed between a batch's write and its commit, or between a state's write and its name: the state before holds."""
    path, rows = str(tmp_path / "work"), spark.range(1000)
    work = lambda df: df.withColumn("twice", F.col("id") * 2)
    left = sinks.write_in_batches(rows, path, "id", 100, work, most=4)
    assert left == 6 and sinks.read_state(spark, path + "/state") == {"batches": 10, "done": 4}

    def killed(*_, **__):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(sinks, "write_state", killed)
        with pytest.raises(KeyboardInterrupt):
            sinks.write_in_batches(rows, path, "id", 100, work)
    with monkeypatch.context() as m:
        m.setattr(sinks.json, "dumps", killed)  # the file is there, without a name that counts
        with pytest.raises(KeyboardInterrupt):
            sinks.write_state(spark, path + "/state", {"done": 99})
    assert sinks.read_state(spark, path + "/state") == {"batches": 10, "done": 4}
    committed = sinks.read_batches(spark, path, "id long, twice long")
    assert committed.count() < 1000
    assert sinks.write_in_batches(rows, path, "id", 7, work) == 0
    got = sinks.read_batches(spark, path, "id long, twice long").collect()
    assert sorted(tuple(r) for r in got) == [(i, 2 * i) for i in range(1000)]
    assert sinks.write_in_batches(rows, path, "id", 100, work) == 0  # nothing is left to do


@pytest.mark.parametrize("name", ["last_balanced", "first_balanced", "first_or_tail", "last_flat", "last_closed_flat", "first_flat_or_line", "first_nested", "with_fallbacks", "answer_span", "all_closed", "without_boxes"])
def test_long_boxes(spark, name):
    inner = "a" * 200_000 + "{b}" * 20_000
    row = spark.createDataFrame([("so \\boxed{" + inner + "} end " + "x " * 50_000,)], "c string")
    got = row.select(getattr(boxed, name)(F.col("c")).alias("v")).first()["v"]
    if name in ("last_balanced", "first_balanced", "first_or_tail", "first_nested"):
        assert got == inner


def test_strip_is_linear_and_takes_all_spaces(spark):
    import time

    row = spark.createDataFrame([("\u2003\x85 a" + " " * 1_000_000 + "b\u3000\n",), ("\u200bx ",), (None,), (" \t",)], "c string")
    began = time.time()
    got = [r["v"] for r in row.select(text.strip(F.col("c")).alias("v")).collect()]
    assert time.time() - began < 20 and got == ["a" + " " * 1_000_000 + "b", "\u200bx", None, ""]


def test_filled_buckets_by_parts(spark):
    rows = [(i, "ab"[i % 5 == 0]) for i in range(100)]
    got = pick.fill_buckets(spark.createDataFrame(rows, "i long, b string"), "b", [F.col("i")], 15, "rest").collect()
    want = {}
    for bucket in "ab":
        own = [i for i, b in rows if b == bucket]
        want |= dict.fromkeys(own[:15], bucket)
    want |= dict.fromkeys([i for i, _ in rows if i not in want][:15], "rest")
    assert {r["i"]: r["placed"] for r in got} == want and len(got) == len(want)
