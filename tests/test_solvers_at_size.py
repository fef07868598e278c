"""Solvers do their work once a row, shuffle little, and are exact where numbers are large or prompts ambiguous."""

import duckdb
from pyspark.sql import functions as F

from tracemill import plans
from tracemill.functions import gates, puzzle, solve
from tracemill.operators import equations, search


def parses(made):
    """How often an expression reads its prompt."""
    return str(made).count("regexp_extract")


def test_gravity_reads_its_prompt_once_a_part(spark):
    assert parses(solve.gravity(F.col("prompt"))) == 3 and parses(solve.gravity_by_median(F.col("prompt"))) == 3
    text = "For t = 1.0s, distance = 2.50 m\nFor t = 2.0s, distance = 10.00 m\ndetermine the falling distance for t = 3.0s"
    made = spark.createDataFrame([(text,), ("nothing",), (None,)], "prompt string").select(solve.gravity(F.col("prompt")), solve.gravity_by_median(F.col("prompt")))
    assert [tuple(r) for r in made.collect()] == [("22.50", "22.50"), (None, None), (None, None)]


def test_conversion_reads_its_prompt_once_a_part(spark):
    assert parses(solve.conversion(F.col("prompt"))) == 3 and parses(solve.conversion(F.col("prompt"), median=True)) == 3
    rows = [("2.0 m becomes 5.00\n4.0 m becomes 8.00\nconvert the following measurement: 10.0 m",), ("nothing",), (None,)]
    made = spark.createDataFrame(rows, "prompt string").select(solve.conversion(F.col("prompt")), solve.conversion(F.col("prompt"), median=True))
    assert [tuple(r) for r in made.collect()] == [("22.50", "20.00"), (None, None), (None, None)]


def test_cipher_reads_its_prompt_once_a_part(spark):
    assert parses(solve.cipher(F.col("prompt"))) <= 4  # the words of both sides are matched by their counts too
    text = "ab -> xy\nac -> zy\nNow, decrypt the following text: ab d"
    got = spark.createDataFrame([(text,), (None,)], "prompt string").select(solve.cipher(F.col("prompt")).alias("s")).select("s.*").collect()
    assert tuple(got[0]) == ("xy ?", 1, 1) and got[1]["answer"] is None


def executed(made):
    return made._jdf.queryExecution().executedPlan().toString()


def test_rule_statuses_shuffles_a_row_an_order_and_no_row_a_rule(spark, tmp_path):
    rows = [(1, n, 7 * n, 11 * n) for n in range(1, 5)] + [(2, 1, 5, 6), (2, 1, 8, 9), (2, 2, 30, 31), (3, 1, 1, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    made = plans.QUERIES["rule_statuses"](spark, str(tmp_path))
    below = executed(made).split("Exchange hashpartitioning")
    assert len(below) == 2 and "Generate" not in below[1]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert sorted(map(tuple, made.collect())) == sorted(con.execute(plans.ORACLE_SQL["rule_statuses"]).fetchall())


def test_next_terms_of_large_numbers(spark):
    n, r = 3_000_000_000, 55_000
    rows = [([(n + i) ** 2 for i in range(5)],), ([r**i for i in range(5)],), ([7 * 3**i for i in range(5)],), ([-(2**63) + i for i in range(5)],), ([2**63 - 5 + i for i in range(5)],), ([None] * 5,)]
    made = spark.createDataFrame(rows, "t array<long>").select(puzzle.next_term(F.col("t")).alias("n"))
    assert [x["n"] for x in made.collect()] == [(n + 5) ** 2, None, 7 * 3**5, -(2**63) + 5, None, None]


def test_bits_tell_their_rule_where_three_bytes_do_not(spark, tmp_path):
    keys = [27122, 34448, 109361]  # whose three bytes a mask alone explains
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    got = plans.QUERIES["solve_bits"](spark, str(tmp_path)).collect()
    assert {(r["p_partkey"], r["answer"], r["rule"]) for r in got} == {(27122, "01100011", "rol1_mask"), (34448, "00110101", "rol1_mask"), (109361, "01011100", "rol1_mask")}


def test_cryptarithms_that_differ_by_names_are_searched_once(spark, monkeypatch):
    rows, cut_ = {}, search.cut

    def kept(df, name):
        rows[name] = cut_(df, name)
        return rows[name]

    monkeypatch.setattr(search, "cut", kept)
    text = "12{34 = 46\n21{13 = 34\nNow, determine the result for: 24{12"
    name = lambda k: text.translate({ord(str(d)): "!@$%^&"[(d + k) % 6] for d in range(1, 7)}).replace("{", "{|+"[k % 3])
    made = spark.createDataFrame([(k, name(k)) for k in range(6)] + [(9, "nothing")], "k int, p string")
    got = {r["k"]: tuple(r)[1:] for r in search.cryptarithms(made, "k", F.col("p")).collect()}
    assert rows["search-start"].count() == 1
    assert len({got[k] for k in range(6)}) == 1 and got[9][1] == "unparsed"


def test_ranks_sum_floors_after_they_are_counted(spark, tmp_path):
    rows = [(s, "ANR"[i % 3], float(i * 37 % 101), i, i % 7) for s in range(3) for i in range(150 * s + 2)]
    spark.createDataFrame(rows, "l_suppkey long, l_returnflag string, l_extendedprice double, l_orderkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    made = plans.QUERIES["allocated_ranks"](spark, str(tmp_path))
    plan = executed(made)
    assert "Window [sum(" in plan and "Window [sum(" not in plan[plan.index("HashAggregate(keys=[block"):]  # not over all rows of a block
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert sorted(map(tuple, made.collect())) == sorted(con.execute(plans.ORACLE_SQL["allocated_ranks"]).fetchall())


def test_gates_solve_equal_examples_once(spark, monkeypatch):
    rows, cut_ = {}, gates.cut

    def kept(df, name):
        rows[name] = cut_(df, name)
        return rows[name]

    monkeypatch.setattr(gates, "cut", kept)
    text = "00000000 -> 00000000\n10000001 -> 11111111\nNow, determine the output for: 10000000"
    made = spark.createDataFrame([(3, text), (1, text), (2, text.replace("10000000", "00000001")), (4, None)], "k int, p string")
    got = {r["k"]: r for r in gates.per_bit(made, "k", F.col("p")).collect()}
    assert rows["gate-words"].count() == 2
    assert got[1]["rules"] == got[3]["rules"] and got[1]["answer"] == got[3]["answer"] == "11111111" and got[2]["answer"] is not None and got[4]["answer"] is None


def test_equations_shuffle_no_row_a_candidate(spark):
    rows = [("k", i, str(10 + i * 7 % 90), "+", str(10 + i * 11 % 90), None if i == 1 else str(20 + i * 7 % 90 + i * 11 % 90) if i != 70 else "3", i == 1) for i in range(1, 140)]
    rows += [("m", 1, "12", "+", "34", None, True), ("m", 2, "56", "+", "17", "73", False), ("m", 3, "21", "+", "13", "34", False)]
    lines = spark.createDataFrame(rows, "key string, i int, a string, op string, b string, y string, asked boolean")
    made = equations.solved(lines)
    assert not [line for line in executed(made).splitlines() if "Exchange hashpartitioning" in line and " o#" in line]
    got = {r["key"]: r for r in made.collect()}
    assert got["m"]["rule"] == "addition" and got["m"]["answer"] == "46"
    missed = {(x["name"], x["a"], x["b"]) for x in got["k"]["rejected"]}
    assert got["k"]["rule"] is None and len(got["k"]["rejected"]) == 128 and ("addition", "50", "60") in missed  # line 70 alone misses it


def test_equal_ciphers_are_solved_once(spark, monkeypatch):
    rows, cut_ = {}, search.cut

    def kept(df, name):
        rows[name] = cut_(df, name)
        return rows[name]

    monkeypatch.setattr(search, "cut", kept)
    text = "bcd -> abc\nNow, decrypt the following text: bcde dcb"
    made = spark.createDataFrame([(3, text), (1, text), (2, text.replace("dcb", "cdb")), (5, None), (4, None)], "k int, p string")
    vocabulary = spark.createDataFrame([("abcd",), ("abcx",), ("cba",), ("abca",)], "word string")
    got = {r["k"]: tuple(r)[1:] for r in search.cipher_words(made, "k", F.col("p"), vocabulary).collect()}
    assert rows["search-ciphers"].count() == 3 and rows["search-candidates"].count() == 4
    assert got == {1: (None, "ambiguous", 2), 3: (None, "ambiguous", 2), 2: (None, "ambiguous", 2), 4: (None, "unparsed", 0), 5: (None, "unparsed", 0)}


def test_equations_work_out_equal_lines_once_and_write_logs_out_within_their_row(spark, monkeypatch):
    rows, cut_ = {}, equations.cut

    def kept(df, name):
        rows[name] = cut_(df, name)
        return rows[name]

    monkeypatch.setattr(equations, "cut", kept)
    lines = [(k, i, str(20 + i), "+", "13", None if i == 1 else f"+{i}" if k == 7 else str(33 + i + (k == 5 and i == 3)), i == 1) for k in range(9) for i in range(1, 5)] + [(9, 1, "12", "+", "34", None, True), (9, 2, "10", None, "20", "30", False)]
    df = spark.createDataFrame(lines, "key int, i int, a string, op string, b string, y string, asked boolean")
    made = equations.solved(df)
    got = {r["key"]: r.asDict(recursive=True) for r in made.collect()}
    assert rows["equation-misses"].count() == 11  # three sums, one wrong, three signed as they stand and with a minus, and the line without an operator
    logs = [line for line in executed(made).splitlines() if "Generate" in line]
    assert not logs and got[0]["rule"] == "addition" and got[0]["answer"] == "34" and got[5]["rule"] is None and len(got[5]["rejected"]) == 128
    monkeypatch.setattr(equations, "BROADCAST_ROWS", 3)
    assert {r["key"]: r.asDict(recursive=True) for r in equations.solved(df).collect()} == got
