"""Long multiplication and division against Python's decimals; every line of the working holds by itself."""

import random
from decimal import ROUND_DOWN, Decimal, localcontext

import duckdb

from tracemill import plans
from tracemill.functions import longhand


def rows():
    rng = random.Random(3)
    number = lambda k, p: str(rng.randrange(10**k)) + ("." + "".join(rng.choice("0123456789") for _ in range(p)) if p else "")
    made = [(number(rng.randint(1, 40), rng.randint(0, 5)), number(rng.randint(1, 30), rng.randint(0, 5))) for _ in range(60)]
    return [*made, ("0", "5"), ("7", "0"), ("0.00", "1.5"), ("0007", "03.10"), ("12", "x"), ("-1", "2"), ("", "1"), (None, "1"), ("9" * 300, "9" * 35), ("1", "9" * 40)]


def places(x):
    return len(x.partition(".")[2])


def test_products_and_quotients(spark):
    df = spark.createDataFrame(rows(), "a string, b string")
    odd = lambda r: r["a"] in (None, "", "-1") or r["b"] == "x"
    with localcontext() as context:
        context.prec = 1000
        for r in longhand.long_multiplication(df, "a", "b").collect():
            if odd(r):
                assert r["product"] is None and r["working"] is None
                continue
            assert r["product"] == f"{Decimal(r['a']) * Decimal(r['b']):.{places(r['a']) + places(r['b'])}f}"
            assert len(r["working"]) == max(0, 2 * len(r["b"].lstrip("0.").replace(".", "").replace("0", "")) - 1)
            for line in r["working"]:
                left, sum_ = line.split(" = ")
                x, sign, y = left.split(" ")
                assert (Decimal(x) * Decimal(y) if sign == "*" else Decimal(x) + Decimal(y)) == Decimal(sum_)
        for r in longhand.long_division(df, "a", "b").collect():
            if odd(r) or Decimal(r["b"]) == 0 or len(r["b"]) == 40:
                assert r["quotient"] is None and r["working"] is None
                continue
            assert r["quotient"] == f"{(Decimal(r['a']) / Decimal(r['b'])).quantize(Decimal('0.001'), rounding=ROUND_DOWN):.3f}"
            for line in r["working"]:
                x, _, y, _, q, _, rest = line.split(" ")
                assert int(x) == int(y) * int(q) + int(rest) and int(rest) < int(y)


def test_parts_are_dealt_to_all_tasks(spark, tmp_path):
    spark.createDataFrame([(k, k % 50 + 1) for k in range(1, 400)], "p_partkey long, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    made = plans.QUERIES["longhand_arithmetic"](spark, str(tmp_path))
    assert made.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert sorted(map(tuple, made.collect())) == sorted(con.execute(plans.ORACLE_SQL["longhand_arithmetic"]).fetchall())
