"""Merges of adapters as tables of cells: weighted sums, random drops, and trimming with an elected sign. No tensor is whole in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.operators.rank import seeded
from tracemill.operators.search import small
from tracemill.sources.files import cut

#: Parts that a round divides the range of a group's values into.
BINS = 1_024


def kth_largest(df: DataFrame, by: list[str], value: Column, share: float) -> DataFrame:
    """(by, threshold): the k-th largest value of every group, k the given share of its rows, rounded up.

    Rounds of histograms instead of a sort: each finds the part of the range that holds the k-th value and takes the
    least and largest value in it as the next range, until it is one value. A round shuffles at most BINS rows a group
    after partial counts. Null values are no rows.
    """
    rows = cut(df.select(*by, value.cast("double").alias("_v")).where("_v IS NOT NULL"), "merge-values")
    state = rows.groupBy(*by).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.ceil(F.count(F.lit(1)) * F.lit(share)).alias("need"))
    state = cut(state.where("need > 0"), "merge-state")
    named = lambda s: s.select(*[F.col(b).alias(f"_{b}") for b in by], "lo", "hi", "need")
    while not state.where("lo < hi").isEmpty():
        same = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
        inside = rows.join(small(named(state.where("lo < hi"))), same).where("_v BETWEEN lo AND hi")
        # lo falls into the first part and hi into the last, so a round always divides.
        part = F.least(F.lit(BINS - 1), F.floor((F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS)).cast("int")
        counts = inside.groupBy(*by, "need", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("l"), F.max("_v").alias("h"))
        lists = counts.groupBy(*by, "need").agg(F.reverse(F.array_sort(F.collect_list(F.struct("part", "n", "l", "h")))).alias("parts"))  # BINS at most
        start = F.struct(F.col("need").alias("need"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
        step = lambda s, x: F.when(s["lo"].isNotNull(), s).when(s["need"] > x["n"], F.struct((s["need"] - x["n"]).alias("need"), s["lo"].alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["need"].alias("need"), x["l"].alias("lo"), x["h"].alias("hi")))
        found = lists.select(*by, F.aggregate("parts", start, step).alias("s")).select(*by, "s.lo", "s.hi", "s.need")
        state = cut(state.where("lo >= hi").unionByName(found), "merge-state")
    return state.select(*by, F.col("lo").alias("threshold"))


def linear(df: DataFrame, cell: list[str], value: str, weight: Column) -> DataFrame:
    """The weighted sum of every cell over its sources; a cell that a source lacks counts as 0 there."""
    return df.groupBy(*cell).agg(F.sum(F.col(value) * weight).alias(value))


def dropped(df: DataFrame, keys: list[str], value: str, share: float, seed: int = 0) -> DataFrame:
    """A share of the cells goes, by a seeded hash of their keys, and what stays is scaled up by it; the same in every run."""
    kept = F.substring(seeded(*[F.col(k).cast("string") for k in keys], seed=seed), 1, 8) >= f"{int(share * 16**8):08x}"
    return df.where(kept).withColumn(value, F.col(value) / (1 - share))


def trimmed(df: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """The cells of every group whose size reaches that of its k-th largest, ties too."""
    least = kth_largest(df, by, F.abs(value), share)
    least = small(cut(least.select(*[F.col(b).alias(f"_{b}") for b in by], "threshold"), "merge-least"))
    same = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
    return df.join(least, same).where(F.abs(value) >= F.col("threshold")).drop("threshold", *[f"_{b}" for b in by])


def elected(df: DataFrame, cell: list[str], value: str) -> DataFrame:
    """Per cell the mean of the values that have the sign of its sum; cells whose sum is 0 have none."""
    plus, minus = F.sum(F.when(F.col(value) > 0, F.col(value))), F.sum(F.when(F.col(value) < 0, F.col(value)))
    n_plus, n_minus = F.count_if(F.col(value) > 0), F.count_if(F.col(value) < 0)
    made = df.groupBy(*cell).agg(F.coalesce(plus, F.lit(0)).alias("_p"), F.coalesce(minus, F.lit(0)).alias("_m"), n_plus.alias("_np"), n_minus.alias("_nm"))
    mean = F.when(F.col("_p") + F.col("_m") > 0, F.try_divide("_p", "_np")).when(F.col("_p") + F.col("_m") < 0, F.try_divide("_m", "_nm"))
    return made.select(*cell, mean.alias(value)).where(F.col(value).isNotNull())
