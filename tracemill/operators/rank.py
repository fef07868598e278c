"""Ranking, capping, dedup and mixing over a total order (DataFrame -> DataFrame). Orders must break ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Leading digits of a hash that cut a group into parts (4,096 of them).
KEY_DIGITS = 3
#: Rank up to which the optimizer pushes a limit into a window (its default), and the parts of a group above it.
GROUP_LIMIT = 1_000
PARTS = 64


def seeded(*cols: Column, seed: int = 0) -> Column:
    """A shuffle key that is the same in every run and for every partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *cols))


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def placed(df: DataFrame, by: list[str], order: list[Column], key: Column | None = None) -> DataFrame:
    """``_pos``, the 0-based rank in the group, and ``_size`` of the group.

    Without ``key`` a group is ranked in one task. ``key``, a hexadecimal hash, leads the order then, and its first digits
    cut a group into parts that are ranked apart; a part's offset is the count of the parts before it, which takes a
    table of 16 ** KEY_DIGITS rows a group at most. Nulls in ``by`` are a group.
    """
    if key is None:
        own = Window.partitionBy(*by)
        return df.withColumn("_pos", F.row_number().over(own.orderBy(*order)) - 1).withColumn("_size", F.count(F.lit(1)).over(own))
    df = df.withColumn("_part", F.substring(key, 1, KEY_DIGITS))
    parts = df.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy(*by)
    before = F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    keys = [*by, "_part"]
    parts = parts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(own).alias("_size"))
    df = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(key, *order)))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    df = df.join(parts, same).withColumn("_pos", F.col("_before") + F.col("_rn") - 1)
    return df.drop("_part", "_rn", "_before", *[f"_k{i}" for i in range(len(keys))])


def cap_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of every group.

    Up to GROUP_LIMIT the optimizer drops later rows before the shuffle. Above it rows are dealt into parts by their hash,
    and the first n of each part go on, so that a group's last task has at most PARTS * n rows.
    """
    if n > GROUP_LIMIT:
        df = df.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.lit(PARTS)))
        df = numbered(df, [*by, "_part"], order, "_rn").where(F.col("_rn") <= n).drop("_rn", "_part")
    return numbered(df, by, order, "_rn").where(F.col("_rn") <= n).drop("_rn")


def keep_first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return cap_per_group(df, by, order, 1)


def depth_fill(df: DataFrame, group: str, problem: str, order: list[Column], first_seen: str, target: int) -> DataFrame:
    """Round-robin by depth: one trace of every problem, then a second, until a group has ``target`` rows."""
    own = Window.partitionBy(group, problem)
    df = df.withColumn("depth", F.row_number().over(own.orderBy(*order)) - 1)
    df = df.withColumn("n_traces", F.count(F.lit(1)).over(own)).withColumn("_seen", F.min(first_seen).over(own))
    return cap_per_group(df, [group], [F.col("depth"), F.col("n_traces"), F.col("_seen"), F.col(first_seen)], target).drop("_seen")


def first_last(df: DataFrame, by: list[str], value: str, first: str, last: str) -> DataFrame:
    """The first and the last value of every group, both from one aggregation."""
    return df.groupBy(*by).agg(F.min(value).alias(first), F.max(value).alias(last))


def upsample(df: DataFrame, by: list[str], order: list[Column], target: int, key: Column | None = None) -> DataFrame:
    """Rows of every group repeated in turn until it has ``target``; ``variation`` counts the turns. ``key`` as in ``placed``."""
    df = placed(df, by, order, key).where(F.col("_pos") < target)
    turns = F.ceil((F.lit(target) - F.col("_pos")) / F.col("_size")).cast("int")
    return df.withColumn("variation", F.explode(F.sequence(F.lit(0), turns - 1))).drop("_pos", "_size")


def holdout_split(df: DataFrame, by: list[str], order: list[Column], held: int, cap: int) -> DataFrame:
    """``split``: the first ``held`` rows of a group are held out, the next ``cap`` train, the rest go."""
    df = numbered(df, by, order, "_rn").where(F.col("_rn") <= held + cap)
    return df.withColumn("split", F.when(F.col("_rn") <= held, "holdout").otherwise("train")).drop("_rn")


def stratified_batches(df: DataFrame, label: str, order: list[Column], size: int, key: Column | None = None) -> DataFrame:
    """``batch``: labels dealt evenly. Positions follow from per-label ranks and counts, so only a table with a row per label is ordered globally. ``key`` as in ``placed``."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(label).alias("_l"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    df = placed(df, [label], order, key).join(counts, F.col(label).eqNullSafe(F.col("_l")))
    batches = F.ceil(F.col("_all") / F.lit(size))
    return df.withColumn("batch", F.pmod(F.col("_before") + F.col("_pos"), batches)).drop("_pos", "_size", "_l", "_before", "_all")


def first_wins(sources: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first source that has the key."""
    ranked = [s.withColumn("_src", F.lit(i)) for i, s in enumerate(sources)]
    out = ranked[0]
    for s in ranked[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return keep_first(out, [key], [F.col("_src")]).drop("_src")


def oversample(df: DataFrame, copies: Column) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
