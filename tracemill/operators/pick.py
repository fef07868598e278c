"""Orders, samples, thresholds and bounded fills (DataFrame -> DataFrame). Orders must break ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators.rank import cap_per_group, numbered, seeded


def sample(df: DataFrame, n: int, key: Column, seed: int = 0) -> DataFrame:
    """n rows, or all if there are fewer, the same in every run: the first by a seeded hash of the key."""
    return df.orderBy(seeded(key, seed=seed), key).limit(n)


def sample_per_group(df: DataFrame, by: list[str], n: int, key: Column, seed: int = 0) -> DataFrame:
    return cap_per_group(df, by, [seeded(key, seed=seed), key], n)


def page(df: DataFrame, order: list[Column], n: int, skip: int = 0) -> DataFrame:
    """n rows of an order after the first ``skip``."""
    return df.orderBy(*order).offset(skip).limit(n)


def at_least_kth(df: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """``kept``: whether a value reaches the k-th largest of its group; ties with it are kept."""
    ranked = numbered(df.select(*by, F.col(value).alias("_v")), by, [F.col("_v").desc()], "_rn").where(F.col("_rn") <= k)
    least = ranked.groupBy(*[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)]).agg(F.min("_v").alias("_least"))
    on = [F.col(b).eqNullSafe(F.col(f"_b{i}")) for i, b in enumerate(by)]
    return df.join(least, on).withColumn("kept", F.col(value) >= F.col("_least")).drop("_least", *[f"_b{i}" for i in range(len(by))])


def fill_buckets(df: DataFrame, bucket: str, order: list[Column], size: int, second: str) -> DataFrame:
    """``placed``: the first ``size`` rows of a bucket stay, as many of the rest go to bucket ``second``, others have none.

    Buckets are cut in parts first, so that a hot one is never ranked in one task; ``order`` must break all ties.
    """
    stays = cap_per_group(df, [bucket], order, size).withColumn("placed", F.col(bucket))
    own = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in df.columns]
    taken = stays.select(*[F.col(c).alias(f"_s_{c}") for c in df.columns])
    spilled = df.join(taken, own, "left_anti").orderBy(*order).limit(size).withColumn("placed", F.lit(second))
    return stays.unionByName(spilled)


def mixed(sources: list[tuple[DataFrame, int]], key: Column, n: int, seed: int = 0) -> DataFrame:
    """Sources with their copies in one, shuffled by a seeded hash, the first n rows."""
    out = None
    for df, copies in sources:
        own = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out.orderBy(seeded(key, F.col("copy").cast("string"), seed=seed), key, "copy").limit(n)


def joined_on_text(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column) -> DataFrame:
    """Inner join of rows with equal normalised keys, by their hashes first and then by the keys themselves."""
    a, b = left.withColumn("_lk", left_key), right.withColumn("_rk", right_key)
    return a.join(b, (F.xxhash64("_lk") == F.xxhash64("_rk")) & (F.col("_lk") == F.col("_rk"))).drop("_lk", "_rk")


def first_column(df: DataFrame, candidates: list[str]) -> str | None:
    """The column whose name is the first of the candidates, in any case."""
    known = {c.lower(): c for c in reversed(df.columns)}
    return next((known[c.lower()] for c in candidates if c.lower() in known), None)


def canonical(df: DataFrame, aliases: dict[str, list[str]], defaults: dict[str, str]) -> DataFrame:
    """The columns of ``aliases`` from the first alias each that exists, else their default; all others go."""
    found = {name: first_column(df, [name, *others]) for name, others in aliases.items()}
    return df.select(*[(F.col(f"`{c}`") if c else F.lit(defaults.get(name))).cast("string").alias(name) for name, c in found.items()])


def zipped(left: DataFrame, right: DataFrame, by: str, order: str) -> DataFrame:
    """Rows of one group paired by their places in an order; the longer side's rest goes."""
    a, b = (numbered(x, [by], [F.col(order)], "_at") for x in (left, right))
    b = b.select(*[F.col(c).alias(f"right_{c}") for c in b.columns])
    return a.join(b, (F.col(by) == F.col(f"right_{by}")) & (F.col("_at") == F.col("right__at"))).drop("_at", "right__at", f"right_{by}")


def running(df: DataFrame, by: list[str], order: list[Column], hit: Column) -> DataFrame:
    """n and correct of every group up to and with each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("correct", F.sum(hit.cast("long")).over(w))
