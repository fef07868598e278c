"""Row filters that every curation step uses (DataFrame -> DataFrame); a condition that is null keeps no row."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def complete(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without a null in the given columns, or in any if none are given."""
    return df.na.drop(subset=[f"`{c}`" for c in columns] or None)


def correct(df: DataFrame, met: Callable[[Column, Column], Column], pred: str, gold: str) -> DataFrame:
    """Rows whose answer a comparator of the library accepts; a null on either side is no match."""
    return df.where(F.coalesce(met(F.col(pred), F.col(gold)), F.lit(False)))


def discrepant(df: DataFrame, told: str, gold: str) -> DataFrame:
    """Rows that have a gold answer and tell another, or none."""
    return df.where(F.col(gold).isNotNull() & ~F.col(told).eqNullSafe(F.col(gold)))


def allowed(df: DataFrame, label: str, labels: Iterable[str]) -> DataFrame:
    """Rows whose label is in the list, as it stands; a null label never is."""
    return df.where(F.col(label).isin(*labels))


def without(df: DataFrame, *prefixes: str) -> DataFrame:
    """All columns but helpers, whose names begin with one of the prefixes."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith(prefixes)])


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n) of every rule of a training set: the rows that break it, those where it is null among them, in one pass."""
    counts = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"r{i}") for i, rule in enumerate(rules.values())]
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("n")) for i, name in enumerate(rules)])
    return df.agg(*counts).select(F.explode(pairs).alias("p")).select("p.rule", "p.n")
