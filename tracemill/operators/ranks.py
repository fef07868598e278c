"""Ranks for the components of a block, dealt by their singular values, and use of experts by a router."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def allocate_ranks(values: DataFrame, block: str, component: str, place: str, value: str, total: int, least: int, priority: Mapping[str, float]) -> DataFrame:
    """(block, component, rank): every component keeps its first ``least`` values, the largest others share the rest of ``total``.

    ``values`` has a row per singular value, which fall with ``place`` (from 0) inside a component, so that taking the
    largest next value again and again is one rank over the block. Values weigh by the component's priority (1 if it has
    none); of equal ones the first component by name and the first place go first. If the floors need more than ``total``,
    only they are given. Rows without a value are left out.
    """
    weight = F.lit(1.0)
    for name, by in priority.items():
        weight = F.when(F.col(component) == name, F.lit(float(by))).otherwise(weight)
    rows = values.where(F.col(value).isNotNull()).select(block, component, place, (F.col(value) * weight).alias("_w"))
    floor = F.col(place) < least
    order = Window.partitionBy(block, floor).orderBy(F.col("_w").desc(), component, place)
    dealt = rows.select(block, component, floor.alias("_f"), F.row_number().over(order).alias("_k"))
    # Floors are counted per component, and no more than ``total`` places are shared: a block's rows are not held for a window over all of them.
    near = F.sort_array(F.collect_list(F.when(~F.col("_f") & (F.col("_k") <= total), F.col("_k"))))
    counts = dealt.groupBy(block, component, "_f").agg(F.count(F.lit(1)).alias("_n"), near.alias("_ks"))
    per = counts.groupBy(block, component).agg(F.coalesce(F.sum(F.when(F.col("_f"), F.col("_n"))), F.lit(0)).alias("_u"), F.flatten(F.collect_list("_ks")).alias("_ks"))
    used = F.sum("_u").over(Window.partitionBy(block))
    shared = F.size(F.filter("_ks", lambda k: k <= F.lit(total) - F.col("_used")))
    return per.withColumn("_used", used).select(block, component, (F.col("_u") + shared).cast("long").alias("rank"))


def top_places(scores: Column, k: int) -> Column:
    """The places (from 0) of the k largest scores, larger first, of equal ones the first; null scores last."""
    pairs = F.transform(scores, lambda x, i: F.struct((-x).alias("down"), i.alias("i")))
    fresh = F.filter(pairs, lambda p: p["down"].isNotNull())
    return F.transform(F.slice(F.array_sort(fresh), 1, k), lambda p: p["i"])


def router_use(logits: DataFrame, scores: str, experts: int, k: int) -> DataFrame:
    """(expert, picks, share) for each of ``experts``, unused ones with 0: how often it is among a row's top k."""
    picks = logits.select(F.explode(top_places(F.col(scores), k)).alias("expert")).groupBy("expert").agg(F.count(F.lit(1)).alias("picks"))
    every = logits.sparkSession.range(experts).select(F.col("id").cast("int").alias("expert"))
    full = every.join(F.broadcast(picks), "expert", "left").select("expert", F.coalesce("picks", F.lit(0)).alias("picks"))
    total = F.sum("picks").over(Window.partitionBy(F.lit(0)))
    return full.withColumn("share", F.when(total > 0, F.col("picks") / total).otherwise(0.0))
