"""Profiles and reports (DataFrame -> DataFrame)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators import rank
from tracemill.sources.files import cut


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def describe(df: DataFrame, value: str, by: str) -> DataFrame:
    v = F.col(value)
    quantiles = [F.percentile(v, F.lit(q)).alias(f"p{int(q * 100)}") for q in (0.25, 0.5, 0.75)]
    return df.groupBy(by).agg(F.count(v).alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_samp(v), 4).alias("std"), F.min(v).alias("min"), *quantiles, F.max(v).alias("max"))


def accuracy_report(df: DataFrame, by: str, ok: Column, truncated: Column) -> DataFrame:
    pct = lambda c: F.round(100.0 * F.sum(c.cast("int")) / F.count(F.lit(1)), 2)
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(ok.cast("int")).alias("passed"),
        (F.count(F.lit(1)) - F.sum(ok.cast("int"))).alias("failed"),
        F.sum(truncated.cast("int")).alias("truncated"),
        pct(ok).alias("acc_pct"),
        pct(truncated).alias("trunc_pct"),
    )


def exclusive_quantile(values: Column, q: float) -> Column:
    """Quantile by (n + 1) * q over an ascending array, as exclusive definitions have it; clamped at the ends."""
    n = F.size(values)
    at = F.lit(q) * (n + 1)
    lo = F.greatest(F.lit(1), F.least(n, F.floor(at).cast("int")))
    hi = F.greatest(F.lit(1), F.least(n, lo + 1))
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), at - lo))
    return F.element_at(values, lo) + part * (F.element_at(values, hi) - F.element_at(values, lo))


def entropy_metrics(counts: DataFrame, by: str, n: str) -> DataFrame:
    """Normalised entropy, share of the largest, coefficient of variation and number of active keys."""
    share = F.col(n) / F.sum(n).over(Window.partitionBy(by))
    shares = counts.withColumn("_p", share)
    return shares.groupBy(by).agg(
        F.round(-F.sum(F.when(F.col("_p") > 0, F.col("_p") * F.ln("_p"))) / F.ln(F.count(F.lit(1))), 6).alias("entropy"),
        F.round(F.max("_p"), 6).alias("max_share"),
        F.round(F.stddev_samp(n) / F.avg(n), 6).alias("load_cv"),
        F.sum((F.col(n) > 0).cast("int")).alias("active"),
        F.sum(n).alias("total"),
    )


def mode_or_abstain(df: DataFrame, by: str, value: str) -> DataFrame:
    """The most common value of a group; null if two share the first place."""
    counts = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("_n"))
    top = counts.withColumn("_top", F.max("_n").over(Window.partitionBy(by))).where(F.col("_n") == F.col("_top"))
    return top.groupBy(by).agg(F.when(F.count(F.lit(1)) == 1, F.max(value)).alias("mode"), F.max("_top").alias("votes"))


#: Characters of text in a block of documents, whose terms one task counts.
BLOCK_CHARS = 8_000_000
#: Terms on a smaller share of a group's documents are not summed at first.
TERM_SHARE = 0.005


def _counted(terms: Column) -> Column:
    """(term, c) of every distinct one of the terms, by the places in their order at which another begins."""
    at = lambda s: F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: (i == 0) | (i == F.size(s)) | (F.get(s, i) != F.get(s, i - 1)))
    runs = lambda s, p: F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: F.struct(F.get(s, a).alias("term"), (b - a).alias("c")))
    return F.transform(F.array(F.sort_array(terms)), lambda s: F.transform(F.array(at(s)), lambda p: runs(s, p))[0])[0]


def _packed(df: DataFrame, number: str) -> DataFrame:
    """A row per block and bucket: its terms in order as one text, and a number of each."""
    rows = df.groupBy("block", "bucket").agg(F.sort_array(F.collect_list(F.struct("term", number))).alias("rows"))
    return rows.select("block", "bucket", F.array_join("rows.term", "\n").alias("terms"), F.col(f"rows.{number}").alias("numbers"))


def _unpacked(df: DataFrame, number: str) -> DataFrame:
    return df.select("block", "bucket", "numbers", F.posexplode(F.split("terms", "\n")).alias("at", "term")).select("block", "bucket", "term", F.get("numbers", F.col("at")).alias(number))


def top_terms(df: DataFrame, key: str, by: str, text: str, terms: Callable[[Column], Column], n: int, min_df: int = 3, max_share: float = 0.95) -> DataFrame:
    """(by, term, score): the n terms of every group with the highest mean of their L2-normed TF-IDF weights in its documents.

    ``terms`` makes the array of a text's terms, none with a line break; rows without a text are left out, rows of one key
    and group are one document. Documents are dealt into blocks of BLOCK_CHARS, once for both steps that read them, as long
    as no Python function makes ``df`` (then they are shuffled twice). Only a block's distinct terms are shuffled, a row per block and bucket of terms, to be counted over all documents, and those that are
    known (on ``min_df`` documents at least and ``max_share`` of them at most) come back to it in the same way.
    As no weight is above 1, a term's mean is at most its share of the documents: terms below TERM_SHARE are summed only
    if the n-th mean of a group leaves room for them.
    """
    docs = df.select(F.col(key).alias("key"), F.col(by).alias("by"), F.col(text).alias("text")).where("text IS NOT NULL")
    sizes = cut(docs.groupBy("by").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).alias("chars")), "term-groups")
    rows, chars = sizes.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("chars"), F.lit(0))).first()
    groups = sizes.where("by IS NOT NULL").select("by", "docs")
    blocks = chars // BLOCK_CHARS + 1
    # A block is never null to the optimizer either, so both steps read the same shuffle.
    block = F.coalesce(F.pmod(F.hash("key"), F.lit(blocks)), F.lit(0))
    dealt = docs.withColumn("block", block).repartitionById(blocks, F.col("block"))
    whole = dealt.groupBy("block", "key", "by").agg(F.collect_list("text").alias("texts"))
    every = F.flatten(F.transform("texts", terms))
    counted = whole.select("block", "key", "by", F.inline(_counted(every)))
    found = whole.select("block", F.explode(F.array_distinct(every)).alias("term")).groupBy("block", "term").agg(F.count(F.lit(1)).alias("m"))
    found = _unpacked(_packed(found.withColumn("bucket", F.pmod(F.hash("term"), F.lit(blocks))), "m").repartitionById(blocks, F.col("bucket")), "m")
    found = found.withColumn("df", F.sum("m").over(Window.partitionBy("bucket", "term"))).where((F.col("df") >= min_df) & (F.col("df") <= max_share * rows))
    known = _unpacked(_packed(found, "df").repartitionById(blocks, F.col("block")), "df").drop("bucket")
    weight = (1 + F.ln("c")) * (F.ln(F.lit(1.0 + rows) / (1 + F.col("df"))) + 1)
    weights = counted.join(known.hint("shuffle_hash"), ["block", "term"]).withColumn("w", weight)
    normed = weights.withColumn("u", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("block", "key"))))
    share = TERM_SHARE
    while True:
        often = normed.join(F.broadcast(groups), "by").where(F.col("df") >= share * F.col("docs"))
        sums = cut(often.groupBy("by", "term", "docs").agg((F.sum("u") / F.col("docs")).alias("mean")), "term-means")
        # A mean that only just passes the share could be tied with one that was left out, once both are rounded.
        sure = sums.where(F.col("mean") > share + 1e-7).groupBy("by").agg(F.count(F.lit(1)).alias("sure")).where(F.col("sure") >= n)
        if groups.where(F.col("docs") * share > min_df).join(sure, "by", "left_anti").isEmpty():
            break
        share /= 16
    scored = sums.select(F.col("by").alias(by), "term", F.round("mean", 8).alias("score"))
    return rank.cap_per_group(scored, [by], [F.desc("score"), F.col("term")], n)
