"""Line dedup by site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import WS_CLASS, cut, fresh_names, small_side

#: A line on more than this share of a host's distinct pages is boilerplate.
RATIO = 0.05
#: ... if it is on at least this many of them, so that tiny hosts keep their text.
MIN_PAGES = 3
#: Hosts up to which the rule table (some hundred hashes a host) is broadcast.
BROADCAST_HOSTS = 2_000


def boilerplate_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(_host, _rules): per host the MD5s of its boilerplate lines.

    A page is a distinct text of its host: exact copies count once, or a large group of copies would turn its own
    content into boilerplate. A host has at most (lines a page) / ratio such lines.
    """
    text = F.col(f"`{text_col}`")
    pages = docs.where(text.isNotNull()).select(
        F.col(f"`{host_col}`").alias("_host"),
        F.md5(text).alias("_page"),
        F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: ~F.rlike(x, F.lit(f"^{WS_CLASS}*$"))), F.md5)).alias("_lines"),
    )
    pages = cut(pages.groupBy("_host", "_page").agg(F.first("_lines").alias("_lines")), "line-pages")
    totals = pages.groupBy("_host").agg(F.count(F.lit(1)).alias("_total")).withColumnRenamed("_host", "_h2")
    counts = pages.select("_host", F.explode("_lines").alias("_line")).groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.where(F.col("_n") >= min_pages)
    often = counts.join(F.broadcast(totals) if totals.count() <= BROADCAST_HOSTS else totals, F.col("_host").eqNullSafe(F.col("_h2")))
    often = often.where(F.col("_n") > F.lit(ratio) * F.col("_total"))
    return often.groupBy("_host").agg(F.collect_set("_line").alias("_rules"))


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Every input column with boilerplate lines taken out of the text, and n_lines, n_dropped.

    Lines end at ``\\n``; equality is of whole lines. Lines without words never count as boilerplate. A null text
    stays null with 0 lines; an empty text is one empty line. Null hosts form one host. Rows are never dropped, even
    if no line remains; the order of the remaining lines holds. Empty input gives an empty result. Input columns
    named n_lines or n_dropped are replaced; columns of any other name, those of inner steps too, pass unchanged.
    """
    rules = small_side(cut(boilerplate_lines(docs, host_col, text_col, ratio, min_pages), "line-rules"), BROADCAST_HOSTS)
    host, drop, own, left = fresh_names(docs, "_host", "_rules", "_all", "_kept")
    rules = rules.select(F.col("_host").alias(host), F.col("_rules").alias(drop))
    joined = docs.join(rules, F.col(f"`{host_col}`").eqNullSafe(F.col(host)), "left")
    lines, source = F.split(F.col(f"`{text_col}`"), "\n"), F.col(f"`{text_col}`")
    kept = F.when(F.col(drop).isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col(drop), F.md5(x))))
    joined = joined.withColumn(own, F.coalesce(F.size(lines), F.lit(0))).withColumn(left, kept)
    text = F.when(F.col(own) == F.size(left), source).otherwise(F.array_join(left, "\n"))
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")],
        F.when(source.isNull(), 0).otherwise(F.col(own)).cast("long").alias("n_lines"),
        F.when(source.isNull(), 0).otherwise(F.col(own) - F.size(left)).cast("long").alias("n_dropped"),
    )


ORACLE_SQL = rf"""
WITH l AS (SELECT source, text, unnest(string_split(text, chr(10))) AS line FROM documents),
n AS (SELECT source, line, count(DISTINCT text) AS n FROM l GROUP BY ALL),
t AS (SELECT source, count(DISTINCT text) AS total FROM documents GROUP BY ALL),
b AS (SELECT n.source, list(line) AS rules FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source
      WHERE n >= {MIN_PAGES} AND n > CAST({RATIO} AS DOUBLE) * total
        AND NOT regexp_full_match(line, '[\x20\x09-\x0D]*') GROUP BY ALL),
d AS (SELECT doc_id, string_split(text, chr(10)) AS lines, coalesce(rules, []) AS rules
      FROM documents LEFT JOIN b ON documents.source IS NOT DISTINCT FROM b.source),
k AS (SELECT doc_id, lines, list_filter(lines, lambda x: NOT list_contains(rules, x)) AS kept FROM d)
SELECT doc_id, array_to_string(kept, chr(10)) AS text,
       coalesce(len(lines), 0) AS n_lines, coalesce(len(lines) - len(kept), 0) AS n_dropped
FROM k
"""
