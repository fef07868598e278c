"""Profiling and reporting queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.functions import text
from tracemill.functions.classify import answer_type, drop_reason, first_match, top_score
from tracemill.operators import profile, rank
from tracemill.plans.registry import query
from tracemill.sources.files import cut


@query("""
WITH d AS (SELECT doc_id, lang, n_chars, lower(regexp_replace(text, '[\\s\\p{Z}]+', '', 'g')) AS k FROM documents),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS rn FROM d) WHERE rn = 1),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS cap FROM u) WHERE cap <= 50)
SELECT lang, coalesce(quality, -1) AS quality, count(*) AS n, round(avg(n_chars), 4) AS mean_chars
FROM c LEFT JOIN labels USING (doc_id) GROUP BY ALL""")
def balanced_corpus_report(t):
    """Distinct texts, at most 50 a language by length, counted by language and label."""
    docs = t("documents").select("doc_id", "lang", "n_chars", F.sha2(text.norm(F.col("text")), 256).alias("k"))
    docs = docs.groupBy("k").agg(F.min(F.struct("doc_id", "lang", "n_chars")).alias("d")).select("d.*")
    docs = rank.cap_per_group(docs, ["lang"], [F.col("n_chars"), F.col("doc_id")], 50)
    joined = docs.join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    out = joined.groupBy("lang", F.coalesce("quality", F.lit(-1)).alias("quality"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY ALL")
def doc_value_counts(t):
    return profile.value_counts(t("documents"), "lang")


@query("""SELECT lang, count(n_chars) AS n, round(avg(n_chars), 4) AS mean, round(stddev_samp(n_chars), 4) AS std, min(n_chars) AS min,
quantile_cont(n_chars::DOUBLE, 0.25) AS p25, quantile_cont(n_chars::DOUBLE, 0.5) AS p50, quantile_cont(n_chars::DOUBLE, 0.75) AS p75, max(n_chars) AS max
FROM documents GROUP BY ALL""")
def doc_profile_describe(t):
    return profile.describe(t("documents"), "n_chars", "lang")


@query("""SELECT count(*) AS n_rows, count(*) FILTER (text IS NULL) AS null_text, count(*) FILTER (source IS NULL) AS null_source,
count(*) - count(DISTINCT md5(text)) - max((text IS NULL)::INT) AS dup_text FROM documents""")
def null_and_dup_counts(t):
    null = lambda c: F.sum(F.col(c).isNull().cast("long"))
    dup = F.count(F.lit(1)) - F.count_distinct(F.md5("text")) - F.max(F.col("text").isNull().cast("int"))
    return t("documents").agg(F.count(F.lit(1)).alias("n_rows"), null("text").alias("null_text"), null("source").alias("null_source"), dup.alias("dup_text"))


@query("""SELECT lang, count(*) FILTER (quality = 0) AS q0, count(*) FILTER (quality = 1) AS q1,
round(count(*) FILTER (quality = 0) / count(*), 3) AS r0, round(count(*) FILTER (quality = 1) / count(*), 3) AS r1
FROM documents JOIN labels USING (doc_id) GROUP BY ALL""")
def lang_quality_crosstab(t):
    table = t("documents").select("doc_id", "lang").join(t("labels"), "doc_id").groupBy("lang").pivot("quality", [0, 1]).agg(F.count(F.lit(1)))
    n0, n1 = F.coalesce("0", F.lit(0)), F.coalesce("1", F.lit(0))
    return table.select("lang", n0.alias("q0"), n1.alias("q1"), F.round(n0 / (n0 + n1), 3).alias("r0"), F.round(n1 / (n0 + n1), 3).alias("r1"))


KEYWORDS = ("token", "license", "the", "und")


@query(" UNION ALL ".join(f"SELECT '{k}' AS keyword, count(*) FILTER (contains(lower(text), '{k}')) AS n FROM documents" for k in KEYWORDS))
def keyword_counts(t):
    """One scan for all keywords, then one row each."""
    sums = [F.count_if(F.contains(F.lower("text"), F.lit(k))).alias(k) for k in KEYWORDS]
    return t("documents").agg(*sums).unpivot([], list(KEYWORDS), "keyword", "n")


@query("""SELECT source, count(*) AS n, round(avg(n_chars), 3) AS mean_chars, round(avg(len(string_split(text, ' '))), 3) AS mean_words,
round(avg((contains(text, '|'))::INT), 3) AS share_table, max(n_chars) AS longest FROM documents GROUP BY ALL""")
def source_stats_named_agg(t):
    return t("documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("n_chars"), 3).alias("mean_chars"),
        F.round(F.avg(F.size(F.split("text", " "))), 3).alias("mean_words"),
        F.round(F.avg(F.contains("text", F.lit("|")).cast("int")), 3).alias("share_table"),
        F.max("n_chars").alias("longest"),
    )


@query("""WITH v AS (SELECT l_returnflag, list(l_quantity ORDER BY l_quantity) AS a, count(*) AS n, quantile_cont(l_quantity, 0.9) AS p90,
quantile_cont(l_quantity, 0.5) AS p50 FROM lineitem GROUP BY ALL), w AS (SELECT *, 0.9::DOUBLE * (n + 1) AS x FROM v)
SELECT l_returnflag, p50, p90, round(a[floor(x)::BIGINT] + (x - floor(x)) * (a[floor(x)::BIGINT + 1] - a[floor(x)::BIGINT]), 6) AS p90_exclusive FROM w""")
def length_percentiles(t):
    """Linear percentiles, and the exclusive one from counted values (few distinct ones), not from a list of all rows."""
    counts = t("lineitem").groupBy("l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy("l_returnflag").orderBy("l_quantity").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("upto", F.sum("c").over(order)).withColumn("all", F.sum("c").over(Window.partitionBy("l_returnflag")))
    at = F.lit(0.9) * (F.col("all") + 1)
    value = lambda k: F.min(F.when(F.col("upto") >= k, F.col("l_quantity")))
    p = lambda q: F.percentile("l_quantity", F.lit(q), F.col("c")).alias(f"p{int(q * 100)}")
    out = counts.groupBy("l_returnflag").agg(p(0.5), p(0.9), value(F.floor(at)).alias("lo"), value(F.floor(at) + 1).alias("hi"), F.max(at - F.floor(at)).alias("part"))
    return out.select("l_returnflag", "p50", "p90", F.round(F.col("lo") + F.col("part") * (F.col("hi") - F.col("lo")), 6).alias("p90_exclusive"))


@query("""WITH k AS (SELECT md5(lower(regexp_replace(text, '[\\s\\p{Z}]+', '', 'g'))) AS k, count(*) AS n FROM documents GROUP BY ALL)
SELECT count(*) AS distinct_texts, count(*) FILTER (n >= 2) AS with_copies, sum(n)::BIGINT AS total FROM k""")
def distinct_norm_text(t):
    keys = t("documents").groupBy(F.md5(text.norm(F.col("text"))).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return keys.agg(F.count(F.lit(1)).alias("distinct_texts"), F.count_if(F.col("n") >= 2).alias("with_copies"), F.sum("n").alias("total"))


@query("SELECT left(text, 80) AS head, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) >= 2")
def shared_prefixes(t):
    """First 80 characters that two rows or more share: the prefix projection, not a count of equal texts."""
    return t("documents").groupBy(F.substring("text", 1, 80).alias("head")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("""SELECT md5(lower(regexp_replace(text, '[\\s\\p{Z}]+', '', 'g'))) AS k, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL HAVING count(*) >= 2""")
def having_two_versions(t):
    """Whole normalised texts with two rows or more."""
    docs = t("documents").where("text IS NOT NULL")
    return docs.groupBy(F.md5(text.norm(F.col("text"))).alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("""SELECT l_shipmode_like AS kind, count(*) AS total, sum(ok)::BIGINT AS passed, count(*) - sum(ok)::BIGINT AS failed, sum(tr)::BIGINT AS truncated,
round(100.0::DOUBLE * sum(ok) / count(*), 2) AS acc_pct, round(100.0::DOUBLE * sum(tr) / count(*), 2) AS trunc_pct
FROM (SELECT l_linestatus AS l_shipmode_like, (l_returnflag = 'A')::INT AS ok, (l_quantity > 40)::INT AS tr FROM lineitem) GROUP BY ALL""")
def accuracy_report(t):
    rows = t("lineitem").withColumnRenamed("l_linestatus", "kind")
    return profile.accuracy_report(rows, "kind", F.col("l_returnflag") == "A", F.col("l_quantity") > 40)


@query("""SELECT drop_reason, count(*) AS n FROM (SELECT CASE WHEN n_chars < 200 THEN 'short' WHEN n_chars > 5000 THEN 'long' WHEN contains(text, '|') THEN 'table'
WHEN lower(text) = text THEN 'no_case' ELSE 'kept' END AS drop_reason FROM documents) GROUP BY ALL""")
def drop_reason_counts(t):
    n, c = F.col("n_chars"), F.col("text")
    reason = drop_reason([("short", n < 200), ("long", n > 5000), ("table", F.contains(c, F.lit("|"))), ("no_case", F.lower(c) == c)])
    return t("documents").groupBy(F.coalesce(reason, F.lit("kept")).alias("drop_reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT family, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(p_name, '^[a-d]') THEN 'early' WHEN regexp_matches(p_type, 'STEEL|BRASS') THEN 'metal'
WHEN p_size > 25 THEN 'large' ELSE 'other' END AS family FROM (SELECT p_name, p_type, p_size FROM part)) GROUP BY ALL""")
def classify_first_match(t):
    part = t("part")
    rules = first_match(F.concat_ws("|", F.substring("p_name", 1, 1), F.col("p_type")), [("^[a-d][|]", "early"), ("[|].*(STEEL|BRASS)", "metal")], "")
    family = F.coalesce(F.nullif(rules, F.lit("")), F.when(F.col("p_size") > 25, "large"), F.lit("other"))
    return part.groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("n"))


ANSWERS = """CASE k WHEN 0 THEN lpad(bin((l_orderkey % 256)::BIGINT), 8, '0') WHEN 1 THEN (l_linenumber * 10 + 5)::VARCHAR WHEN 2 THEN 'XLVII' WHEN 3 THEN 'The cat' ELSE 'x=1' END"""


@query(f"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_full_match(a, '[01]+') THEN 'binary' WHEN regexp_full_match(a, '-?[0-9]+(\\.[0-9]+)?') THEN 'numeric'
WHEN regexp_full_match(a, '[IVXLCDM]+') THEN 'roman' WHEN regexp_full_match(a, '[A-Za-z]+( [A-Za-z]+)*') THEN 'english_phrase' ELSE 'other' END AS kind
FROM (SELECT {ANSWERS} AS a FROM (SELECT *, l_orderkey % 5 AS k FROM lineitem))) GROUP BY ALL""")
def answer_type_counts(t):
    k = F.col("l_orderkey") % 5
    a = F.when(k == 0, F.lpad(F.bin(F.col("l_orderkey") % 256), 8, "0")).when(k == 1, (F.col("l_linenumber") * 10 + 5).cast("string"))
    a = a.when(k == 2, "XLVII").when(k == 3, "The cat").otherwise("x=1")
    return t("lineitem").groupBy(answer_type(a).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT topic, count(*) AS n FROM (SELECT CASE WHEN greatest(a, b, c) = 0 THEN 'general' WHEN a = greatest(a, b, c) THEN 'german' WHEN b = greatest(a, b, c) THEN 'french' ELSE 'spanish' END AS topic
FROM (SELECT contains(text, ' und ')::INT + contains(text, ' der ')::INT AS a, contains(text, ' le ')::INT + contains(text, ' et ')::INT AS b,
contains(text, ' los ')::INT + contains(text, ' que ')::INT AS c FROM documents)) GROUP BY ALL""")
def topic_max_score(t):
    score = lambda *w: sum((F.contains("text", F.lit(f" {x} ")).cast("int") for x in w), F.lit(0))
    topic = top_score([("german", score("und", "der")), ("french", score("le", "et")), ("spanish", score("los", "que"))], "general")
    return t("documents").groupBy(topic.alias("topic")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT coalesce(lang, 'TOTAL') AS lang, count(*) AS n, round(avg(n_chars), 4) AS mean_chars FROM documents GROUP BY ROLLUP (lang)""")
def category_rollup_total(t):
    out = t("documents").rollup("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))
    return out.withColumn("lang", F.coalesce("lang", F.lit("TOTAL")))


@query("""WITH c AS (SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY l_partkey) AS top FROM c)
SELECT l_partkey, CASE WHEN count(*) = 1 THEN max(l_returnflag) END AS mode, max(top) AS votes FROM m WHERE n = top GROUP BY ALL""")
def mode_with_abstain(t):
    return profile.mode_or_abstain(t("lineitem"), "l_partkey", "l_returnflag")


@query("""WITH c AS (SELECT event_type, user_id, count(*)::BIGINT AS n FROM events GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY event_type) AS p FROM c)
SELECT event_type, round(-sum(p * ln(p)) / ln(count(*)), 6) AS entropy, round(max(p), 6) AS max_share, round(stddev_samp(n) / avg(n), 6) AS load_cv,
count(*) FILTER (n > 0) AS active, sum(n)::BIGINT AS total FROM p GROUP BY ALL""")
def entropy_metrics(t):
    counts = t("events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return profile.entropy_metrics(counts, "event_type", "n")


@query("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY source) AS share, sum(n) OVER (PARTITION BY source) AS volume FROM c)
SELECT source, lang, n, round(share, 6) AS share FROM s WHERE share > 0.6::DOUBLE AND volume > 20""")
def distinctive_share(t):
    """Languages that make up over 0.6 of a source of more than 20 documents."""
    counts = t("documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    volume = F.sum("n").over(Window.partitionBy("source"))
    out = counts.withColumn("volume", volume).withColumn("share", F.col("n") / F.col("volume")).where("share > 0.6D AND volume > 20")
    return out.select("source", "lang", "n", F.round("share", 6).alias("share"))


@query("""SELECT doc_id, left(sha1(text || '||' || source), 12) AS sha_id, left(md5(text || '|||' || source), 16) AS md5_id FROM documents""")
def hash_ids(t):
    return t("documents").select("doc_id", text.sha_id(F.col("text"), F.col("source")).alias("sha_id"), text.md5_id(F.col("text"), F.col("source")).alias("md5_id"))


@query("""SELECT template, count(*) AS n FROM (SELECT regexp_replace(regexp_replace(trim(regexp_replace(lower('Order ' || o_orderkey || '  of ' || md5(o_custkey::VARCHAR) || chr(10) || o_orderstatus), '\\s+', ' ', 'g')),
'\\b[0-9]+\\b', '<NUM>', 'g'), '\\b[0-9a-f]{8,}\\b', '<HEX>', 'g') AS template FROM orders) GROUP BY ALL""")
def prompt_normaliser(t):
    prompt = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit("  of "), F.md5(F.col("o_custkey").cast("string")), F.lit("\n"), F.col("o_orderstatus"))
    return t("orders").groupBy(text.template(prompt).alias("template")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), '\\r\\n?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS cleaned,
floor(length(text) / 3.5::DOUBLE)::BIGINT AS est_tokens FROM documents""")
def strip_control_clean_cot(t):
    c = text.squeeze_blank_lines(text.unix_lines(text.drop_control(F.col("text"))))
    return t("documents").select("doc_id", F.md5(c).alias("cleaned"), text.est_tokens(F.col("text")).alias("est_tokens"))


@query("""WITH w AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM documents),
tf AS (SELECT lang, term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM w GROUP BY ALL), n AS (SELECT lang, count(*) AS n FROM documents GROUP BY ALL),
s AS (SELECT lang, term, round((1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1), 4) AS score FROM tf JOIN n USING (lang) WHERE df >= 3 AND df <= 0.95::DOUBLE * n),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, term) AS rn FROM s)
SELECT lang, term, score FROM r WHERE rn <= 12""")
def tfidf_top_terms(t):
    """Sublinear tf times smoothed idf per language, the 12 best terms; counts combine before they are shuffled."""
    docs = t("documents")
    words = docs.select("doc_id", "lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0)).alias("term"))
    per_doc = words.groupBy("lang", "term", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    tf = per_doc.groupBy("lang", "term").agg(F.sum("c").alias("tf"), F.count(F.lit(1)).alias("df"))
    scored = tf.join(docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang").where("df >= 3 AND df <= 0.95D * n")
    score = F.round((1 + F.ln("tf")) * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1), 4)
    return rank.cap_per_group(scored.select("lang", "term", score.alias("score")), ["lang"], [F.desc("score"), F.col("term")], 12)


@query("""WITH d AS (SELECT doc_id, lang, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}_]{2,}') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, lang, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM d),
c AS (SELECT doc_id, lang, term, count(*) AS c FROM g GROUP BY ALL), n AS (SELECT count(*) AS n FROM d), l AS (SELECT lang, count(*) AS docs FROM d GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM c GROUP BY ALL), k AS (SELECT term, ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf FROM f, n WHERE df >= 3 AND df <= 0.95::DOUBLE * n),
w AS (SELECT doc_id, lang, term, (1 + ln(c)) * idf AS w FROM c JOIN k USING (term)), q AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS u FROM w),
s AS (SELECT lang, term, round(sum(u) / docs, 8) AS score FROM q JOIN l USING (lang) GROUP BY lang, term, docs),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, term) AS rn FROM s)
SELECT lang, term, score FROM r WHERE rn <= 12""")
def tfidf_ngram_terms(t):
    """TF-IDF of 1- and 2-grams over all documents, accents stripped, L2 norm; per language the 12 terms of the highest mean weight."""
    words = lambda x: F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}_]{2,}"), 0)
    rest = lambda w: F.greatest(F.size(w) - 1, F.lit(0))
    pairs = lambda w: F.zip_with(F.slice(w, F.lit(1), rest(w)), F.slice(w, F.lit(2), rest(w)), lambda a, b: F.concat_ws(" ", a, b))
    terms = lambda x: F.transform(F.array(words(x)), lambda w: F.concat(w, pairs(w)))[0]
    low = t("documents").select("doc_id", "lang", F.lower("text").alias("text")).where("text IS NOT NULL")
    short = text.has_short_accents(F.col("text"))
    others = cut(low.where(~short).withColumn("text", text.strip_accents(F.col("text"))), "plain-texts")
    docs = low.where(short).withColumn("text", text.strip_short_accents(F.col("text"))).unionByName(others)
    return profile.top_terms(docs, "doc_id", "lang", "text", terms, 12)
