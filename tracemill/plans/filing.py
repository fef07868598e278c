"""Queries over files: each writes a table with a sink, reads it back with a scan and returns its rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.plans.registry import query
from tracemill.sources import files, sinks


@query("SELECT doc_id, md5(text) AS text_md5, lang, source FROM documents")
def csv_round_trip(t):
    """Texts with line breaks, quotes, nulls and empty strings through a CSV."""
    docs = t("documents")
    path = files.scratch(docs.sparkSession, "csv")
    sinks.write_csv(docs, path, ["doc_id", "lang", "source", "text"])
    back = files.scan_csv(docs.sparkSession, path, "doc_id long, lang string, source string, text string")
    return back.select("doc_id", F.md5("text").alias("text_md5"), "lang", "source")


@query("SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations")
def jsonl_round_trip(t):
    rows = t("conversations")
    path = files.scratch(rows.sparkSession, "jsonl")
    sinks.write_jsonl(rows, path)
    back = files.scan_jsonl(rows.sparkSession, path, "conv_id long, turn long, role string, text string")
    return back.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0")
def jsonl_skips_bad_lines(t):
    """Cut objects and blank lines are skipped, a bad type too."""
    rows, k = t("customer"), F.col("c_custkey")
    line = F.to_json(F.struct("c_custkey", "c_name"))
    line = F.when(k % 7 == 0, F.substring(line, 1, 20)).when(k % 77 == 11, '{"c_custkey": "x"}').when(k % 11 == 0, "  ").otherwise(line)
    path = files.scratch(rows.sparkSession, "lenient")
    rows.select(line.alias("value")).write.text(path)
    return files.scan_jsonl(rows.sparkSession, path, "c_custkey long, c_name string", strict=False)


@query("SELECT 'o_orderstatus=' || o_orderstatus AS part, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY ALL")
def records_below_a_folder(t):
    rows = t("orders").select("o_orderkey", "o_orderstatus")
    path = files.scratch(rows.sparkSession, "records")
    rows.write.partitionBy("o_orderstatus").json(path)
    return files.scan_records(rows.sparkSession, path, "o_orderkey long").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region")
def sources_that_exist(t):
    """Of three files one is missing; the other two have different columns."""
    nation, region = t("nation"), t("region")
    spark = nation.sparkSession
    paths = [files.scratch(spark, n) for n in ("nation", "gone", "region")]
    nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).write.json(paths[0])
    region.select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")).write.json(paths[2])
    return files.union_present(spark, paths, spark.read.json).select(F.col("key").cast("int").alias("key"), "name", F.col("region").cast("int").alias("region"))


@query("SELECT lpad(n_nationkey::VARCHAR, 4, '0') AS id, n_name AS name, count(*) AS times FROM (SELECT * FROM nation UNION ALL SELECT * FROM nation WHERE n_regionkey = 1) GROUP BY ALL")
def csv_rebuilt_from_appends(t):
    """Rows appended twice to JSON lines, the CSV made of them, read as strings: ids keep their zeros."""
    rows = t("nation").select(F.lpad(F.col("n_nationkey").cast("string"), 4, "0").alias("id"), F.col("n_name").alias("name"), "n_regionkey")
    spark = rows.sparkSession
    log, path = files.scratch(spark, "log"), files.scratch(spark, "csv")
    sinks.write_jsonl(rows.select("id", "name"), log, "append")
    sinks.write_jsonl(rows.where("n_regionkey = 1").select("id", "name"), log, "append")
    sinks.csv_from_jsonl(spark, log, path, "id string, name string", ["id", "name"])
    return files.scan_csv(spark, path).groupBy("id", "name").agg(F.count(F.lit(1)).alias("times"))


@query("""SELECT part, count(*) AS n FROM (SELECT unnest(['all', CASE WHEN length(text) >= 500 THEN 'valid' ELSE 'invalid' END]) AS part FROM documents) GROUP BY ALL""")
def split_outputs(t):
    docs = t("documents").select("doc_id", "text")
    path = files.scratch(docs.sparkSession, "split")
    sinks.write_split(docs, path, F.length("text") >= 500)
    out = [sinks.read_split(docs.sparkSession, path, p).agg(F.lit(p).alias("part"), F.count(F.lit(1)).alias("n")) for p in ("all", "valid", "invalid")]
    return out[0].union(out[1]).union(out[2])


@query("SELECT count(*) AS rows, count(DISTINCT user_id) AS users, sum((event_type = 'purchase')::INT)::BIGINT AS purchases FROM events")
def manifest(t):
    rows = t("events")
    path = files.scratch(rows.sparkSession, "manifest")
    sinks.write_manifest(rows, path, F.count(F.lit(1)).alias("rows"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("event_type") == "purchase").alias("purchases"))
    return files.scan_jsonl(rows.sparkSession, path, "rows long, users long, purchases long")


@query("""SELECT coalesce(o_orderkey, l_orderkey) AS key, CASE WHEN l_orderkey IS NOT NULL THEN 'shipped' ELSE o_orderstatus END AS status, o_totalprice AS price
FROM orders FULL JOIN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49 GROUP BY ALL) ON o_orderkey = l_orderkey""")
def upserted_index(t):
    index = t("orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    updates = t("lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("key")).distinct().withColumn("status", F.lit("shipped"))
    return sinks.upsert(index, updates, "key")


@query("SELECT r_regionkey AS key, r_name AS name, true AS marked FROM region")
def csv_with_mark(t):
    """A CSV with a byte order mark; scans read past it, its bytes are there."""
    rows = t("region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    spark = rows.sparkSession
    path = files.scratch(spark, "bom")
    sinks.write_marked_csv(rows, path, ["key", "name"])
    marked = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).agg(F.every(F.hex(F.substring("content", 1, 3)) == "EFBBBF").alias("marked"))
    return files.scan_csv(spark, path, "key int, name string").join(F.broadcast(marked))


@query("SELECT word, length(word) AS n FROM (SELECT DISTINCT trim(unnest(string_split(p_name, ' '))) AS word FROM part) WHERE word <> ''")
def words_of_a_list(t):
    words = t("part").select(F.explode(F.split("p_name", " ")).alias("w")).select(F.concat(F.lit(" "), "w", F.lit("\t")).alias("value"))
    path = files.scratch(words.sparkSession, "words")
    words.write.text(path)
    return files.word_list(words.sparkSession, path).select("word", F.length("word").alias("n"))


@query("SELECT conv_id, md5(coalesce(string_agg(text, '' ORDER BY turn), '')) AS text, string_agg(role, '' ORDER BY turn) AS role FROM conversations GROUP BY ALL")
def streamed_pieces(t):
    rows = t("conversations").groupBy("conv_id", "turn").agg(F.max("text").alias("text"), F.max("role").alias("role"))
    return files.joined_deltas(rows, "conv_id", "turn", "text", "role").select("conv_id", F.md5("text").alias("text"), "role")


@query("SELECT n_nationkey, n_name AS text FROM nation")
def one_text_a_row(t):
    rows = t("nation").select("n_nationkey", "n_name")
    path = files.scratch(rows.sparkSession, "texts")
    sinks.write_texts(rows, path, "n_nationkey", "n_name")
    return rows.sparkSession.read.option("wholetext", "true").text(path).select("n_nationkey", F.rtrim(F.regexp_replace("value", "\n", "")).alias("text"))
