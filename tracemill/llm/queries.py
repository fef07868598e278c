"""The registered queries of this subpackage and their SQL, one per operator and one for the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import exact_dedup, fingerprints, html_extract, line_dedup, mixing, negatives, ngram_join, pii, quality, secrets, sharding, spelling
from tracemill.llm.bpe import bpe_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bpe_vocab_path() -> str:
    """The public byte-level vocabulary installed beside the tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = html_extract.extract_main_text(_table(spark, sf_dir, "pages"))
    return made.withColumn("n_chars", F.length("text").cast("long"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bpe_round_trip(_table(spark, sf_dir, "documents"), bpe_vocab_path())
    n = (F.octet_length("ids") / 4).cast("long")
    return made.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_components(_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprints.render(F.col("vec")).alias("fingerprint"),
        fingerprints.render(F.col("edited_vec")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("vec"), F.col("edited_vec")).alias("near_edited"),
        fingerprints.likeness(F.col("vec"), F.col("next_vec")).alias("near_next"),
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixing.mix(_table(spark, sf_dir, "documents"))
    return made.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii.find(_table(spark, sf_dir, "documents"))
    counts = [pii.count_of(F.col("spans"), kind).alias(f"n_{kind}") for kind in pii.BASE]
    return made.select("doc_id", *counts, F.sha2(pii.written(F.col("spans"), pii.BASE), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_html": op2_html,
    "op3_bpe": op3_bpe,
    "op4_quality": op4_quality,
    "op5_line_dedup": op5_line_dedup,
    "op6_ngram_join": op6_ngram_join,
    "op7_sharding": op7_sharding,
    "op8_fingerprints": op8_fingerprints,
    "op9_secrets": op9_secrets,
    "op10_mixing": op10_mixing,
    "op11_spelling": op11_spelling,
    "op12_pii": op12_pii,
    "op13_negatives": op13_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": exact_dedup.ORACLE_SQL,
    "op5_line_dedup": line_dedup.ORACLE_SQL,
    "op10_mixing": mixing.ORACLE_SQL,
    "op11_spelling": spelling.ORACLE_SQL,
    "op12_pii": pii.ORACLE_SQL,
    "op13_negatives": negatives.ORACLE_SQL,
}
