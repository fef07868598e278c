"""The corpus pipeline: quality, line dedup, near duplicates, mixing, tokens. Each stage works on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import line_dedup, mixing, ngram_join, quality
from tracemill.llm.bpe import bpe_round_trip
from tracemill.llm.common import cut, small_side
from tracemill.llm.queries import bpe_vocab_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good; it learns from the labelled ones among ``docs``.

    Rows are judged one by one by their text alone: null ids, repeated rows and equal texts each get their own verdict,
    empty and null texts the middle one. An empty input gives an empty result. Columns beyond COLUMNS are left out.
    """
    scored = quality.score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("score >= 0.5").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their boilerplate lines taken out; n_chars follows the text (null for a null text).

    A null source is a source of its own. No row goes, even if none of its lines remains.
    """
    made = line_dedup.drop_boilerplate(docs.select(*COLUMNS))
    return made.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _with_row(docs: DataFrame, name: str) -> DataFrame:
    """COLUMNS and ``_row``, a number of its own for every row, written down so that it holds: ids may be null or repeat."""
    return cut(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), name)


def keep_one_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id (null last) of every near-duplicate group; rows without a group stay.

    Of rows that share that id too, one stays. Rows are told apart by a number of their own, so a repeated id neither
    drags an unlike row along nor saves a like one. Rows without words are in no group and all stay.
    """
    rows = _with_row(docs, "pipeline-near")
    groups = ngram_join.near_components(rows, id_col="_row").where("n_shingles > 0").select("_row", F.col("component_id").alias("_c"))
    # Groups of one need no second look; hot groups are pre-aggregated before the shuffle.
    groups = cut(groups, "pipeline-groups")
    linked = groups.where("_c <> _row").select("_c").distinct()
    members = groups.join(linked, "_c", "left_semi")
    found = cut(rows.select("_row", "doc_id").join(small_side(cut(members, "pipeline-members")), "_row"), "pipeline-found")
    first = found.groupBy("_c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("k"))
    stays = first.select(F.col("k._row").alias("_row"))
    gone = small_side(cut(found.join(stays, "_row", "left_anti").select("_row"), "pipeline-gone"))
    return rows.join(gone, "_row", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as many times as the mix takes it; rows that share an id count each for themselves."""
    rows = _with_row(docs, "pipeline-mix-rows")
    taken = mixing.mix(rows, carry=("_row",)).where("copies > 0").select("_row", "copies")
    taken = small_side(cut(taken, "pipeline-mix"))
    return rows.join(taken, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and the hashes of token ids and decoded text of every row; a null text is encoded as empty."""
    made = bpe_round_trip(docs, bpe_vocab_path())
    n = (F.octet_length("ids") / 4).cast("long")
    return made.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", keep_one_near),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: The classifier and the tokenizer have no SQL form; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage-" + name.split(" ")[0])
    return STAGES[-1][1](spark, docs, sf_dir)
