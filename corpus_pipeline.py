"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
what a stage returns and gives it to the next one. All but the last return the
columns of documents; further columns are not read and not kept. In all stages a
row is a document, also where its doc_id is null or repeated, and an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.common import Scratch, row_keys
from topicloom.llm.lines import dedup_passages
from topicloom.llm.mixing import expand, mix_sources
from topicloom.llm.near import near_duplicates
from topicloom.llm.packing import pack
from topicloom.llm.quality import quality_rules

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _judged(rows: DataFrame) -> DataFrame:
    """What operators read, with the row's key for an id."""
    return rows.select(F.col("__row").alias("doc_id"), "text")


def _without(rows: DataFrame, gone: DataFrame, scratch: Scratch) -> DataFrame:
    """rows but for those whose keys stand as ids in ``gone``, which is written
    first, so that Spark knows its size and moves the texts only if it is large."""
    return rows.join(scratch.keep(gone.select(F.col("doc_id").alias("__row")).distinct(), "gone"), "__row", "left_anti").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and the forest, as they are. Null, empty and
    short texts go; rows that repeat a doc_id are judged one by one, each with the
    labels of that id; without labels the base rules alone decide."""
    scratch = Scratch(spark, "quality")
    rows, other = row_keys(docs.select(*COLUMNS), scratch)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    if other:
        labels = labels.join(rows.select("doc_id", "__row"), "doc_id").drop("doc_id").withColumnRenamed("__row", "doc_id")
    judged = quality_rules(_judged(rows), labels, scratch)
    return _without(rows, judged.where(~F.col("kept")), scratch)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, without the lines of passages that an earlier row holds (by
    doc_id, then text; those without an id come last). n_chars follows a text that
    lost lines. A null text stays null; one that loses all its lines stays empty."""
    rows = dedup_passages(docs.select(*COLUMNS), Scratch(spark, "lines"))
    return rows.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group of near copies, by doc_id, then text; those
    without an id come last. Rows without words, and null texts, all stay; of a row
    that is repeated one stays."""
    scratch = Scratch(spark, "near")
    rows, _ = row_keys(docs.select(*COLUMNS), scratch)
    return _without(rows, near_duplicates(_judged(rows), scratch).where(~F.col("kept")), scratch)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, those of small sources more than once, null and empty texts
    among them. A null source is a source; rows of one without words come once."""
    scratch = Scratch(spark, "mixing")
    return expand(docs.select(*COLUMNS), mix_sources(docs, scratch), scratch)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row, repeated ones too, in sequences of 2048 tokens. A
    null or empty text is its end id alone."""
    import public_tokenizers

    return pack(docs, Scratch(spark, "packing"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("mixing", mixing), ("packing", packing)]
#: Signatures, the forest and tokens have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
