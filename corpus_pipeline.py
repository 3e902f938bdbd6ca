"""Documents to packed training sequences, stage by stage.

Each stage works on all rows of the one before, which are written as Parquet
and read again in between.  All but the last return the columns of
``documents``; where a stage changes a text, ``n_chars`` follows it.  Null
texts and null or repeated ids are rows like others, as the operators' own
rules have it; other columns are left behind; an empty table goes through as an
empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import line_dedup, near_dedup, packing, queries, suffix_dedup, toxicity
from attesta.llm.common import shared_dir, small, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _blank(text) -> Column:
    """Whether there is nothing but white space."""
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def _changed(after: DataFrame) -> DataFrame:
    """The columns of documents of rows with ``n_removed`` and ``was_blank``: a row that lost all but white space goes, one that had no more before stays."""
    cut = F.col("n_removed") > 0
    length = F.when(cut, F.length("text").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars")
    return after.filter(~cut | F.col("was_blank") | ~_blank(F.col("text"))).select("doc_id", "text", "lang", "source", length)


def _marked(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, F.coalesce(_blank(F.col("text")), F.lit(True)).alias("was_blank"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below 0.5; the model learns from all labels of these documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs.select(COLUMNS), model, keep=tuple(COLUMNS)).filter("score < 0.5").select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, but for a word, go."""
    return _changed(line_dedup.line_dedup(_marked(docs)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more."""
    gone = near_dedup.near_dedup(docs).filter("not kept").select("doc_id")
    return docs.select(COLUMNS).join(small(stage(gone)), "doc_id", "left_anti").select(COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 100 bytes that also start earlier go."""
    return _changed(suffix_dedup.suffix_dedup(_marked(docs), cut_text=True))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences of as many."""
    parts = packing.pieces(docs, queries.vocabulary("word_bpe_49k.json"), queries.SEQUENCE)
    return packing.pack(parts, queries.SEQUENCE).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_passages),
    ("packing", pack),
]

#: SQL cannot state the first and last stage; ``tests/llm/test_pipeline.py`` compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the documents that stay, with their places in the sequences; each stage's rows are left in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES:
        path = shared_dir(spark)
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
