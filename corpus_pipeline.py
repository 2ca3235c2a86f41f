"""Corpus pipeline over the ``documents`` table.

Five stages, each a call of one operator over all that its predecessor kept:
quality classifier, n-gram Jaccard join, benchmark decontamination, personal
data, byte-pair encoding.  The stages that drop near copies and benchmark
passages do so by row, known by its id (NULL equals NULL) and a 64-bit hash of
its text: different texts that share an id, or have none, are judged each for
itself; rows of one id and equal text are one.  The rows to drop are broadcast
only up to ``BROADCAST_ROWS``, so the texts themselves are shuffled only beyond
that bound.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.bpe import bpe_encode, read_model
from panelforge.llm.common import bounded, crc_fold, stored, table
from panelforge.llm.decontam import contamination
from panelforge.llm.ngram_join import similarity_join
from panelforge.llm.pii import find_personal_data
from panelforge.llm.quality import keep_good

#: SQL cannot express the trained stages, MinHash banding or the tokenizer.
ORACLE_SQL = None
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"),
                     train=lambda i: crc_fold(i, 5) != 1, calibrate=lambda i: crc_fold(i, 5) == 1)


def by_row(docs: DataFrame) -> DataFrame:
    """(row, text) for the operators; rows with an id come first, then by it."""
    return docs.select(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id",
                                F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).alias("row"), "text")


def of_rows(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """``docs`` with (left_semi) or without (left_anti) those of ``rows(row)``."""
    named = rows.select(F.col("row.doc_id").alias("of_id"), F.col("row.h").alias("of_h"))
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("of_h"))
    return docs.join(bounded(named, rows.count()), same, how)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near
    copies (five-word shingles, Jaccard 0.8 or more)."""
    found = stored(similarity_join(by_row(docs), id_col="row").select("row", "class_id"), "pipeline-classes")
    first = (F.col("row.doc_id").eqNullSafe(F.col("class_id.doc_id")) & (F.col("row.h") == F.col("class_id.h")))
    gone = stored(found.where(~first).select("row").distinct(), "pipeline-gone")
    kept = of_rows(docs, gone, "left_anti")
    again = stored(found.where(first).groupBy("row").count().where("count > 1").select("row"), "pipeline-repeated")
    if again.count():       # repeated rows of one id and text
        text = F.xxhash64(F.coalesce("text", F.lit("")))
        once = of_rows(kept, again, "left_semi").withColumn("_h", text).dropDuplicates(["doc_id", "_h"]).drop("_h")
        kept = of_rows(kept, again, "left_anti").unionByName(once)
    return kept.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth are benchmark passages."""
    found = contamination(by_row(docs), table(spark, sf_dir, "benchmark"), id_col="row")
    gone = stored(found.where("contaminated").select("row").distinct(), "pipeline-contaminated")
    return of_rows(docs, gone, "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by the kind's name."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = find_personal_data(docs, keep=rest).withColumnRenamed("redacted", "text")
    return (out.withColumn("n_chars", F.char_length("text").cast("bigint"))
            .select(*docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their decoding of every document that is left."""
    return bpe_encode(docs, read_model(TOKENIZER))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontaminate),
          ("personal_data", personal_data), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written as Parquet
    in the shared folder and read again by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
