"""Registered queries of the subpackage: one ``opN_<name>`` per operator.

Each query applies its operator with production parameters to its whole
table; the digest columns are derived from the operator's own outputs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .common import crc_fold, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {"op5_decontamination": oracle.OP5, "op12_hard_negatives": oracle.OP12}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; of the four folds to learn from, one
    calibrates and the others are counted."""
    from .toxicity import score_toxicity
    out = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                         train=lambda i: crc_fold(i, 5) > 1, calibrate=lambda i: crc_fold(i, 5) == 1)
    return out.select("doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query
def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the model of nine folds."""
    from .ngram_lm import score_texts
    out = score_texts(table(spark, sf_dir, "documents"), train=lambda i: crc_fold(i, 10) != 0)
    return out.select("doc_id", (crc_fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known",
                      "train_tokens", "base_score", "score")


@query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two of three folds."""
    from .langid import predict_language
    out = predict_language(table(spark, sf_dir, "documents"), train=lambda i: crc_fold(i, 3) != 1)
    return out.select("doc_id", (crc_fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


@query
def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document."""
    from .ngram_join import similarity_join
    return similarity_join(table(spark, sf_dir, "documents"))


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    from .decontam import contamination
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; one fold of labels is held out, one
    calibrates, the others are learned."""
    from .quality import score_quality
    out = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                        train=lambda i: crc_fold(i, 5) > 1, calibrate=lambda i: crc_fold(i, 5) == 1)
    return out.withColumn("held_out", crc_fold("doc_id", 5) == 0)


@query
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from .html_text import main_text
    out = main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    from .pii import KINDS, find_personal_data
    out = find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: F.filter(base, lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"),
                      joined(F.col("spans")).alias("spans"))


@query
def op9_bpe(spark: SparkSession, sf_dir: str,
            path: str = public_tokenizers.path("word_bpe_49k.json")) -> DataFrame:
    """Token digests of every document."""
    from .bpe import bpe_encode, read_model
    out = bpe_encode(table(spark, sf_dir, "documents"), read_model(path))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query
def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest rows of every fiftieth vector."""
    from .ann import nearest
    return nearest(table(spark, sf_dir, "embeddings"), is_query=lambda i: i % 50 == 0)


@query
def op11_alignment(spark: SparkSession, sf_dir: str, path_a: str = public_tokenizers.path("byte_bpe_50k.json"),
                   path_b: str = public_tokenizers.path("piece_bpe_32k.model")) -> DataFrame:
    """Alignment of two tokenizers over every document."""
    from .align import alignment
    return alignment(table(spark, sf_dir, "documents"), path_a, path_b)[0]


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, a seventh of the labels moved."""
    from .negatives import hard_negatives
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label),
                          is_anchor=lambda i: i % 100 == 0)


@query
def op13_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowing fingerprints of every document and of its edited text."""
    from .fingerprint import edited_fingerprints, fingerprint_text
    out = edited_fingerprints(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.char_length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint_text(F.col("pos"), F.col("hash")).alias("fingerprint"),
        fingerprint_text(F.col("edited_pos"), F.col("edited_hash")).alias("edited_fingerprint"),
        "near_edited", "near_next")
