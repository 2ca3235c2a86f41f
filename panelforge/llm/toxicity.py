"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, one for toxic and one for ordinary text, share their lowest
order: the pooled continuation counts (distinct predecessors of a word in
either class).  With absolute discounts an expression with few distinct
contexts in a class keeps no mass of its own and falls back on those shared
counts, where both classes agree, so rare words say nothing.

    P_c(w)   = (max(k_c(w) - D1, 0) + g_c * P_sh(w)) / K_c,  k_c: distinct predecessors in class c
    P_c(w|v) = (max(n_c(v,w) - D2, 0) + g_c(v) * P_c(w)) / n_c(v)
    n_c(v,w): distinct predecessors of the bigram in class c, so a passage that is copied counts once
    P_sh(w)  = (max(k(w) - D0, 0) + D0 * V / (V + 1)) / K    pooled over both classes

A toxic text is mostly ordinary words, so its likelihood is that of a mixture
(``SHARE`` toxic model, the rest ordinary model).  The log-likelihood ratio of
mixture and ordinary model is normalised by length over the whole text (by n
and by the square root of n) and over its most toxic stretch of ``STRETCH``
words; a logistic calibration on a fold of labelled rows that the counts never
saw turns the three into a probability.

Scale: counts are grouped in Spark over a bounded sample of labelled rows
(``MAX_TOXIC``, ``MAX_ORDINARY`` and ``MAX_CALIBRATION`` documents expected,
chosen by a hash of the id; equal texts count once).  What is broadcast is
bounded by that sample: words and bigrams above their discount.  Scoring is
one map over all documents and whole texts.

Defined results: NULL and empty texts have zero evidence and get the
calibration's answer for that; labels other than 0 and 1 are ignored; without
labels of both classes every score is the share of toxic labels (0 without
labels).  Repeated rows give repeated results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibrate import logistic_fit
from .common import ALNUM, HashIndex, row_sums, stored, text_blocks, word_hashes

MAX_TOXIC, MAX_ORDINARY, MAX_CALIBRATION = 4_000, 16_000, 6_000
D1, D2 = 2.0, 4.0
SHARE = 0.01
STRETCH = 64
START = np.uint64(0x5354415254)


def _pairs(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Predecessor of every word (START for the first of a text)."""
    prev = np.empty_like(words)
    prev[1:] = words[:-1]
    first = np.cumsum(counts) - counts
    prev[first[counts > 0]] = START
    return prev


def bigram_counts(docs: DataFrame) -> DataFrame:
    """(v, w, nt, no): distinct bigrams of ``docs(text, toxic)`` with their
    continuation counts (distinct predecessors) in toxic and ordinary texts;
    v and w are 64-bit word hashes."""
    def run(batches):
        for batch in batches:
            toxic = np.asarray(batch.column("toxic"))
            for a, b, data, off in text_blocks(batch, "text"):
                w, n = word_hashes(data, off, ALNUM)
                if len(w) == 0:
                    continue
                v = _pairs(w, n)
                u = _pairs(v, n)
                cls = np.repeat(toxic[a:b], n)
                key = _pair_key(_pair_key(u, v), w) * np.uint64(2) + cls.astype(np.uint64)
                _, first = np.unique(key, return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[first].view(np.int64)) for x in (u, v, w)] + [pa.array(cls[first], pa.int32())],
                    names=["u", "v", "w", "c"])

    rows = docs.select("text", "toxic").mapInArrow(run, "u bigint, v bigint, w bigint, c int")
    return (rows.groupBy("u", "v", "w").agg(F.max("c").alias("t"), F.max(1 - F.col("c")).alias("o"))
            .groupBy("v", "w").agg(F.sum("t").alias("nt"), F.sum("o").alias("no")))


class KneserNey:
    """Log-likelihood ratios (toxic over ordinary) as lookup arrays."""

    def __init__(self, unknown: float, words, ratio, contexts, backoff, bigrams, direct):
        self.unknown = unknown
        self.words, self.ratio = _sorted(words, ratio)
        self.contexts, self.backoff = _sorted(contexts, backoff)
        self.bigrams, self.direct = _sorted(bigrams, direct)

    def features(self, data: np.ndarray, off: np.ndarray, index) -> np.ndarray:
        """The three length-normalised log-likelihood ratios of each row."""
        words, contexts, bigrams = index
        w, n = word_hashes(data, off, ALNUM)
        out = np.zeros((len(n), 3))
        if len(w) == 0:
            return out
        v = _pairs(w, n)
        at = words.find(w)
        s = np.where(at >= 0, self.ratio[at] if len(self.ratio) else 0.0, self.unknown)
        if len(self.contexts):
            at = contexts.find(v)
            s += np.where(at >= 0, self.backoff[at], 0.0)
        if len(self.bigrams):
            at = bigrams.find(_pair_key(v, w))
            s = np.where(at >= 0, self.direct[at], s)
        z = np.log1p(SHARE * np.expm1(np.minimum(s, 30.0)))
        total = row_sums(z, n)
        ends = np.cumsum(n)
        run = np.concatenate([[0.0], np.cumsum(z)])
        stop = np.minimum(np.arange(len(z)) + STRETCH, np.repeat(ends, n))
        stretch = (run[stop] - run[:-1]) / STRETCH
        full = np.flatnonzero(n)
        best = np.maximum.reduceat(stretch, (ends - n)[full])
        out[full, 0] = total[full] / n[full]
        out[full, 1] = total[full] / np.sqrt(n[full])
        out[full, 2] = np.maximum(best, 0.0)
        return np.sign(out) * np.log1p(50.0 * np.abs(out))

    def index(self):
        return HashIndex(self.words), HashIndex(self.contexts), HashIndex(self.bigrams)


def _sorted(keys, values):
    keys = np.asarray(keys, np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.asarray(values, np.float64)[order]


def _pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return v * np.uint64(0x9E3779B97F4A7C15) + w


def kneser_ney(docs: DataFrame) -> KneserNey | None:
    """Fit both models on ``docs(text, toxic)``; None without both classes."""
    pairs = stored(bigram_counts(docs), "kn-bigrams")
    words = stored(pairs.groupBy("w").agg(
        F.count_if(F.col("nt") > 0).alias("kt"), F.count_if(F.col("no") > 0).alias("ko"),
        F.count(F.lit(1)).alias("k")), "kn-words")
    s = words.agg(
        F.sum("kt").alias("kt"), F.sum("ko").alias("ko"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("v"),
        F.sum(F.least("kt", F.lit(D1))).alias("gt"), F.sum(F.least("ko", F.lit(D1))).alias("go"),
        F.count_if(F.col("k") == 1).alias("n1"), F.count_if(F.col("k") == 2).alias("n2")).first()
    if not s.kt or not s.ko:
        return None
    d0 = s.n1 / (s.n1 + 2 * s.n2) if s.n1 else 0.5
    shared = (F.greatest(F.col("k") - d0, F.lit(0.0)) + d0 * s.v / (s.v + 1)) / F.lit(float(s.k))
    words = words.select(
        "w", "kt", "ko",
        ((F.greatest(F.col("kt") - D1, F.lit(0.0)) + s.gt * shared) / float(s.kt)).alias("pt"),
        ((F.greatest(F.col("ko") - D1, F.lit(0.0)) + s.go * shared) / float(s.ko)).alias("po"))
    told = words.where((F.col("kt") > D1) | (F.col("ko") > D1))
    ratio = told.select("w", F.log(F.col("pt") / F.col("po")).alias("r")).toArrow()
    # only contexts with a bigram above the discount differ from plain back-off
    over = lambda c: F.greatest(F.col(c) - D2, F.lit(0.0))
    context = (pairs.groupBy("v").agg(
        F.sum("nt").alias("tt"), F.sum("no").alias("to"),
        F.sum(over("nt")).alias("mt"), F.sum(over("no")).alias("mo"))
        .where((F.col("mt") > 0) | (F.col("mo") > 0))
        .select("v", "tt", "to",
                F.when(F.col("tt") > 0, (F.col("tt") - F.col("mt")) / F.col("tt")).otherwise(1.0).alias("bt"),
                F.when(F.col("to") > 0, (F.col("to") - F.col("mo")) / F.col("to")).otherwise(1.0).alias("bo")))
    tiny = F.lit(1e-12)
    weights = context.select("v", F.log(F.greatest("bt", tiny) / F.greatest("bo", tiny)).alias("r")).toArrow()
    kept = (pairs.where((F.col("nt") > D2) | (F.col("no") > D2))
            .join(context, "v").join(words.select("w", "pt", "po"), "w"))
    pt = F.when(F.col("tt") > 0, over("nt") / F.col("tt")).otherwise(0.0) + F.col("bt") * F.col("pt")
    po = F.when(F.col("to") > 0, over("no") / F.col("to")).otherwise(0.0) + F.col("bo") * F.col("po")
    direct = kept.select("v", "w", F.log(F.greatest(pt, tiny) / F.greatest(po, tiny)).alias("r")).toArrow()
    col = lambda t, c: t.column(c).to_numpy()
    keys = _pair_key(col(direct, "v").view(np.uint64), col(direct, "w").view(np.uint64)).view(np.int64)
    unknown = float(np.log((s.gt / s.kt) / (s.go / s.ko)))
    return KneserNey(unknown, col(ratio, "w"), col(ratio, "r"), col(weights, "v"), col(weights, "r"),
                     keys, col(direct, "r"))


def score_features(docs: DataFrame, model: KneserNey, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``f0 f1 f2`` of every row of ``docs(text, ...)``."""
    def run(batches):
        index = model.index()
        for batch in batches:
            f = [model.features(data, off, index) for _, _, data, off in text_blocks(batch, "text")]
            f = np.concatenate(f) if f else np.zeros((0, 3))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], *[pa.array(f[:, i]) for i in range(3)]],
                names=[*keep, "f0", "f1", "f2"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select("text", *keep).mapInArrow(run, f"{kinds}, f0 double, f1 double, f2 double")


def _sampled(labelled: DataFrame, bound: tuple[int, int]) -> DataFrame:
    """About ``bound`` rows (of class 0, of class 1) or all, by a hash of the id."""
    n = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for c, most in zip((0, 1), bound):
        share = F.when(F.col("toxic") == c, min(1.0, most / max(n.get(c, 0), 1))).otherwise(share)
    u = F.pmod(F.xxhash64(F.lit("toxicity"), "_id"), F.lit(1 << 30)) / float(1 << 30)
    return labelled.where(u < share)


def score_toxicity(docs: DataFrame, labels: DataFrame, train, calibrate, id_col: str = "doc_id",
                   text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``id_col``, ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5) of
    every row of ``docs``.  ``train`` and ``calibrate`` are conditions on the
    id that pick the labelled rows to count and to calibrate on."""
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    # one label per id: a repeated label row must not repeat its document
    lab = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic"))
           .where(F.col("toxic").isin(0, 1)).groupBy("_id").agg(F.max("toxic").alias("toxic")))
    fit_ids = _sampled(lab.where(train(F.col("_id"))), (MAX_ORDINARY, MAX_TOXIC))
    cal_ids = _sampled(lab.where(calibrate(F.col("_id"))), (MAX_CALIBRATION, MAX_CALIBRATION))
    fit = (src.join(F.broadcast(fit_ids), "_id")                # bounded by the sample
           .dropDuplicates(["text", "toxic"]).select("text", "toxic"))
    model = kneser_ney(fit)
    if model is None:
        share = lab.where(train(F.col("_id"))).agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0]
        score = F.lit(float(share))
        return src.select(F.col("_id").alias(id_col), score.alias("score"),
                          (score >= 0.5).cast("int").alias("predicted"))
    cal = score_features(src.join(F.broadcast(cal_ids), "_id"), model, ["toxic"]).toArrow()
    if cal.num_rows == 0 or len(set(cal.column("toxic").to_pylist())) < 2:
        # no calibration rows: fall back on the training rows' own features
        cal = score_features(fit, model, ["toxic"]).toArrow()
    x = np.column_stack([cal.column(f"f{i}").to_numpy() for i in range(3)])
    w = logistic_fit(x, cal.column("toxic").to_numpy().astype(float))
    f = score_features(src, model, ["_id"])
    z = F.lit(float(w[3]))
    for i in range(3):
        z = z + F.lit(float(w[i])) * F.col(f"f{i}")
    score = 1.0 / (1.0 + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0))))
    return f.select(F.col("_id").alias(id_col), score.alias("score"), (z >= 0).cast("int").alias("predicted"))
