"""Language identification: multinomial naive Bayes over hashed character
n-grams.

Texts are lower-cased and read as code points; n-grams of 1 to ``MAX_N``
characters are hashed into ``BUCKETS`` cells.  Counts per language and cell
are summed in Spark over a bounded sample of labelled rows (about
``MAX_PER_LANG`` documents of each language, chosen by a hash of the id) and
smoothed to a matrix of log-probabilities, cells by languages, whose size is
fixed (``BUCKETS`` times at most ``MAX_LANGS``) and which travels with the
task.  Scoring is one map over all documents: each text's row of the sparse
count matrix is kept as its list of cells and multiplied with the matrix by a
gather and a segmented sum in numpy.

Defined results: a text that is NULL or has no letter is ``und`` with score 0;
labels that are NULL are not learned; without labels every text is ``und``.
The score is the posterior of the predicted language; ties go to the
alphabetically first language.  Repeated rows give repeated results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, row_sums, stored, text_blocks

BUCKETS = 1 << 16
MAX_N = 3
MAX_PER_LANG = 4_000
TILE = 250             # languages of one matrix (64 MB), and of the counts a task holds
ALPHA = 0.1
BLOCK = 1 << 20
UNKNOWN = "und"


def cells(data: np.ndarray, off: np.ndarray):
    """Hashed n-grams of a block of texts: for every order the cells in text
    order and their number per text."""
    raw = data.tobytes()
    texts = [raw[a:b].decode("utf-8", "replace").lower() for a, b in zip(off[:-1], off[1:])]
    n = np.array([len(t) for t in texts], np.int64)
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(cp))       # characters from here to the text's end
    key = np.zeros(len(cp), np.uint64)
    out = []
    for k in range(1, MAX_N + 1):
        if len(cp) < k:
            break
        key = key[:len(cp) - k + 1] * np.uint64(0x100000001B3) + cp[k - 1:] + np.uint64(k)
        cell = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64) % BUCKETS
        out.append((cell[left[:len(cell)] >= k], np.maximum(n - k + 1, 0)))
    return out


def cell_counts(docs: DataFrame) -> DataFrame:
    """(lang, cell, n) over ``docs(text, lang)``."""
    def rows_of(total):
        for lang, acc in total.items():
            at = np.flatnonzero(acc)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(acc[at])],
                names=["lang", "cell", "n"])

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for a, b, data, off in text_blocks(batch, "text", BLOCK):
                grams = cells(data, off)
                for lang in set(langs[a:b]):
                    mine = np.array([x == lang for x in langs[a:b]])
                    if lang not in total and len(total) >= TILE:
                        yield from rows_of(total)
                        total = {}
                    acc = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    for cell, n in grams:
                        acc += np.bincount(cell[np.repeat(mine, n)], minlength=BUCKETS)
        yield from rows_of(total)

    rows = docs.select("lang", "text").mapInArrow(run, "lang string, cell int, n bigint")
    return rows.groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def predict_language(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text",
                     lang_col: str = "lang") -> DataFrame:
    """``id_col``, ``lang_pred``, ``score`` for every row of ``docs``;
    ``train`` is a condition on the id that picks the rows to learn from."""
    text = F.col(text_col).cast("string")
    labelled = docs.where(train(F.col(id_col))).where(F.col(lang_col).isNotNull() & text.isNotNull())
    lang = F.col(lang_col).cast("string")
    # one row per language, as the model has one column per language
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy(lang.alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    out = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    if not sizes:
        return out.select(F.col("id").alias(id_col), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    share = docs.sparkSession.createDataFrame([(k, min(1.0, MAX_PER_LANG / n)) for k, n in sizes.items()],
                                              "lang string, share double")
    u = F.pmod(F.xxhash64(F.lit("language"), id_col), F.lit(1 << 30)) / float(1 << 30)
    sample = (labelled.select(text.alias("text"), lang.alias("lang"), u.alias("u"))
              .join(bounded(share, len(sizes)), "lang").where(F.col("u") < F.col("share")).select("text", "lang"))
    langs = sorted(sizes)
    counts = cell_counts(sample)
    if len(langs) > TILE:
        counts = stored(counts, "language-counts")
    kind = out.schema["id"].dataType.simpleString()
    has = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    state = (out.withColumn("letters", has).withColumn("best", F.lit(None).cast("string"))
             .withColumn("top", F.lit(float("-inf"))).withColumn("total", F.lit(0.0)))
    schema = f"id {kind}, text string, letters boolean, best string, top double, total double"
    for first in range(0, len(langs), TILE):
        tile = langs[first:first + TILE]
        logp = log_probabilities(counts if len(langs) <= TILE else counts.where(F.col("lang").isin(tile)), tile)
        last = first + TILE >= len(langs)
        state = state.mapInArrow(tile_scores(logp, tile, last), schema)
        if not last:
            # one matrix at a time in a worker
            state = stored(state, "language-scores")
    return state.select(F.col("id").alias(id_col),
                        F.when(F.col("letters"), F.col("best")).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
                        F.when(F.col("letters"), 1.0 / F.col("total")).otherwise(F.lit(0.0)).alias("score"))


def log_probabilities(counts: DataFrame, langs: list[str]) -> np.ndarray:
    """Smoothed log probability of every cell (rows) in every language (columns)."""
    n = np.zeros((BUCKETS, len(langs)))
    got = counts.toArrow()                       # at most BUCKETS x TILE rows
    if got.num_rows:
        column = np.searchsorted(langs, got.column("lang").to_pylist())
        n[got.column("cell").to_numpy(), column] = got.column("n").to_numpy()
    return np.log((n + ALPHA) / (n.sum(axis=0) + ALPHA * BUCKETS)).astype(np.float32)


def tile_scores(logp: np.ndarray, langs: list[str], last: bool):
    """Carries on, for some of the languages, each text's best language, its
    log score ``top`` and ``total`` = sum of exp(score - top); equal scores go
    to the smaller name.  The ``last`` tile hands on no text."""
    def run(batches):
        for batch in batches:
            best, top, total = [], [], []
            old = [batch.column(c) for c in ("best", "top", "total")]
            had_best, had_top, had_total = old[0].to_pylist(), old[1].to_numpy(), old[2].to_numpy()
            for a, b, data, off in text_blocks(batch, "text", BLOCK):
                s = np.zeros((b - a, len(langs)))
                for cell, n in cells(data, off):
                    for j in range(len(langs)):
                        s[:, j] += row_sums(logp[:, j][cell], n)
                at, high = s.argmax(axis=1), s.max(axis=1)
                mine = np.exp(s - high[:, None]).sum(axis=1)
                new = np.maximum(high, had_top[a:b])
                top.append(new)
                total.append(mine * np.exp(high - new) + had_total[a:b] * np.exp(had_top[a:b] - new))
                best += [langs[j] if h > o else w for j, h, o, w in zip(at, high, had_top[a:b], had_best[a:b])]
            join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0))
            text = pa.nulls(batch.num_rows, pa.string()) if last else batch.column("text")
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), text, batch.column("letters"), pa.array(best, pa.string()), join(top), join(total)],
                names=["id", "text", "letters", "best", "top", "total"])
    return run
