"""Quality by co-training two views of a document.

The **content view** sees the words: shares of capitals, digits, symbols and
repeated words, word lengths, vocabulary, each over the whole text and at its
worst stretch of ``STRETCH`` words.  The **page view** sees the record around
them: language, source, declared length and the layout of lines.  Each view
has a logistic classifier.  In each of ``ROUNDS`` rounds both are fitted on
the labelled rows and on what the other view was sure of among the unlabelled
ones: beyond the thresholds where ``SURE`` of its labels, for either side, were
right on the calibration fold (a view that never is that sure teaches
nothing).  At the
end a logistic combination, fitted on a fold of labelled rows that neither
view has learned from, merges the two calibrated views.

Scale: features are computed once, in one map over whole texts, and stored (a
few dozen numbers per document).  A fit is a handful of Newton steps; each is
one pass over that table whose sums (a matrix of fixed size) are added up in
Spark.  Both views share a pass.  All rows take part; only calibration reads a
bounded sample (about ``CALIBRATION`` labelled rows, by a hash of the id).

Defined results: NULL and empty texts have all-zero content; NULL metadata is
a category of its own; labels other than 0 and 1 are ignored; without labels
of both classes every score is the share of good labels (1 without labels).
Repeated rows get the same score each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibrate import logistic_fit, sigmoid
from .common import SPACED, row_sums, span_hashes, stored, text_blocks, word_spans

ROUNDS = 2
SURE = 0.998
NEWTON_STEPS = 7
RIDGE = 1.0
STRETCH = 16
CALIBRATION = 10_000
LANGS, SOURCES = 8, 16
N_CONTENT = 18                       # features of the content view, intercept included
N_PAGE = 9 + LANGS + SOURCES

_UPPER = np.zeros(256, np.float32)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.float32)
_DIGIT[48:58] = 1
_SYMBOL = np.zeros(256, np.float32)
_SYMBOL[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'"]] = 1


def content_features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows of the content view for a block of texts."""
    n_rows = len(off) - 1
    out = np.zeros((n_rows, N_CONTENT))
    out[:, -1] = 1.0
    if len(data) == 0:
        return out
    starts, ends, folded = word_spans(data, off, SPACED)
    if len(starts) == 0:
        return out
    h = span_hashes(starts, ends, folded)
    n = np.diff(np.searchsorted(starts, off))
    doc = np.repeat(np.arange(n_rows), n)
    length = (ends - starts).astype(np.float64)
    count = lambda table: np.diff(np.concatenate([[0.0], np.cumsum(table[data], dtype=np.float64)])[
        np.column_stack([starts, ends])], axis=1)[:, 0]
    upper, digit, symbol = count(_UPPER), count(_DIGIT), count(_SYMBOL)
    repeat = np.zeros(len(h))
    repeat[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    capitals = (upper > 0.7 * np.maximum(length - symbol, 1)) & (length > 1)
    marked = symbol / length
    order = np.lexsort((h, doc))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    total = np.maximum(n, 1)
    size = np.maximum(row_sums(length, n), 1)
    mean = lambda x: row_sums(x.astype(np.float64), n) / total
    first, last = np.cumsum(n) - n, np.repeat(np.cumsum(n), n)
    full = np.flatnonzero(n)

    def worst(x):
        run = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
        stop = np.minimum(np.arange(len(x)) + STRETCH, last)
        top = np.zeros(n_rows)
        top[full] = np.maximum.reduceat(run[stop] - run[:-1], first[full]) / STRETCH
        return top

    distinct = np.bincount(doc[order][fresh], minlength=n_rows)
    some = (n > 0).astype(float)
    columns = [row_sums(upper, n) / size, row_sums(digit, n) / size, row_sums(symbol, n) / size, mean(repeat),
               mean(capitals), mean(marked > 0.2), mean(length == 1), np.minimum(mean(length), 50) / 10,
               distinct / total, distinct / np.maximum(np.sqrt(n), 1) / 10, np.log1p(n) / 10, some,
               worst(repeat), worst(capitals), worst(marked > 0.2), worst(np.minimum(marked, 1)),
               worst((length == 1) & (symbol == 1))]
    out[:, :-1] = np.column_stack(columns)
    return out


def page_features(batch: pa.RecordBatch, a: int, b: int, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows of the page view: metadata columns and line layout."""
    n_rows = b - a
    out = np.zeros((n_rows, N_PAGE))
    out[:, -1] = 1.0
    size = np.diff(off).astype(np.float64)
    newline = np.concatenate([[0], np.cumsum(data == 10)]) if len(data) else np.zeros(1, np.int64)
    lines = np.diff(newline[off]) + 1.0
    declared = np.array([np.nan if x is None else float(x) for x in batch.column("n_chars").slice(a, n_rows).to_pylist()])
    known = np.isfinite(declared)
    out[:, 0] = np.log1p(size) / 10
    out[:, 1] = np.log1p(lines) / 5
    out[:, 2] = np.log1p(size / lines) / 5
    out[:, 3] = np.where(known, np.log1p(np.maximum(np.nan_to_num(declared), 0)) / 10, 0)
    out[:, 4] = known
    out[:, 5] = np.where(known & (size > 0), np.clip(np.nan_to_num(declared) / np.maximum(size, 1), 0, 2), 1)
    some = size > 0
    tail = data[np.maximum(off[1:][some] - 1, 0)]
    out[some, 6] = np.isin(tail, np.frombuffer(b".!?\n", np.uint8))
    head = data[off[:-1][some]]
    out[some, 7] = (head >= 97) & (head <= 122)
    for column, first, cells in (("lang_cell", 8, LANGS), ("source_cell", 8 + LANGS, SOURCES)):
        out[np.arange(n_rows), first + np.asarray(batch.column(column).slice(a, n_rows)) % cells] = 1.0
    return out


def _cell(column, n: int):
    """Hashed category; NULL has a cell of its own."""
    return F.coalesce(F.pmod(F.xxhash64(column.cast("string")), F.lit(n - 1)) + 1, F.lit(0)).cast("int")


def feature_table(docs: DataFrame) -> DataFrame:
    """(id, content, page): both views of ``docs(id, text, lang, source,
    n_chars)`` as binary float32 vectors."""
    def run(batches):
        for batch in batches:
            for a, b, data, off in text_blocks(batch, "text"):
                views = [content_features(data, off), page_features(batch, a, b, data, off)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a),
                     *[pa.array([r.tobytes() for r in v.astype(np.float32)], pa.binary()) for v in views]],
                    names=["id", "content", "page"])

    src = docs.select("id", "text", F.col("n_chars").cast("double").alias("n_chars"),
                      _cell(F.col("lang"), LANGS).alias("lang_cell"), _cell(F.col("source"), SOURCES).alias("source_cell"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, content binary, page binary")


def _rows(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array([np.frombuffer(x.as_buffer(), np.float32) for x in column], np.float64).reshape(-1, width)


class Views:
    """Weights and calibration (slope, intercept) of the two views."""

    def __init__(self):
        self.weights = [np.zeros(N_CONTENT), np.zeros(N_PAGE)]
        self.scale = [np.array([1.0, 0.0]), np.array([1.0, 0.0])]
        self.limits = [(2.0, -1.0), (2.0, -1.0)]

    def sure(self, view: int, x: np.ndarray) -> np.ndarray:
        """Pseudo-labels: 1, 0, or -1 where the view is not sure."""
        p = sigmoid(self.scale[view][0] * (x @ self.weights[view]) + self.scale[view][1])
        high, low = self.limits[view]
        return np.where(p >= high, 1, np.where(p <= low, 0, -1))

    def calibrate(self, x: list[np.ndarray], y: np.ndarray) -> None:
        """Scales and confidence limits from labelled rows of both classes."""
        for v in (0, 1):
            z = x[v] @ self.weights[v]
            self.scale[v] = logistic_fit(z[:, None], y)
            p = sigmoid(self.scale[v][0] * z + self.scale[v][1])
            self.limits[v] = _limit(p, y), 1.0 - _limit(1.0 - p, 1.0 - y)


def _limit(p: np.ndarray, y: np.ndarray) -> float:
    """Lowest threshold above which ``SURE`` of the labels (and one more, wrong
    one) are 1; 2 if there is none."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    # rows that tie with the threshold must count: ends of tie groups only
    ends = np.append(p[order][1:] < p[order][:-1], True)[:len(y)]
    good = np.flatnonzero((hits >= SURE * np.arange(2, len(y) + 2)) & ends)
    return float(p[order[good[-1]]]) if len(good) else 2.0


def _step(rows: DataFrame, teachers: Views | None, weights: list[np.ndarray]) -> list[np.ndarray]:
    """One Newton step of both views over ``rows(content, page, y)``; ``y`` is
    the label, -1 for unlabelled rows, -2 for rows that must not be learned."""
    widths = (N_CONTENT, N_PAGE)

    def run(batches):
        sums = [np.zeros((w + 1, w)) for w in widths]
        for batch in batches:
            y = np.asarray(batch.column("y"))
            x = [_rows(batch.column(c), w) for c, w in zip(("content", "page"), widths)]
            for v in (0, 1):
                label = y.copy()
                if teachers is not None:
                    label = np.where(y == -1, teachers.sure(1 - v, x[1 - v]), y)
                use = label >= 0
                xv, t = x[v][use], label[use]
                p = sigmoid(xv @ weights[v])
                sums[v][:-1] += (xv * (p * (1 - p))[:, None]).T @ xv
                sums[v][-1] += xv.T @ (t - p)
        flat = np.concatenate([s.reshape(-1) for s in sums])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)],
                                         names=["k", "s"])

    got = rows.mapInArrow(run, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).toArrow()
    flat = np.zeros(sum((w + 1) * w for w in widths))
    flat[got.column("k").to_numpy()] = got.column("s").to_numpy()
    out, at = [], 0
    for v, w in enumerate(widths):
        s = flat[at:at + (w + 1) * w].reshape(w + 1, w)
        at += (w + 1) * w
        grad = s[-1] - RIDGE * weights[v]
        step = np.linalg.solve(s[:-1] + RIDGE * np.eye(w), grad)
        out.append(weights[v] + np.clip(step, -10, 10))
    return out


class QualityModel:
    """Both views and their combination; ``share`` instead where the labels
    do not hold both classes."""

    def __init__(self, views: Views | None, mixed: np.ndarray | None, share: float = 1.0):
        self.views, self.mixed, self.share = views, mixed, share

    def scores(self, content: np.ndarray, page: np.ndarray):
        """Probabilities of label 1 by content, by page, and combined."""
        if self.views is None:
            return (np.full(len(content), self.share),) * 3
        z = [s[0] * (x @ w) + s[1] for x, w, s in zip((content, page), self.views.weights, self.views.scale)]
        return sigmoid(z[0]), sigmoid(z[1]), sigmoid(self.mixed[0] * z[0] + self.mixed[1] * z[1] + self.mixed[2])


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    column = lambda c: F.col(c) if c in docs.columns else F.lit(None)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                       column("lang").alias("lang"), column("source").alias("source"),
                       column("n_chars").alias("n_chars"))


def fit_quality(docs: DataFrame, labels: DataFrame, train, calibrate, id_col: str = "doc_id",
                text_col: str = "text", label_col: str = "quality") -> tuple[QualityModel, DataFrame]:
    """The model and the stored feature table (id, content, page, ...)."""
    src = _source(docs, id_col, text_col)
    lab = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
           .where(F.col("label").isin(0, 1)).groupBy("id").agg(F.max("label").alias("label")))
    kept = F.when(F.col("label").isNull(), -1).when(train(F.col("id")), F.col("label")).otherwise(-2)
    table = stored(feature_table(src).join(lab, "id", "left").withColumn("y", kept.cast("int")), "quality-features")
    picked = calibrate(F.col("id")) & F.col("label").isNotNull()
    seen = table.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0), F.count_if(picked)).first()
    if not seen[0] or not seen[1]:
        return QualityModel(None, None, 1.0 if not seen[0] + seen[1] else float(seen[0] > 0)), table
    u = F.pmod(F.xxhash64(F.lit("quality"), "id"), F.lit(1 << 30)) / float(1 << 30)
    cal = table.where(picked & (u < min(1.0, CALIBRATION / max(seen[2], 1)))).select("content", "page", "label").toArrow()
    cx = [_rows(cal.column("content"), N_CONTENT), _rows(cal.column("page"), N_PAGE)]
    cy = cal.column("label").to_numpy().astype(float)
    able = len(set(cy.tolist())) == 2
    views = Views()
    rows = table.select("content", "page", "y").where("y >= -1")
    for r in range(ROUNDS + 1):
        weights = views.weights
        for _ in range(NEWTON_STEPS):
            weights = _step(rows, views if r else None, weights)
        views = Views()
        views.weights = weights
        if able:
            views.calibrate(cx, cy)
    mixed = (logistic_fit(np.column_stack([s[0] * (x @ w) + s[1] for x, w, s in zip(cx, views.weights, views.scale)]), cy)
             if able else np.array([0.5, 0.5, 0.0]))
    return QualityModel(views, mixed), table


def score_quality(docs: DataFrame, labels: DataFrame, train, calibrate, id_col: str = "doc_id",
                  text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``id_col``, ``content_score``, ``page_score``, ``score`` (0 to 1,
    higher: better) and ``predicted`` for every row of ``docs``.  ``train`` and
    ``calibrate`` are conditions on the id that pick labelled rows."""
    model, table = fit_quality(docs, labels, train, calibrate, id_col, text_col, label_col)

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            c, p, both = model.scores(_rows(batch.column("content"), N_CONTENT), _rows(batch.column("page"), N_PAGE))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(c), pa.array(p), pa.array(both), pa.array((both >= 0.5).astype(np.int32))],
                names=["id", "content_score", "page_score", "score", "predicted"])

    out = table.select("id", "content", "page").mapInArrow(
        run, f"id {table.schema['id'].dataType.simpleString()}, content_score double, page_score double, "
             "score double, predicted int")
    return out.withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, labels: DataFrame, train, calibrate, id_col: str = "doc_id",
              text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier does not reject:
    a second map over the texts, so no text is shuffled."""
    model, _ = fit_quality(docs, labels, train, calibrate, id_col, text_col, label_col)
    names = [f"c{i}" for i in range(len(docs.columns))]
    with_text = _with_views(docs.toDF(*names), names, docs.columns, text_col)

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for a, b, data, off in text_blocks(batch, "text"):
                _, _, both = model.scores(content_features(data, off), page_features(batch, a, b, data, off))
                keep[a:b] = both >= 0.5
            yield batch.select(names).filter(pa.array(keep))

    kinds = ", ".join(f"{n} {with_text.schema[n].dataType.simpleString()}" for n in names)
    return with_text.mapInArrow(run, kinds).toDF(*docs.columns)


def _with_views(docs: DataFrame, names: list[str], columns: list[str], text_col: str) -> DataFrame:
    """``docs`` under neutral names with the inputs of both views beside them."""
    at = {c: n for n, c in zip(names, columns)}
    column = lambda c: F.col(at[c]) if c in at else F.lit(None)
    return docs.select(*names, F.col(at[text_col]).cast("string").alias("text"),
                       column("n_chars").cast("double").alias("n_chars"),
                       _cell(column("lang"), LANGS).alias("lang_cell"),
                       _cell(column("source"), SOURCES).alias("source_cell"))
