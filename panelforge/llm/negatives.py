"""Hard negatives by integer inner products.

Vectors become whole numbers (``floor(scale * x)``); a row's score for an
anchor is their exact inner product.  Scores of a tile of anchors and
candidates are one matrix product by **Strassen's recursion** on int64: odd
sides are padded with zeros, seven products of half-size tiles replace eight,
down to sides of ``LEAF``.  Additions wrap around at 64 bits, which keeps the
result exact whenever the score itself fits.

Two rounds over blocks of the table, each a shuffle of (anchor block, candidate
block) units of bounded size; inside a unit the candidates come tile by tile:

1. *positives*: anchors meet the candidates of their own label only; every
   tile's best candidates are merged into a heap of ``k`` per anchor;
2. *windows*: every anchor carries the score limits of its positives; of the
   other labels' candidates within ``low * p <= high * n <= high * p`` each
   window keeps a heap of its ``k`` best.

The heaps are mergeable (two sorted runs by score and id, cut to ``k``): tiles
merge inside a unit, and Spark merges the units' heaps by a ranked window per
anchor, or per anchor and positive, over ``k`` rows a unit.  Blocks follow a
hash of the id, so a label with a third of the rows is many blocks; nothing is
collected per label.

Defined results: rows with a NULL id, label or vector, or with a NULL or
non-finite component, take no part.  Shorter vectors count as padded with
zeros; an empty vector scores 0.  Repeated rows (equal id, label and vector)
count once; other rows of one id act as one anchor, which ranks all their
scores together, and are never each other's positive.  Ties go to the smaller
id.  An anchor with fewer than ``k`` positives has those it has; a positive
whose window is empty (always, for a negative score) gives no row.  Components beyond 64 bits, and tables whose scores might be, are worked
out with unbounded integers; a returned score beyond 64 bits is an error, as
its column cannot hold it.  An empty table gives no rows.  Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SCALE = 256
LOW, HIGH = 80, 100               # of a positive's score, in hundredths
BLOCK, ANCHOR_BLOCK = 16_384, 2_048
TILE, ANCHOR_TILE = 2_048, 256    # candidates and anchors of one product
LEAF = 8
INT64 = 1 << 63


def padded(x: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """``x`` with zeros below and to the right."""
    if x.shape == (rows, cols):
        return x
    out = np.zeros((rows, cols), x.dtype)
    out[:x.shape[0], :x.shape[1]] = x
    return out


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of integer matrices by Strassen's seven products."""
    m, k = a.shape
    n = b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    h, d, w = -(-m // 2), -(-k // 2), -(-n // 2)
    a, b = padded(a, 2 * h, 2 * d), padded(b, 2 * d, 2 * w)
    a11, a12, a21, a22 = a[:h, :d], a[:h, d:], a[h:, :d], a[h:, d:]
    b11, b12, b21, b22 = b[:d, :w], b[:d, w:], b[d:, :w], b[d:, w:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * h, 2 * w), a.dtype)
    out[:h, :w] = p1 + p4 - p5 + p7
    out[:h, w:] = p3 + p5
    out[h:, :w] = p2 + p4
    out[h:, w:] = p1 - p2 + p3 + p6
    return out[:m, :n]


class Heaps:
    """One bounded heap per row of a tile: the ``k`` best (score, place), best
    first; a smaller place wins a tie.  ``valid`` marks the entries in use."""

    def __init__(self, rows: int, k: int, kind):
        self.k = k
        self.score = np.zeros((rows, k), kind)
        self.place = np.zeros((rows, k), np.int64)
        self.valid = np.zeros((rows, k), bool)

    def merge(self, score: np.ndarray, place: np.ndarray, valid: np.ndarray) -> None:
        """Merge with other runs of the same rows."""
        score = np.concatenate([self.score, score], axis=1)
        place = np.concatenate([self.place, place], axis=1)
        valid = np.concatenate([self.valid, valid], axis=1)
        # stable sorts from the last key to the first: place, score downwards, unused behind
        order = np.argsort(place, axis=1, kind="stable")
        for key in (-score, ~valid):
            order = np.take_along_axis(order, np.argsort(np.take_along_axis(key, order, 1), axis=1, kind="stable"), 1)
        order = order[:, :self.k]
        self.score, self.place, self.valid = (np.take_along_axis(x, order, 1) for x in (score, place, valid))


def best_of(score: np.ndarray, fits: np.ndarray, first: int, k: int):
    """Scores, places (counted from ``first``) and use of the ``k`` best
    candidates per row among those that fit; the first of equal scores wins."""
    rows = np.arange(len(score))
    # below every score: these are within 63 bits or unbounded
    least = np.iinfo(np.int64).min if score.dtype != object else score.min() - 1
    left = np.where(fits, score, least)
    out = [[], [], []]
    for _ in range(min(k, score.shape[1])):
        at = left.argmax(axis=1)
        for to, x in zip(out, (score[rows, at], first + at, left[rows, at] != least)):
            to.append(x)
        left[rows, at] = least
    return [np.stack(x, axis=1) for x in out]


def usable(df: DataFrame, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    """(id, label, vec array<double>) of the rows that take part."""
    src = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"),
                    F.col(vec_col).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return src.where(F.col("id").isNotNull() & F.col("label").isNotNull()
                     & F.coalesce(~bad, F.lit(False))).dropDuplicates()


def whole_numbers(x: np.ndarray, scale: int, kind) -> np.ndarray:
    """``floor(scale * x)``; doubles from 2^52 on are whole already."""
    if kind is np.int64:
        return np.floor(x * scale).astype(np.int64)
    return np.array([int(v) * scale if abs(v) >= 1 << 52 else math.floor(v * scale) for v in x.tolist()], object)


def _matrix(column, dim: int, scale: int, kind) -> np.ndarray:
    """Rows of whole numbers, padded with zeros to ``dim``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dim), kind)
    out[np.arange(dim)[None] < size[:, None]] = whole_numbers(
        column.flatten().to_numpy(zero_copy_only=False), scale, kind)
    return out


def _units(left: DataFrame, right: DataFrame, n_left: int, n_right: int) -> tuple[DataFrame, DataFrame, list]:
    """Deal both sides into blocks by a hash of the id and bring every left
    block together with every right block."""
    a, b = max(1, -(-n_left // ANCHOR_BLOCK)), max(1, -(-n_right // BLOCK))
    left = (left.withColumn("ask", F.pmod(F.xxhash64("id"), F.lit(a)).cast("int"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(b - 1)))))
    right = (right.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(b)).cast("int"))
             .withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(a - 1)))))
    return left, right, ["ask", "block"]


class Unit:
    """Products of a unit's anchors with its candidates, tile by tile, the
    candidates in ascending order of id; and the heaps they are merged into."""

    def __init__(self, mine: pa.Table, theirs: pa.Table, dim: int, scale: int, kind, k: int):
        self.mine, self.theirs = mine, theirs.sort_by("id") if theirs.num_rows else theirs
        self.k, self.kind, self.heaps = k, kind, {}
        if not mine.num_rows or not theirs.num_rows:
            return
        both = pa.chunked_array(mine.column("label").chunks + self.theirs.column("label").chunks).combine_chunks()
        label = both.dictionary_encode().indices.to_numpy()
        self.anchor, self.id = mine.column("id").to_numpy(), self.theirs.column("id").to_numpy()
        self.anchor_label, self.label = label[:len(self.anchor)], label[len(self.anchor):]
        self.left, self.right = (_matrix(t.column("vec"), dim, scale, kind) for t in (mine, self.theirs))

    def tiles(self):
        """(rows of anchors, first candidate, scores, same label, other id)."""
        if not self.mine.num_rows or not self.theirs.num_rows:
            return
        for i in range(0, len(self.anchor), ANCHOR_TILE):
            rows = slice(i, i + ANCHOR_TILE)
            for j in range(0, len(self.id), TILE):
                at = slice(j, j + TILE)
                score = strassen(self.left[rows], np.ascontiguousarray(self.right[at].T))
                yield (rows, j, score, self.anchor_label[rows, None] == self.label[None, at],
                       self.anchor[rows, None] != self.id[None, at])

    def keep(self, key, score, fits, first) -> None:
        """Merge the best of a tile into the heaps of ``key`` = (first anchor,
        window)."""
        if key not in self.heaps:
            self.heaps[key] = Heaps(len(score), self.k, self.kind)
        self.heaps[key].merge(*best_of(score, fits, first, self.k))

    def rows(self) -> pa.Table:
        """``anchor``, ``place`` (of the window, from 1), ``id``, ``score``."""
        a, w, c, s = [], [], [], []
        for (start, window), h in self.heaps.items():
            row, col = np.nonzero(h.valid)
            a.append(start + row)
            w.append(np.full(len(row), window + 1))
            c.append(h.place[row, col])
            s.extend(h.score[row, col].tolist())
        join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0), pa.int64())
        return pa.table({"anchor": self.mine.column("id").take(join(a)), "place": join(w).cast(pa.int32()),
                         "id": self.theirs.column("id").take(join(c)), "score": pa.array(s, pa.int64())})


def hard_negatives(df: DataFrame, is_anchor, k: int = 5, id_col: str = "vec_id", label_col: str = "label",
                   vec_col: str = "embedding", scale: int = SCALE, low: int = LOW, high: int = HIGH) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``,
    ``positive_score``, ``negative_score`` of every row for which
    ``is_anchor(id)`` holds."""
    src = stored(usable(df, id_col, label_col, vec_col), "negatives-vectors")
    kid = src.schema["id"].dataType.simpleString()
    limits = src.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("vec")).alias("dim"),
                     F.max(F.aggregate("vec", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))).alias("top"),
                     F.count(F.when(is_anchor(F.col("id")), 1)).alias("anchors")).first()
    if not limits["anchors"]:
        return df.sparkSession.createDataFrame([], (
            f"anchor_id {kid}, positive_id {kid}, rank int, negative_id {kid}, positive_score bigint, "
            "negative_score bigint"))
    dim = max(1, limits["dim"])
    # a window's limits multiply scores by up to ``low`` and ``high``
    most = dim * ((int(limits["top"]) + 1) * scale) ** 2 * max(low, high)
    kind = np.int64 if most < INT64 else object
    # columns of their own: both sides of a unit come from the same table
    anchors = src.where(is_anchor(F.col("id"))).select(*[F.col(c).alias(c) for c in src.columns])
    schema = f"anchor {kid}, place int, id {kid}, score bigint"

    def positives(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        unit = Unit(mine, theirs, dim, scale, kind, k)
        for rows, first, score, same, other in unit.tiles():
            unit.keep((rows.start, 0), score, same & other, first)
        return unit.rows()

    # blocks of a label meet blocks of the same label
    left, right, unit = _units(anchors, src, limits["anchors"], limits["rows"])
    found = left.groupBy("label", *unit).cogroup(right.groupBy("label", *unit)).applyInArrow(positives, schema)
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), F.col("id"))
    top = stored(found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k), "negatives-positives")
    limited = anchors.join(top.groupBy("anchor").agg(       # at most k rows of an anchor
        F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda s: s["score"]).alias("limits")),
        F.col("id") == F.col("anchor")).drop("anchor")

    def windows(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        unit = Unit(mine, theirs, dim, scale, kind, k)
        wanted = mine.column("limits").to_pylist()
        for rows, first, score, same, _ in unit.tiles():
            middle = score * high
            for place in range(k):
                has = np.array([place < len(w) for w in wanted[rows]])[:, None]
                p = np.array([w[place] if place < len(w) else 0 for w in wanted[rows]], kind)[:, None]
                fits = has & ~same & (low * p <= middle) & (middle <= high * p)
                if fits.any():
                    unit.keep((rows.start, place), score, fits, first)
        return unit.rows()

    left, right, unit = _units(limited, src, limits["anchors"], limits["rows"])
    near = left.groupBy(*unit).cogroup(right.groupBy(*unit)).applyInArrow(windows, schema)
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.col("id"))
    near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return (near.join(top.select("anchor", "place", F.col("id").alias("positive_id"),
                                 F.col("score").alias("positive_score")), ["anchor", "place"])
            .select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))
