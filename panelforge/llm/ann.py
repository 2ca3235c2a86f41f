"""Approximate nearest neighbours by cosine: inverted lists scanned with an
adaptive number of dimensions.

Fit (driver, on a bounded sample of ``SAMPLE`` vectors): a random rotation, a
coarse k-means of about half the square root of the table's size (``MAX_LISTS``
at most), and the number of lists a query must probe to reach
``TARGET_RECALL`` within the sample.  Every vector is then assigned to its
list in Spark.

Search: queries meet the lists they probe in a shuffle.  A list of more than
``BLOCK`` vectors is dealt into blocks and its queries into blocks as well, so
a unit of work is bounded whatever the size of a list.  In a unit the rotated
vectors are read in column blocks of ``COLUMNS``.  After each one the partial
distance d of the first m of D dimensions estimates the whole one, and the
hypothesis that the candidate is nearer than the query's k-th best so far is
dropped if  d * D / m > (1 + EPSILON / sqrt(m))^2 * tau.  What survives all
columns is scored exactly: cosine in double precision on the original vectors.
The k best of each unit are merged by a ranked window per query, whose input
is k rows per unit.

Defined results: vectors that are NULL, zero, hold a NULL or non-finite
component, or have another length than the most frequent one take no part, as
queries or candidates; neither do rows with a NULL id.  A row is not its own
neighbour; ties go to the smaller id; a query with fewer than k candidates
gets all of them.  Repeated rows (equal id and vector) count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SAMPLE = 20_000
MAX_LISTS = 4_096
TARGET_RECALL = 0.97
CALIBRATION_QUERIES = 256
BLOCK, QUERY_BLOCK = 8_192, 2_048
COLUMNS = 16
EPSILON = 2.1
ROUNDS = 10


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec array<double>) of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0.0)
    src = (df.select(F.col(id_col).alias("id"), v.alias("vec")).where(F.col("id").isNotNull())
           .where(F.coalesce(~bad & some, F.lit(False))).dropDuplicates(["id", "vec"]))
    size = src.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return src.where(F.size("vec") == (size["d"] if size else 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class Coarse:
    """Rotation, list centres and the number of lists to probe."""

    def __init__(self, sample: np.ndarray, rows: int, k: int, recall: float):
        rng = np.random.default_rng(64)
        dim = sample.shape[1]
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        x = _unit(sample) @ self.rotation
        lists = int(min(MAX_LISTS, max(1, np.sqrt(rows) / 2), len(x)))
        c = x[rng.permutation(len(x))[:lists]]
        for _ in range(ROUNDS):
            a = (x @ c.T).argmax(axis=1)
            total = np.zeros_like(c)
            np.add.at(total, a, x)
            norm = np.linalg.norm(total, axis=1, keepdims=True)
            c = np.where(norm > 0, total / np.where(norm > 0, norm, 1), c)
        self.centres = c
        # lists to probe: the fewest that hold the sample's own neighbours
        a = (x @ c.T).argmax(axis=1)
        q = x[:CALIBRATION_QUERIES]
        sims = q @ x.T
        sims[np.arange(len(q)), np.arange(len(q))] = -9
        near = np.argsort(-sims, axis=1)[:, :min(k, len(x) - 1)]
        place = np.argsort(np.argsort(-(q @ c.T), axis=1), axis=1)
        depth = np.sort(place[np.arange(len(q))[:, None], a[near]].reshape(-1))
        want = int(np.ceil(recall * len(depth))) - 1
        self.probes = int(depth[want]) + 1 if len(depth) else lists

    def assign(self, vec: np.ndarray) -> np.ndarray:
        return (_unit(vec) @ self.rotation @ self.centres.T).argmax(axis=1)

    def probe(self, vec: np.ndarray, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """Lists of each query, nearest first: ``probes`` of them, more while
        they hold fewer than ``least`` vectors."""
        order = np.argsort(-(_unit(vec) @ self.rotation @ self.centres.T), axis=1)
        held = np.cumsum(sizes[order], axis=1)
        n = np.maximum(self.probes, np.minimum((held < least).sum(axis=1) + 1, order.shape[1]))
        return [o[:m].astype(np.int32) for o, m in zip(order, n)]


def scan(q: np.ndarray, x: np.ndarray, same: np.ndarray, k: int, columns: int = COLUMNS, epsilon: float = EPSILON):
    """(query row, candidate row) pairs that survive the adaptive scan of
    rotated unit vectors; ``same`` marks pairs to leave out.  The k best by
    partial distance set each query's first threshold."""
    dim = q.shape[1]
    part = np.zeros((len(q), len(x)))
    m = min(columns, dim)
    square = lambda a, b: (
        (q[:, a:b] ** 2).sum(1)[:, None] + (x[:, a:b] ** 2).sum(1)[None] - 2 * q[:, a:b] @ x[:, a:b].T)
    part += square(0, m)
    part[same] = np.inf
    kk = min(k, len(x))
    lead = np.argpartition(part, kk - 1, axis=1)[:, :kk]
    rows = np.arange(len(q))[:, None]
    whole = ((q[:, None, :] - x[lead]) ** 2).sum(axis=2)
    whole[~np.isfinite(part[rows, lead])] = np.inf
    tau = whole.max(axis=1) + 1e-9
    alive = part * dim / m <= (1 + epsilon / np.sqrt(m)) ** 2 * tau[:, None]
    alive[rows, lead] |= np.isfinite(part[rows, lead])
    alive &= ~same
    i, j = np.nonzero(alive)
    d = part[i, j]
    while m < dim and len(i):
        to = min(m + columns, dim)
        d = d + ((q[i, m:to] - x[j, m:to]) ** 2).sum(axis=1)
        m = to
        keep = d * dim / m <= (1 + (epsilon / np.sqrt(m) if m < dim else 0)) ** 2 * tau[i] + 1e-9
        i, j, d = i[keep], j[keep], d[keep]
    return i, j


def nearest(df: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
            recall: float = TARGET_RECALL) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``id_col``, ``score``: the ``k``
    nearest rows found of every row for which ``is_query(id)`` holds."""
    src = stored(usable(df, id_col, vec_col), "ann-vectors")
    rows = src.count()
    kind = src.schema["id"].dataType.simpleString()
    schema = f"query_id {kind}, rank int, {id_col} {kind}, score double"
    if rows < 2:
        return df.sparkSession.createDataFrame([], schema)
    u = F.pmod(F.xxhash64(F.lit("ann"), "id"), F.lit(1 << 30)) / float(1 << 30)
    sample = src.where(u < min(1.0, SAMPLE / rows)).select("vec").toArrow()
    if sample.num_rows < 2:
        sample = src.select("vec").limit(SAMPLE).toArrow()
    dim = len(sample.column(0)[0])
    coarse = Coarse(_matrix(sample.column(0), dim), rows, k, recall)

    def assign(batches):
        for b in batches:
            if b.num_rows:
                at = coarse.assign(_matrix(b.column("vec"), dim)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), pa.array(at)],
                                                 names=["id", "vec", "list"])

    placed = stored(src.mapInArrow(assign, f"id {kind}, vec array<double>, list int"), "ann-lists")
    sizes = np.zeros(len(coarse.centres), np.int64)
    for r in placed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():     # at most MAX_LISTS rows
        sizes[r["list"]] = r["n"]

    def probe(batches):
        for b in batches:
            if b.num_rows:
                lists = coarse.probe(_matrix(b.column("vec"), dim), sizes, 4 * k)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("vec"), pa.array(lists, pa.list_(pa.int32()))], names=["id", "vec", "lists"])

    probes = stored(src.where(is_query(F.col("id"))).mapInArrow(
        probe, f"id {kind}, vec array<double>, lists array<int>"), "ann-probes")
    asked = probes.select("id", "vec", F.explode("lists").alias("list"))
    # blocks of each list's vectors and queries
    n_blocks = F.lit(np.maximum(1, -(-sizes // BLOCK)).astype(int).tolist())
    counts = np.zeros(len(sizes), np.int64)
    for r in asked.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():      # at most MAX_LISTS rows
        counts[r["list"]] = r["n"]
    n_asks = F.lit(np.maximum(1, -(-counts // QUERY_BLOCK)).astype(int).tolist())
    blocks, asks = F.get(n_blocks, F.col("list")), F.get(n_asks, F.col("list"))
    left = (asked.withColumn("ask", F.pmod(F.xxhash64("id"), asks).cast("int"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))))
    right = (placed.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
             .withColumn("ask", F.explode(F.sequence(F.lit(0), asks - 1))))

    def search(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        empty = pa.table({"q": mine.column("id").slice(0, 0), "id": mine.column("id").slice(0, 0),
                          "score": pa.array([], pa.float64())})
        if mine.num_rows == 0 or theirs.num_rows == 0:
            return empty
        qv, xv = _matrix(mine.column("vec"), dim), _matrix(theirs.column("vec"), dim)
        qid, xid = mine.column("id").to_numpy(), theirs.column("id").to_numpy()
        qu, xu = _unit(qv), _unit(xv)
        qr, xr = qu @ coarse.rotation, xu @ coarse.rotation
        out = []
        for a in range(0, len(qid), 256):
            same = qid[a:a + 256, None] == xid[None]
            i, j = scan(qr[a:a + 256], xr, same, k)
            # cosine of the original vectors
            s = (qv[a + i] * xv[j]).sum(1) / (np.linalg.norm(qv[a + i], axis=1) * np.linalg.norm(xv[j], axis=1))
            # overflow or underflow of the plain form: the scaled vectors
            odd = ~np.isfinite(s)
            s[odd] = (qu[a + i[odd]] * xu[j[odd]]).sum(1)
            order = np.lexsort((xid[j], -s, i))
            i, j, s = i[order], j[order], s[order]
            first = np.searchsorted(i, i)
            top = np.arange(len(i)) - first < k
            out.append((a + i[top], j[top], s[top]))
        i, j, s = (np.concatenate(c) for c in zip(*out))
        return pa.table({"q": mine.column("id").take(pa.array(i)), "id": theirs.column("id").take(pa.array(j)),
                         "score": pa.array(s)})

    unit = ["list", "block", "ask"]
    found = left.groupBy(*unit).cogroup(right.groupBy(*unit)).applyInArrow(
        search, f"q {kind}, id {kind}, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.col("id"))
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select(F.col("q").alias("query_id"), "rank", F.col("id").alias(id_col), "score"))
