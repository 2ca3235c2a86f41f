"""Trees grown over cells instead of rows.

A tree sees a row only through the bins of its features: rows of equal bins go
to the same node of every tree, and a split needs their count and the sum of
their targets alone.  ``count_cells`` adds the rows up by the bins of all edge
sets of a grid at once (the intervals between the union of the edges), in one
pass; the trees of all maps then grow over these cells, one sequence or a few
trees to a task.  Nothing is lost: sums are exact, and squared errors follow
from count, mean and sum of squares around the mean of a cell.

How many cells there are depends on the edges and on how many combinations of
bins occur, not on the number of rows; a table with more than ``CELLS`` of them
is left to the growth over rows (the callers fall back on it).

The rows' bootstrap belongs to rows, not cells: ``bootstrap_sums`` draws every
row's weight in every tree once, for all numbers of bins and folds together.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import forest as fo

CELLS = 1_500_000             # entries (cell and part) that are kept on the driver and in a task
SUM_BYTES = 1 << 26           # of a task's bootstrap sums
DRAW_ROWS = 1 << 15           # whose weights in a tree are drawn at once: they stay in the processor's cache
EXAMPLES_FOR_SPLITS = 10_000  # rows, at least, from which Spark ML takes thresholds
_PLACE = np.uint64(0x5851F42D4C957F2D)


def cell_keys(codes: np.ndarray) -> np.ndarray:
    """One number per row of ``codes``."""
    key = np.zeros(len(codes), np.uint64)
    for f in range(codes.shape[1]):
        key = fo.mix(key ^ codes[:, f].astype(np.uint64))
    return key


@dataclass
class Cells:
    """Cells by ascending ``key``: ``codes`` (intervals between ``unions``), and by
    part of the rows (``parts``) their number, mean and sum of squares around it."""

    unions: list
    edges: dict
    key: np.ndarray
    codes: np.ndarray
    parts: list
    n: np.ndarray
    mean: np.ndarray
    m2: np.ndarray

    def binned(self, name) -> tuple[np.ndarray, np.ndarray]:
        """Distinct bins under the edges ``name``, and each cell's place among them."""
        bins = np.empty(self.codes.shape, np.int64)
        for f, (union, edges) in enumerate(zip(self.unions, self.edges[name])):
            bins[:, f] = np.append(np.searchsorted(edges, union, side="left"), len(edges))[self.codes[:, f]]
        place, span = np.zeros(len(bins), np.int64), 1
        for f in range(bins.shape[1]):
            size = len(self.edges[name][f]) + 1
            if span * size >= 1 << 62:
                place = np.unique(place, return_inverse=True)[1]
                span = len(place)
            place, span = place * size + bins[:, f], span * size
        _, first, inverse = np.unique(place, return_index=True, return_inverse=True)
        return bins[first], inverse

    def stats(self, parts, inverse: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number, mean and sum of squares around it of the rows of ``parts`` in
        each of ``size`` groups of cells."""
        at = [i for i, p in enumerate(self.parts) if p in parts]
        n, mean, m2 = (np.concatenate([a[i] for i in at] or [np.zeros(0)]) for a in (self.n, self.mean, self.m2))
        group = np.tile(inverse, len(at))
        count = np.bincount(group, n, size)
        middle = np.divide(np.bincount(group, n * mean, size), count, out=np.zeros(size), where=count > 0)
        return count, middle, np.bincount(group, m2 + n * (mean - middle[group]) ** 2, size)


def count_cells(data: DataFrame, edges: dict) -> Cells | None:
    """The cells of ``data`` (``part``, ``y``, ``f_0 ..``) under all sets of
    ``edges`` (name -> edges per feature); None if there are too many."""
    d = len(next(iter(edges.values())))
    unions = [np.unique(np.concatenate([e[f] for e in edges.values()])) for f in range(d)]
    names = [f"c_{f}" for f in range(d)]

    def code(batches):
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns[2:]]
            codes = [pa.array(np.searchsorted(u, c, side="left").astype(np.int32)) for u, c in zip(unions, columns)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *codes], names=["part", "y", *names])

    coded = data.select(F.col("part").cast("int"), "y", *[f"f_{f}" for f in range(d)]).mapInArrow(
        code, "part int, y double, " + ", ".join(f"{c} int" for c in names))
    found = coded.groupBy("part", *names).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"),
        (F.var_pop("y") * F.count(F.lit(1))).alias("m2")).limit(CELLS + 1).toArrow()
    if not 0 < found.num_rows <= CELLS:
        return None
    codes = np.stack([found.column(c).to_numpy() for c in names], axis=1)
    key, first, cell = np.unique(cell_keys(codes), return_index=True, return_inverse=True)
    if (codes != codes[first][cell]).any():       # two cells of one key
        return None
    part = found.column("part").to_numpy()
    parts = np.unique(part).tolist()
    stats = []
    for c in ("n", "mean", "m2"):
        values = np.zeros((len(parts), len(key)))
        values[np.searchsorted(parts, part), cell] = found.column(c).to_numpy()
        stats.append(values)
    return Cells(unions, edges, key, codes[first].astype(np.int32), parts, *stats)


# ------------------------------------------------------------ boosted trees
def sampled(data: DataFrame, rows: int, least: int, seed: int) -> DataFrame:
    """The rows that Spark ML's trees would take their thresholds from."""
    fraction = least / rows if least < rows else 1.0
    spark, jvm = data.sparkSession, SparkContext._active_spark_context._jvm
    start = jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    drawn = data._jdf.toJavaRDD().sample(False, fraction, start)
    return DataFrame(spark._jsparkSession.createDataFrame(drawn, data._jdf.schema()), spark)


def thresholds(values: np.ndarray, rows: int, least: int, bins: int) -> np.ndarray:
    """Spark ML's thresholds of one feature, from the values of ``sampled``."""
    kept = values[values != 0]
    found, counts = np.unique(kept, return_counts=True)
    expected = (least / rows if least < rows else 1.0) * rows
    if not len(found):
        return np.zeros(0)
    if expected - len(kept) > np.finfo(float).eps * len(kept) * 100:
        at = np.searchsorted(found, 0.0)
        found, counts = np.insert(found, at, 0.0), np.insert(counts.astype(float), at, expected - len(kept))
    middle, splits = (found[:-1] + found[1:]) / 2, min(bins, rows) - 1
    if len(middle) <= splits:
        return middle
    out, stride, total = [], expected / (splits + 1), float(counts[0])
    target = stride
    for i in range(1, len(found)):
        before, total = total, total + float(counts[i])
        if abs(before - target) < abs(total - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


def spark_edges(data: DataFrame, rows: int, n_features: int, bins: tuple, seed: int) -> dict:
    """Number of bins -> thresholds per feature that Spark ML's trees would use
    over ``data`` (``f_0 ..``) of ``rows`` rows."""
    out, drawn = {}, {}
    for b in bins:
        least = max(min(b, rows) ** 2, EXAMPLES_FOR_SPLITS)
        if least not in drawn:
            table = sampled(data.select(*[f"f_{f}" for f in range(n_features)]), rows, least, seed).toArrow()
            drawn[least] = [table.column(f).to_numpy() for f in range(n_features)]
        out[b] = [thresholds(x, rows, least, b) for x in drawn[least]]
    return out


def boosted_tree(codes: np.ndarray, bins: int, n: np.ndarray, target: np.ndarray, depth: int, least: float) -> np.ndarray:
    """Value per cell of one regression tree over cells of ``n`` rows with mean
    ``target``; cells without rows are led along.  A split needs a gain in
    variance of ``least``.  Sums are whole numbers: equal splits tie exactly."""
    d = codes.shape[1]
    most = float((n * np.abs(target)).sum())
    scale = 2.0 ** (60 - np.ceil(np.log2(most))) if most > 0 else 1.0
    s = np.rint(n * target * scale).astype(np.int64)
    w = n.astype(np.int64)
    value = np.full(len(n), s.sum() / w.sum() / scale)
    sums = fo.Sums()

    def gains(left_w, left_s, right_w, right_s, total_w, total_s):
        with np.errstate(divide="ignore", invalid="ignore"):
            gap = (left_s / left_w - right_s / right_w) / scale
            gain = left_w.astype(float) * right_w / total_w.astype(float) ** 2 * gap ** 2
        gain[(right_w <= 0) | ~(gain >= least)] = -1.0
        return gain

    cell, node = np.arange(len(n)), np.zeros(len(n), np.int64)
    for _ in range(depth):
        own = np.flatnonzero(w[cell] > 0)
        live, base = cell[own], node[own] * d
        key = np.concatenate([(base + f) * bins + codes[live, f] for f in range(d)])
        key, kw, ks = sums(key, np.tile(w[live], d), np.tile(s[live], d))
        at, feature, cut, _, lw, ls, tw, ts = fo.best_splits(key, kw, ks, d, bins, gains)
        if not len(at):
            break
        split = np.full(int(node.max()) + 1, -1)
        split[at] = np.arange(len(at))
        of = split[node]
        cell, of = cell[of >= 0], of[of >= 0]
        node = 2 * of + (codes[cell, feature[of]] > cut[of])
        value[cell] = np.stack([ls / lw, (ts - ls) / (tw - lw)], axis=1).reshape(-1)[node] / scale
    return value


def boosted_errors(cells: Cells, name, bins: int, depth: int, rounds: int, step: float, least: float,
                   train: list, valid: list) -> list[float]:
    """Mean squared error over the rows of the parts ``valid`` after each round
    of boosting (squared loss, as Spark ML does it) on those of ``train``."""
    codes, inverse = cells.binned(name)
    n, mean, _ = cells.stats(train, inverse, len(codes))
    vn, vmean, vm2 = cells.stats(valid, inverse, len(codes))
    found, out = np.zeros(len(codes)), []
    for i in range(rounds):
        target = mean if i == 0 else 2 * (mean - found)
        found = found + (step if i else 1.0) * boosted_tree(codes, bins, n, target, depth, least)
        out.append(float((vn @ (found - vmean) ** 2 + vm2.sum()) / vn.sum()) if vn.sum() else float("nan"))
    return out


def boosted_jobs(spark, cells: Cells, jobs: list[tuple], rounds: int, step: float, least: float) -> list[list[float]]:
    """``boosted_errors`` of every job (name, bins, depth, train, valid), one to a task."""
    shared = spark.sparkContext.broadcast((vars(cells), jobs))

    def run(batches):
        held, todo = shared.value
        held = Cells(**held)
        for batch in batches:
            for j in batch.column(0).to_pylist():
                name, bins, depth, train, valid = todo[j]
                yield pa.RecordBatch.from_pylist([{"job": j, "mse": boosted_errors(
                    held, name, bins, depth, rounds, step, least, train, valid)}],
                    pa.schema([("job", pa.int32()), ("mse", pa.list_(pa.float64()))]))

    found = spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(run, "job int, mse array<double>").collect()
    shared.unpersist()
    return [r["mse"] for r in sorted(found, key=lambda r: r["job"])]


# ----------------------------------------------------------------- forests
def forest_edges(data: DataFrame, rows: dict, n_features: int, bins: tuple, sets: dict) -> dict:
    """(set, number of bins) -> edges as ``forest.bin_edges`` takes them from the
    rows of the set's parts, all from one pass; ``rows`` counts them by part."""
    u = F.pmod(F.xxhash64(F.lit("edges"), "key"), F.lit(1 << 30)) / float(1 << 30)
    share = {name: min(1.0, fo.EDGE_SAMPLE / max(sum(rows[p] for p in parts), 1)) for name, parts in sets.items()}
    wanted = F.lit(False)
    for name, parts in sets.items():
        wanted = wanted | (F.col("part").isin(list(parts)) & (u < share[name]))
    table = data.where(wanted).select("part", u.alias("u"), *[f"f_{f}" for f in range(n_features)]).toArrow()
    part, draw = table.column("part").to_numpy(), table.column("u").to_numpy()
    out = {}
    for name, parts in sets.items():
        take = np.isin(part, list(parts)) & (draw < share[name])
        for b in bins:
            out[name, b] = [fo.edges_of(table.column(2 + f).to_numpy()[take], b) for f in range(n_features)]
    return out


def bootstrap_sums(data: DataFrame, cells: Cells, parts: list, trees: int, seed: int, scales: list,
                   block_of: list, cores: int) -> DataFrame:
    """Weight and weighted fixed-point target, at each of ``scales``, of every
    (tree, part, cell), from one draw of each row's weight in each tree: rows
    ``block, tree, start, sums``, of the cells from ``start`` on, all parts after
    each other, the weights before the targets.

    Rows meet by cell: a task has a run of cells with about the same number of
    rows; the rows of a large cell are dealt over several tasks by their key."""
    at = [cells.parts.index(p) for p in parts]
    rows = cells.n[at].sum(axis=0)
    size = rows + rows.sum() / len(rows)          # so a task's cells are bounded as well
    ends = np.cumsum(size)
    wide = 2 * len(rows) * len(parts) * trees * 8 * (1 + len(scales))
    tasks = int(max(2 * cores, -(-wide // SUM_BYTES), -(-rows.sum() // (10 * fo.CHUNK_ROWS))))
    tasks = int(min(tasks, max(1, -(-rows.sum() * trees // fo.CHUNK_ROWS))))
    begin = (ends - size) / ends[-1] * tasks
    finish = ends / ends[-1] * tasks
    first = np.searchsorted(finish, np.arange(tasks) - 1e-6, side="left")
    last = np.searchsorted(begin, np.arange(1, tasks + 1) + 1e-6, side="right")
    n_features = len(cells.unions)
    shared = data.sparkSession.sparkContext.broadcast((cells.unions, cells.key, begin, finish, first, last))

    def place(batches):
        unions, known, begin, finish, *_ = shared.value
        for part, key, y, *columns in fo.chunks(batches):
            codes = np.stack([np.searchsorted(u, c, side="left") for u, c in zip(unions, columns)], axis=1)
            cell = np.searchsorted(known, cell_keys(codes))
            u = (fo.mix(key.view(np.uint64) ^ _PLACE) >> np.uint64(11)).astype(float) / float(1 << 53)
            task = np.minimum(begin[cell] + u * (finish[cell] - begin[cell]), tasks - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(task), pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(key), pa.array(y)],
                names=["task", "cell", "part", "key", "y"])

    def add(batches):
        *_, first, last = shared.value
        held = None
        for task, cell, part, key, y in fo.chunks(batches):
            if held is None:
                start, width = int(first[task[0]]), int(last[task[0]] - first[task[0]])
                held = np.zeros((trees, 1 + len(scales), len(parts) * width), np.int64)
            slot = np.searchsorted(parts, part) * width + cell - start
            order = np.argsort(slot, kind="stable")
            for rows in np.split(order, range(DRAW_ROWS, len(order), DRAW_ROWS)):
                at, k = slot[rows], key[rows].view(np.uint64)
                runs = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                own, fixed = at[runs], [np.rint(y[rows] * scale).astype(np.int64) for scale in scales]
                for t in range(trees):
                    drawn = fo.row_weights(k, t, seed)
                    held[t, 0, own] += np.add.reduceat(drawn, runs)
                    for i, f in enumerate(fixed, 1):
                        held[t, i, own] += np.add.reduceat(drawn * f, runs)
        for t in range(trees if held is not None else 0):
            yield pa.RecordBatch.from_arrays(
                [pa.array([block_of[t]], pa.int32()), pa.array([t], pa.int32()), pa.array([start], pa.int32()),
                 pa.array([held[t].tobytes()], pa.binary())], names=["block", "tree", "start", "sums"])

    placed = data.where(F.col("part").isin(parts)).select("part", "key", "y", *[f"f_{f}" for f in range(n_features)]).mapInArrow(
        place, "task int, cell int, part int, key bigint, y double")
    return (placed.repartitionById(tasks, "task").mapInArrow(add, "block int, tree int, start int, sums binary")
            .checkpoint(eager=True))


def grown_values(codes: np.ndarray, bins: int, w: np.ndarray, s: np.ndarray, tree: int, depths: list, per_node: int,
                 seed: int, scale: float, mean: float, sums) -> dict:
    """Depth -> value per cell of the tree that ``forest.grow`` makes of rows
    with these sums, cut at that depth."""
    d, m = codes.shape[1], per_node
    value, out = np.full(len(codes), mean), {}
    cell, node, path = np.arange(len(codes)), np.zeros(len(codes), np.int64), np.ones(1, np.int64)
    for level in range(max(depths)):
        if level in depths:
            out[level] = value.copy()
        live = np.flatnonzero(w[cell] > 0)
        if not len(live):
            break
        drawn = fo.drawn_features(np.full(len(path), tree), path, d, m, seed)
        own, at = cell[live], node[live]
        chosen = drawn[at]
        key = np.concatenate([(at * m + j) * bins + codes[own, chosen[:, j]] for j in range(m)])
        key, kw, ks = sums(key, np.tile(w[own], m), np.tile(s[own], m))
        at, place, cut, _, lw, ls, tw, ts = fo.best_splits(key, kw, ks, m, bins)
        if not len(at):
            break
        split = np.full(len(path), -1)
        split[at] = np.arange(len(at))
        of = split[node]
        cell, of = cell[of >= 0], of[of >= 0]
        child = 2 * of + (codes[cell, drawn[at, place][of]] > cut[of])
        value[cell] = np.stack([ls / lw / scale, (ts - ls) / (tw - lw) / scale], axis=1).reshape(-1)[child]
        path = np.stack([2 * path[at], 2 * path[at] + 1], axis=1).reshape(-1)
        # a side of one row cannot be split
        going = np.stack([lw, tw - lw], axis=1).reshape(-1) > 1
        number = np.cumsum(going) - 1
        cell, node, path = cell[going[child]], number[child[going[child]]], path[going]
    for depth in depths:
        out.setdefault(depth, value)
    return out


def tree_blocks(counts: list, cores: int) -> list:
    """Number of the block of each tree: some blocks for every core, none of
    which goes beyond one of ``counts``."""
    size = max(1, counts[-1] // (3 * cores))
    out, block = [], -1
    for low, high in zip([0, *counts], counts):
        for t in range(low, high):
            block += (t - low) % size == 0
            out.append(block)
    return out


def forest_errors(sums: DataFrame, cells: Cells, parts: list, jobs: list, depths: list, counts: list, block_of: list,
                  seed: int, scales: list) -> dict:
    """(job, depth, number of trees) -> mean squared error; a job is (edges'
    name, bins, parts to grow on, parts to score, scale, mean target).  A task grows
    a block of trees for all jobs and adds up their values; blocks meet by job and depth."""
    spark, d = sums.sparkSession, len(cells.unions)
    m, blocks = -(-d // 3), block_of[counts[-1] - 1] + 1
    binned = [cells.binned(name) for name, *_ in jobs]
    scored = [cells.stats(job[3], inverse, len(codes)) for (codes, inverse), job in zip(binned, jobs)]
    shared = spark.sparkContext.broadcast((binned, scored, len(cells.key)))

    def grow(batches):
        binned, _, size = shared.value
        held, block = {}, None
        for batch in batches:
            for row in batch.to_pylist():
                block = row["block"]
                if row["tree"] not in held:
                    held[row["tree"]] = np.zeros((1 + len(scales), len(parts), size), np.int64)
                got = np.frombuffer(row["sums"], np.int64).reshape(1 + len(scales), len(parts), -1)
                held[row["tree"]][:, :, row["start"]:row["start"] + got.shape[2]] += got
        table, total = fo.Sums(), {}
        for tree in sorted(held):
            for j, (_, bins, train, _, scale, mean) in enumerate(jobs):
                codes, inverse = binned[j]
                own = np.zeros((2, len(codes)), np.int64)
                for i in (i for i, p in enumerate(parts) if p in train):
                    np.add.at(own[0], inverse, held[tree][0, i])
                    np.add.at(own[1], inverse, held[tree][1 + scales.index(scale), i])
                for depth, value in grown_values(codes, bins, *own, tree, depths, m, seed, scale, mean, table).items():
                    total[j, depth] = total.get((j, depth), 0) + value
        for (j, depth), value in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([j], pa.int32()), pa.array([depth], pa.int32()), pa.array([block], pa.int32()),
                 pa.array([value.tobytes()], pa.binary())], names=["job", "depth", "block", "total"])

    ends = {block_of[c - 1]: c for c in counts}

    def score(table: pa.Table) -> pa.Table:
        j, depth = table.column("job")[0].as_py(), table.column("depth")[0].as_py()
        n, mean, m2 = shared.value[1][j]
        total, out = 0, []
        for row in table.sort_by("block").to_pylist():
            total = total + np.frombuffer(row["total"])
            if row["block"] in ends and n.sum():
                trees = ends[row["block"]]
                out.append((j, depth, trees, float((n @ (total / trees - mean) ** 2 + m2.sum()) / n.sum())))
        return pa.Table.from_pylist([dict(zip(("job", "depth", "trees", "mse"), o)) for o in out], pa.schema(
            [("job", pa.int32()), ("depth", pa.int32()), ("trees", pa.int32()), ("mse", pa.float64())]))

    totals = sums.where(F.col("tree") < counts[-1]).repartitionById(blocks, "block").mapInArrow(
        grow, "job int, depth int, block int, total binary")
    found = totals.groupBy("job", "depth").applyInArrow(score, "job int, depth int, trees int, mse double").collect()
    shared.unpersist()
    return {(r["job"], r["depth"], r["trees"]): r["mse"] for r in found}


def forest_grid_errors(data: DataFrame, n_features: int, bins: tuple, depths: list, counts: list, folds: int,
                       seed: int) -> tuple | None:
    """Forests of all maps on every fold, grown over cells: per fold a dict
    (bins, depth, number of trees) -> mean squared error, and a function from a
    map to the RMSE on the test rows of its forest of all training rows.  None
    without training rows or with too many cells."""
    spark, own = data.sparkSession, [*range(folds)]
    data = data.withColumn("part", F.coalesce("fold", F.lit(-1)))
    got = {r["part"]: r for r in data.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs("y")).alias("top"), F.avg("y").alias("mean")).collect()}
    held = [p for p in own if p in got]
    if not held:
        return None
    rows = {p: got[p]["n"] if p in got else 0 for p in own}
    sets = {f: [p for p in own if p != f] for f in own} | {"all": own}
    total = {name: sum(rows[p] for p in parts) for name, parts in sets.items()}
    means = {name: sum(got[p]["mean"] * rows[p] for p in parts if rows[p]) / max(total[name], 1) for name, parts in sets.items()}
    # as of a growth over the rows of each set
    scale = {name: fo.fixed_point(total[name], max((got[p]["top"] for p in parts if rows[p]), default=0.0))
             for name, parts in sets.items()}
    scales = sorted(set(scale.values()))
    cells = count_cells(data, forest_edges(data, rows, n_features, bins, sets))
    if cells is None:
        return None
    cores = spark.sparkContext.defaultParallelism
    block_of = tree_blocks(counts, cores)
    sums = bootstrap_sums(data, cells, held, counts[-1], seed, scales, block_of, cores)

    def errors(jobs, depths, counts):
        return forest_errors(sums, cells, held, [((name, b), b, sets[name], scored, scale[name], means[name])
                                                 for name, b, scored in jobs], depths, counts, block_of, seed, scales)

    jobs = [(f, b, [f]) for f in own for b in bins]
    mse = [{} for _ in own]
    for (j, depth, n), found in errors(jobs, depths, counts).items():
        mse[jobs[j][0]][jobs[j][1], depth, n] = found

    def holdout(best):
        b, depth, n = best
        found = errors([("all", b, [-1])], [depth], [n])
        return math.sqrt(found[0, depth, n]) if found else None

    return mse, holdout


# executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
