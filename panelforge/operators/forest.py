"""Random forests whose chance belongs to the rows and the nodes.

Spark ML draws a forest's bootstrap by partition, so its trees change with the
layout and the number of cores.  Here a row's weight in a tree is a Poisson
draw from a hash of (row key, tree), and a node's features are drawn from a
hash of (tree, path of the node).  Sums of the target are whole numbers (fixed
point), so they do not depend on the order of addition.  A forest is therefore
the same on any layout, and forests are nested: the first n trees, cut at depth
d, are the forest of n trees and depth d.  A grid over numbers of trees and
depths needs one growth per number of bins and fold.

Growth is level by level, one job for all trees: every partition routes its
rows through the trees so far and adds up (weight, target) by node, feature
and bin; the partial histograms of a tree meet in one group, whose size is
bounded by the model (open nodes x features x bins) and not by the data; the
best splits, one row per split, make the next level on the driver, as Spark
ML does.  Rows are read once per level and never shuffled.

Rows with a NULL feature, label or key take no part.  Equal gains go to the
feature drawn first and the smallest cut.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE_SAMPLE = 20_000          # rows, by key hash, whose quantiles give the bin edges
CHUNK_ROWS = 100_000          # rows that a task routes through a tree at once
DENSE = 16                    # a table of sums may have this many places per entry, else entries are sorted
LEAF = (1 << 16) - 1          # cut of a leaf: no bin is beyond it
LEAST_GAIN = 1e-9             # of a node's own term; below it a gain is rounding
_POISSON = np.cumsum([np.exp(-1.0) / float(np.prod(range(1, k + 1))) for k in range(13)])
# weight by the first 16 bits of a draw, -1 where a bound lies among the draws of those bits
_BITS = np.arange((1 << 16) + 1) / float(1 << 16)
_WEIGHT = np.searchsorted(_POISSON, _BITS[:-1], side="right")
_WEIGHT = np.where(np.searchsorted(_POISSON, _BITS[1:], side="left") == _WEIGHT, _WEIGHT, -1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit."""
    with np.errstate(over="ignore"):
        x = np.asarray(x).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        # in place: a new array per step costs more than the step
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return x


def row_weights(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Poisson(1) weight of every row in a tree."""
    salt = mix(mix(np.uint64(seed)) ^ np.uint64(tree))
    draw = mix(key ^ salt)
    w = _WEIGHT.take((draw >> np.uint64(48)).view(np.int64))
    near = np.flatnonzero(w < 0)
    if len(near):
        u = (draw[near] >> np.uint64(11)).astype(np.float64) / float(1 << 53)
        w[near] = np.searchsorted(_POISSON, u, side="right")
    return w


def drawn_features(tree: np.ndarray, path: np.ndarray, features: int, m: int, seed: int) -> np.ndarray:
    """``m`` features per node, drawn without replacement."""
    salt = mix(mix(np.uint64(seed) ^ np.uint64(1 << 40)) ^ tree.astype(np.uint64)) ^ path.astype(np.uint64)
    rank = mix(mix(salt)[:, None] ^ np.arange(features, dtype=np.uint64)[None])
    return np.argsort(rank, axis=1, kind="stable")[:, :m].astype(np.int32)


@dataclass
class Forest:
    """Trees as arrays over nodes; ``child`` is the left child (the right one
    follows it), -1 at a leaf; the first ``trees`` nodes are the roots."""

    trees: int
    edges: list                                   # per feature, ascending; bin = edges below the value
    scale: float                                  # fixed point of the target
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    cut: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    child: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    gain: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def codes(self, columns: list[np.ndarray]) -> np.ndarray:
        """Bins of a batch's rows, one column per feature."""
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, columns)], axis=1)

    def ways(self) -> np.ndarray:
        """Per node the next one on the left (at a leaf the leaf), its feature
        and its cut, in one number."""
        inner = self.child >= 0
        left = np.where(inner, self.child, np.arange(len(self.child))).astype(np.int64)
        return left << 32 | self.feature.astype(np.int64) << 16 | np.where(inner, self.cut, LEAF)

    @staticmethod
    def step(ways: np.ndarray, node: np.ndarray, codes: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Nodes one level further down; leaves stay.  ``codes`` are flat,
        ``start`` is where a row's codes begin."""
        way = ways.take(node)
        return (way >> 32) + (codes.take(start + (way >> 16 & LEAF)) > (way & LEAF))

    def predictions(self, codes: np.ndarray, depths: list[int]):
        """Per tree, the value of every row at each depth limit."""
        start, ways, flat = np.arange(len(codes)) * codes.shape[1], self.ways(), codes.reshape(-1)
        for t in range(self.trees):
            node, at, out = np.full(len(codes), t, np.int64), 0, {}
            for d in sorted(set(depths)):
                for _ in range(d - at):
                    node = self.step(ways, node, flat, start)
                at = d
                out[d] = self.value[node]
            yield out

    def importances(self) -> np.ndarray:
        """Share of every feature in the gains, per tree and then over trees."""
        root = np.full(len(self.child), -1)
        root[:self.trees] = np.arange(self.trees)
        inner = np.flatnonzero(self.child >= 0)
        for n in inner:                            # parents come before children
            root[self.child[n]] = root[self.child[n] + 1] = root[n]
        by_tree = np.zeros((self.trees, len(self.edges)))
        np.add.at(by_tree, (root[inner], self.feature[inner]), self.gain[inner])
        total = by_tree.sum(axis=1, keepdims=True)
        mean = np.divide(by_tree, total, out=np.zeros_like(by_tree), where=total > 0).sum(axis=0)
        return mean / mean.sum() if mean.sum() else mean


def prepared(df: DataFrame, features: list[str], label: str, keys: list[str], extra: tuple = ()) -> DataFrame:
    """``key`` (hash of the keys), ``y``, ``f_0 ..`` and the columns ``extra``
    of the rows that take part."""
    cols = [F.col(c).cast("double").alias(f"f_{i}") for i, c in enumerate(features)]
    out = df.na.drop("any", subset=[*features, label, *keys]).select(
        F.xxhash64(*keys).alias("key"), F.col(label).cast("double").alias("y"), *cols, *extra)
    return out


def bin_edges(data: DataFrame, rows: int, n_features: int, bins: int) -> list[np.ndarray]:
    """Cuts per feature: between all neighbours of at most ``bins`` values,
    else quantiles.  Taken from ``EDGE_SAMPLE`` rows chosen by key hash."""
    u = F.pmod(F.xxhash64(F.lit("edges"), "key"), F.lit(1 << 30)) / float(1 << 30)
    sample = data.where(u < min(1.0, EDGE_SAMPLE / max(rows, 1))).select(*[f"f_{i}" for i in range(n_features)]).toArrow()
    return [edges_of(sample.column(i).to_numpy(), bins) for i in range(n_features)]


def edges_of(values: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between all neighbours of at most ``bins`` values, else quantiles."""
    x = np.sort(values)
    values = np.unique(x)
    if len(values) > bins:
        return np.unique(x[(np.arange(1, bins) * len(x)) // bins])
    return (values[1:] + values[:-1]) / 2


def chunks(batches):
    """Columns of the rows of several batches together."""
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= CHUNK_ROWS:
            yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]
            held, rows = [], 0
    if held:
        yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]


class Sums:
    """Sums by key, keys ascending; whole numbers throughout, weights above 0.
    Keys that are close together are counted in a table that is kept for the
    next call, others are sorted."""

    def __init__(self):
        self.w = self.s = np.zeros(0, np.int64)

    def __call__(self, key: np.ndarray, w: np.ndarray, s: np.ndarray):
        if not len(key):
            return key, w, s
        places = int(key.max()) + 1
        if places > DENSE * len(key):
            order = np.argsort(key)
            key = key[order]
            last = np.flatnonzero(np.concatenate([key[1:] != key[:-1], [True]]))
            return key[last], *(np.diff(np.cumsum(x[order])[last], prepend=0) for x in (w, s))
        if places > len(self.w):
            self.w, self.s = np.zeros(places, np.int64), np.zeros(places, np.int64)
        np.add.at(self.w, key, w)
        np.add.at(self.s, key, s)
        key = np.flatnonzero(self.w[:places])
        out = key, self.w[key], self.s[key]
        self.w[key] = self.s[key] = 0
        return out


def square_gains(left_w, left_s, right_w, right_s, total_w, total_s) -> np.ndarray:
    """What a cut takes off the sum of squares; -1 where there is none."""
    own = total_s.astype(float) ** 2 / total_w
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_s.astype(float) ** 2 / left_w + right_s.astype(float) ** 2 / right_w - own
    gain[(right_w <= 0) | ~(gain > LEAST_GAIN * (own + 1))] = -1.0
    return gain


def best_splits(key: np.ndarray, w: np.ndarray, s: np.ndarray, m: int, bins: int, gains=square_gains):
    """Of every node with a split: its number, the place of the drawn feature, the cut,
    the gain, and (weight, sum) of the left side and of the node."""
    run = key // bins
    start = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    length = np.diff(np.append(start, len(key)))
    cw, cs = np.cumsum(w), np.cumsum(s)
    base_w, base_s = np.repeat(cw[start] - w[start], length), np.repeat(cs[start] - s[start], length)
    left_w, left_s = cw - base_w, cs - base_s
    end = start + length - 1
    total_w = np.repeat(left_w[end], length)
    total_s = np.repeat(left_s[end], length)
    gain = gains(left_w, left_s, total_w - left_w, total_s - left_s, total_w, total_s)
    node = run // m
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    top = np.maximum.reduceat(gain, first)
    hit = np.flatnonzero(gain == np.repeat(top, np.diff(np.append(first, len(key)))))
    # first place of the best gain of each node
    hit = hit[np.concatenate([[True], node[hit][1:] != node[hit][:-1]])]
    hit = hit[gain[hit] > 0]
    return (node[hit], run[hit] % m, key[hit] % bins, gain[hit], left_w[hit], left_s[hit], total_w[hit], total_s[hit])


_SPLITS = ["tree", "open", "place", "cut", "gain", "left_w", "left_s", "w", "s"]


def grow(data: DataFrame, n_features: int, trees: int, depth: int, bins: int, seed: int,
         edges: list[np.ndarray], scale: float, per_node: int | None = None) -> Forest:
    """The forest of ``trees`` trees down to ``depth`` over the rows of
    ``data`` (see ``prepared``); ``per_node`` features a node, a third if not given."""
    spark = data.sparkSession
    m = per_node or -(-n_features // 3)
    forest = Forest(trees, edges, scale, np.zeros(trees, np.int32), np.zeros(trees, np.int32),
                    np.full(trees, -1, np.int32), np.zeros(trees), np.zeros(trees))
    path, tree_of = np.ones(trees, np.int64), np.arange(trees)
    open_nodes = np.arange(trees)
    for level in range(depth):
        drawn = drawn_features(tree_of[open_nodes], path[open_nodes], n_features, m, seed)
        number = np.full(len(forest.child), -1, np.int32)       # of the open nodes within their tree
        order = np.argsort(tree_of[open_nodes], kind="stable")
        open_nodes, drawn = open_nodes[order], drawn[order]
        first = np.searchsorted(tree_of[open_nodes], np.arange(trees + 1))
        number[open_nodes] = np.arange(len(open_nodes)) - first[tree_of[open_nodes]]
        # plain arrays: executors need no copy of this class
        shared = spark.sparkContext.broadcast((forest.ways(), number, first, drawn))

        def count(batches, shared=shared, level=level):
            ways, number, first, drawn = shared.value
            binned, sums, parts = Forest(trees, edges, scale), Sums(), {}
            for columns in chunks(batches):
                key, y = columns[0].view(np.uint64), np.rint(columns[1] * scale).astype(np.int64)
                codes = binned.codes(columns[2:]).reshape(-1)
                for t in range(trees):
                    if first[t] == first[t + 1]:
                        continue
                    w = row_weights(key, t, seed)
                    row = np.flatnonzero(w)
                    node, start = np.full(len(row), t, np.int64), row * n_features
                    for _ in range(level):
                        node = Forest.step(ways, node, codes, start)
                    at = number.take(node).astype(np.int64)
                    live = np.flatnonzero(at >= 0)
                    at, start, row = at[live], start[live], row[live]
                    w = w[row]
                    chosen, place = drawn.take(first[t] + at, axis=0), at * m
                    k = np.concatenate([(place + j) * bins + codes.take(start + chosen[:, j]) for j in range(m)])
                    parts.setdefault(t, []).append(sums(k, np.tile(w, m), np.tile(w * y[row], m)))
            for t, held in parts.items():
                k, w, s = held[0] if len(held) == 1 else sums(*(np.concatenate(x) for x in zip(*held)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t], pa.int32()), *[pa.array([x.astype(np.int64).tobytes()], pa.large_binary()).cast(pa.binary())
                                                  for x in (k, w, s)]], names=["tree", "k", "w", "s"])

        def choose(table: pa.Table) -> pa.Table:
            k, w, s = Sums()(*(np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("k", "w", "s")))
            got = best_splits(k, w, s, m, bins) if len(k) else [np.zeros(0)] * 8
            t = table.column("tree")[0].as_py()
            kinds = [pa.int64()] * 3 + [pa.float64()] + [pa.int64()] * 4
            return pa.table([pa.array(np.full(len(got[0]), t), pa.int32()), *[pa.array(x, kind) for x, kind in zip(got, kinds)]],
                            names=_SPLITS)

        partial = data.select("key", "y", *[f"f_{i}" for i in range(n_features)]).mapInArrow(
            count, "tree int, k binary, w binary, s binary")
        found = partial.groupBy("tree").applyInArrow(
            choose, "tree int, open bigint, place bigint, cut bigint, gain double, left_w bigint, left_s bigint, "
                    "w bigint, s bigint").toArrow().sort_by([("tree", "ascending"), ("open", "ascending")])
        shared.unpersist()
        t, at, place, cut, gain, lw, ls, w, s = (found.column(c).to_numpy() for c in _SPLITS)
        if not len(t):
            break
        parent = open_nodes[first[t] + at]
        if level == 0:
            forest.value[parent] = s / w / scale
        left = len(forest.child) + 2 * np.arange(len(parent))
        forest.feature[parent] = drawn[first[t] + at, place]
        forest.cut[parent], forest.child[parent], forest.gain[parent] = cut, left, gain
        grown = lambda a, new: np.concatenate([a, np.stack(new, axis=1).reshape(-1).astype(a.dtype)])
        none = np.zeros(len(parent))
        forest.value = grown(forest.value, (ls / lw / scale, (s - ls) / (w - lw) / scale))
        forest.feature, forest.cut = grown(forest.feature, (none, none)), grown(forest.cut, (none, none))
        forest.gain, forest.child = grown(forest.gain, (none, none)), grown(forest.child, (none - 1, none - 1))
        path = grown(path, (2 * path[parent], 2 * path[parent] + 1))
        tree_of = grown(tree_of, (tree_of[parent],) * 2)
        # a side of one row cannot be split
        open_nodes = np.stack([left, left + 1], axis=1).reshape(-1)[np.stack([lw, w - lw], axis=1).reshape(-1) > 1]
    return forest


def target_scale(data: DataFrame, trees_weight: int = 13) -> tuple[int, float, float]:
    """Rows, mean target, and the power of two that keeps every weighted sum of
    fixed-point targets within 62 bits."""
    r = data.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("y")).alias("top"), F.avg("y").alias("mean")).first()
    return r["n"], r["mean"] or 0.0, fixed_point(r["n"], r["top"], trees_weight)


def fixed_point(rows: int, top: float | None, trees_weight: int = 13) -> float:
    most = max(rows, 1) * max(top or 0.0, 1e-300) * trees_weight
    return 2.0 ** int(np.clip(62 - np.ceil(np.log2(most)), -60, 60))


def fit_forest(data: DataFrame, n_features: int, trees: int, depth: int, bins: int, seed: int,
               edges: list[np.ndarray] | None = None, per_node: int | None = None) -> Forest:
    """A forest over ``data`` (see ``prepared``); bin edges from the same rows
    unless given.  Without rows it predicts 0, without splits the mean."""
    rows, mean, scale = target_scale(data)
    edges = edges or bin_edges(data, rows, n_features, bins)
    forest = grow(data, n_features, trees, depth, bins, seed, edges, scale, per_node)
    bare = np.flatnonzero(forest.child[:trees] < 0)
    forest.value[bare] = mean
    return forest


def squared_errors(data: DataFrame, forest: Forest, depths: list[int], counts: list[int]) -> dict:
    """(depth, number of trees) -> mean squared error over ``data``, all from
    one pass: running means of the trees' values at each depth."""
    shared = data.sparkSession.sparkContext.broadcast(vars(forest))
    n = len(forest.edges)

    def run(batches):
        forest = Forest(**shared.value)
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            codes, y = forest.codes(cols[2:]), cols[1]
            total, out = {d: np.zeros(len(y)) for d in depths}, []
            for t, values in enumerate(forest.predictions(codes, depths), 1):
                for d in depths:
                    total[d] += values[d]
                    if t in counts:
                        out.append((d, t, float(((total[d] / t - y) ** 2).sum()), len(y)))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("depth", "trees", "sse", "n"), o)) for o in out],
                pa.schema([("depth", pa.int32()), ("trees", pa.int32()), ("sse", pa.float64()), ("n", pa.int64())]))

    part = data.select("key", "y", *[f"f_{i}" for i in range(n)]).mapInArrow(run, "depth int, trees int, sse double, n bigint")
    got = part.groupBy("depth", "trees").agg((F.sum("sse") / F.sum("n")).alias("mse")).collect()
    shared.unpersist()
    return {(r["depth"], r["trees"]): r["mse"] for r in got}


# executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
