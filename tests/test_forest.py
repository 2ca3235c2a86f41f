"""Forests: against a plain recursive grower, nested, and layout-free."""
import numpy as np
import pytest

from panelforge.operators import forest as fo


def rows(n, seed=4):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        a, b, c, d = (float(v) for v in rng.integers(0, 9, 4))
        out.append((i, a, b, c, d, 3 * a - b * b + (a > 4) * c + float(rng.normal())))
    return out


def frame(spark, n=400):
    return spark.createDataFrame(rows(n), "id long, a double, b double, c double, d double, y double")


def plain(key, codes, y, tree, depth, m, bins, seed):
    """One tree by recursion: {path: (weight, sum, feature, cut)}."""
    w = fo.row_weights(key, tree, seed)
    out = {}

    def split(at, path, level):
        tw, ts = int(w[at].sum()), int((w[at] * y[at]).sum())
        best = None
        if level < depth and tw > 1:
            chosen = fo.drawn_features(np.array([tree]), np.array([path]), codes.shape[1], m, seed)[0]
            for f in chosen:
                for cut in range(bins):
                    left = at[codes[at, f] <= cut]
                    lw, ls = int(w[left].sum()), int((w[left] * y[left]).sum())
                    if 0 < lw < tw:
                        own = float(ts) ** 2 / tw
                        gain = float(ls) ** 2 / lw + float(ts - ls) ** 2 / (tw - lw) - own
                        if gain > fo.LEAST_GAIN * (own + 1) and (best is None or gain > best[0] * (1 + 1e-12)):
                            best = gain, f, cut
        out[path] = (tw, ts, *(best[1:] if best else (None, None)))
        if best:
            go = codes[at, best[1]] > best[2]
            split(at[~go], 2 * path, level + 1)
            split(at[go], 2 * path + 1, level + 1)

    split(np.flatnonzero(w), 1, 0)
    return out


def paths(forest, tree):
    """{path: (value, feature, cut)} of a grown tree."""
    out, todo = {}, [(tree, 1)]
    while todo:
        n, p = todo.pop()
        c = forest.child[n]
        out[p] = (forest.value[n], *((forest.feature[n], forest.cut[n]) if c >= 0 else (None, None)))
        if c >= 0:
            todo += [(c, 2 * p), (c + 1, 2 * p + 1)]
    return out


def test_trees_equal_plain_recursion(spark):
    df = frame(spark, 300)
    data = fo.prepared(df, list("abcd"), "y", ["id"]).repartition(3)
    forest = fo.fit_forest(data, 4, 3, 5, 8, seed=9)
    t = data.toArrow()
    codes = forest.codes([t.column(f"f_{i}").to_numpy() for i in range(4)])
    y = np.rint(t.column("y").to_numpy() * forest.scale).astype(np.int64)
    for tree in range(3):
        want = plain(t.column("key").to_numpy().view(np.uint64), codes, y, tree, 5, 2, 8, 9)
        got = paths(forest, tree)
        assert got.keys() == want.keys() and len(got) > 10
        for p, (w, s, f, cut) in want.items():
            assert got[p][0] == pytest.approx(s / w / forest.scale, rel=1e-12)
            if f is not None:
                # a cut may lie anywhere in a gap that the node's rows leave
                assert got[p][1] == f


def same(a, b):
    return all(np.array_equal(getattr(a, c), getattr(b, c)) for c in ("feature", "cut", "child", "value", "gain"))


def test_layout_does_not_matter(spark):
    df = frame(spark)
    fits = [fo.fit_forest(fo.prepared(df.repartition(n), list("abcd"), "y", ["id"]), 4, 5, 6, 16, seed=1) for n in (1, 3, 8)]
    assert same(fits[0], fits[1]) and same(fits[0], fits[2])
    imp = fits[0].importances()
    assert imp.sum() == pytest.approx(1.0) and imp.argmax() in (0, 1)


def test_prefixes_and_cuts_are_the_smaller_forests(spark):
    df = frame(spark)
    data = fo.prepared(df, list("abcd"), "y", ["id"])
    whole = fo.fit_forest(data, 4, 6, 7, 16, seed=2)
    nested = fo.squared_errors(data, whole, [2, 4, 7], [1, 3, 6])
    for (depth, trees), mse in nested.items():
        own = fo.fit_forest(data, 4, trees, depth, 16, seed=2)
        assert fo.squared_errors(data, own, [depth], [trees])[depth, trees] == pytest.approx(mse, rel=1e-12)
        # and the mean of the trees' own predictions
        t = data.toArrow()
        codes = own.codes([t.column(f"f_{i}").to_numpy() for i in range(4)])
        p = np.mean([v[depth] for v in own.predictions(codes, [depth])], axis=0)
        assert ((p - t.column("y").to_numpy()) ** 2).mean() == pytest.approx(mse, rel=1e-9)


def test_edges(spark):
    df = frame(spark, 5)
    schema = df.schema
    nothing = fo.prepared(df.limit(0), list("abcd"), "y", ["id"])
    forest = fo.fit_forest(nothing, 4, 2, 3, 8, seed=1)
    assert len(forest.child) == 2 and fo.squared_errors(nothing, forest, [3], [2]) == {}
    flat = spark.createDataFrame([(i, 1.0, 1.0, 1.0, 1.0, 2.5) for i in range(9)] + [(9, None, 1.0, 1.0, 1.0, 9.0)], schema)
    data = fo.prepared(flat, list("abcd"), "y", ["id"])
    forest = fo.fit_forest(data, 4, 2, 3, 8, seed=1)
    assert data.count() == 9 and fo.squared_errors(data, forest, [0, 3], [1, 2])[3, 2] == pytest.approx(0.0)


def test_sums_close_and_far_keys():
    """The table of sums is left empty for the next call; far keys are sorted."""
    rng, sums = np.random.default_rng(3), fo.Sums()
    for places in (5, 40, 10_000_000, 30):
        key, w, s = rng.integers(0, places, 400), rng.integers(1, 9, 400), rng.integers(-(1 << 50), 1 << 50, 400)
        want = {}
        for k, a, b in zip(key.tolist(), w.tolist(), s.tolist()):
            x = want.get(k, (0, 0))
            want[k] = x[0] + a, x[1] + b
        k, a, b = (x.tolist() for x in sums(key, w, s))
        assert k == sorted(want) and [want[i] for i in k] == list(zip(a, b))
    assert not sums.w.any() and not sums.s.any()


def test_ways_lead_to_children_and_stay_at_leaves():
    f = fo.Forest(1, [np.array([0.5]), np.array([1.5, 2.5])], 1.0, np.array([1, 0, 0, 0, 0], np.int32),
                  np.array([1, 0, 0, 0, 0], np.int32), np.array([1, 3, -1, -1, -1], np.int32))
    codes = np.array([[0, 0], [1, 1], [0, 2]])
    start, node = np.arange(3) * 2, np.zeros(3, np.int64)
    seen = [(node := fo.Forest.step(f.ways(), node, codes.reshape(-1), start)).tolist() for _ in range(3)]
    assert seen == [[1, 1, 2], [3, 4, 2], [3, 4, 2]]
