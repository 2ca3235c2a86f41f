"""Trees grown over cells: against Spark ML and the growth over rows."""
import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from panelforge.operators import cells as cl
from panelforge.operators import ml


def frame(spark, n=600, seed=6):
    rng = np.random.default_rng(seed)
    rows = [(i, float(a), float(b), float(c % 3), float(a * a - 2 * b + c % 3 + rng.normal() / 3))
            for i, (a, b, c) in enumerate(zip(*np.round(rng.normal(size=(2, n)), 1), rng.integers(0, 9, n)))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y double")


def plain_gbt(df, grid, seed=42):
    """(bins, depth, iterations) -> mean RMSE over the folds, from separate fits."""
    data = ml.assemble(ml.split_and_folds(df, ["id"]), ["a", "b", "c"]).where("split = 'train'").checkpoint()
    out = {}
    for b in grid["maxBins"]:
        for d in grid["maxDepth"]:
            for i in grid["maxIter"]:
                rmse = []
                for f in (0, 1):
                    model = GBTRegressor(labelCol="y", featuresCol="features", maxDepth=d, maxBins=b, maxIter=i,
                                         seed=seed, minInfoGain=1e-9).fit(data.where(F.col("fold") != f))
                    rmse.append(model.transform(data.where(F.col("fold") == f)).agg(
                        F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2))).first()[0])
                out[b, d, i] = np.mean(rmse)
    return out


GRID = {"maxDepth": (2, 3), "maxBins": (8, 16), "maxIter": (1, 4)}


def test_boosted_grid_grows_over_cells_as_spark_does_over_rows(spark, monkeypatch):
    df = frame(spark).repartition(3).checkpoint()
    want = plain_gbt(df, GRID)
    monkeypatch.setattr(ml, "GBTRegressor", None)           # no fit over rows
    got = {(r.maxBins, r.maxDepth, r.maxIter): r.avg_rmse for r in
           ml.boosted_grid(df, ["a", "b", "c"], "y", ["id"], GRID).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-9)


def test_boosted_grid_with_too_many_cells_fits_over_rows(spark, monkeypatch):
    df, grid = frame(spark), GRID | {"maxDepth": (2,)}       # without ties, which Spark ML leaves to rounding
    row = lambda: [tuple(r) for r in ml.boosted_grid(df, ["a", "b", "c"], "y", ["id"], grid).collect()]
    cells = row()
    monkeypatch.setattr(cl, "CELLS", 5)
    for a, b in zip(cells, row()):
        assert a == pytest.approx(b, rel=1e-9)


def test_deep_boosted_trees_do_not_depend_on_the_layout(spark):
    df = frame(spark, 500)
    grid = {"maxDepth": (105,), "maxBins": (32,), "maxIter": (1, 3)}
    out = [[tuple(r) for r in ml.boosted_grid(df.repartition(n), ["a", "b", "c"], "y", ["id"], grid).collect()] for n in (1, 4)]
    for a, b in zip(*out):
        assert a == pytest.approx(b, rel=1e-9)


def test_thresholds_are_spark_ones(spark):
    """Also where Spark draws a sample and adds the zeros it expects."""
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b), float(rng.normal())) for a, b in
            zip(rng.integers(1, 60, 25_000), rng.integers(0, 7, 25_000))]
    df = spark.createDataFrame(rows, "f_0 double, f_1 double, y double").repartition(3).checkpoint()
    edges = cl.spark_edges(df, len(rows), 2, (16,), 7)[16]
    model = GBTRegressor(labelCol="y", featuresCol="features", maxDepth=12, maxBins=16, maxIter=1, seed=7).fit(
        ml.assemble(df, ["f_0", "f_1"]))
    import re
    for f in (0, 1):
        used = {float(v) for v in re.findall(rf"feature {f} <= (\S+)\)", model.toDebugString)}
        assert used == set(edges[f].tolist()) and len(used) > 5


def test_cells_hold_every_row(spark):
    df = frame(spark).select(F.pmod("id", F.lit(3)).alias("part"), "y", *[F.col(c).alias(f"f_{i}") for i, c in enumerate("abc")])
    edges = {"few": [np.array([0.0]), np.array([-0.5, 0.5]), np.array([])],
             "more": [np.array([-1.0, 0.2]), np.array([0.1]), np.array([0.5])]}
    cells = cl.count_cells(df, edges)
    rows = df.collect()
    y = np.array([r.y for r in rows])
    assert cells.n.sum() == len(rows)
    for name in edges:
        codes, inverse = cells.binned(name)
        n, mean, m2 = cells.stats([0, 1, 2], inverse, len(codes))
        bins = [tuple(int((np.asarray(e) < v).sum()) for e, v in zip(edges[name], (r.f_0, r.f_1, r.f_2))) for r in rows]
        assert sorted(map(tuple, codes.tolist())) == sorted(set(bins))
        for c, a, b, s in zip(map(tuple, codes.tolist()), n, mean, m2):
            own = y[[x == c for x in bins]]
            assert a == len(own) and b == pytest.approx(own.mean()) and s == pytest.approx(((own - own.mean()) ** 2).sum())


def test_forest_grid_grows_over_cells_as_over_rows(spark, monkeypatch):
    df = frame(spark).repartition(3).checkpoint()
    grid = {"numTrees": (2, 5, 7), "maxDepth": (2, 6), "maxBins": (4, 16)}
    run = lambda: [tuple(r) for r in ml.forest_grid(df, ["a", "b", "c"], "y", ["id"], grid).collect()]
    with monkeypatch.context() as few:
        few.setattr(cl, "CELLS", 5)
        want = run()
    monkeypatch.setattr(cl.fo, "grow", None)                # no growth level by level over rows
    got = run()
    assert len(got) == len(want) == 12 and sum(r[-1] for r in got) == 1
    for a, b in zip(got, want):
        assert a == pytest.approx(b, rel=1e-9)


@pytest.mark.parametrize("n,kinds", [(900, 40), (900, 1)])
def test_bootstrap_sums_are_those_of_the_rows(spark, monkeypatch, n, kinds):
    """With a cell's rows dealt over several tasks too."""
    monkeypatch.setattr(cl.fo, "CHUNK_ROWS", 50)
    rng = np.random.default_rng(2)
    rows = [(int(k), int(p), float(x % kinds), float(y)) for k, p, x, y in
            zip(rng.integers(-(1 << 62), 1 << 62, n), rng.integers(-1, 2, n), rng.integers(0, 99, n), rng.normal(size=n))]
    data = spark.createDataFrame(rows, "key long, part int, f_0 double, y double").repartition(4)
    cells = cl.count_cells(data, {"e": [np.arange(0.5, 50)]})
    scales, trees = [2.0 ** 20, 2.0 ** 30], 3
    found = cl.bootstrap_sums(data, cells, [0, 1], trees, 5, scales, [0, 0, 1], 3).collect()
    got = np.zeros((trees, 3, 2, len(cells.key)), np.int64)
    for r in found:
        assert r.block == [0, 0, 1][r.tree]
        x = np.frombuffer(r.sums, np.int64).reshape(3, 2, -1)
        got[r.tree, :, :, r.start:r.start + x.shape[2]] += x
    want = np.zeros_like(got)
    for t in range(trees):
        for (_, part, x, y), w in zip(rows, cl.fo.row_weights(np.array([r[0] for r in rows]).view(np.uint64), t, 5)):
            c = int(np.flatnonzero((cells.codes[:, 0] == int(x)))[0])
            if part >= 0:
                want[t, :, part, c] += [w, *(w * int(np.rint(y * s)) for s in scales)]
    assert (got == want).all() and len({(r.start, len(r.sums)) for r in found}) >= (2 if kinds > 1 else 1)
    assert len(found) >= 2 * trees                          # several tasks


def test_row_weights_are_poisson_draws_of_the_hash():
    fo, key = cl.fo, np.random.default_rng(3).integers(0, 1 << 63, 300_000).astype(np.uint64)
    draw = fo.mix(key ^ fo.mix(fo.mix(np.uint64(4)) ^ np.uint64(2)))
    u = (draw >> np.uint64(11)).astype(float) / float(1 << 53)
    assert (fo.row_weights(key, 2, 4) == (u[:, None] >= fo._POISSON).sum(axis=1)).all()
