"""Tiles of products, correlations and wide principal components against numpy."""

import numpy as np
import pandas as pd
import pytest

from framelens.operators import grams, reduction, tables
from framelens.plans import pipeline


def table(spark, x, y=None, parts=5):
    nothing = lambda v: None if v is None or np.isnan(v) else float(v)
    rows = [(i, i % 3, [nothing(v) for v in a], [nothing(v) for v in (y[i] if y is not None else [])]) for i, a in enumerate(x)]
    return spark.createDataFrame(rows, "frame int, class int, features array<double>, others array<double>").repartition(parts)


@pytest.mark.parametrize(("tile", "rows"), [(512, 2048), (3, 7)])
@pytest.mark.parametrize("holes", [False, True])
def test_correlations(spark, monkeypatch, tile, rows, holes):
    monkeypatch.setattr(grams, "TILE", tile)
    monkeypatch.setattr(grams, "ROWS", rows)
    rng = np.random.default_rng(3)
    x = rng.normal(1e6, 1, (120, 8))
    x[:, 1], x[:, 2] = 5.0, 2 * x[:, 0] + rng.normal(0, 0.1, 120)
    y = np.c_[x[:, 0] - x[:, 3], rng.normal(0, 1e-6, 120)]
    if holes:
        x[rng.random(x.shape) < 0.2], y[rng.random(y.shape) < 0.2] = np.nan, np.nan
    df = table(spark, x, y)
    want = pd.concat([pd.DataFrame(x, columns=range(8)), pd.DataFrame(y, columns=range(8, 10))], axis=1).corr().fillna(0).to_numpy()
    for r in grams.correlations(df, "features", "others").collect():
        assert abs(r["r"] - want[r["i"], 8 + r["j"]]) < 1e-8
    own = grams.correlations(df, "features").collect()
    assert sorted((r["i"], r["j"]) for r in own) == [(i, j) for i in range(8) for j in range(i + 1, 8)]
    assert all(abs(r["r"] - want[r["i"], r["j"]]) < 1e-8 for r in own)


def test_hundreds_of_pairs_of_columns(spark):
    rng = np.random.default_rng(4)
    wide = spark.createDataFrame(pd.DataFrame(rng.normal(size=(60, 45)), columns=[f"c{i}" for i in range(45)]))
    r = tables.correlations(wide, wide.columns[:40], wide.columns[40:])
    assert r.count() == 200
    want = wide.toPandas().corr()
    assert all(abs(x["r"] - want.loc[x["feature"], x["component"]]) < 1e-9 for x in r.collect())
    top = tables.top_contributions(r, 2).collect()
    assert len(top) == 10


@pytest.mark.parametrize("tile", [512, 5])
def test_tiled_scatter(spark, monkeypatch, tile):
    monkeypatch.setattr(reduction, "TILE", tile)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 12)) @ rng.normal(size=(12, 12))
    df = table(spark, x)
    s = reduction.scatter(df, "class")
    for c in range(3):
        own = x[c::3] - x[c::3].mean(0)
        assert np.allclose(s.scatters[c], own.T @ own)
    words = df.selectExpr("case class when 0 then 'b' when 1 then 'a' end as class", "features")
    named = reduction.scatter(words, "class")
    assert named.classes == ["a", "b"] and np.allclose(named.scatters[1], s.scatters[0])


@pytest.mark.parametrize(("width", "spread"), [(64, 1.0), (64, 0.0), (5, 1.0)])
def test_wide_components_are_those_of_the_covariance(spark, width, spread):
    """Spread-out and equal eigenvalues; to 1e-6 of the dense solver."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, width)) * np.exp(-spread * np.arange(width) / 8) + 100.0
    df = table(spark, x)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    values, vectors = values[::-1], reduction.signed(vectors[:, ::-1])
    got = reduction.fit_wide_pca(df, k=3)
    assert np.allclose(got.values, values[:3], rtol=1e-6) and np.allclose(got.matrix, vectors[:, :3], atol=1e-6)
    dense = reduction.fit_pca(reduction.scatter(df, "class"), 3)
    assert np.allclose(dense.matrix, got.matrix, atol=1e-6)
    most = reduction.fit_wide_pca(df, k=None)
    assert len(most.values) == int(np.searchsorted(np.cumsum(values), 0.95 * values.sum()) + 1)
    white = reduction.fit_wide_pca(df, k=2, whiten=True)(df).toPandas()["proj"]
    assert np.allclose(np.cov(np.stack(white).T), np.eye(2), atol=1e-6)


def test_components_of_more_features_than_a_scatter_may_have(spark, monkeypatch):
    monkeypatch.setattr(reduction, "WIDEST", 50)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 3)) @ rng.normal(size=(3, 700)) + 0.01 * rng.normal(size=(40, 700))
    df = table(spark, x)
    with pytest.raises(ValueError, match="700 features"):
        reduction.scatter(df, "class")
    got = reduction.fit_wide_pca(df, k=3)
    assert np.allclose(got.values, np.linalg.svd(x - x.mean(0), compute_uv=False)[:3] ** 2 / 39)


def test_projection_keeps_nulls(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [3.0, 4.0])], "k int, features array<double>")
    out = {r["k"]: r["proj"] for r in reduction.project(df, np.array([[1.0], [10.0]]), np.array([1.0, 0.0])).collect()}
    assert out == {1: [20.0], 2: None, 3: [42.0]}


def test_sum_over_pairs_of_classes(spark):
    rng = np.random.default_rng(8)
    s = reduction.scatter(table(spark, rng.normal(size=(50, 4))), "class")
    deltas, weights = reduction._pairwise(s)
    assert np.allclose((deltas * weights[:, None]).T @ deltas, s.total * s.between)


def test_mhlda_takes_more_components_than_classes(spark):
    rng = np.random.default_rng(9)
    fit = reduction.fit_mhlda(reduction.scatter(table(spark, rng.normal(size=(90, 6))), "class"), 5)
    assert fit.matrix.shape == (6, 5)
    assert reduction.fit_flda(reduction.scatter(table(spark, rng.normal(size=(90, 6))), "class"), 5).matrix.shape == (6, 2)


def test_biplot(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(80, 6))
    df = table(spark, x)
    out = reduction.project(df, np.eye(6)[:, [4, 1]]).join(df.select("frame", "features"), "frame")
    arrows = {r["pos"]: r for r in pipeline.loadings(out, top=2).collect()}
    assert arrows.keys() == {1, 4}
    assert np.isclose(arrows[4]["arrow"][0], 0.9 * np.abs(x[:, [4, 1]]).max())
    points = pipeline.scatter_points(out, ["class"], ["frame"], "class", stride=20)
    assert points.count() == 6
