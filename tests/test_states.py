"""Lagged pairs, mixtures from several starts and seeded mini-batches against numpy."""

import warnings

import numpy as np
import pytest

from framelens.operators import clustering as K


def series(spark, sizes, width=3, parts=7, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(name, i, rng.normal(size=width).tolist(), float(i)) for name, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "replica string, frame int, features array<double>, value double").repartition(parts), rows


@pytest.mark.parametrize("block", [50_000, 7])
@pytest.mark.parametrize("lag", [1, 5])
def test_lag_pairs_cross_partitions_and_blocks(spark, block, lag):
    """One trajectory over all tasks, some shorter than the lag, one without a name."""
    sizes = {"a": 90, "b": 3, "c": 1, "d": 40, None: 20, "e": 6}
    df, rows = series(spark, sizes)
    got = K.lag_pairs(df, ["replica"], ["frame"], "value", lag, block)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    want = sorted((float(i), float(i + lag)) for n in sizes.values() for i in range(n - lag))
    assert sorted(map(tuple, got.collect())) == want
    shift, scale = np.zeros(3), np.ones(3)
    c0, ct, n = K.lagged_sums(df, ["replica"], ["frame"], "features", lag, shift, scale, block)
    x = {name: np.array([r[2] for r in rows if r[0] == name]) for name in sizes}
    a, b = (np.vstack(v) for v in zip(*[(v[:-lag], v[lag:]) for v in x.values() if len(v) > lag], strict=True))
    assert n == len(a)
    assert np.allclose(c0, (a.T @ a + b.T @ b) / (2 * n)) and np.allclose(ct, (a.T @ b + b.T @ a) / (2 * n))


def test_lagged_sums_by_tiles(spark, monkeypatch):
    df, _ = series(spark, {"a": 50, "b": 9}, width=8)
    whole = K.lagged_sums(df, ["replica"], ["frame"], "features", 2, np.zeros(8), np.ones(8))
    monkeypatch.setattr(K, "TILE", 3)
    for a, b in zip(whole, K.lagged_sums(df, ["replica"], ["frame"], "features", 2, np.zeros(8), np.ones(8)), strict=True):
        assert np.allclose(a, b)


def blobs(seed, n, k, width, spread):
    rng = np.random.default_rng(seed)
    own = rng.integers(0, k, n)
    return rng.normal(0, spread, (n, width)) + 3 * rng.normal(size=(k, width))[own]


def table(spark, x, parts=4):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "frame int, features array<double>").repartition(parts)


def test_the_best_of_ten_starts(spark):
    """As likely as the best of ten fits by numpy, each to the same tolerance."""
    x = blobs(3, 400, 6, 4, 1.0)
    shift, scale = x.mean(0), x.std(0)
    z = (x - shift) / scale
    local = [K.fit_local(z, 5, 42 + i, 1000, 1e-4) for i in range(10)]
    fits = K.mixtures(table(spark, x), "features", {i: m for i, (m, _) in enumerate(local)}, shift, scale, 1000, 1e-4)
    assert all(done for _, _, done in fits.values())
    best = max(value for _, value, _ in fits.values())
    assert best >= max(value for _, value in local) - 1e-6
    for model, value, _ in fits.values():
        parts = model.log_parts(z)
        assert np.isclose(value, np.log(np.exp(parts).sum(1)).sum())


def test_a_fit_that_has_not_converged_says_so(spark):
    df = table(spark, blobs(4, 120, 3, 2, 2.0))
    with pytest.warns(UserWarning, match="not converged"):
        K.mixture_states(df, ["frame"], max_k=3, stride=1, starts=1, steps=1, tolerance=0.0)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        out, curve = K.mixture_states(df, ["frame"], max_k=3, stride=1, starts=2)
    assert out.where("global_cluster_id is null").count() == 0
    assert {r["converged"] for r in curve.collect()} == {True}


def lloyd(x, k, tries=10):
    return min(K.kmeans(x, k, seed)[1] for seed in range(tries))


@pytest.mark.parametrize("batch_rows", [200_000, 150])
def test_mini_batches_come_near_full_kmeans(spark, batch_rows):
    x = blobs(5, 900, 7, 3, 0.6)
    frames, batches = K.embedded(table(spark, x), ["frame"], "features", lambda v: v, batch_rows)
    assert batches == (1 if batch_rows > 900 else 6) and frames.count() == 900
    fits = K.mini_batch_kmeans(frames, batches, range(2, 9))
    for k, (centres, inertia) in fits.items():
        assert len(centres) == k and np.isclose(inertia, ((x - centres[K.nearest(x, centres)]) ** 2).sum())
        assert inertia <= 1.02 * lloyd(x, k), k


def test_seeds_are_few_spread_out_and_weigh_all_frames(spark):
    x = np.vstack([blobs(6, 300, 2, 2, 0.1), [[50.0, 50.0]], [[-50.0, 50.0]]])
    frames, _ = K.embedded(table(spark, x), ["frame"], "features", lambda v: v)
    candidates, weights = K.seeds(frames, 4, rounds=3)
    assert len(candidates) <= 25 and weights.sum() == 302
    assert {(50.0, 50.0), (-50.0, 50.0)} <= {tuple(c) for c in candidates.tolist()}
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(40)], "frame int, features array<double>")
    one, _ = K.embedded(same, ["frame"], "features", lambda v: v)
    candidates, weights = K.seeds(one, 4)
    assert candidates.tolist() == [[1.0, 2.0]] and weights.tolist() == [40.0]


def test_seeds_from_tasks_without_frames(spark, tmp_path):
    """Splits of a file that hold no row group give tasks no frame: they draw none, and what the others draw is the same."""
    x = np.round(blobs(5, 60, 3, 3, 0.5), 3)
    path = str(tmp_path / "frames")
    spark.createDataFrame([((i + 0.5) / len(x), v) for i, v in enumerate(x.tolist())], "u double, x array<double>").coalesce(1).write.parquet(path)
    found, weights = K.seeds(spark.read.parquet(path), 4)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        split = spark.read.parquet(path)
        assert split.rdd.getNumPartitions() > 1  # the file has one row group
        again, own = K.seeds(split, 4)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert np.array_equal(again, found) and np.array_equal(own, weights) and own.sum() == len(x)
