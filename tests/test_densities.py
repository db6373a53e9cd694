"""Weighted and Gaussian densities against direct sums."""

import warnings

import numpy as np
import pytest

from framelens.operators import amino


def direct(x, w, bins, kernel):
    """All distances from kernels summed frame by frame."""
    z = amino.normalised(x.T)
    n = w.sum() ** 2 / (w**2).sum()
    h = amino.bandwidth(n, kernel)
    grids = [np.linspace(t.min(), t.max(), bins) for t in z]
    out = {}
    for i in range(len(z)):
        for j in range(i, len(z)):
            p = np.zeros((bins, bins))
            for a, b, weight in zip(z[i], z[j], w, strict=True):
                d = ((grids[i] - a)[:, None] / h) ** 2 + ((grids[j] - b)[None, :] / h) ** 2
                p += weight * (np.maximum(0, 1 - d) if kernel == "epanechnikov" else np.exp(-0.5 * d))
            out[i, j] = amino.information_distance(p / p.sum())
    return out


@pytest.mark.parametrize("kernel", ["epanechnikov", "gaussian"])
@pytest.mark.parametrize("small", [False, True])
def test_densities(spark, monkeypatch, kernel, small):
    if small:
        monkeypatch.setattr(amino, "TILE", 20)
        monkeypatch.setattr(amino, "CELLS", 100)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(70, 5))
    x[:, 1] = x[:, 0] + 0.2 * x[:, 1]
    x[:, 4] = 3.0
    w = rng.random(70) + 0.1
    rows = [(v, float(k)) for v, k in zip(x.tolist(), w, strict=True)] + [(x[0].tolist(), None), (x[1].tolist(), 0.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "features array<double>, weight double").repartition(4)
    pairs, count = amino.frame_distances(df, bins=9, kernel=kernel, weights="weight")
    want = direct(x, w, 9, kernel)
    got = {(r["i"], r["j"]): r["distance"] for r in pairs.collect()}
    assert count == 5 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    even, _ = amino.frame_distances(df.where("weight > 0"), bins=9, kernel=kernel)
    plain = direct(x, np.ones(70), 9, kernel)
    assert all(abs(r["distance"] - plain[r["i"], r["j"]]) < 1e-9 for r in even.collect())


def test_what_is_asked_for_is_done_or_refused(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 1.0],), ([2.0, 2.0],)], "features array<double>")
    assert amino.frame_distances(df, bins=60)[0].count() == 3
    for options in ({"bins": 5000}, {"bins": 0}, {"kernel": "box"}):
        with pytest.raises(ValueError):
            amino.frame_distances(df, **options)
    assert amino.frame_distances(df.where("false"), kernel="gaussian") == (None, 0)


def test_distortions_fall_and_restless_medoids_are_reported(monkeypatch):
    rng = np.random.default_rng(2)
    at = rng.random((12, 2)) + np.repeat([[0, 0], [9, 0], [0, 9]], 4, axis=0)
    d = np.linalg.norm(at[:, None] - at[None], axis=2)
    found = amino.distortions(d, 5)
    assert [k for k, _, _ in found] == [1, 2, 3, 4, 5] and all(len(c) == k for k, _, c in found)
    assert {c // 4 for c in found[2][2]} == {0, 1, 2} and found[2][1] < found[1][1]
    monkeypatch.setattr(amino, "ROUNDS", 0)
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        amino.medoids(d, [0, 1])
    assert "still move" in str(told[0].message)
