"""Quantiles by selection against numpy."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from framelens.operators import contingency, quantiles
from framelens.operators.moments import min_max_scaled

SHARES = [0.0, 0.2, 0.37, 0.5, 0.99, 1.0]


def frame(spark, columns, parts=3):
    rows = [([None if v is None else float(v) for v in r],) for r in zip(*columns, strict=True)]
    return spark.createDataFrame(rows, "features array<double>").repartition(parts)


def by_numpy(columns):
    out = {}
    for p, c in enumerate(columns):
        x = np.array([v for v in c if v is not None and not np.isnan(v)], float)
        if len(x):
            out[p] = np.quantile(x, SHARES)
    return out


@pytest.mark.parametrize("state", [1 << 22, 100])
def test_quantiles(spark, monkeypatch, state):
    """Skewed, tied, constant, signed-zero, tiny and huge values; few cells take more passes to the same values."""
    monkeypatch.setattr(quantiles, "STATE", state)
    rng = np.random.default_rng(1)
    n = 400
    columns = [
        rng.normal(size=n), np.exp(rng.normal(0, 200, n).clip(-700, 700)), rng.integers(0, 4, n), np.full(n, 7.5), -np.exp(rng.normal(0, 50, n)),
        np.where(rng.random(n) < 0.5, 0.0, -0.0), [None] * n, [None if i % 3 else float("nan") if i % 2 else i for i in range(n)], rng.normal(size=n).astype(np.float32),
        np.nextafter(1.0, 2.0) * rng.integers(0, 2, n) + 1.0, [5e-324 * (i % 3) for i in range(n)],
    ]
    got = {r["pos"]: r["values"] for r in quantiles.quantiles(frame(spark, columns), SHARES).collect()}
    want = by_numpy(columns)
    assert got.keys() == want.keys() and 6 not in got
    for p, v in want.items():
        assert np.allclose(got[p], v, rtol=1e-14, atol=0), p


def test_infinite_values_and_none(spark):
    inf = float("inf")
    got = quantiles.quantiles(frame(spark, [[1.0, -inf, 3.0, inf, inf]]), [0.0, 0.5, 1.0]).first()["values"]
    assert got == [-inf, 3.0, inf]
    assert quantiles.quantiles(spark.createDataFrame([], "features array<double>"), SHARES).count() == 0
    assert quantiles.quantiles(spark.createDataFrame([([],), (None,)], "features array<double>"), SHARES).count() == 0
    ragged = spark.createDataFrame([([1.0, 2.0],), ([3.0],), ([5.0, 8.0, 9.0],)], "features array<double>")
    assert {r["pos"]: r["values"] for r in quantiles.quantiles(ragged, [0.5]).collect()} == {0: [3.0], 1: [5.0], 2: [9.0]}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=64), min_size=1, max_size=30))
def test_order_statistics_of_any_doubles(spark, values):
    ranks = np.arange(len(values))
    same = np.zeros(len(values), int)
    got = quantiles.order_statistics(frame(spark, [values], 2), "features", same, ranks, np.full(len(values), min(values)), np.full(len(values), max(values)))
    assert (got == np.sort(values)).all()


@given(st.lists(st.floats(allow_nan=False), min_size=2, max_size=20))
def test_keys_have_the_order_of_the_doubles(values):
    x = np.array(values) + 0.0
    keys = quantiles.ordered(x)
    assert (quantiles.doubles(keys) == x).all()
    assert (np.sort(x) == x[np.argsort(keys)]).all()


def test_no_list_of_values_in_the_plan(spark):
    rng = np.random.default_rng(2)
    df = frame(spark, rng.normal(size=(30, 50)))
    score = contingency.chi_squared(df.selectExpr("features", "cast(features[0] > 0 as int) as label"), "label")
    plan = score._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_sampled_edges_and_stride(spark):
    rows = [(i, i % 2, [float(i), float(i * i % 17)]) for i in range(100)]
    df = spark.createDataFrame(rows, "frame int, label int, features array<double>")
    edges = {r["pos"]: r["edges"] for r in contingency.quantile_edges(df, 5, sample_rows=11, order=["frame"]).collect()}
    assert edges[0] == [0, 2, 4, 6, 8, 10]
    part = contingency.chi_squared(df, "label", stride=3, key=["label"], order=["frame"])
    kept = [r for label in (0, 1) for r in [x for x in rows if x[1] == label][::3]]
    cuts = {r["pos"]: r["edges"] for r in contingency.quantile_edges(df).collect()}
    want = contingency.binned(contingency.to_long(spark.createDataFrame(kept, df.schema), keep=["label"]), spark.createDataFrame(list(cuts.items()), "pos int, edges array<double>"))
    counts = {}
    for r in want.collect():
        counts[r["pos"], r["bin"], r["label"]] = counts.get((r["pos"], r["bin"], r["label"]), 0) + 1
    for r in part.collect():
        o = np.array([[counts.get((r["pos"], b, k), 0) for k in (0, 1)] for b in range(len(cuts[r["pos"]]) - 1)], float)
        o = o[o.sum(1) > 0]
        e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
        assert np.isclose(r["score"], ((o - e) ** 2 / e).sum())
    assert min_max_scaled(df).count() == 100
