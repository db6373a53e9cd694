"""The registry of parameters, and class assignment within a run."""

import numpy as np
import pytest

from framelens.operators import amino
from framelens.plans import pipeline
from framelens.plans.parameters import Parameters, flattened, overridden


def test_each_operator_has_its_own_defaults():
    p = Parameters()
    assert (p.fisher_amino.knee_sensitivity, p.chi_sq_amino.knee_sensitivity, p.variance.knee_sensitivity) == (2.0, 5.0, 1.0)
    assert (p.bpso.stride, p.mpso.sampling_stride, p.chi_sq_amino.stride) == (10, 15, 25)
    rows = pipeline.parameter_rows(p)
    assert len(rows) == len({name for name, _, _ in rows}) >= 60 and all(text for _, _, text in rows)
    assert ("bpso.w", "0.729") in {r[:2] for r in rows}


def test_overrides_are_typed():
    p = overridden(Parameters(), {"bpso.w": "0.5", "bpso.candidate_limit": "12", "mpso.candidate_limit": "None", "seed": 7, "gmm.max_k": 4.0})
    assert (p.bpso.w, p.bpso.candidate_limit, p.mpso.candidate_limit, p.seed, p.gmm.max_k) == (0.5, 12, None, 7, 4)
    assert Parameters().bpso.w == 0.729 and dict((n, v) for n, v, _ in flattened(p))["bpso.w"] == 0.5
    for name, value in (("bpso.w", "much"), ("gmm.max_k", 4.5), ("gmm.max_k", None), ("seed", True), ("bpso.none", 1), ("none", 1)):
        with pytest.raises(ValueError, match=name):
            overridden(Parameters(), {name: value})


def test_parameters_reach_the_swarms(spark, monkeypatch):
    got = {}
    monkeypatch.setattr(pipeline.S, "bpso", lambda *a, **k: got.update(bpso=(a, k)) or [1])
    monkeypatch.setattr(pipeline.S, "mpso", lambda *a, **k: got.update(mpso=(a, k)) or ([1], np.ones((1, 1))))
    p = overridden(Parameters(), {"bpso.w": 0.1, "bpso.c1": 0.2, "bpso.c2": 0.3, "bpso.stride": 4, "bpso.n_rounds": 3, "mpso.feature_threshold": 0.6, "mpso.sampling_stride": 2})
    for method in ("bpso", "mpso"):
        pipeline.select(None, "class", "features", method, p)
    assert got["bpso"][1] == {"stride": 4, "w": 0.1, "c1": 0.2, "c2": 0.3, "n_rounds": 3}
    assert got["mpso"][1] == {"stride": 2, "threshold": 0.6, "n_rounds": 1}
    assert got["bpso"][0][3:9] == (None, 2.0, 50, 20, 30, 0.95) and got["mpso"][0][2] == 5


@pytest.mark.parametrize("assign", ["metadata", "gmm"])
def test_classes_are_assigned_within_the_run(spark, assign):
    rng = np.random.default_rng(3)
    own = np.arange(120) % 2
    x = rng.normal(0, 0.3, (120, 4)) + 5 * own[:, None]
    rows = [("AB"[c], "x", "1", i, v) for i, (c, v) in enumerate(zip(own.tolist(), x.tolist(), strict=True))]
    df = spark.createDataFrame(rows, "construct string, subconstruct string, replica string, frame_number int, features array<double>")
    p = overridden(Parameters(), {"gmm.max_k": 3, "gmm.stride": 1, "pca.num_eigenvector": 2, "fisher_amino.bins": 8, "fisher_amino.n_amino_outputs": 3})
    options = {} if assign == "metadata" else {"starts": 2}
    (result,) = pipeline.run(df, "state", configs=[("fisher_amino", "pca")], parameters=p, filter_variance=False, assign=assign, **options)
    states = {r["state"] for r in result.data.select("state").distinct().collect()}
    assert states == {"A_x", "B_x"} if assign == "metadata" else len(states) >= 2 and all(s.startswith("cluster_") for s in states)
    assert pipeline.leaderboard([result], "state").first()["separability"] > 1


def test_normalised_frames(spark):
    x = np.array([[1.0, 5.0, np.nan], [3.0, 5.0, 2.0], [5.0, 5.0, 6.0]])
    df = spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "k int, features array<double>")
    got = {r["k"]: r["features"] for r in amino.normalised_frames(df).collect()}
    assert np.allclose([got[i][0] for i in range(3)], x[:, 0] / x[:, 0].std()) and [got[i][1] for i in range(3)] == [0.0] * 3
    assert got[0][2] is None and np.isclose(got[1][2], 1.0)
