"""Warm starts, strides and rounds of the swarms."""

import numpy as np
import pandas as pd
import pytest

from framelens.operators import selection as S
from framelens.plans import pipeline as P
from framelens.plans.parameters import overridden


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    y = np.arange(240) % 3
    x = rng.normal(size=(240, 6))
    x[:, :2] += 1.2 * y[:, None]
    rows = [(int(c), v) for c, v in zip(y, x.tolist(), strict=True)]
    return spark.createDataFrame(rows, "class int, features array<double>").repartition(3), x, y


def test_a_warm_start_finds_the_same_in_fewer_passes(data, monkeypatch):
    df, _, _ = data
    frames = S.packed(df, "class", "features")
    first, second = np.array([True, True, False, True, False, False]), np.array([True, True, True, True, False, False])
    passes = []
    newton = S._newton_sums
    monkeypatch.setattr(S, "_newton_sums", lambda *a: passes.append(1) or newton(*a))
    value, states = S.binary_losses(frames, [first])
    cold, fresh = S.binary_losses(frames, [second])
    long = len(passes)
    passes.clear()
    warm, moved = S.binary_losses(frames, [second], starts=states)
    assert np.allclose(warm, cold) and np.allclose(moved[0], fresh[0], atol=1e-4)
    assert (states[0][..., [2, 4, 5]] == 0).all() and len(passes) < long - len(passes)
    again, same = S.binary_losses(frames, [first], starts=states)
    assert np.allclose(again, value) and np.allclose(same[0], states[0])
    masks = [np.array([1, 0, 0, 1, 1, 1] * 2, bool)]
    a, held = S.projection_losses(frames, masks, 2)
    b, _ = S.projection_losses(frames, masks, 2, starts=held)
    assert np.allclose(a, b)
    frames.blocks.unpersist()


def test_particles_start_from_their_own_last_mask():
    seen = []

    def loss(masks, states):
        seen.append(states)
        return np.array([float(m.sum()) for m in masks]), [m.tolist() for m in masks]

    run = S.evaluated(loss)
    one, two, three = np.array([0.9, 0.1]), np.array([0.1, 0.9]), np.array([0.9, 0.9])
    assert run(np.array([one, two])).tolist() == [1.0, 1.0] and seen == [[None, None]]
    assert run(np.array([three, two])).tolist() == [2.0, 1.0] and seen[1] == [[True, False]]
    assert run(np.array([one, two])).tolist() == [1.0, 1.0] and len(seen) == 2


def test_swarm_parameters_reach_the_swarm(data, monkeypatch):
    df, _, _ = data
    got = []
    monkeypatch.setattr(S, "swarm", lambda evaluate, size, particles, steps, seed, w, c1, c2: got.append((particles, steps, w, c1, c2)) or (np.ones(size), 0.0))
    S.bpso(df, "class", particles=7, steps=2, w=0.5, c1=1.0, c2=2.0)
    S.mpso(df, "class", 2, particles=5, steps=3, w=0.4, c1=1.1, c2=2.1)
    assert got == [(7, 2, 0.5, 1.0, 2.0), (5, 3, 0.4, 1.1, 2.1)]
    part = S.strided(df, "class", "features", 4, 42)
    assert 20 < part.count() < 110 and S.strided(df, "class", "features", 1, 42) is df


def test_rounds_end_when_the_set_is_stable_and_go_on_where_they_stopped(spark, tmp_path):
    answers = {None: [5, 3, 2, 1], (5, 3, 2, 1): [3, 2], (3, 2): [2, 3], (2, 3): [9]}
    asked = []

    def select(among):
        asked.append(among)
        return answers[None if among is None else tuple(among)]

    assert S.rounds(select, 10) == [2, 3] and asked == [None, [5, 3, 2, 1], [3, 2]]
    asked.clear()
    at = str(tmp_path / "rounds")
    assert S.rounds(select, 1, at, spark) == [5, 3, 2, 1]
    assert S.rounds(select, 2, at, spark) == [3, 2] and asked == [None, [5, 3, 2, 1]]
    assert S.rounds(select, 9, at, spark) == [2, 3] and S.rounds(select, 9, at, spark) == [2, 3]
    assert len(asked) == 3 and spark.read.parquet(at).count() == 3


def test_rounds_of_a_swarm_shrink_to_the_informative_features(data):
    df, _, _ = data
    one = S.bpso(df, "class", candidate_limit=6, particles=6, steps=2, alpha=0.7)
    more = S.bpso(df, "class", candidate_limit=6, particles=6, steps=2, alpha=0.7, n_rounds=4)
    assert set(more) <= set(one) and set(more) & {0, 1}
    at, matrix = S.mpso(df, "class", 2, candidate_limit=6, particles=4, steps=1, n_rounds=2)
    assert matrix.shape == (len(at), 2) and np.allclose(matrix.sum(0), 1)


@pytest.mark.parametrize("bags", [0, 2])
def test_sums_of_all_classifiers_are_those_of_each_alone(bags):
    """Over more frames than are multiplied at once; some classifiers are off, and a view has none on."""
    rng = np.random.default_rng(2)
    n = 2 * S.CACHED + 70
    x, y, fold, row = rng.normal(size=(n, 4)), rng.integers(0, 3, n).astype(np.int32), rng.integers(0, 2, n).astype(np.int32), rng.permutation(n).astype(np.uint64)
    views = [np.eye(4)[:, :2], rng.normal(size=(4, 3)), np.eye(4)]
    shape = (2, max(bags, 1), 3)
    weights = [rng.normal(size=(*shape, v.shape[1] + 1)) for v in views]
    on = [np.ones(shape, bool), rng.random(shape) < 0.6, np.zeros(shape, bool)]
    on[1][0, 0, 0], on[1][1, 0, 1] = True, False
    blocks = pd.DataFrame({"x": [x.tobytes()], "y": [y.tobytes()], "fold": [fold.tobytes()], "row": [row.tobytes()]})
    got = next(S._newton_sums(views, weights, on, bags)(iter([blocks])))
    assert got["view"].tolist() == [0, 1]
    for v, sums in zip(got["view"], got["sums"], strict=True):
        z, d = S._offset(x, views[v]), views[v].shape[1] + 1
        want = []
        for k, b, c in np.argwhere(on[v]).tolist():
            sign = np.where(y == c, 1.0, -1.0)
            slack = 1 - sign * (z @ weights[v][k, b, c])
            times = (S.draws(row, k * bags + b) if bags else np.ones(n)) * (fold != k) * (slack > 0)
            want.append(np.column_stack([(z.T * times) @ z, z.T @ (times * slack * sign)]))
        assert np.allclose(np.frombuffer(sums).reshape(-1, d, d + 1), want)


def test_the_workflow_scales_its_frames_once(data):
    """What a configuration gives is a projection of stored frames, so that no later pass aggregates or scales the input again."""
    df, _, _ = data
    p = overridden(P.Parameters(), {"fisher_amino.knee_sensitivity": 1.0, "fisher_amino.bins": 5})
    for r in P.run(df, "class", configs=[("fisher_amino", "flda"), ("fisher_amino", "pca")], parameters=p, filter_variance=False):
        plan = r.data._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and "Join" not in plan, r.name
        assert r.data.count() == 240
