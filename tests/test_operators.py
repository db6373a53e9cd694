"""Numeric operators against plain numpy, and the invariants that they promise."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framelens.functions.features import feature_columns, gather, pairwise_distances, to_array, to_wide
from framelens.operators import amino, clustering, reduction, selection, tables, thresholds
from framelens.operators import moments as M
from framelens.plans import pipeline
from framelens.plans.parameters import overridden


def frame(spark, x, y):
    rows = [(i, int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "frame_number long, class int, features array<double>")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(42)
    y = np.arange(300) % 3
    x = rng.normal(0, 1, (300, 8))
    x[:, :3] += 3 * y[:, None]
    return frame(spark, x, y), x, y


def proj(df):
    rows = df.orderBy("frame_number").collect()
    return np.array([r["proj"] for r in rows])


def test_scatter_is_partition_invariant(spark, data):
    df, x, y = data
    for parts in (1, 4, 13):
        s = reduction.scatter(df.repartition(parts), "class")
        for c in range(3):
            d = x[y == c] - x[y == c].mean(0)
            assert np.allclose(s.scatters[c], d.T @ d) and np.allclose(s.means[c], x[y == c].mean(0))
        t = x - x.mean(0)
        assert np.allclose(s.within + s.between, t.T @ t)
        assert np.allclose(s.norms, np.linalg.norm(x, axis=0))


def test_pca(data):
    df, x, _ = data
    fit = reduction.fit_pca(reduction.scatter(df, "class"), 3)
    z = proj(fit(df))
    values = np.linalg.svd(x - x.mean(0))[1] ** 2 / (len(x) - 1)
    assert np.allclose(fit.values, values[:3]) and np.allclose(z.var(0, ddof=1), values[:3]) and np.allclose(z.mean(0), 0, atol=1e-10)
    assert (np.abs(np.corrcoef(z.T) - np.eye(3)) < 1e-6).all()
    assert reduction.fit_pca(reduction.scatter(df, "class"), None).matrix.shape[1] == thresholds.components_for(values)


@pytest.mark.parametrize("name", ["flda", "mhlda", "zhlda", "gdhlda"])
def test_discriminants(data, name):
    df, _, y = data
    fit = reduction.FITS[name](reduction.scatter(df, "class"), 5)
    z = proj(fit(df))
    # MHLDA has as many components as features, the others one fewer than classes.
    assert z.shape[1] == (5 if name == "mhlda" else 2) and np.isfinite(z).all()
    again = proj(reduction.FITS[name](reduction.scatter(df.repartition(7), "class"), 5)(df))
    # Beyond the rank of the scatter between classes any direction is as good.
    assert np.allclose(z[:, :2], again[:, :2], atol=1e-6)


def test_flda_separates_and_needs_two_classes(spark, data):
    df, x, y = data
    z = proj(reduction.fit_flda(reduction.scatter(df, "class"), 1)(df))[:, 0]
    means = sorted(z[y == c].mean() for c in range(3))
    assert means[1] - means[0] > 1 and means[2] - means[1] > 1
    with pytest.raises(ValueError):
        reduction.fit_flda(reduction.scatter(frame(spark, x, np.zeros(300)), "class"))


def test_translation_invariance_of_centred_descent(spark, data):
    df, x, y = data
    a = proj(reduction.fit_zhlda(reduction.scatter(df, "class"), 2, center=True)(df))
    b = proj(reduction.fit_zhlda(reduction.scatter(frame(spark, x + 0.0, y), "class"), 2, center=True)(df))
    assert np.allclose(a, b)


def test_separability_formula(data):
    df, x, y = data
    between = sum((y == c).sum() * (x[y == c].mean(0) - x.mean(0)) ** 2 for c in range(3))
    within = sum(((x[y == c] - x[y == c].mean(0)) ** 2).sum(0) for c in range(3))
    assert abs(M.separability(df, "class").first()[0] - between.sum() / (within.sum() + 1e-9)) < 1e-9
    top = M.top(M.fisher_scatter(M.class_moments(df, "class")), 3).collect()
    assert {r["pos"] for r in top} == {0, 1, 2}


def test_constant_features(spark):
    df = frame(spark, np.column_stack([np.ones(20), np.arange(20.0)]), np.arange(20) % 2)
    z = np.array([r["features"] for r in M.standard_scaled(df).orderBy("frame_number").collect()])
    assert (z[:, 0] == 0).all() and abs(z[:, 1].std(ddof=1) - 1) < 1e-12
    assert [r["pos"] for r in thresholds.above_percentile(M.variances(df).select("pos", "variance"), "variance").collect()] == []


def test_empty(spark):
    df = spark.createDataFrame([], "frame_number long, class int, features array<double>")
    assert M.class_moments(df, "class").count() == 0
    assert amino.select_features(df) == []
    with pytest.raises(ValueError):
        reduction.scatter(df, "class")


@given(st.lists(st.floats(0.01, 100), min_size=3, max_size=30), st.floats(0.1, 5))
@settings(max_examples=50, deadline=None)
def test_knee_is_on_the_curve(values, sensitivity):
    values = sorted(values, reverse=True)
    found = thresholds.knee(values, 1.0, sensitivity)
    assert found is None or found[1] == values[int(found[0]) - 1]


def test_knee_of_a_clear_curve():
    assert thresholds.knee([1 / (i + 0.1) for i in range(20)], 0.0)[0] in (1, 2, 3)
    assert thresholds.knee([1, 1, 1, 1]) is None


def test_mrmr_and_svm():
    rng = np.random.default_rng(0)
    r = np.abs(np.corrcoef(rng.normal(size=(5, 50))))
    order = selection.relevance_order(np.array([1, 5, 2, 3, 4.0]), r, 4)
    assert order[0] == 1 and len(set(order)) == 4
    x = rng.normal(size=(120, 3))
    y = (x[:, 0] > 0).astype(int)
    assert selection.accuracy(x, y) > 0.9 and selection.accuracy(x, y, bags=3) > 0.85
    assert selection.binary_fitness(np.zeros(3), x, y) == 1.0
    assert 0 <= selection.projection_fitness(rng.random(6), x, y, 2) <= 1


def test_swarms_reproduce_and_find_the_signal(data):
    df, _, _ = data
    a = selection.bpso(df, "class", particles=6, steps=3, sample_rows=150)
    assert a == selection.bpso(df.repartition(5), "class", particles=6, steps=3, sample_rows=150) and set(a) & {0, 1, 2}
    at, matrix = selection.mpso(df, "class", 2, particles=4, steps=1, sample_rows=120)
    assert matrix.shape == (len(at), 2) and np.allclose(matrix.sum(0)[matrix.sum(0) > 0], 1)


def test_amino_groups_copies(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 200))
    df = frame(spark, np.column_stack([a, a * 2, b, b + 0.01 * rng.normal(size=200)]), np.zeros(200))
    t = amino.sampled_trajectories(df)
    d = amino.distance_matrix(amino.pair_distances(spark, t), 4)
    assert np.allclose(d, d.T) and d[0, 1] < d[0, 2] and d[2, 3] < d[0, 3]
    centres, _ = amino.medoids(d, amino.spread_seeds(d, 2))
    assert len({c // 2 for c in centres}) == 2
    p = amino.joint_density(t[0], t[2], 12, amino.bandwidth(200))
    assert abs(p.sum() - 1) < 1e-12


def test_states(spark):
    rng = np.random.default_rng(4)
    own = rng.integers(0, 3, 240)
    df = frame(spark, rng.normal(0, 0.3, (240, 3)) + 4 * own[:, None], own)
    for out in (clustering.mixture_states(df, ["frame_number"], max_k=5, stride=1)[0], clustering.spectral_states(df, ["frame_number"], components=30, max_k=6)):
        counts = tables.composition(out, "global_cluster_id", "class").collect()
        assert np.mean([r["percent"] for r in counts]) > 60
    slow = clustering.time_lagged_states(df, ["class"], ["frame_number"], lag=2, max_k=4)
    assert slow.where("TICA_1 is null").count() == 0


def test_pipeline_runs_the_grid(data, tmp_path):
    df, _, _ = data
    p = overridden(pipeline.Parameters(), {"mpso.max_candidates": 4, "mpso.optimization_iterations": 1, "mpso.sampling_stride": 1, "flda.num_eigenvector": 2, "pca.num_eigenvector": 2, "sample_rows": 90, "fisher_amino.n_amino_outputs": 4, "fisher_amino.bins": 8, "mpso.n_dimensions": 3})
    assert len(pipeline.configurations()) == 20
    results = pipeline.run(df, "class", configs=[("fisher_amino", "pca"), ("mpso", "flda")], parameters=p, filter_variance=False)
    board = pipeline.leaderboard(results, "class").collect()
    assert [r["rank"] for r in sorted(board, key=lambda r: -r["separability"])] == [1, 2] and abs(sum(r["share"] for r in board) - 1) < 1e-9
    assert pipeline.run_summary(results, "class").where("samples = 300 and classes = 3").count() == 2
    assert set(results[0].selected) <= set(pipeline.selected_union(results))
    pipeline.save(results, str(tmp_path / "out"))
    assert df.sparkSession.read.parquet(str(tmp_path / "out" / results[0].name / "data")).count() == 300
    step = lambda: pipeline.checkpointed(df, str(tmp_path / "cp"), "scaled", p, M.standard_scaled)
    assert step().count() == step().count() == 300
    with pytest.raises(ValueError):
        pipeline.select(df, "class", "features", "none", p)


def test_wide_views(spark):
    df = spark.createDataFrame([(1, 2.0, 3, "a")], "frame_number int, f double, g int, replica string")
    assert feature_columns(df) == ["f", "g"]
    array = to_array(df, ["f", "g"])
    assert to_wide(gather(array, [1]), ["g"]).first()["g"] == 3.0
    points = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 3.0, 4.0)], "frame int, m int, x double, y double")
    assert pairwise_distances(points, ["frame"], "m", ["x", "y"]).first()["distance"] == 5.0


def test_class_assignment(spark):
    rng = np.random.default_rng(6)
    rows = [("A" if i < 60 else "B", "x", "1", i % 60, [float(v) for v in rng.normal(0, 0.2, 3) + (3 if i % 60 < 30 else 0)]) for i in range(120)]
    df = spark.createDataFrame(rows, "construct string, subconstruct string, replica string, frame_number long, features array<double>")
    assert {r["class"] for r in pipeline.assigned(df, "metadata").collect()} == {"A_x", "B_x"}
    for how, options in (("gmm", {"max_k": 3, "stride": 1, "steps": 2}), ("spectral", {"components": 20, "max_k": 3}), ("tica", {"lag": 2, "max_k": 3})):
        out = pipeline.assigned(df, how, **options)
        assert out.where("class like 'cluster_%'").count() == 120
    with pytest.raises(ValueError):
        pipeline.assigned(df, "none")


def test_swarms_and_distances_use_every_frame(spark):
    rng = np.random.default_rng(11)
    y = np.repeat([0, 1, 2], [1500, 1000, 6])
    x = rng.normal(size=(len(y), 4)) + np.outer(y, [1.5, 0, 0, 0])
    df = frame(spark, x, y).repartition(5)
    frames = selection.packed(df, "class", "features")
    masks = [np.array([True, False, True, False]), np.ones(4, bool)]
    got = frames.accuracies([np.eye(4)[:, m] for m in masks])
    parts = [p for r in frames.blocks.collect() for p in zip(np.frombuffer(r["x"]).reshape(-1, 4), np.frombuffer(r["y"], np.int32), np.frombuffer(r["fold"], np.int32), strict=True)]
    px, py, fold = (np.array(v) for v in zip(*parts, strict=True))
    assert len(py) == len(y) and [np.bincount(fold[py == c]).tolist() for c in range(3)] == [[500] * 3, [334, 333, 333], [2] * 3]
    assert frames.sizes.tolist() == np.bincount(fold).tolist()
    for m, value in zip(masks, got, strict=True):
        want = []
        for k in range(3):
            models = [selection.fit_svm(px[fold != k][:, m], np.where(py[fold != k] == c, 1.0, -1.0)) for c in range(3)]
            want.append((selection.decide(px[fold == k][:, m], models) == py[fold == k]).mean())
        assert abs(value - np.mean(want)) < 1e-9
    assert abs(selection.draws(np.arange(100_000, dtype=np.uint64), 3).mean() - 1) < 0.02
    assert selection.projection_losses(frames, [np.array([True, False, False, True] * 2)], 2)[0][0] < 1
    frames.blocks.unpersist()
    whole = amino.normalised(x.T)
    want = amino.distance_matrix(amino.pair_distances(spark, whole, 12), 4)
    pairs, count = amino.frame_distances(df, bins=12)
    assert count == 4 and np.allclose(amino.distance_matrix(pairs, 4), want)
    assert pipeline.Parameters().sample_rows is None


def test_states_that_occur_late_are_found(spark):
    rng = np.random.default_rng(8)
    own = np.repeat([0, 1, 2], [300, 60, 60])
    df = frame(spark, rng.normal(0, 0.3, (420, 2)) + 8 * np.column_stack([own == 1, own == 2]), own)
    out, curve = clustering.mixture_states(df, ["frame_number"], max_k=4, stride=2, sample_rows=60)
    bics = {r["k"]: r["bic"] for r in curve.collect()}
    assert bics[3] < bics[2] - 100
    for out in (out, clustering.spectral_states(df, ["frame_number"], components=40, max_k=5)):
        late = out.where("class > 0").groupBy("class").agg({"global_cluster_id": "min"}).collect()
        assert len({r[1] for r in late}) == 2


def test_leaderboard_is_of_the_whole_workflow(spark, monkeypatch):
    from framelens.plans import learning

    given = {}

    def run(df, target, features="features", configs=None, parameters=None, filter_variance=True):
        given.update(configs=configs or pipeline.configurations(), parameters=parameters or pipeline.Parameters(), filter_variance=filter_variance)
        raise InterruptedError

    monkeypatch.setattr(pipeline, "run", run)
    with pytest.raises(InterruptedError):
        learning.o101_pipeline_leaderboard(spark, "/root/testdata/sf0.001")
    # The workflow's own parameters, but that every frame is used.
    every = overridden(pipeline.Parameters(), {"bpso.stride": 1, "mpso.sampling_stride": 1, "chi_sq_amino.stride": 1})
    assert given == {"configs": pipeline.configurations(), "parameters": every, "filter_variance": True}


def test_a_stored_step_is_made_again_for_other_rows(spark, tmp_path):
    at = str(tmp_path / "in")
    step = lambda: pipeline.checkpointed(spark.read.parquet(at), str(tmp_path / "cp"), "copy", pipeline.Parameters(), lambda df: df).count()
    spark.range(1001).repartition(1001).write.parquet(at)
    assert step() == 1001
    name = sorted((tmp_path / "in").glob("part-*"))[-1]
    spark.range(7).coalesce(1).write.parquet(str(tmp_path / "more"))
    next((tmp_path / "more").glob("part-*")).rename(name.with_name("part-99999-more.parquet"))
    assert step() == 1008


def test_projection_loss_by_hand():
    """Two dimensions, the first feature in both: its two uses count as overlap."""
    chosen = np.array([[1.0, 1.0], [0.0, 1.0], [0.0, 0.0]])
    r = np.array([[1.0, 0.5], [0.5, 1.0]])
    want = 0.8 * (0.9 * 0.25 + 0.1 * 3 / 6) + 0.2 * (0.7 * 0.25 + 0.3 * 2 / 6)
    assert abs(selection.projection_loss(0.75, chosen, r, 0.9, 0.2) - want) < 1e-12


def loop_descent(w, within, means, n, rate, steps, patience, tolerance, epsilon, every, least):
    """The descent pair by pair, with the matrices of every pair spelt out."""
    pairs = [(np.outer(means[g] - means[h], means[g] - means[h]), n[g] * n[h]) for g in range(len(n)) for h in range(g + 1, len(n))]
    last, calm = float("inf"), 0
    for step in range(steps):
        a, value, slope = np.trace(w.T @ within @ w), 0.0, np.zeros_like(w)
        for between, weight in pairs:
            b = np.trace(w.T @ between @ w)
            if b > least:
                b += epsilon
                value += weight * a / b
                slope += 2 * weight / b * within @ w - 2 * weight * a / b**2 * between @ w
        slope /= max(1.0, np.linalg.norm(slope))
        w = w - rate * (slope - w @ slope.T @ w)
        calm = calm + 1 if abs(last - value) < tolerance else 0
        if calm >= patience:
            return w
        last = value
        if step % every == 0:
            w = np.linalg.qr(w)[0]
    return w


@pytest.mark.parametrize(("epsilon", "every", "least"), [(1e-8, 20, 1e-12), (1e-10, 25, 0.0)])
def test_descent_equals_loops(epsilon, every, least):
    rng = np.random.default_rng(4)
    means, n = rng.normal(size=(4, 5)), np.array([10.0, 20.0, 5.0, 8.0])
    half = rng.normal(size=(5, 5))
    w, g = rng.normal(size=(5, 2)), np.triu_indices(4, 1)
    got = reduction.descend(w, half @ half.T, means[g[0]] - means[g[1]], n[g[0]] * n[g[1]], 1e-3, 90, 5, 1e-9, epsilon, every, least)
    assert np.allclose(got, loop_descent(w, half @ half.T, means, n, 1e-3, 90, 5, 1e-9, epsilon, every, least), atol=1e-8)


def test_mhlda_leaves_single_rows_out():
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(41, 4)) + np.repeat([0, 2, 9], [20, 20, 1])[:, None] * np.array([1, 0, 0.5, 0]), np.repeat([0, 1, 2], [20, 20, 1])
    means = np.array([x[y == c].mean(0) for c in range(3)])
    scatters = np.array([(x[y == c] - means[c]).T @ (x[y == c] - means[c]) for c in range(3)])
    fit = reduction.fit_mhlda(reduction.Scatter([0, 1, 2], np.array([20.0, 20.0, 1.0]), means, scatters), 3)
    within = sum(20 / 41 * np.linalg.inv(scatters[c] + 1e-4 * np.eye(4)) for c in range(2)) + 1e-9 * np.eye(4)
    between = sum(20 * np.outer(means[c] - x.mean(0), means[c] - x.mean(0)) for c in range(2))
    assert fit.matrix.shape == (4, 3)
    v = fit.matrix[:, 0]
    assert np.allclose(between @ v, fit.values[0] * within @ v, rtol=1e-6, atol=1e-6)


def test_gathering_thousands_of_positions(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6, 3000))
    df = frame(spark, x, np.zeros(6))
    for at in (sorted(rng.permutation(3000)[:1500].tolist()), rng.permutation(3000)[:700].tolist(), [2, 2, 1], [5, 0], [], [2999] * 300):
        got = gather(df, at).orderBy("frame_number").collect()
        assert np.allclose([r["features"] for r in got], x[:, at])
    assert gather(df, [1, 5000]).first()["features"][1] is None
