"""Queries on reductions, selections, feature clusters and states."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from framelens.functions.features import gather, to_long
from framelens.operators import amino as A
from framelens.operators import clustering as K
from framelens.operators import moments as M
from framelens.operators import reduction as R
from framelens.operators import selection as S
from framelens.operators import thresholds as H
from framelens.plans import pipeline as P
from framelens.plans.parameters import overridden
from framelens.plans.registered import LONG, query
from framelens.plans.statistics import VARIANCE_KNEE, VARIANCE_LEVEL, WIDE, embeddings, lines

#: Fewer clusters and coarser grids than the workflow's own; all frames.
SMALL = overridden(P.Parameters(), {"fisher_amino.n_amino_outputs": 8, "fisher_amino.bins": 10, "fisher_amino.knee_sensitivity": 1.0, "chi_sq_amino.max_amino": 8, "chi_sq_amino.bins": 10, "chi_sq_amino.knee_sensitivity": 1.0, "chi_sq_amino.stride": 1})
#: The workflow's own, on all frames.
ALL_FRAMES = overridden(P.Parameters(), {"bpso.stride": 1, "mpso.sampling_stride": 1, "chi_sq_amino.stride": 1})


def _top(spark, sf_dir, k=16):
    """Embeddings cut to the k features of highest Fisher score."""
    df = embeddings(spark, sf_dir)
    best = [r["pos"] for r in M.top(M.fisher_laplacian(M.class_moments(df, "label")), k).collect()]
    return gather(df, best)


def _numbers(df, *keep):
    return df.select(*keep, F.transform("proj", lambda x: F.round(x, 6)).alias("proj"))


@query(
    """with m as (select l_returnflag as c, avg(l_quantity) a, avg(l_extendedprice) b, avg(l_discount) d, avg(l_tax) e from lineitem group by 1),
    r as (select l_returnflag as c, l_quantity - a as x0, l_extendedprice - b as x1, l_discount - d as x2, l_tax - e as x3 from lineitem join m on l_returnflag = c)
    select c as l_returnflag, i, j, round(v, 2) as v from (
    """
    + " union all ".join(f"select c, {i} as i, {j} as j, sum(x{i} * x{j}) / count(*) as v from r group by c" for i in range(4) for j in range(4))
    + ")"
)
def o75_class_scatter(spark, sf_dir):
    s = R.scatter(lines(spark, sf_dir), "l_returnflag")
    rows = [(str(c), i, j, float(round(s.scatters[k, i, j] / s.n[k], 2)) + 0.0) for k, c in enumerate(s.classes) for i in range(4) for j in range(4)]
    return spark.createDataFrame(rows, "l_returnflag string, i int, j int, v double")


@query()
def o76_pca(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    return _numbers(R.fit_pca(R.scatter(df, "label"), 2)(df), "vec_id", "label")


@query(f"with {LONG} select round(sum(v), 5) as total from (select var_samp(x) as v from long group by pos)")
def o76_pca_total_variance(spark, sf_dir):
    s = R.scatter(embeddings(spark, sf_dir), "label")
    return spark.createDataFrame([(float(round(R.fit_pca(s, s.means.shape[1]).values.sum(), 5)),)], "total double")


@query()
def o76_wide_pca(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    return _numbers(R.fit_wide_pca(df, k=2)(df), "vec_id", "label")


_D = "d as (select l_quantity::DOUBLE as x0, l_extendedprice::DOUBLE as x1, l_discount::DOUBLE as x2, l_tax::DOUBLE as x3, (l_quantity + l_discount) / 2 as y0, (l_extendedprice + l_tax) / 2 as y1 from lineitem)"


@query(
    f"with {_D}, r as ("
    + " union all ".join(f"select {i} as pos, [corr(x{i}, y0), corr(x{i}, y1)] as r from d" for i in range(4))
    + """), m as (select greatest(max(abs(y0)), max(abs(y1))) as reach from d)
    select pos, k::INT as k, round(r[k + 1] * 0.9 * reach, 4) as arrow, round(abs(r[1]) + abs(r[2]), 6) as weight
    from (select * from r order by abs(r[1]) + abs(r[2]) desc limit 3), m, (select unnest([0, 1]) as k)"""
)
def o107_loading_arrows(spark, sf_dir):
    df = lines(spark, sf_dir)
    half = np.array([[0.5, 0.0], [0.0, 0.5], [0.5, 0.0], [0.0, 0.5]])
    both = R.project(df.withColumn("_x", F.col("features")), half, features="_x")
    return P.loadings(both, top=3).select("pos", F.posexplode("arrow").alias("k", "arrow"), F.round("weight", 6).alias("weight")).withColumn("arrow", F.round("arrow", 4))


@query(
    f"""with {LONG}, v as (select pos from long group by pos order by var_pop(x) desc, pos limit 12), k as (select pos, row_number() over (order by pos) as n from v)
    select a.pos as pos_i, b.pos as pos_j, round(corr(a.x, b.x), 6) as r from long a join long b using (vec_id) join k ka on ka.pos = a.pos join k kb on kb.pos = b.pos
    where ka.n < kb.n group by 1, 2"""
)
def o107_redundancy(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    kept = sorted(r["pos"] for r in M.variances(df).orderBy(F.desc("variance"), "pos").limit(12).collect())
    return P.redundancy(df, kept).withColumn("r", F.round("r", 6))


def _reduction(name):
    def run(spark, sf_dir):
        df = _top(spark, sf_dir)
        return _numbers(R.FITS[name](R.scatter(df, "label"), 2)(df), "vec_id", "label")

    return run


@query()
def o77_flda(spark, sf_dir):
    return _reduction("flda")(spark, sf_dir)


@query()
def o78_mhlda(spark, sf_dir):
    return _reduction("mhlda")(spark, sf_dir)


@query()
def o79_zhlda(spark, sf_dir):
    return _reduction("zhlda")(spark, sf_dir)


@query()
def o80_gdhlda(spark, sf_dir):
    return _reduction("gdhlda")(spark, sf_dir)


@query()
def o82_mrmr(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    at = S.shortlist(df, "label", "features", 40, 2.0, 40, 12)
    return spark.createDataFrame(list(enumerate(at)), "rank int, pos int")


@query()
def o84_bpso(spark, sf_dir):
    at = S.bpso(embeddings(spark, sf_dir), "label", candidate_limit=16, mrmr_limit=12, particles=8, steps=4)
    return spark.createDataFrame([(int(p),) for p in at], "pos int")


@query()
def o86_mpso(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    at, matrix = S.mpso(df, "label", 3, candidate_limit=12, mrmr_limit=8, particles=6, steps=2)
    return _numbers(R.project(gather(df, at), matrix), "vec_id", "label")


@query("select l_orderkey, l_linenumber, l_returnflag, round((l_quantity + l_discount) / (2 + 1e-12), 6) as d1, round((l_extendedprice + l_tax) / (2 + 1e-12), 6) as d2 from lineitem")
def o88_mean_projection(spark, sf_dir):
    chosen = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [0.0, 1.0]])
    out = R.project(lines(spark, sf_dir), chosen / (chosen.sum(0) + 1e-12))
    return out.select("l_orderkey", "l_linenumber", "l_returnflag", *[F.round(F.get("proj", F.lit(i)), 6).alias(f"d{i + 1}") for i in range(2)])


@query(f"with {LONG}, s as (select pos, stddev_pop(x) as s from long group by 1) select vec_id, pos, round(case when s > 1e-12 then x / s else 0 end, 5) as x from long join s using (pos)")
def o89_normalised_trajectories(spark, sf_dir):
    df = A.normalised_frames(embeddings(spark, sf_dir))
    return to_long(df, keep=["vec_id"]).select("vec_id", "pos", F.round("x", 5).alias("x"))


@query("select count(*) as n, round(2.2 * power(count(*), -1.0 / 6), 9) as bandwidth from embeddings")
def o90_bandwidth(spark, sf_dir):
    n = embeddings(spark, sf_dir).count()
    return spark.createDataFrame([(n, round(float(A.bandwidth(n)), 9))], "n long, bandwidth double")


@query()
def o92_information_distances(spark, sf_dir):
    return A.frame_distances(_top(spark, sf_dir, 10), bins=10)[0].select("i", "j", F.round("distance", 9).alias("distance"))


@query()
def o92_gaussian_distances(spark, sf_dir):
    """Weighted frames, Gaussian kernel, all pairs of the first 16 features."""
    df = gather(embeddings(spark, sf_dir), range(16)).withColumn("weight", 1.0 + F.col("label"))
    return A.frame_distances(df, bins=12, kernel="gaussian", weights="weight")[0].select("i", "j", F.round("distance", 9).alias("distance"))


@query()
def o95_distortions(spark, sf_dir):
    """What the number of clusters is chosen by."""
    pairs, count = A.frame_distances(_top(spark, sf_dir, 16), bins=10)
    rows = A.distortions(A.distance_matrix(pairs, count), 8)
    return spark.createDataFrame([(k, round(value, 9), [int(c) for c in centres]) for k, value, centres in rows], "k int, distortion double, medoids array<int>")


@query()
def o95_amino(spark, sf_dir):
    at = A.select_features(_top(spark, sf_dir, 16), max_outputs=8, bins=10)
    return spark.createDataFrame([(int(p),) for p in at], "pos int")


def _amino_pipeline(method):
    def run(spark, sf_dir):
        at, _ = P.select(embeddings(spark, sf_dir), "label", "features", method, SMALL)
        return spark.createDataFrame([(int(p),) for p in at], "pos int")

    return run


@query()
def o95a_fisher_amino(spark, sf_dir):
    return _amino_pipeline("fisher_amino")(spark, sf_dir)


@query()
def o95b_chi_sq_amino(spark, sf_dir):
    return _amino_pipeline("chi_sq_amino")(spark, sf_dir)


@query()
def o71_mixture_states(spark, sf_dir):
    return K.mixture_states(_top(spark, sf_dir, 8), ["vec_id"])[0].select("vec_id", "global_cluster_id")


@query()
def o72_bic_curve(spark, sf_dir):
    return K.mixture_states(_top(spark, sf_dir, 8), ["vec_id"], starts=0)[1].drop("converged")


@query()
def o73_spectral_states(spark, sf_dir):
    return K.spectral_states(_top(spark, sf_dir, 16), ["vec_id"]).select("vec_id", "global_cluster_id")


@query()
def o74_time_lagged_states(spark, sf_dir):
    df = K.time_lagged_states(_top(spark, sf_dir, 16), ["label"], ["vec_id"], lag=3)
    return df.select("vec_id", "global_cluster_id", F.round("TICA_1", 6).alias("TICA_1"), F.round("TICA_2", 6).alias("TICA_2"))


@query()
def o101_pipeline_leaderboard(spark, sf_dir):
    results = P.run(embeddings(spark, sf_dir), "label", parameters=ALL_FRAMES)
    return P.leaderboard(results, "label").select("pipeline", F.round("separability", 6).alias("separability"), "rank", F.round("share", 6).alias("share"))


@query(f"with {LONG}, {VARIANCE_KNEE} select vec_id, count(*) as n, round(sum(x), 5) as total from long where pos in (select pos from a where v > {VARIANCE_LEVEL}) group by 1")
def o99_variance_filtered(spark, sf_dir):
    df, _ = P.variance_filtered(embeddings(spark, sf_dir), "features", P.Parameters())
    return to_long(df, keep=["vec_id"]).groupBy("vec_id").agg(F.count("x").alias("n"), F.round(F.sum("x"), 5).alias("total"))


@query(
    """with r(pipeline, features, components) as (values ('means_all', 64, 2), ('means_half', 32, 2))
    select pipeline, (select count(*) from embeddings) as samples, features::INT as features, (select count(distinct label) from embeddings) as classes, components::INT as components from r"""
)
def o20_summary_of_runs(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    width = df.select(F.max(F.size("features"))).first()[0]
    results = []
    for name, chosen in (("means_all", range(width)), ("means_half", range(0, width, 2))):
        halves = np.array([[k % 2 == 0, k % 2 == 1] for k in range(len(chosen))], float)
        results.append(P.Result(name, list(chosen), R.project(gather(df, chosen), halves / halves.sum(0)), 2))
    return P.run_summary(results, "label")


@query()
def o107_scree(spark, sf_dir):
    rows = P.scree(R.scatter(embeddings(spark, sf_dir), "label"))
    return spark.createDataFrame(rows, "component int, variance double, running double")


@query(f"with {WIDE}, {VARIANCE_KNEE} select pos, round(v, 4) as variance from a where v > {VARIANCE_LEVEL}")
def o58_variance_knee_filter(spark, sf_dir):
    return H.variance_cut(M.variances(lines(spark, sf_dir)).select("pos", "variance")).withColumn("variance", F.round("variance", 4))


def flagship(spark, sf_dir):
    """Fisher scores, the ten best features, discriminant axes, separability of each."""
    df = _top(spark, sf_dir, 10)
    out = R.fit_flda(R.scatter(df, "label"), 2)(df)
    return M.component_separability(out, "label", "proj")
