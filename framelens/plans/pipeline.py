"""The whole workflow: variance filter, scaling, classes, selection, reduction, leaderboard."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.functions.features import gather
from framelens.operators import amino as A
from framelens.operators import clustering as K
from framelens.operators import contingency as C
from framelens.operators import grams as G
from framelens.operators import moments as M
from framelens.operators import reduction as R
from framelens.operators import selection as S
from framelens.operators import tables as T
from framelens.operators import thresholds as H
from framelens.plans.parameters import Parameters, flattened
from framelens.sources.shared import stored

SELECTIONS = ("bpso", "mpso", "fisher_amino", "chi_sq_amino")
REDUCTIONS = ("flda", "pca", "zhlda", "mhlda", "gdhlda")


@dataclass
class Result:
    """What a configuration gave; data is lazy."""

    name: str
    selected: list[int]
    data: DataFrame
    components: int
    parameters: dict = field(default_factory=dict)
    created: str = ""

    def manifest(self) -> str:
        return json.dumps({"name": self.name, "selected": self.selected, "components": self.components, "parameters": self.parameters, "created": self.created}, sort_keys=True)


def configurations(selections: Sequence[str] = SELECTIONS, reductions: Sequence[str] = REDUCTIONS) -> list[tuple[str, str]]:
    return [(s, r) for s in selections for r in reductions]


def parameter_rows(parameters: Parameters) -> list[tuple[str, str, str]]:
    """name, value, help."""
    return [(name, str(value), text) for name, value, text in flattened(parameters)]


def assigned(df: DataFrame, how: str, parts: Sequence[str] = ("construct", "subconstruct"), key: Sequence[str] = ("construct", "subconstruct", "replica"), order: Sequence[str] = ("frame_number",), features: str = "features", **options) -> DataFrame:
    """df with class: the joined metadata, or the state that a clustering gives each frame."""
    if how == "metadata":
        return df.withColumn("class", F.concat_ws("_", *parts))
    if how == "gmm":
        out = K.mixture_states(df, [*key, *order], features, **options)[0]
    elif how == "spectral":
        out = K.spectral_states(df, [*key, *order], features, **options)
    elif how == "tica":
        out = K.time_lagged_states(df, key, order, features, **options)
    else:
        raise ValueError(f"unknown class assignment {how!r}: one of metadata, gmm, spectral, tica")
    return out.withColumn("class", F.concat(F.lit("cluster_"), F.col("global_cluster_id").cast("string")))


def run_summary(results: Sequence[Result], target: str) -> DataFrame:
    """pipeline, samples, features, classes, components: one row per result."""
    rows = []
    for r in results:
        counts = T.class_summary(r.data, target)
        rows.append(counts.select(F.lit(r.name).alias("pipeline"), F.col("rows").alias("samples"), F.lit(len(r.selected)).alias("features"), "classes", F.lit(r.components).alias("components")))
    return T.unioned(rows)


def selected_union(results: Sequence[Result]) -> list[int]:
    """Features that any result selected, in the order of the configurations."""
    return list(dict.fromkeys(p for r in results for p in r.selected))


def variance_filtered(df: DataFrame, features: str, p: Parameters) -> tuple[DataFrame, list[int]]:
    """df with the features that vary enough, and their positions."""
    stats = H.without_insane(M.variances(df, features).select("pos", "variance"), "variance")
    v = p.variance
    kept = H.variance_cut(stats, "variance", v.knee_sensitivity, v.outlier_multiplier, v.fallback_percentile, v.min_clean_ratio)
    positions = sorted(r["pos"] for r in kept.collect())  # one number per feature
    return gather(df, positions, features), positions


def _amino(df: DataFrame, features: str, scores: DataFrame, sensitivity: float, most: int | None, bins: int | None, sample_rows: int | None, fallback: float | None) -> list[int]:
    kept = H.cut_by_knee(scores, "score", sensitivity, 1.0, fallback)
    positions = [r["pos"] for r in kept.orderBy(F.desc("score"), "pos").collect()]
    if not positions:
        return []
    cut = M.min_max_scaled(gather(df, positions, features), features, 1e-12)
    return [positions[i] for i in A.select_features(cut, features, most, bins, sample_rows)]


def select(df: DataFrame, target: str, features: str, method: str, p: Parameters) -> tuple[list[int], np.ndarray | None]:
    """Positions, and a matrix where the method projects."""
    if method == "bpso":
        o = p.bpso
        return S.bpso(df, target, features, o.candidate_limit, o.knee_sensitivity, o.mrmr_limit, o.n_particles or o.population_size, o.max_iter, o.accuracy_sparsity_weight, p.seed, p.sample_rows, stride=o.stride, w=o.w, c1=o.c1, c2=o.c2, n_rounds=o.n_rounds), None
    if method == "mpso":
        o = p.mpso
        return S.mpso(df, target, o.n_dimensions, features, o.candidate_limit, o.knee_sensitivity, o.mrmr_limit, o.max_candidates, o.optimization_iterations, o.accuracy_sparsity_weight, o.dimension_independence_penalty, p.seed, p.sample_rows, stride=o.sampling_stride, threshold=o.feature_threshold, n_rounds=o.n_rounds)
    if method == "fisher_amino":
        o = p.fisher_amino
        scores = M.fisher_pooled_samples(M.class_moments(df, target, features))
        return _amino(df, features, scores, o.knee_sensitivity, o.n_amino_outputs, o.bins, p.sample_rows, None), None
    if method == "chi_sq_amino":
        o = p.chi_sq_amino
        scores = C.chi_squared(stored(M.min_max_scaled(df, features)), target, features, o.q_bins, o.stride)
        return _amino(df, features, scores, o.knee_sensitivity, o.max_amino, o.bins, p.sample_rows, 0.0), None
    raise ValueError(f"unknown selection {method!r}: one of {', '.join(SELECTIONS)}")


def reduce(df: DataFrame, target: str, features: str, method: str, p: Parameters) -> tuple[DataFrame, int]:
    """df with proj, and its number of components."""
    if method not in R.FITS:
        raise ValueError(f"unknown reduction {method!r}: one of {', '.join(REDUCTIONS)}")
    o = getattr(p, method)
    if method == "pca":
        fit = R.fit_wide_pca(df, features, o.num_eigenvector)
        return fit(df, features), fit.matrix.shape[1]
    options = {"rate": o.learning_rate, "steps": o.num_iteration, "patience": o.stop_crit, "tolerance": o.convergence_threshold} if method in ("zhlda", "gdhlda") else {"regularization": o.regularization}
    fit = R.FITS[method](R.scatter(df, target, features), o.num_eigenvector, **options)
    return fit(df, features), fit.matrix.shape[1]


def run(df: DataFrame, target: str, features: str = "features", configs: Sequence[tuple[str, str]] | None = None, parameters: Parameters | None = None, filter_variance: bool = True, assign: str | None = None, **assignment) -> list[Result]:
    """Every configuration on the same filtered and scaled frames.

    assign: how each frame gets its class, named as target, after scaling (metadata, gmm, spectral or tica;
    see ``assigned``, which takes the rest); None where target is a column of df.
    """
    p = parameters or Parameters()
    positions = None
    if filter_variance:
        df, positions = variance_filtered(df, features, p)
    # Every pass of a selection or reduction reads these frames, so they are scaled once.
    df = stored(M.standard_scaled(df, features))
    if assign is not None:
        own = {"gmm": asdict(p.gmm), "spectral": asdict(p.spectral), "tica": asdict(p.tica)}.get(assign, {})
        df = stored(assigned(df, assign, features=features, **{**own, **assignment}).withColumnRenamed("class", target))
    results: list[Result] = []
    chosen: dict[str, tuple] = {}
    for selection, reduction in configs or configurations():
        if selection not in chosen:
            chosen[selection] = select(df, target, features, selection, p)
        at, matrix = chosen[selection]
        cut = gather(df, at, features)
        if matrix is not None:
            cut = R.project(cut, matrix, None, features, features)
        data, count = reduce(cut, target, features, reduction, p)
        own = [positions[i] for i in at] if positions is not None else list(at)
        results.append(Result(f"{selection}_{reduction}", own, data, count, asdict(p), datetime.now(timezone.utc).isoformat()))
    return results


def leaderboard(results: Sequence[Result], target: str) -> DataFrame:
    """pipeline, separability, rank, share."""
    rows = [M.separability(r.data, target, "proj").withColumn("pipeline", F.lit(r.name)) for r in results]
    return T.leaderboard(T.unioned(rows))


def save(results: Sequence[Result], path: str, mode: str = "errorifexists") -> None:
    """Parquet per pipeline, its manifest beside it as a one-row text table."""
    for r in results:
        r.data.write.mode(mode).parquet(f"{path}/{r.name}/data")
        r.data.sparkSession.createDataFrame([(r.manifest(),)], "value string").write.mode(mode).text(f"{path}/{r.name}/manifest")


def checkpointed(df: DataFrame, path: str, step: str, parameters: Parameters, make) -> DataFrame:
    """The stored result of a step for these parameters, this input schema and these files (name, size, time); made if there is none."""
    spark = df.sparkSession
    files = []
    for name in sorted(df.inputFiles()):
        file = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        status = file.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(file)
        files.append((name, status.getLen(), status.getModificationTime()))
    key = hashlib.sha256(json.dumps([step, asdict(parameters), df.schema.json(), files], sort_keys=True).encode()).hexdigest()[:16]
    at = f"{path}/{step}-{key}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make(df).write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def scree(s: R.Scatter) -> list[tuple[int, float, float]]:
    """component, variance, running share: what a scree plot draws."""
    values = R.fit_pca(s, s.means.shape[1]).values
    return [(i, float(v), float(c)) for i, (v, c) in enumerate(zip(values, np.cumsum(values) / values.sum(), strict=True))]


def loadings(df: DataFrame, features: str = "features", proj: str = "proj", top: int = 8, dimensions: int = 3) -> DataFrame:
    """pos, arrow, weight: the features that correlate most with the first dimensions, as arrows of a biplot.

    weight sums the sizes of a feature's correlations; arrows are these times 0.9 of the largest coordinate of the frames.
    """
    df = df.select(features, F.slice(proj, 1, dimensions).alias("_proj"))
    reach = df.agg(F.max(F.array_max(F.transform("_proj", F.abs))).alias("_reach"))  # one row
    r = G.correlations(df, features, "_proj").groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "r"))).alias("_r"), F.sum(F.abs("r")).alias("weight"))
    best = r.orderBy(F.desc(F.round("weight", 12)), "i").limit(top).crossJoin(F.broadcast(reach))
    return best.select(F.col("i").alias("pos"), F.transform("_r", lambda x: x["r"] * 0.9 * F.col("_reach")).alias("arrow"), "weight")


def redundancy(df: DataFrame, positions: Sequence[int], features: str = "features") -> DataFrame:
    """pos_i, pos_j, r: how far each two of the selected features tell the same (pos_i before pos_j in positions)."""
    r = G.correlations(gather(df, positions, features), features)
    named = lambda c: F.element_at(F.array(*[F.lit(int(p)) for p in positions]), F.col(c) + 1)
    return r.select(named("i").alias("pos_i"), named("j").alias("pos_j"), "r")


def scatter_points(df: DataFrame, key: Sequence[str], order: Sequence[str], target: str, proj: str = "proj", dimensions: int = 3, stride: int = 20) -> DataFrame:
    """key, order, target and the first dimensions of every stride-th frame of each trajectory: the points of a biplot."""
    return T.stride(df, key, order, stride).select(*key, *order, target, F.slice(proj, 1, dimensions).alias(proj))
