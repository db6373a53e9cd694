"""Parameters of the workflow: a frozen set for each operator, its defaults and what each of them does."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace
from types import UnionType
from typing import Any, get_args, get_type_hints


def _p(default, text: str):
    return field(default=default, metadata={"help": text})


# Default values are fixed: they are those of the workflow's published settings.
@dataclass(frozen=True)
class Variance:
    knee_sensitivity: float = _p(1.0, "larger is more conservative about calling a point a knee")
    outlier_multiplier: float = _p(3.0, "interquartile ranges beyond which a variance is left out of the search for the knee")
    fallback_percentile: float = _p(90.0, "percentile that is the threshold where there is no knee")
    min_clean_ratio: float = _p(0.5, "share of features that must be left without outliers, else all are used")


@dataclass(frozen=True)
class Bpso:
    candidate_limit: int | None = _p(None, "features kept by Fisher score; None finds the knee")
    knee_sensitivity: float = _p(2.0, "of the knee among Fisher scores")
    mrmr_limit: int = _p(50, "features kept by relevance over redundancy")
    population_size: int = _p(20, "particles")
    n_particles: int | None = _p(None, "particles, before population_size")
    max_iter: int = _p(30, "iterations of the swarm")
    accuracy_sparsity_weight: float = _p(0.95, "weight of the error against the share of features used")
    w: float = _p(0.729, "inertia of a particle")
    c1: float = _p(1.49445, "pull of a particle's own best position")
    c2: float = _p(1.49445, "pull of the swarm's best position")
    stride: int = _p(10, "the swarm sees about every stride-th frame")
    n_rounds: int = _p(1, "rounds at most, each among what the one before selected")


@dataclass(frozen=True)
class Mpso:
    n_dimensions: int = _p(5, "dimensions that features are gathered in")
    candidate_limit: int | None = _p(None, "features kept by Fisher score; None finds the knee")
    knee_sensitivity: float = _p(2.0, "of the knee among Fisher scores")
    mrmr_limit: int = _p(60, "features kept by relevance over redundancy")
    optimization_iterations: int = _p(10, "iterations of the swarm")
    max_candidates: int = _p(40, "particles")
    accuracy_sparsity_weight: float = _p(0.9, "weight of the error against the share of places used")
    feature_threshold: float = _p(0.5, "position above which a feature is in a dimension")
    dimension_independence_penalty: float = _p(0.2, "weight of redundant and overlapping dimensions")
    sampling_stride: int = _p(15, "the swarm sees about every stride-th frame")
    n_rounds: int = _p(1, "rounds at most, each among the features in use")


@dataclass(frozen=True)
class FisherAmino:
    n_amino_outputs: int | None = _p(None, "most features that stand for clusters; None means 40")
    knee_sensitivity: float = _p(2.0, "of the knee among Fisher scores")
    bins: int | None = _p(20, "grid points of a feature's density")


@dataclass(frozen=True)
class ChiSqAmino:
    stride: int = _p(25, "counts are of about every stride-th frame")
    max_amino: int | None = _p(None, "most features that stand for clusters; None means 40")
    q_bins: int = _p(5, "quantile bins")
    knee_sensitivity: float = _p(5.0, "of the knee among chi-squared scores")
    bins: int | None = _p(20, "grid points of a feature's density")


@dataclass(frozen=True)
class Flda:
    num_eigenvector: int | None = _p(None, "components; None means 95 % of the variance")
    regularization: float = _p(1e-6, "added to the scatter within classes in the classical mode")


@dataclass(frozen=True)
class Pca:
    num_eigenvector: int | None = _p(None, "components; None means 95 % of the variance")


@dataclass(frozen=True)
class Mhlda:
    num_eigenvector: int | None = _p(None, "components; None means 95 % of the variance")
    regularization: float = _p(1e-4, "added to each class's scatter before it is inverted")


@dataclass(frozen=True)
class Descent:
    num_eigenvector: int | None = _p(None, "components; None means 95 % of the variance")
    learning_rate: float = _p(0.0001, "step of the descent")
    num_iteration: int = _p(1000, "steps at most")
    stop_crit: int = _p(30, "steps of little change after which the descent ends")
    convergence_threshold: float = _p(1e-5, "change that counts as little")


@dataclass(frozen=True)
class Gmm:
    stride: int = _p(10, "the number of states is found on about every stride-th frame")
    max_k: int = _p(15, "most states")
    sensitivity: float = _p(1.0, "of the knee of the criterion")


@dataclass(frozen=True)
class Spectral:
    components: int = _p(50, "landmarks")
    max_k: int = _p(15, "most states")


@dataclass(frozen=True)
class Tica:
    lag: int = _p(10, "frames between the two of a pair")
    components: int = _p(5, "slow components")
    max_k: int = _p(15, "most states")


@dataclass(frozen=True)
class Parameters:
    """Those of all operators; ``overridden`` changes some."""

    variance: Variance = Variance()
    bpso: Bpso = Bpso()
    mpso: Mpso = Mpso()
    fisher_amino: FisherAmino = FisherAmino()
    chi_sq_amino: ChiSqAmino = ChiSqAmino()
    flda: Flda = Flda()
    pca: Pca = Pca()
    zhlda: Descent = Descent()
    mhlda: Mhlda = Mhlda()
    gdhlda: Descent = Descent()
    gmm: Gmm = Gmm()
    spectral: Spectral = Spectral()
    tica: Tica = Tica()
    sample_rows: int | None = _p(None, "frames that swarms and mutual information are computed on, at most; None means all")
    seed: int = _p(42, "of samples and swarms")


def flattened(p: Parameters) -> list[tuple[str, Any, str]]:
    """(operator.name, value, help) of every parameter."""
    out = []
    for f in fields(p):
        own = getattr(p, f.name)
        if is_dataclass(own):
            out += [(f"{f.name}.{g.name}", getattr(own, g.name), g.metadata["help"]) for g in fields(own)]
        else:
            out.append((f.name, own, f.metadata["help"]))
    return out


def _typed(name: str, value: Any, kind: Any) -> Any:
    """value as its type says; text is read as that type."""
    kinds = get_args(kind) if isinstance(kind, UnionType) else (kind,)
    if value is None or (isinstance(value, str) and value.strip().lower() in ("none", "")):
        if type(None) in kinds:
            return None
        raise ValueError(f"{name} can't be None")
    want = next(k for k in kinds if k is not type(None))
    try:
        if isinstance(value, bool) or (want is int and float(value) != int(float(value))):
            raise ValueError
        return want(float(value)) if want is int else want(value)
    except (TypeError, ValueError):
        raise ValueError(f"{name} must be {want.__name__}, not {value!r}") from None


def overridden(p: Parameters, changes: dict[str, Any]) -> Parameters:
    """p with changes, named operator.name; unknown names and values of another type are refused."""
    known = {name for name, _, _ in flattened(p)}
    if wrong := sorted(set(changes) - known):
        raise ValueError(f"unknown parameters {', '.join(wrong)}; known are {', '.join(sorted(known))}")
    for name, value in changes.items():
        group, _, own = name.rpartition(".")
        part = getattr(p, group) if group else p
        part = replace(part, **{own: _typed(name, value, get_type_hints(type(part))[own])})
        p = replace(p, **{group: part}) if group else part
    return p
