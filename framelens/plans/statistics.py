"""Queries on moments, scaling, Fisher and chi-squared scores, and cuts."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelens.functions.features import feature_columns, to_array, to_long
from framelens.operators import contingency as C
from framelens.operators import moments as M
from framelens.operators import thresholds as T
from framelens.plans.registered import KNEE, LONG, query, table

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
WIDE = """long as (select l_returnflag as cls, unnest(range(0, 4))::INT as pos,
    unnest([l_quantity, l_extendedprice, l_discount, l_tax])::DOUBLE as x from lineitem)"""
PER_CLASS = """stats as (select {c} as cls, pos, count(x) n, avg(x) m, var_pop(x) * count(x) ss from long group by 1, 2),
    grand as (select pos, avg(x) g from long group by 1),
    joined as (select s.*, g.g from stats s join grand g using (pos))"""


def embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "features")


def lines(spark, sf_dir):
    """The line items as a frame table of four features, class by return flag."""
    return to_array(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", *NUMBERS), NUMBERS)


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("select count(*)::BIGINT as columns, string_agg(c, ',') as names from (select unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) as c) where (select count(*) from lineitem) > 0")
def o21_feature_columns(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    names = feature_columns(df, metadata=("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    return df.select(*names).limit(1).select(F.lit(len(names)).cast("long").alias("columns"), F.lit(",".join(names)).alias("names"))


@query(f"with {LONG} select pos, count(x) as n, round(avg(x), 6) as mean, round(var_pop(x), 6) as variance from long group by pos")
def o37_streaming_variance(spark, sf_dir):
    return rounded(M.variances(embeddings(spark, sf_dir)), "mean", "variance")


@query(f"with {WIDE} select cls as l_returnflag, pos, count(x) as n, round(avg(x), 6) as mean, round(var_pop(x), 4) as variance from long group by 1, 2")
def o38_class_moments(spark, sf_dir):
    m = M.class_moments(lines(spark, sf_dir), "l_returnflag")
    return m.select("l_returnflag", "pos", "n", F.round("mean", 6).alias("mean"), F.round(F.col("ss") / F.col("n"), 4).alias("variance"))


_FISHER = f"with {LONG}, {PER_CLASS.format(c='label')} select pos, round(sum(n * (m - g) * (m - g)) / ({{within}}), 6) as score from joined {{where}} group by pos"


@query(_FISHER.format(within="sum(n * ss / (n - 1)) + 1e-12", where="where n >= 2"))
def o39_fisher_pooled(spark, sf_dir):
    return rounded(M.fisher_pooled_samples(M.class_moments(embeddings(spark, sf_dir), "label")), "score")


@query(_FISHER.format(within="sum(greatest(ss, 0)) + 1e-12", where=""))
def o40_fisher_scatter(spark, sf_dir):
    return rounded(M.fisher_scatter(M.class_moments(embeddings(spark, sf_dir), "label")), "score")


@query(f"with {WIDE}, {PER_CLASS.format(c='cls')} select pos, round(sum(n * (m - g) * (m - g)) / (sum(ss) + 1e-12), 6) as score from joined group by pos")
def o41_fisher_lines(spark, sf_dir):
    return rounded(M.fisher_scatter(M.class_moments(lines(spark, sf_dir), "l_returnflag")), "score")


@query(_FISHER.format(within="sum(ss)", where=""))
def o42_fisher_laplacian(spark, sf_dir):
    return rounded(M.fisher_laplacian(M.class_moments(embeddings(spark, sf_dir), "label")), "score")


@query(f"with {LONG}, {PER_CLASS.format(c='label')} select round(sum(n * (m - g) * (m - g)) / (sum(ss) + 1e-9), 6) as separability from joined")
def o43_separability(spark, sf_dir):
    return rounded(M.separability(embeddings(spark, sf_dir), "label"), "separability")


@query(f"with {LONG}, {PER_CLASS.format(c='label')}, s as (select pos, sum(n * (m - g) * (m - g)) / (sum(ss) + 1e-9) as v from joined group by pos) select pos, round(v, 6) as separability, round(v / sum(v) over (), 6) as share from s")
def o43_component_separability(spark, sf_dir):
    return rounded(M.component_separability(embeddings(spark, sf_dir), "label"), "separability", "share")


def _scaling(kind):
    return f"with {LONG}, s as (select pos, {kind} from long group by pos) select vec_id, long.pos, round((x - shift) / scale, 5) as z from long join s using (pos)"


def _long(df, sf=None):
    return to_long(df, keep=["vec_id"]).select("vec_id", "pos", F.round("x", 5).alias("z"))


@query(_scaling("avg(x) as shift, case when stddev_samp(x) > 0 then stddev_samp(x) else 1.0 end as scale"))
def o32_standard_scaled(spark, sf_dir):
    return _long(M.standard_scaled(embeddings(spark, sf_dir)))


@query(_scaling("avg(x) as shift, case when stddev_pop(x) > 0 then stddev_pop(x) else 1.0 end as scale"))
def o33_population_scaled(spark, sf_dir):
    return _long(M.standard_scaled(embeddings(spark, sf_dir), sample=False))


@query(_scaling("min(x) as shift, case when max(x) > min(x) then max(x) - min(x) else 1.0 end as scale"))
def o34_min_max_scaled(spark, sf_dir):
    return _long(M.min_max_scaled(embeddings(spark, sf_dir)))


@query(_scaling("min(x) as shift, max(x) - min(x) + 1e-12 as scale"))
def o35_min_max_epsilon(spark, sf_dir):
    return _long(M.min_max_scaled(embeddings(spark, sf_dir), epsilon=1e-12))


@query(_scaling("0.0 as shift, case when sum(x * x) > 0 then sqrt(sum(x * x)) else 1.0 end as scale"))
def o36_l2_scaled(spark, sf_dir):
    return _long(M.l2_scaled(embeddings(spark, sf_dir)))


_EDGES = "q as (select pos, quantile_cont(x, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) as q from long group by pos)"
_BIN = "case when x <= q[2] then 0 when x <= q[3] then 1 when x <= q[4] then 2 when x <= q[5] then 3 else 4 end"


@query(f"with {LONG}, {_EDGES}, e as (select pos, unnest(range(0, 6))::INT as k, unnest(q) as edge from q) select pos, k, round(edge, 6) as edge from e")
def o44_quantile_edges(spark, sf_dir):
    edges = C.quantile_edges(embeddings(spark, sf_dir))
    return edges.select("pos", F.posexplode("edges").alias("k", "edge")).select("pos", "k", F.round("edge", 6).alias("edge"))


@query(f"with {LONG}, {_EDGES} select pos, ({_BIN})::INT as bin, count(*) as n from long join q using (pos) group by 1, 2")
def o45_binned(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    return C.binned(to_long(df), C.quantile_edges(df)).groupBy("pos", "bin").agg(F.count(F.lit(1)).alias("n"))


_CHI = f"""with {LONG}, {_EDGES}, b as (select label, pos, {_BIN} as bin from long join q using (pos)),
    o as (select pos, bin, label, count(*) as o from b group by all),
    r as (select pos, bin, sum(o) as r from o group by all), c as (select pos, label, sum(o) as c from o group by all),
    t as (select pos, sum(o) as t from o group by all),
    g as (select r.pos, coalesce(o.o, 0) as o, r.r * c.c / t.t as e from r join c using (pos) join t using (pos)
          left join o on o.pos = r.pos and o.bin = r.bin and o.label = c.label)
    select pos, round(sum((o - e) * (o - e) / e), 6) as score from g group by pos"""


@query(_CHI)
def o46_chi_squared(spark, sf_dir):
    return rounded(C.chi_squared(embeddings(spark, sf_dir), "label"), "score")


_VAR = f"with {LONG}, v as (select pos, var_pop(x) as variance from long group by pos)"


@query(f"{_VAR}, l as (select quantile_cont(variance, 0.75) + 0.5 * (quantile_cont(variance, 0.75) - quantile_cont(variance, 0.25)) as m from v) select pos, round(variance, 6) as variance from v, l where variance <= m")
def o52_iqr_outliers(spark, sf_dir):
    return rounded(T.without_outliers(M.variances(embeddings(spark, sf_dir)).select("pos", "variance"), "variance", 0.5), "variance")


@query(f"{_VAR} select pos, round(variance, 6) as variance from v where variance <= 100 * (select median(variance) from v)")
def o53_sane_variances(spark, sf_dir):
    return rounded(T.without_insane(M.variances(embeddings(spark, sf_dir)).select("pos", "variance"), "variance"), "variance")


@query(f"{_VAR}, s as (select *, sum(variance) over (order by variance desc, pos) / sum(variance) over () as running from v), p as (select *, coalesce(lag(running) over (order by variance desc, pos), 0) as b from s) select pos, round(variance, 6) as variance, round(running, 6) as running from p where b < 0.5")
def o55_cumulative_cut(spark, sf_dir):
    return rounded(T.cumulative_cut(M.variances(embeddings(spark, sf_dir)).select("pos", "variance"), "variance", 0.5), "variance", "running")


@query(f"with {LONG}, {PER_CLASS.format(c='label')}, s as (select pos, sum(n * (m - g) * (m - g)) / sum(ss) as score from joined group by pos) select pos, round(score, 6) as score, row_number() over (order by score desc, pos)::INT as rank from s")
def o56_ranked_scores(spark, sf_dir):
    return rounded(M.ranked(M.fisher_laplacian(M.class_moments(embeddings(spark, sf_dir), "label"))), "score")


@query(f"with {LONG}, {PER_CLASS.format(c='label')}, s as (select pos, sum(n * (m - g) * (m - g)) / sum(ss) as score from joined group by pos) select pos, round(score, 6) as score from s order by score desc, pos limit 10")
def o57_top_candidates(spark, sf_dir):
    return rounded(M.top(M.fisher_laplacian(M.class_moments(embeddings(spark, sf_dir), "label")), 10), "score")


@query(_CHI.rsplit("select pos, round(", 1)[0] + f", c2 as (select pos, sum((o - e) * (o - e) / e) as v from g group by pos), k as {KNEE.format(table='c2', sensitivity=1.0)} select pos, round(v, 6) as score from c2, k where v >= coalesce(level, (select quantile_cont(v, 0.9) from c2))")
def o58_knee_of_chi_squared(spark, sf_dir):
    return rounded(T.cut_by_knee(C.chi_squared(embeddings(spark, sf_dir), "label"), sensitivity=1.0), "score")


@query(f"{_VAR} select pos, round(variance, 6) as variance from v where variance > (select quantile_cont(variance, 0.9) from v)")
def o59_variance_percentile(spark, sf_dir):
    return rounded(T.above_percentile(M.variances(embeddings(spark, sf_dir)).select("pos", "variance"), "variance"), "variance")


#: Tables a (pos, v), q, clean and k (level) of a variance cut, from the variances of long.
VARIANCE_KNEE = f"""a as (select pos, var_pop(x) as v from long group by pos), q as (select quantile_cont(v, 0.75) + 3.0 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) as most from a),
    part as (select v from a, q where v <= most), clean as (select v from part where (select count(*) from part) >= 0.5 * (select count(*) from a) union all select v from a where (select count(*) from part) < 0.5 * (select count(*) from a)),
    k as {KNEE.format(table='clean', sensitivity=1.0)}"""
#: The level without a knee.
VARIANCE_LEVEL = "coalesce((select level from k), (select case when count(*) > 10 then quantile_cont(v, 0.9) else 2 * median(v) end from a))"


@query(f"with {LONG}, {VARIANCE_KNEE} select pos, round(v, 6) as variance from a where v > {VARIANCE_LEVEL}")
def o59_variance_knee(spark, sf_dir):
    return rounded(T.variance_cut(M.variances(embeddings(spark, sf_dir)).select("pos", "variance")), "variance")


@query(f"with {LONG}, {PER_CLASS.format(c='label')}, s as (select pos, sum(n * (m - g) * (m - g)) / (sum(n * ss / (n - 1)) + 1e-12) as v from joined where n >= 2 group by pos), k as {KNEE.format(table='s', sensitivity=1.0)} select pos, round(v, 6) as score from s, k where v >= coalesce(level, (select quantile_cont(v, 0.9) from s))")
def o60_fisher_knee_cut(spark, sf_dir):
    return rounded(T.cut_by_knee(M.fisher_pooled_samples(M.class_moments(embeddings(spark, sf_dir), "label"))), "score")
