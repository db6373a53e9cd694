"""Queries on filters, joins, composition and leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelens.functions import features as X
from framelens.operators import clustering as K
from framelens.operators import moments as M
from framelens.operators import tables as T
from framelens.plans.registered import LONG, query, table
from framelens.plans.statistics import embeddings, lines, rounded


def trajectories(spark, sf_dir):
    """Events as frames: a trajectory per user, in order of time."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("replica"), "ts", "event_id", "event_type", F.col("value"))


ORDER = ["ts", "event_id"]
_PATHS = """paths as (select 'base/' || event_type || '/' || (user_id % 5)::VARCHAR || '/' || (user_id % 7)::VARCHAR || '_s'
    || lpad((event_id % 3 * 100 + 1)::VARCHAR, 3, '0') || '_e' || lpad((event_id % 3 * 100 + 100)::VARCHAR, 3, '0') || '_pairwise_dist.' || case when event_id % 2 = 0 then 'h5' else 'npy' end as path from events)"""
_PARTS = r"""parts as (select path, regexp_extract(path, '([^/]+)/([^/]+)/([^/]+)_s(\d+)[^/]*\.(h5|npy)$', 1) as construct,
    regexp_extract(path, '([^/]+)/([^/]+)/([^/]+)_s(\d+)[^/]*\.(h5|npy)$', 2) as subconstruct,
    regexp_extract(path, '([^/]+)/([^/]+)/([^/]+)_s(\d+)[^/]*\.(h5|npy)$', 3) as replica,
    regexp_extract(path, '([^/]+)/([^/]+)/([^/]+)_s(\d+)[^/]*\.(h5|npy)$', 4)::INT - 1 as start_frame,
    regexp_extract(path, '([^/]+)/([^/]+)/([^/]+)_s(\d+)[^/]*\.(h5|npy)$', 5) as kind from (select distinct path from paths))"""


def event_paths(spark, sf_dir):
    """Paths of data files as the events would name them."""
    e = table(spark, sf_dir, "events")
    part = lambda c, width: F.lpad(c.cast("string"), width, "0")
    start = F.col("event_id") % 3 * 100
    kind = F.when(F.col("event_id") % 2 == 0, F.lit("h5")).otherwise(F.lit("npy"))
    return e.select(F.concat(F.lit("base/"), "event_type", F.lit("/"), (F.col("user_id") % 5).cast("string"), F.lit("/"), (F.col("user_id") % 7).cast("string"), F.lit("_s"), part(start + 1, 3), F.lit("_e"), part(start + 100, 3), F.lit("_pairwise_dist."), kind).alias("path"))


@query(f"with {_PATHS}, {_PARTS}, n as (select *, row_number() over (partition by construct, subconstruct, replica, start_frame order by kind) as n from parts) select construct, subconstruct, replica, start_frame, kind, path from n where n = 1")
def o01_file_discovery(spark, sf_dir):
    from framelens.sources.files import discovered

    return discovered(event_paths(spark, sf_dir))


@query("select c_custkey, c_mktsegment from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
def o02_filter_by_names(spark, sf_dir):
    return T.by_names(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), c_mktsegment=["BUILDING", "MACHINERY"])


@query("select r_name, string_agg(n_name, ',' order by n_name) as members from (select distinct r_name, n_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey) group by r_name")
def o03_catalogue(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return T.catalogue(rows, "r_name", "n_name").select("r_name", F.array_join("members", ",").alias("members"))


@query("with f as (select user_id as replica, value, row_number() over (partition by user_id order by ts, event_id) as frame_number from events), t as (select user_id as replica, row_number() over (partition by user_id order by event_id) - 1 as idx, event_id * 0.5 as time from events where event_type <> 'click') select f.replica, f.frame_number, t.time::DOUBLE as time from f left join t on f.replica = t.replica and f.frame_number = t.idx + 1")
def o12_time_join(spark, sf_dir):
    frames = T.numbered(trajectories(spark, sf_dir), ["replica"], ORDER)
    kept = trajectories(spark, sf_dir).where("event_type <> 'click'")
    times = T.numbered(kept, ["replica"], ["event_id"], 0).select("replica", F.col("frame_number").alias("idx"), (F.col("event_id") * 0.5).alias("time"))
    return T.with_times(frames, times, ["replica"]).select("replica", "frame_number", "time")


@query("select user_id as replica, event_id, (row_number() over (partition by user_id order by ts, event_id) + 100)::BIGINT as frame_number from events")
def o13_frame_numbers(spark, sf_dir):
    return T.numbered(trajectories(spark, sf_dir), ["replica"], ORDER, 101).select("replica", "event_id", "frame_number")


@query("with r as (select distinct l_quantity::INT as r from lineitem), n as (select a.r as res_i, b.r as res_j from r a join r b on a.r < b.r) select (row_number() over (order by res_i, res_j) - 1)::INT as pos, 'RES' || res_i || '_' || res_j as name, res_i, res_j from n")
def o22_pair_names(spark, sf_dir):
    return X.pair_names(table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("residue")))


@query("select user_id as replica, event_id, frame_number from (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as frame_number from events) where frame_number >= 5")
def o23_from_frame(spark, sf_dir):
    return T.from_frame(T.numbered(trajectories(spark, sf_dir), ["replica"], ORDER), 5).select("replica", "event_id", "frame_number")


@query(f"with {LONG} select vec_id, pos, case when pos % 7 <> 0 then round(x, 6) end as x from long")
def o24_masked_pairs(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    masked = df.select(F.explode(F.sequence(F.lit(0), F.size("features") - 1)).alias("pos")).distinct().where("pos % 7 = 0")
    return X.to_long(X.mask_pairs(df, masked), keep=["vec_id"]).select("vec_id", "pos", F.round("x", 6).alias("x"))


@query(
    """with r as (select distinct p_size as r from part where p_size % 17 <> 0), g as (select r, case when r - lag(r) over (order by r) > 1 or lag(r) over (order by r) is null then 1 else 0 end as new from r),
    i as (select r, sum(new) over (order by r) as island from g),
    e as (select r, row_number() over (partition by island order by r) as u, row_number() over (partition by island order by r desc) as d from i),
    k as (select r from e where u > 2 and d > 2) select a.r as res_i, b.r as res_j from k a join k b on a.r < b.r"""
)
def o25_boundary_clip(spark, sf_dir):
    names = X.pair_names(table(spark, sf_dir, "part").where("p_size % 17 <> 0").select(F.col("p_size").alias("residue")))
    return T.boundary_clip(names.select("res_i", "res_j"), 2)


@query("select vec_id, label, round(embedding[4]::DOUBLE, 6) as f3, round(embedding[1]::DOUBLE, 6) as f0, round(embedding[11]::DOUBLE, 6) as f10 from embeddings")
def o26_gather(spark, sf_dir):
    wide = X.to_wide(X.gather(embeddings(spark, sf_dir), [3, 0, 10]), ["f3", "f0", "f10"])
    return wide.select("vec_id", "label", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("f3", "f0", "f10")])


@query("select user_id as replica, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as n from events) where (n - 1) % 5 = 0")
def o27_stride(spark, sf_dir):
    return T.stride(trajectories(spark, sf_dir), ["replica"], ORDER, 5).select("replica", "event_id")


@query("select event_id, value from events order by ts, event_id limit 500")
def o28_head_sample(spark, sf_dir):
    return T.head(trajectories(spark, sf_dir), ORDER, 500).select("event_id", "value")


@query("select event_id, value from events order by md5('42:' || event_id::VARCHAR), event_id limit 2000")
def o29_random_sample(spark, sf_dir):
    return T.random_sample(table(spark, sf_dir, "events").select("event_id", "value"), 2000, key=["event_id"])


@query("select event_id, value from events where value is not null and not isnan(value) and abs(value) < 'infinity'::DOUBLE")
def o30_finite(spark, sf_dir):
    return T.finite(table(spark, sf_dir, "events").select("event_id", "value"), ["value"])


@query("select l_orderkey, string_agg(l_suppkey, ',' order by l_linenumber, l_suppkey) as suppliers from (select l_orderkey, l_suppkey, min(l_linenumber) as l_linenumber from lineitem group by 1, 2) group by l_orderkey")
def o31_distinct_names(spark, sf_dir):
    rows = T.distinct_in_order(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_suppkey", ["l_linenumber"], "suppliers")
    return rows.select("l_orderkey", F.array_join("suppliers", ",").alias("suppliers"))


_CORR = "corr({a}, {b})"
_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" union all ".join(f"select '{a}' as feature, '{b}' as component, round(coalesce(corr({a}, {b}), 0), 5) as r from lineitem" for a in _NUM for b in _NUM))
def o47_correlations(spark, sf_dir):
    return rounded(T.correlations(table(spark, sf_dir, "lineitem"), _NUM, _NUM), "r", digits=5)


_PROJ = "p as (select l_quantity, l_extendedprice, l_discount, l_tax, l_quantity * 0.5 + l_discount * 100 as d1, l_tax * 10 - l_extendedprice * 0.001 as d2 from lineitem)"
_PROJ_R = " union all ".join(f"select '{a}' as feature, '{b}' as component, coalesce(corr({a}, {b}), 0) as r from p" for a in _NUM for b in ("d1", "d2"))


def _projected(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*_NUM, (F.col("l_quantity") * 0.5 + F.col("l_discount") * 100).alias("d1"), (F.col("l_tax") * 10 - F.col("l_extendedprice") * 0.001).alias("d2"))


@query(f"with {_PROJ}, r as ({_PROJ_R}), k as (select *, row_number() over (partition by component order by abs(r) desc, feature)::INT as rank from r) select feature, component, round(r, 5) as r, rank from k where rank <= 3")
def o48_component_correlations(spark, sf_dir):
    return rounded(T.top_contributions(T.correlations(_projected(spark, sf_dir), _NUM, ["d1", "d2"]), 3), "r", digits=5)


@query(f"with {_PROJ}, r as ({_PROJ_R}), k as (select *, row_number() over (partition by component order by r desc, feature)::INT as rank from r) select feature, component, round(r, 5) as r, rank from k where rank <= 2")
def o49_feature_contributions(spark, sf_dir):
    return rounded(T.top_contributions(T.correlations(_projected(spark, sf_dir), _NUM, ["d1", "d2"]), 2, by_magnitude=False), "r", digits=5)


@query("select c_nationkey, c_mktsegment, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (partition by c_nationkey), 6) as percent from customer group by 1, 2")
def o50_composition(spark, sf_dir):
    return rounded(T.composition(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment"), "percent")


@query("select event_type, count(*) filter (user_id % 3 = 0) as n_0, count(*) filter (user_id % 3 = 1) as n_1, count(*) filter (user_id % 3 = 2) as n_2 from events group by 1")
def o50_crosstab(spark, sf_dir):
    return T.crosstab(table(spark, sf_dir, "events").withColumn("g", F.col("user_id") % 3), "event_type", "g", [0, 1, 2])


@query("select count(l_returnflag) as classes, sum(n)::BIGINT as rows, min(n) as least from (select l_returnflag, count(*) as n from lineitem group by 1)")
def o51_class_summary(spark, sf_dir):
    return T.class_summary(table(spark, sf_dir, "lineitem"), "l_returnflag")


@query(
    """with e as (select min(l_extendedprice) a, max(l_extendedprice) b, (max(l_extendedprice) - min(l_extendedprice)) / 20 w from lineitem),
    c as (select l_returnflag, least(floor((l_extendedprice - a) / w), 19)::INT as bin, count(*) n, any_value(w) w from lineitem, e group by 1, 2)
    select l_returnflag, bin, round(n / (sum(n) over (partition by l_returnflag) * w), 12) as density from c"""
)
def o54_density_histogram(spark, sf_dir):
    return rounded(T.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_returnflag", 20), "density", digits=12)


_SCORES = "s as (select event_type as pipeline, var_pop(value) as separability from events group by 1)"


@query(f"with {_SCORES} select pipeline, round(separability, 6) as separability, rank() over (order by separability desc)::INT as rank, round(separability / sum(separability) over (), 6) as share from s")
def o61_leaderboard(spark, sf_dir):
    scores = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("pipeline")).agg(F.var_pop("value").alias("separability"))
    return rounded(T.leaderboard(scores), "separability", "share")


@query(f"with {_SCORES} select arg_min(pipeline, separability) as pipeline from s")
def o62_best(spark, sf_dir):
    scores = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("pipeline")).agg(F.var_pop("value").alias("separability"))
    return T.best(scores, "pipeline", "separability")


@query("select o_orderkey, l_linenumber, o_orderstatus, l_quantity from orders join lineitem on o_orderkey = l_orderkey")
def o63_aligned_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey"), "o_orderstatus")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    return T.aligned(li, o, ["o_orderkey"]).select("o_orderkey", "l_linenumber", "o_orderstatus", "l_quantity")


@query("select d.doc_id, l.quality from documents d left join labels l using (doc_id)")
def o64_assign_column(spark, sf_dir):
    return T.with_column_of(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "quality", ["doc_id"])


@query("select l_orderkey, l_linenumber from lineitem where l_partkey in (select p_partkey from part where p_size > 25)")
def o65_selected_features(spark, sf_dir):
    chosen = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return T.among(table(spark, sf_dir, "lineitem"), chosen, ["l_partkey"]).select("l_orderkey", "l_linenumber")


@query("select l_orderkey, l_linenumber from lineitem where l_partkey not in (select p_partkey from part where p_size > 25)")
def o66_excluded_features(spark, sf_dir):
    gone = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return T.not_among(table(spark, sf_dir, "lineitem"), gone, ["l_partkey"]).select("l_orderkey", "l_linenumber")


@query("with c as (select distinct label from embeddings) select a.label as a, b.label as b from c a join c b on a.label < b.label")
def o67_class_pairs(spark, sf_dir):
    return T.class_pairs(table(spark, sf_dir, "embeddings"), "label")


@query("select a.o_orderpriority as feature_selection, b.c_mktsegment as dimensionality_reduction, a.o_orderpriority || ' | ' || b.c_mktsegment as name from (select distinct o_orderpriority from orders) a, (select distinct c_mktsegment from customer) b")
def o68_config_product(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("feature_selection"))
    return T.products(a, table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("dimensionality_reduction")))


@query("select c_custkey as id, c_acctbal as balance from customer union all select s_suppkey, s_acctbal from supplier")
def o69_concatenated(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return T.unioned([c, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))])


@query("select c_nationkey as key from customer union select s_nationkey from supplier")
def o70_feature_union(spark, sf_dir):
    return T.united([table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"))])


@query("with p as (select value, lead(value, 5) over (partition by user_id order by ts, event_id) as later, user_id from events), m as (select * from p where later is not null), a as (select avg(value) as a, avg(later) as b from m) select count(*) as n, round(avg((value - a) * (later - b)), 4) as covariance from m, a")
def o74_lag_covariance(spark, sf_dir):
    pairs = K.lag_pairs(trajectories(spark, sf_dir), ["replica"], ORDER, "value", 5).select(F.col("x").alias("value"), "later")
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.round(F.covar_pop("value", "later"), 4).alias("covariance"))


@query("select c_custkey, case when c_mktsegment = 'BUILDING' and c_nationkey = 1 then 1 when c_mktsegment = 'BUILDING' and c_nationkey = 2 then 2 when c_mktsegment = 'MACHINERY' and c_nationkey = 1 then 3 else 0 end::INT as class from customer")
def o97_class_map(spark, sf_dir):
    known = {("BUILDING", 1): 1, ("BUILDING", 2): 2, ("MACHINERY", 1): 3}
    return T.mapped_class(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"], known).select("c_custkey", "class")


@query("select user_id as replica, event_id, ((((row_number() over (partition by user_id order by ts, event_id) - 1) // 4) % 3) + 1)::INT as class from events")
def o98_block_labels(spark, sf_dir):
    return T.block_labels(trajectories(spark, sf_dir), ["replica"], ORDER, 4, 3, 1).select("replica", "event_id", "class")


@query("select a.l_orderkey, a.l_linenumber as i, b.l_linenumber as j, round(sqrt(power(a.l_quantity - b.l_quantity, 2) + power(a.l_discount - b.l_discount, 2) + power(a.l_tax - b.l_tax, 2)), 6) as distance from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber")
def o108_pairwise_distances(spark, sf_dir):
    d = X.pairwise_distances(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", ["l_quantity", "l_discount", "l_tax"])
    return rounded(d, "distance")


@query("with p as (select a.p_size as i, b.p_size as j, (a.p_size * b.p_size)::DOUBLE as x from (select distinct p_size from part) a join (select distinct p_size from part) b on a.p_size < b.p_size) select i, j, x from p union all select j, i, x from p union all select i, i, 0.0 from (select i from p union select j from p)")
def o109_square_form(spark, sf_dir):
    s = table(spark, sf_dir, "part").select("p_size").distinct()
    pairs = s.select(F.col("p_size").alias("i")).join(s.select(F.col("p_size").alias("j")), F.col("i") < F.col("j"))
    return X.square_form(pairs.withColumn("x", (F.col("i") * F.col("j")).cast("double")))


@query("select l_orderkey, l_linenumber, l_quantity, 1 as class from lineitem where l_returnflag = 'A' union all select l_orderkey, l_linenumber, l_quantity, 2 from lineitem where l_returnflag = 'N'")
def o110_labelled_union(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return T.unioned([li.where(F.col("l_returnflag") == f).drop("l_returnflag") for f in ("A", "N")], [1, 2])


@query("select regexp_extract(name, '(?i)^RES(\\d+)_(\\d+)', 1)::INT as res_i, regexp_extract(name, '(?i)^RES(\\d+)_(\\d+)', 2)::INT as res_j, count(*) as n from (select 'res' || l_linenumber || '_' || l_quantity::INT as name from lineitem) group by 1, 2")
def o25_parsed_names(spark, sf_dir):
    names = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("res"), "l_linenumber", F.lit("_"), F.col("l_quantity").cast("int")).alias("name"))
    return names.select(*X.parse_pair()).groupBy("res_i", "res_j").agg(F.count(F.lit(1)).alias("n"))


@query("with s as (select event_type, (user_id % 3)::INT as g, avg(value) as v, count(*) as n from events group by 1, 2) select event_type, g, n, round(v, 6) as mean, row_number() over (order by v desc, event_type, g)::INT as rank from s")
def o96_grid_search(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("g", (F.col("user_id") % 3).cast("int"))
    return rounded(T.ranked_grid(rows, ["event_type", "g"], "value"), "mean")


@query("select l_returnflag, count(*) as n_frames, 4 as n_features, round(avg(l_quantity), 6) as mean_quantity from lineitem group by 1")
def o20_run_summary(spark, sf_dir):
    df = lines(spark, sf_dir)
    return df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_frames"), F.max(F.size("features")).alias("n_features"), F.round(F.avg(F.get("features", F.lit(0))), 6).alias("mean_quantity"))


@query(f"with {LONG}, v as (select pos, var_pop(x) as variance from long group by 1), k as (select pos from v order by variance desc, pos limit 20) select vec_id, count(*) as n, round(sum(x), 5) as total from long where pos in (select pos from k) group by 1")
def o99_variance_filter(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    kept = M.top(M.variances(df), 20, "variance").select("pos")
    return X.to_long(df, keep=["vec_id"]).join(kept, "pos", "left_semi").groupBy("vec_id").agg(F.count("x").alias("n"), F.round(F.sum("x"), 5).alias("total"))
