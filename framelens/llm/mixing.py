"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Sizes are words. Each source gets a target of words; targets above ``cap`` times the
source's size are cut there and the excess is shared again by weight (water filling, in
closed form: the water level is the largest of the levels that follow when the first k
sources, ordered by the level at which they fill up, are full).

Within a source documents have unequal rates, in proportion to a weight: the fourth root
of their size in words, so that longer texts are likelier to come again, or a weight column.
Weights count in steps of an eighth of a doubling. A rate ends at ``cap`` copies and what is cut off there
is shared again among the other documents of the source, by the same water filling over the
weight classes of the source, so the source's expected words are its target.

A document of rate r has floor(r) certain copies; the rest p of the rate is its inclusion
probability for one more. Documents are ranked by Q = odds(U) / odds(p) with U a uniform
number from a digest of the id, and the smallest Q are taken until the source's remaining
words are reached: a sample of fixed size in words, whose inclusion probabilities are close
to the p. Since U depends on the id alone, reruns agree.

No source is ever collected or ranked as a whole: two histograms of Q (4,096 bins, then
4,096 within the bin at the border) find the border, so only the documents of one bin in
16.7 million are ranked by a window.

Defined results: null text has size 0 and takes 0; a null source is a source of its own,
last; rows that repeat an id are ranked side by side, by size; null, negative and zero weights
are the least weight class; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelens.llm.common import WORD, key_of, stored

BINS = 4096
#: 13 hexadecimal digits of a digest are 52 bits.
UNIT = float(1 << 52)
#: Weight classes in a doubling of the weight, and the least and greatest class.
CLASSES, LOWEST, HIGHEST = 8, -400, 400


def source_targets(sizes: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """One row per source: its size and its target (columns _s, _source, source_size, target)."""
    per = sizes.groupBy("_s", "_source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("_source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("_w", weight)
    per = per.withColumn("_cap", F.col("source_size") * F.lit(cap)).withColumn("_full", F.col("_cap") / F.col("_w"))
    before = everything.orderBy("_full", F.col("_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_cap_before", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    per = per.withColumn("_w_before", F.coalesce(F.sum("_w").over(before), F.lit(0)))
    total = F.lit(share) * F.sum("source_size").over(everything)
    level = (total - F.col("_cap_before")) / (F.sum("_w").over(everything) - F.col("_w_before"))
    per = per.withColumn("_level", level)
    per = per.withColumn("target", F.least(F.col("_cap"), F.max("_level").over(everything) * F.col("_w")))
    return per.select("_s", "_source", "source_size", "target")


def _border(rows: DataFrame, bin_column: str, before: str) -> DataFrame:
    """Per source the bin in which the running words pass what is left, and the words before it."""
    bins = rows.groupBy("_s", bin_column).agg(F.sum("size").alias("_words"), F.first("_left").alias("_left"), F.first(before).alias("_start"))
    running = Window.partitionBy("_s").orderBy(bin_column)
    bins = bins.withColumn("_upto", F.col("_start") + F.sum("_words").over(running))
    over = bins.where(F.col("_upto") > F.col("_left")).withColumn("_n", F.row_number().over(running)).where("_n = 1")
    return over.select("_s", F.col(bin_column).alias(f"_at{bin_column}"), (F.col("_upto") - F.col("_words")).alias(f"_before{bin_column}"))


def _sized(docs: DataFrame, weight_col: str | None) -> DataFrame:
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    out = docs.withColumns({"_source": F.col("source"), "size": size, "_s": key_of("source")})
    if weight_col:
        own = F.col(weight_col).cast("double")
        level = F.when(own > 0, F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), F.round(F.log2(own) * CLASSES)))).otherwise(F.lit(LOWEST))
    else:
        level = F.round(F.log2(F.col("size") + 1.0) * (CLASSES / 4))
    return out.withColumn("_class", level.cast("int"))


def _rates(sizes: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """_s, _class and the rate of its documents: at most cap, in proportion to the weight below it, adding up to the target."""
    per = sizes.groupBy("_s", "_class").agg(F.sum("size").alias("_words")).join(targets, "_s")
    per = per.withColumn("_a", F.pow(F.lit(2.0), F.col("_class") / F.lit(float(CLASSES))))
    own = Window.partitionBy("_s")
    before = own.orderBy(F.desc("_class")).rowsBetween(Window.unboundedPreceding, -1)
    after = own.orderBy(F.desc("_class")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full = F.lit(cap) * F.coalesce(F.sum("_words").over(before), F.lit(0))
    # The rate per weight: the largest of those that follow when the heaviest classes are full.
    per = per.withColumn("_each", F.try_divide(F.col("target") - full, F.sum(F.col("_a") * F.col("_words")).over(after)))
    rate = F.least(F.lit(float(cap)), F.greatest(F.lit(0.0), F.coalesce(F.max("_each").over(own), F.lit(0.0)) * F.col("_a")))
    return per.select("_s", "_class", "source_size", "target", "_words", F.round(rate, 9).alias("_rate"))


def _rated(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """rows with their certain copies (_whole) and the probability of one more (_p)."""
    rows = rows.join(rates, ["_s", "_class"]).withColumn("_whole", F.floor("_rate"))
    return rows.withColumn("_p", F.col("_rate") - F.col("_whole"))


def _ranked(rows: DataFrame) -> DataFrame:
    """rows with the ranking variable _q and its bins."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(UNIT)
    odds = (F.col("_u") / (F.lit(1.0) - F.col("_u"))) / (F.col("_p") / (F.lit(1.0) - F.col("_p")))
    rows = rows.withColumn("_u", u).withColumn("_q", F.when(F.col("_p") > 0, odds)).withColumn("_z", F.col("_q") / (F.lit(1.0) + F.col("_q")))
    return rows.withColumn("_b", F.floor(F.col("_z") * BINS)).withColumn("_f", F.floor(F.col("_z") * (BINS * BINS)))


def _copied(wide: DataFrame, sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """wide with size, source_size, target and copies. sizes: stored _s, _source, _class, size, doc_id of the same rows.

    Only narrow rows are shuffled, but for those in the bins at the border.
    """
    targets = source_targets(sizes, list(weights), share, cap).drop("_source")
    rates = stored(_rates(sizes, targets, cap))
    # Whole copies come from sums over the classes, so no document is read for them.
    certain = rates.groupBy("_s").agg(F.sum(F.floor("_rate") * F.col("_words")).alias("_certain"))
    rates = stored(rates.drop("_words").join(certain, "_s").withColumn("_left", F.col("target") - F.col("_certain")).drop("_certain"))

    may = _ranked(_rated(sizes, rates)).where("_q is not null").withColumn("_zero", F.lit(0))
    first = stored(_border(may, "_b", "_zero"))
    inside = may.join(first, "_s").where("_b = _at_b")
    # Sources without a border (all of their documents are taken) have no row here.
    second = stored(_border(inside, "_f", "_before_b"))
    rows = _ranked(_rated(wide, rates)).join(second, "_s", "left")
    at_border = F.coalesce(F.col("_f") == F.col("_at_f"), F.lit(False))
    sure = rows.where(~at_border).withColumn("_more", F.when(F.col("_q").isNull(), F.lit(0)).when(F.col("_at_f").isNull() | (F.col("_f") < F.col("_at_f")), F.lit(1)).otherwise(F.lit(0)))
    upto = F.sum("size").over(Window.partitionBy("_s").orderBy("_q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    middle = F.col("_before_f") + upto - F.col("size") / F.lit(2.0)
    border = rows.where(at_border).withColumn("_more", F.when(middle <= F.col("_left"), F.lit(1)).otherwise(F.lit(0)))
    return sure.unionByName(border).withColumn("copies", (F.col("_whole") + F.col("_more")).cast("long"))


NARROW = ["doc_id", "_source", "size", "_class", "_s"]


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, weight_col: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row of docs. Texts are read once."""
    named = docs.select("doc_id", "text", "source", *([weight_col] if weight_col else []))
    sizes = stored(_sized(named, weight_col).select(*NARROW))
    out = _copied(sizes, sizes, weights, share, cap)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The rows of docs as often as the mix takes them."""
    # Own columns travel in one struct, so that their names cannot clash.
    wide = _sized(docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_row")), None)
    out = _copied(wide.drop("text"), stored(wide.select(*NARROW)), weights, share, cap).where("copies > 0")
    return out.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


ORACLE = r"""
with sizes as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT as size from documents),
per as (select source, sum(size)::BIGINT as source_size from sizes group by source),
weighed as (select *, [5, 2, 1][((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::INT] as w from per),
filled as (select *, source_size * 2.0::DOUBLE as cap, source_size * 2.0::DOUBLE / w as full_at from weighed),
levels as (
  select *, (1.5::DOUBLE * sum(source_size) over ()::DOUBLE
      - coalesce(sum(cap) over (order by full_at, source asc nulls last rows between unbounded preceding and 1 preceding), 0.0))
    / (sum(w) over () - coalesce(sum(w) over (order by full_at, source asc nulls last rows between unbounded preceding and 1 preceding), 0))::DOUBLE as level
  from filled),
targets as (select source, source_size, least(cap, max(level) over () * w) as target from levels),
classed as (
  select s.doc_id, s.size, s.source, t.source_size, t.target, round(log2(s.size + 1.0::DOUBLE) * 2.0::DOUBLE)::INT as class
  from sizes s join targets t on s.source is not distinct from t.source),
classes as (select source, class, target, sum(size)::DOUBLE as words, power(2.0::DOUBLE, class / 8.0::DOUBLE) as a from classed group by source, class, target),
levelled as (
  select *, (target - 2.0::DOUBLE * coalesce(sum(words) over (partition by source order by class desc rows between unbounded preceding and 1 preceding), 0.0::DOUBLE))
    / nullif(sum(a * words) over (partition by source order by class desc rows between current row and unbounded following), 0.0::DOUBLE) as each
  from classes),
rates as (select source, class, round(least(2.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(max(each) over (partition by source), 0.0::DOUBLE) * a)), 9) as rate from levelled),
rated as (
  select c.*, r.rate, (('0x' || substr(md5(coalesce(c.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE as u
  from classed c join rates r on c.source is not distinct from r.source and c.class = r.class),
parts as (select *, floor(rate) as whole, rate - floor(rate) as p from rated),
ranked as (
  select *, case when p > 0 then (u / (1.0::DOUBLE - u)) / (p / (1.0::DOUBLE - p)) end as q,
    target - sum(whole * size) over (partition by source) as remaining
  from parts),
chosen as (
  select *, sum(size) over (partition by source, q is null order by q, doc_id, size rows unbounded preceding) as upto from ranked)
select doc_id, size, source_size, target,
  ((whole + case when q is not null and upto - size / 2.0::DOUBLE <= remaining then 1 else 0 end) * size)::BIGINT as taken,
  (whole + case when q is not null and upto - size / 2.0::DOUBLE <= remaining then 1 else 0 end)::BIGINT as copies
from chosen
"""
