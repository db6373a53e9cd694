"""Quality rules by robust multivariate outliers (DataFrame functions only).

Plain statistics of every whole text, then one minimum-covariance-determinant (MCD)
estimate of centre and scatter per language and source, then rejection by Mahalanobis
distance.

The MCD subset of each group is found by concentration steps: distances under the current
estimate, the ``SUBSET`` share of rows with the smallest ones, a new mean and covariance
from those. There are two deterministic starts, coordinate-wise medians with interquartile
ranges and the plain mean with the plain covariance; after ``STEPS`` steps each group keeps
the start of smaller determinant. Both are made consistent for normal data, and one
reweighting follows: mean and covariance of the rows within the 0.975 quantile of the
chi-squared distribution. A document is rejected beyond its 0.999 quantile.

One step is one aggregation: rows are counted and summed by (group, start, bin of log
distance) with partial sums on the map side, a window over the at most 241 bins of a group
keeps the smallest, and a second small aggregation adds them up. So a group is never
gathered, however large. Statistics are whole thousandths, so sums are exact and reruns
agree.

Every group has its own estimate, whatever its size: its sums are joined by those of
``PRIOR`` typical documents of its language, and a language's by as many typical documents
of the table. So an estimate moves smoothly from the language's to the group's own as the
group grows. A statistic deviates by at least its ``STEP``, what one more symbol, repeated
line, repeated window or capital makes in a text of 100 words, so that constant statistics
do not make a scatter singular.

Defined results: null text has no words; null lang or source are values of their own;
an empty table gives an empty table; rows are judged one by one, repeats included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelens.llm.common import WORD, joined, key_of, stored

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
#: Share of a group that the covariance is estimated from.
SUBSET = 0.75
STEPS = 4
#: Documents that an estimate weighs as much as its group's own when it borrows from what contains the group.
PRIOR = 60
#: Quantiles of the chi-squared distribution with six degrees of freedom.
CHI2_975, CHI2_999 = 14.449, 22.458
#: Factors that make the covariance of the nearest 75 % and 97.5 % of normal rows consistent: share / P(chi2(8) <= quantile of chi2(6)).
CONSISTENT_75, CONSISTENT_975 = 1.3619, 1.0493
#: Least deviation of each statistic, in thousandths: one step of it in a text of 100 words.
STEP = (100.0, 50.0, 150.0, 500.0, 700.0, 130.0)
#: Groups up to which their estimates are broadcast whole (about 500 bytes each).
MAX_BROADCAST = 20_000
STATS = [f"_x{i}" for i in range(len(STEP))]
BINS_PER_E, LOW_BIN, HIGH_BIN = 8, -80, 160


def text_statistics(docs: DataFrame) -> DataFrame:
    """The five counts of every text and the letters in upper case, with doc_id, lang, source."""
    text = F.coalesce("text", F.lit(""))
    out = docs.select("doc_id", "lang", "source", text.alias("_t")).withColumn("_words", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)))
    out = out.withColumn("_n", F.size("_words")).withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)))
    windows = F.transform(F.sequence(F.lit(1), F.col("_n") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, F.lit(WINDOW))))
    out = out.withColumn("_h", F.when(F.col("_n") >= WINDOW, windows))
    # Windows with different digests differ; only texts with an equal pair are looked at word by word.
    out = out.withColumn("_twice", F.coalesce(F.size(F.array_distinct("_h")) < F.size("_h"), F.lit(False)))
    digests = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i"))))
    out = out.withColumn("_sorted", F.when(F.col("_twice"), digests))
    alike = lambda f: lambda x, i: (x[f] == F.get("_sorted", i - 1)[f]) | (x[f] == F.get("_sorted", i + 1)[f])
    spelt = F.transform(F.filter("_sorted", alike("h")), lambda x: F.struct(F.array_join(F.slice("_words", x["i"], F.lit(WINDOW)), " ").alias("s"), x["i"].alias("i")))
    out = out.withColumn("_sorted", F.array_sort(spelt))
    hits = F.array_sort(F.transform(F.filter("_sorted", alike("s")), lambda x: x["i"]))
    covered = F.aggregate(hits, F.struct(F.lit(0).alias("c"), F.lit(-WINDOW).alias("last")), lambda a, x: F.struct((a["c"] + F.least(F.lit(WINDOW), x - a["last"])).alias("c"), x.alias("last")), lambda a: a["c"])
    less = lambda chars: F.length("_t") - F.length(F.translate("_t", chars, ""))
    return out.select(
        "doc_id", "lang", "source",
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        less(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_twice"), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("_n_lines"),
        less("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("_n_upper"),
    )


def _transformed() -> list[Column]:
    """The statistics as whole thousandths, on scales where ordinary texts are near symmetric."""
    n, chars = F.col("n_words"), F.col("word_chars")
    share = lambda part, whole, least, times=100: F.log1p(times * part / (whole + least))
    values = [
        F.log1p(n),
        F.log((chars + 120) / (n + 20)),
        share(F.col("n_symbols"), chars, 100),
        # Ordinary texts repeat a heading now and then: small shares of repeats stay small.
        share(F.col("n_dup_lines"), F.col("_n_lines"), 10, 10),
        share(F.col("n_repeat_words"), n, 50, 10),
        share(F.col("_n_upper"), chars, 200),
    ]
    return [F.round(v * 1000).cast("long").alias(x) for v, x in zip(values, STATS, strict=True)]


def _distance(rows: DataFrame) -> DataFrame:
    """Adds _d: the squared distance by forward substitution in the group's Cholesky factor."""
    for i in range(len(STATS)):
        rest = "".join(f" - _l{i}_{j} * _z{j}" for j in range(i))
        rows = rows.withColumn(f"_z{i}", F.expr(f"({STATS[i]} - _m{i}{rest}) / _l{i}_{i}"))
    return rows.withColumn("_d", F.expr(" + ".join(f"_z{i} * _z{i}" for i in range(len(STATS)))))


#: (row, column) of the lower triangle.
TRIANGLE = [(i, j) for i in range(len(STATS)) for j in range(i + 1)]
SUMS = ["_c", *(f"_s{i}" for i in range(len(STATS))), *(f"_p{i}_{j}" for i, j in TRIANGLE)]
ESTIMATE = [*(f"_m{i}" for i in range(len(STATS))), *(f"_l{i}_{j}" for i, j in TRIANGLE)]


def _sums() -> list[Column]:
    sums = ["count(1) as _c", *(f"sum({x}) as _s{i}" for i, x in enumerate(STATS)), *(f"sum({STATS[i]} * {STATS[j]}) as _p{i}_{j}" for i, j in TRIANGLE)]
    return [F.expr(x) for x in sums]


def _added(df: DataFrame, keys: list[str], prefix: str = "") -> DataFrame:
    return df.groupBy(*keys).agg(*[F.expr(f"sum({c}) as {prefix}{c}") for c in SUMS])


def _subset(rows: DataFrame) -> DataFrame:
    """Sums over the share of each group and start with the smallest distances."""
    bin_of = F.greatest(F.lit(LOW_BIN), F.least(F.lit(HIGH_BIN), F.floor(BINS_PER_E * F.log(F.col("_d") + 1e-9))))
    bins = rows.withColumn("_bin", bin_of).groupBy("_g", "_l", "_start", "_bin").agg(*_sums())
    group = Window.partitionBy("_g", "_start")
    before = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    kept = bins.withColumn("_all", F.sum("_c").over(group)).withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    kept = kept.where(F.col("_before") < F.col("_all") * SUBSET)
    return _added(kept, ["_g", "_l", "_start"])


def _shrunk(sums: DataFrame) -> DataFrame:
    """sums with those of PRIOR typical documents added: of the language, itself joined by as many of the table."""
    sums = stored(sums)  # read three times below
    borrowed = lambda c: f"{c} + {float(PRIOR)} * _u{c} / _u_c"
    whole, languages = _added(sums, ["_start"], "_u"), _added(sums, ["_l", "_start"])
    languages = languages.join(F.broadcast(whole), "_start").selectExpr("_l", "_start", *[f"{borrowed(c)} as _u{c}" for c in SUMS])  # one row per start
    return sums.join(languages, ["_l", "_start"]).selectExpr("_g", "_l", "_start", *[f"{borrowed(c)} as {c}" for c in SUMS])


def _cholesky(sums: DataFrame, factor: float) -> DataFrame:
    """Mean and Cholesky factor of the covariance (times factor) from sums, and the logarithm of its determinant."""
    d = len(STATS)
    out = sums.selectExpr(
        "_g", "_l", "_start", *[f"_s{i} / _c as _m{i}" for i in range(d)],
        *[f"(_p{i}_{j} / _c - (_s{i} / _c) * (_s{j} / _c)) * {factor} as _p{i}_{j}" for i, j in TRIANGLE],
    )
    for j in range(d):  # column by column: a column's entries follow from those to their left
        less = lambda i, j=j: "".join(f" - _l{i}_{k} * _l{j}_{k}" for k in range(j))
        # Rounding aside, what a statistic varies beyond the others is positive.
        out = out.withColumn(f"_l{j}_{j}", F.expr(f"sqrt(greatest(greatest(_p{j}_{j}, {STEP[j] ** 2}D){less(j)}, {(0.1 * STEP[j]) ** 2}D))"))
        if j + 1 < d:
            out = out.withColumns({f"_l{i}_{j}": F.expr(f"(_p{i}_{j}{less(i)}) / _l{j}_{j}") for i in range(j + 1, d)})
    determinant = " + ".join(f"ln(_l{i}_{i})" for i in range(d))
    return out.selectExpr("_g", "_l", "_start", f"{determinant} as _log", *ESTIMATE)


def _starts(rows: DataFrame) -> DataFrame:
    """Medians with interquartile ranges, and means with covariances, of every group."""
    quartiles = rows.groupBy("_g", "_l").agg(*[F.percentile_approx(x, [0.25, 0.5, 0.75], 2000).alias(x) for x in STATS])
    near = lambda c: F.round(c / 50.0) * 50.0  # noqa: E731  far coarser than what the order of merging can change
    columns = [near(F.col(x)[1]).alias(f"_m{i}") for i, x in enumerate(STATS)]
    for i, x in enumerate(STATS):
        columns += [F.lit(0.0).alias(f"_l{i}_{j}") for j in range(i)]
        columns.append(F.greatest(near(F.col(x)[2] - F.col(x)[0]) / 1.349, F.lit(STEP[i])).alias(f"_l{i}_{i}"))
    medians = quartiles.select("_g", "_l", F.lit(0).alias("_start"), F.lit(0.0).alias("_log"), *columns)
    plain = rows.groupBy("_g", "_l").agg(*_sums()).withColumn("_start", F.lit(1))
    return medians.unionByName(_cholesky(_shrunk(plain), 1.0))


def _with(rows: DataFrame, params: DataFrame, groups: int, total: int) -> DataFrame:
    """rows once for every start of their group's estimates. Only groups past MAX_BROADCAST shuffle rows, large ones not even then."""
    packed = params.groupBy("_g").agg(F.collect_list(F.struct("_start", *ESTIMATE)).alias("_e"))  # two at most
    if groups <= MAX_BROADCAST:
        out = rows.join(F.broadcast(packed), "_g")
    else:
        counts = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_times"))
        out = joined(rows, stored(packed.join(counts, "_g")), ["_g"], "_times", total)
    return _distance(out.select(*rows.columns, F.explode("_e").alias("_p")).select(*rows.columns, "_p.*"))


def robust_outliers(docs: DataFrame, cutoff: float = CHI2_999) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the squared robust distance of every row."""
    rows = stored(text_statistics(docs))
    rows = rows.withColumn("_l", key_of("lang")).withColumn("_g", F.concat("_l", F.lit("\t"), key_of("source")))
    rows = rows.select("*", *_transformed())
    total, groups = rows.agg(F.count(F.lit(1)), F.count_distinct("_g")).first()
    params = stored(_starts(rows))
    for _ in range(STEPS):
        params = stored(_cholesky(_shrunk(_subset(_with(rows, params, groups, total))), CONSISTENT_75))
    best = F.row_number().over(Window.partitionBy("_g").orderBy("_log", "_start"))
    raw = stored(params.withColumn("_n", best).where("_n = 1").drop("_n"))
    near = _with(rows, raw, groups, total).where(F.col("_d") <= CHI2_975)
    # A group all of whose rows lie beyond its borrowed estimate keeps that estimate.
    reweighted = _cholesky(_shrunk(near.withColumn("_start", F.lit(0)).groupBy("_g", "_l", "_start").agg(*_sums())), CONSISTENT_975)
    kept = raw.join(reweighted.select("_g"), "_g", "left_anti").withColumn("_start", F.lit(0))
    params = stored(reweighted.unionByName(kept.select(*reweighted.columns)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return _with(rows, params, groups, total).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("_d") <= cutoff)).alias("kept"), F.round("_d", 6).alias("distance"),
    )
