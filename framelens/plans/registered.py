"""Where queries and their SQL oracles are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The long view of embeddings in the oracle's dialect.
LONG = "long as (select vec_id, label, unnest(range(0, len(embedding)))::INT as pos, unnest(embedding)::DOUBLE as x from embeddings)"


#: The knee of the values v of a table, as one row of level (null without one), in the oracle's dialect.
KNEE = """(with s as (select v, (row_number() over (order by v desc) - 1)::DOUBLE as i, count(*) over () as n, max(v) over () as hi, min(v) over () as lo from {table}),
    h as (select i, v, n, (hi - v) / (hi - lo) - i / (n - 1) as h from s where n >= 3 and hi > lo),
    e as (select *, i > 0 and i < n - 1 and h >= lag(h) over w and h >= lead(h) over w as peak, i > 0 and i < n - 1 and h <= lag(h) over w and h <= lead(h) over w as dip from h window w as (order by i)),
    t as (select *, last_value(case when peak then i end ignore nulls) over (order by i rows unbounded preceding) as top,
        last_value(case when peak then h - {sensitivity} / (n - 1) when dip then 0.0 end ignore nulls) over (order by i rows unbounded preceding) as bound from e)
    select max(v) as level from h where i = (select top from t where top is not null and i > top and h < bound order by i limit 1))"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
