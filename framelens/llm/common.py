"""Shared small helpers: table reads, stored intermediates, the word pattern."""

from __future__ import annotations

import tempfile
import uuid
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Keys of a join that are broadcast because they hold too many rows for one task, at most.
HOT_KEYS = 500
#: Rows that a key may always bring to one task.
LEAST_HOT = 500

_own_dir: list[str] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local session that sets none (tests) gets a folder of our own: executors on other
    machines could not read it.
    """
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="framelens-"))
    return _own_dir[0]


def stored(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder and read back.

    Cuts the lineage: a lost executor costs a re-read, never a recomputation, and what
    follows may scan the rows several times.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def key_of(column: str) -> Column:
    """A text key that keeps null apart from every value, so that plain joins can use it."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("~"))


def crc_fold(column: str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo folds; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def bounded_sample(labels: DataFrame, most: int) -> DataFrame:
    """_id, label, _rank of at most most ids of each label (0 and 1): those with the smallest digest of the id.

    labels: _id, label. An id that is labelled several times has its greatest label; null ids
    are left out. Texts are not touched, so choosing the sample moves a few bytes a row.
    """
    once = labels.where(F.col("_id").isNotNull() & F.col("label").isin(0, 1)).groupBy("_id").agg(F.max("label").alias("label"))
    order = [F.md5(F.col("_id").cast("string").cast("binary")), F.col("_id")]
    parts = [once.where(F.col("label") == k).orderBy(*order).limit(most) for k in (0, 1)]
    rank = F.row_number().over(Window.partitionBy("label").orderBy(*order))
    return stored(parts[0].unionByName(parts[1]).withColumn("_rank", rank))


def joined(big: DataFrame, small: DataFrame, keys: list[str], times: str, rows: int) -> DataFrame:
    """Inner join with one row of small per key, where a key may hold any share of the rows of big.

    times: how many rows of big a key has, a column of small (left out of the result). Keys
    with more than rows / HOT_KEYS of them are broadcast, at most HOT_KEYS rows of small; the
    rows of all other keys are shuffled, and no key of those is large. Both sides are read
    twice, so they should be stored or plain scans.
    """
    hot = F.col(times) > max(LEAST_HOT, rows // HOT_KEYS)
    few = F.broadcast(small.where(hot).drop(times))
    names = small.drop(times, *keys).columns
    rest = big.join(F.broadcast(small.where(hot).select(*keys)), keys, "left_anti").join(small.where(~hot).drop(times), keys)
    return big.join(few, keys).select(*big.columns, *names).unionByName(rest.select(*big.columns, *names))


def free(name: str, columns: list[str]) -> str:
    """name, with as many underscores behind it as keep it apart from columns in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def sampled(keys: DataFrame, parts: int, per: int = 20) -> tuple[list[tuple], int]:
    """(about per * parts rows of keys in ascending order, how many rows each stands for).

    A row is sampled by the digest of its values, so repeated keys are sampled together; at
    most 2 * per * parts rows come to the driver.
    """
    every = max(1, keys.count() // (per * parts))
    chosen = keys.where(F.pmod(F.xxhash64(*keys.columns, F.lit(11)), F.lit(every)) == 0)
    return sorted(tuple(r) for r in chosen.limit(2 * per * parts).collect()), every


def splitters(keys: DataFrame, parts: int) -> list[tuple]:
    """At most parts - 1 sampled tuples that cut keys into ranges of like size, in ascending order."""
    sample, _ = sampled(keys, parts)
    return sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []


def fold_of(doc_id, folds: int) -> int:
    return crc32(b"" if doc_id is None else str(doc_id).encode()) % folds
