"""Queries on files of frames, which Spark writes from the given tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from framelens.operators import tables as T
from framelens.plans.registered import query
from framelens.plans.statistics import embeddings
from framelens.sources import files
from framelens.sources.shared import shared_dir

ROWS = 100
_FRAMES = """f as (select 'c' || (label % 3) as construct, 's' || (label % 2) as subconstruct, (vec_id % 4)::VARCHAR as replica, vec_id, embedding,
    row_number() over (partition by label % 3, label % 2, vec_id % 4 order by vec_id) as frame_number from embeddings)"""


def written(spark, sf_dir) -> str:
    """The embeddings as files of at most ROWS frames below a new shared folder."""
    text = lambda c: c.cast("string")
    df = embeddings(spark, sf_dir).select(
        F.concat(F.lit("c"), text(F.col("label") % 3)).alias("construct"), F.concat(F.lit("s"), text(F.col("label") % 2)).alias("subconstruct"),
        text(F.col("vec_id") % 4).alias("replica"), "vec_id", "features",
    )
    base = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    files.save_npy(T.numbered(df, ["construct", "subconstruct", "replica"], ["vec_id"]), base, ROWS)
    return base


@query(f"with {_FRAMES} select construct, subconstruct, replica, frame_number, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) as total from f where construct in ('c1', 'c2') and frame_number between 3 and 150")
def o06_unified_scan(spark, sf_dir):
    """Frames written as files and read back, names and frame numbers taken over by the scan."""
    df = files.frames(spark, written(spark, sf_dir), where="construct in ('c1', 'c2') and frame_number >= 3 and frame_number <= 150")
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return df.select("construct", "subconstruct", "replica", "frame_number", F.round(total, 4).alias("total"))


@query(f"with {_FRAMES} select construct, subconstruct, replica, ((frame_number - 1) // {ROWS} * {ROWS})::INT as start_frame, count(*) as rows, max(len(embedding))::INT as width, 'float32' as dtype from f group by all")
def o11_file_inventory(spark, sf_dir):
    found = files.inventory(spark, written(spark, sf_dir)).where("reason is null")
    return found.select("construct", "subconstruct", "replica", "start_frame", "rows", "width", "dtype")
