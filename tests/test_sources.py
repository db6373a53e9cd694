"""Files, sinks and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelens.operators.moments import class_moments
from framelens.sources import files
from framelens.streaming import moments as streaming


@pytest.fixture
def base(tmp_path):
    rng = np.random.default_rng(1)
    for construct in ("A", "B"):
        for sub in ("x", "y"):
            at = tmp_path / "base" / construct / sub
            at.mkdir(parents=True)
            np.save(at / "time.npy", np.arange(40) * 0.5)
            for replica in (1, 2):
                for first in (1, 21):
                    np.save(at / f"{replica}_s{first:03d}_e{first + 19:03d}_pairwise_dist.npy", rng.random((20, 6), np.float32))
    np.save(tmp_path / "base" / "canonical_resids.npy", np.array([3, 4, 7, 150]))
    return str(tmp_path / "base")


def test_frames(spark, base):
    df = files.frames(spark, base, rows_per_partition=7)
    assert df.count() == 2 * 2 * 2 * 40
    one = df.where("construct = 'A' and subconstruct = 'y' and replica = '2' and frame_number = 22").first()
    assert one["time"] == 10.5 and len(one["features"]) == 6
    assert files.frames(spark, base, ["A"], min_frame=31).groupBy("construct").count().collect()[0]["count"] == 2 * 2 * 10
    assert files.residues(base).tolist() == [3, 4, 7, 150] and files.residues("/nowhere") is None
    assert files.file_summary(df).count() == 8
    assert files.listed(spark, base).count() == 16


def corrupt(path):
    with open(path, "wb") as f:
        f.write(b"broken")


def test_broken_files(spark, base):
    corrupt(f"{base}/A/x/3_s001_e020_pairwise_dist.npy")
    np.save(f"{base}/A/x/4_s001_e020_pairwise_dist.npy", np.zeros(5))
    with pytest.raises(ValueError, match="2 files cannot be read"):
        files.frames(spark, base)
    assert files.frames(spark, base, skip_broken=True).count() == 320
    assert files.frames(spark, base, planned=False, skip_broken=True).where("replica <> '4'").count() == 320
    found = files.inventory(spark, base)
    bad = files.broken_files(found).collect()
    assert {r["path"].rpartition("/")[2][0] for r in bad} == {"3", "4"} and all(r["reason"] for r in bad)
    good = found.where("reason is null").first()
    assert (good["rows"], good["width"], good["dtype"], good["kind"]) == (20, 6, "float32", "npy") and good["bytes"] > 480
    with pytest.raises(Exception):  # noqa: B017
        files.frames(spark, base, planned=False).count()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_are_pushed(spark, base):
    """Names and frame numbers are the source's own filters: nothing is left to Spark, and other files are never opened."""
    kept = lambda where, skip=True: files.frames(spark, base, where=where, rows_per_partition=7, skip_broken=skip)
    whole = kept("construct in ('B', 'C') and subconstruct = 'x' and frame_number > 22 and frame_number <= 30", False)
    for sub in ("x", "y"):
        for replica in (1, 2):
            for first in (1, 21):
                corrupt(f"{base}/A/{sub}/{replica}_s{first:03d}_e{first + 19:03d}_pairwise_dist.npy")
    corrupt(f"{base}/B/x/1_s001_e020_pairwise_dist.npy")
    corrupt(f"{base}/B/x/2_s001_e020_pairwise_dist.npy")
    assert "Filter (" not in plan(whole)
    want = [(k, n) for k in "12" for n in range(23, 31)]
    assert sorted((r["replica"], r["frame_number"]) for r in whole.collect()) == want
    assert whole.rdd.getNumPartitions() == 4
    both = kept("construct = 'B' and subconstruct = 'y' and frame_number >= 5 and time < 3 and replica like '1%'")
    assert "Filter (" in plan(both) and "time" in plan(both)
    assert both.count() == 2
    assert kept("construct = 'B' and construct = 'A'").count() == 0
    assert kept("construct = 'B' and subconstruct = 'y' and frame_number = 21").count() == 2
    assert files.frames(spark, base, ["B"], ["y"], min_frame=40, planned=False).count() == 2
    # Queries on one table, filtered further or not, one after the other or in one plan, don't disturb each other.
    first, second = whole.where("frame_number = 23"), whole.where("frame_number > 24")
    assert (first.count(), whole.count(), second.count(), whole.count()) == (2, 16, 12, 16)
    assert sorted(r["frame_number"] for r in first.union(second).union(whole).collect()) == sorted([23] * 4 + [24] * 2 + [n for n in range(25, 31) for _ in range(4)])
    assert whole.alias("a").join(whole.alias("b"), ["replica", "frame_number"]).count() == 16


def test_many_files_are_planned_without_opening_them(spark, tmp_path):
    at = tmp_path / "many" / "A" / "x"
    at.mkdir(parents=True)
    np.save(at / "0_s001_e002_pairwise_dist.npy", np.zeros((2, 3), np.float32))
    whole = (at / "0_s001_e002_pairwise_dist.npy").read_bytes()
    for k in range(1, 10_000):
        (at / f"{k}_s001_e002_pairwise_dist.npy").write_bytes(whole if k % 100 else b"")
    found = files.inventory(spark, str(tmp_path / "many"))
    assert found.count() == 10_000 and files.broken_files(found).count() == 99
    df = files.frames(spark, str(tmp_path / "many"), skip_broken=True)
    assert df.where("replica = '7'").count() == 2


def test_times_that_are_too_short_give_places(spark, base):
    np.save(f"{base}/A/x/time.npy", np.arange(30) * 0.5)
    rows = files.frames(spark, base, ["A"], ["x"]).where("replica = '1'").orderBy("frame_number").collect()
    assert [r["time"] for r in rows] == [*np.arange(20) * 0.5, *range(20)]


def test_npy_round_trip(spark, base, tmp_path):
    df = files.frames(spark, base)
    assert files.save_npy(df.where("frame_number > 5"), str(tmp_path / "out"), rows=16) == 8 * 3
    back = files.frames(spark, str(tmp_path / "out"))
    key = ["construct", "subconstruct", "replica", "frame_number", "features"]
    assert back.select(key).exceptAll(df.where("frame_number > 5").select(key)).count() == 0 and back.count() == 8 * 35
    with pytest.raises(Exception, match="consecutive"):
        files.save_npy(df.where("frame_number <> 8"), str(tmp_path / "gap"), rows=16)


def test_trajectories_are_clipped_and_masked(spark, base):
    """Residues 3, 4, 7, 150: islands 3-4, 7, 150. One at each edge leaves nothing; masking hides pairs of 150."""
    assert files.trajectories(spark, base, n_edge=1).first()["features"] == []
    row = files.trajectories(spark, base, n_edge=0, mask_from=146).first()["features"]
    assert [x is None for x in row] == [False, False, True, False, True, True]
    np.save(f"{base}/canonical_resids.npy", np.array([1, 2, 3, 9]))
    one = files.trajectories(spark, base, n_edge=0).where("frame_number = 1 and construct = 'A'").orderBy("subconstruct", "replica").first()
    np.save(f"{base}/canonical_resids.npy", np.array([1, 2, 3, 4]))
    cut = files.trajectories(spark, base, n_edge=1).where("frame_number = 1 and construct = 'A'").orderBy("subconstruct", "replica").first()
    assert cut["features"] == [one["features"][3]]


def test_residues_of_a_folder(base):
    np.save(f"{base}/A/x/canonical_resid.npy", np.array([8, 9]))
    assert files.residues(base, "A").tolist() == [8, 9] and files.residues(base, "B") is None


def test_h5_wins(spark):
    paths = [f"b/A/x/1_s001_e100_pairwise_dist.{k}" for k in ("npy", "h5")] + ["b/A/x/other.npy"]
    found = files.discovered(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert [(r["kind"], r["start_frame"]) for r in found] == [("h5", 0)]


def test_sinks(spark, base, tmp_path):
    df = files.frames(spark, base)
    files.save_frames(df, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.where("construct = 'B'").count() == 160
    wide = df.limit(5).select("frame_number", F.lit(1.5).alias("a"), F.lit(2.0).alias("b"))
    files.save_csv(wide, str(tmp_path / "c"))
    assert files.read_columns(spark, str(tmp_path / "c")).first()["features"] == [1.5, 2.0]


def test_streamed_moments(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i % 2, [float(v) for v in rng.normal(size=3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "class int, features array<double>")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streaming.write_partials(stream, "class", str(tmp_path / "parts"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {(r["class"], r["pos"]): r for r in streaming.current(spark, str(tmp_path / "parts"), "class").collect()}
    for r in class_moments(df, "class").collect():
        own = got[(r["class"], r["pos"])]
        assert own["n"] == r["n"] and abs(own["mean"] - r["mean"]) < 1e-9 and abs(own["ss"] - r["ss"]) < 1e-9


def test_windowed_means_close_with_the_watermark(spark, tmp_path):
    """Each micro-batch moves the watermark; rows behind it are dropped, windows behind it come out once."""
    parts = [[("a", 0, 1.0), ("a", 50, 3.0), ("b", 10, 5.0)], [("a", 200, 7.0)], [("a", 30, 100.0), ("a", 500, 9.0)]]
    schema = "key string, s int, value double"
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if n == 0:
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).select("key", F.timestamp_seconds("s").alias("t"), "value")
            out = streaming.windowed(stream, "t", "key", "value", "60 seconds", "60 seconds")
        query = out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = {(r["key"], r["window"]["start"].timestamp()): (r["n"], r["mean"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[("a", 0.0)] == (2, 2.0) and got[("b", 0.0)] == (1, 5.0)  # the row of second 30 came too late
    assert got.keys() <= {("a", 0.0), ("b", 0.0), ("a", 180.0)}
