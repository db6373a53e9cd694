"""Discovery of data files, and a data source of pairwise-distance frames.

Files lie at construct/subconstruct/<replica>_s<first>_e<last>_pairwise_dist.{npy,h5}, one row
per frame; frames are numbered from 1 within a replica.

A scan is planned in two stages. ``inventory`` lists names and lets tasks read the headers: one
row a file with its shape, or with the reason why it cannot be read. The data source then plans
ranges of rows from that table, so the driver opens no file, and files are pruned by names and frame
numbers before any task opens them.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from framelens.sources.shared import shared_dir

#: The layout of file names, and the names of files beside them.
PATH = r"([^/]+)/([^/]+)/([^/]+)_s(\d+)[^/]*\.(h5|npy)$"
RESIDUES = ("canonical_resids.npy", "canonical_resid.npy")
TIMES = "time.npy"
SCHEMA = "construct string, subconstruct string, replica string, frame_number long, time double, features array<float>"
NAMES = ("construct", "subconstruct", "replica")
INVENTORY = "construct string, subconstruct string, replica string, start_frame int, kind string, path string, rows long, width int, dtype string, bytes long, reason string"


def discovered(paths: DataFrame) -> DataFrame:
    """construct, subconstruct, replica, start_frame (from 0), kind, path: one file per segment, h5 before npy."""
    part = lambda k: F.regexp_extract("path", PATH, k)
    files = paths.distinct().where(F.col("path").rlike(PATH)).select(part(1).alias("construct"), part(2).alias("subconstruct"), part(3).alias("replica"), (part(4).cast("int") - 1).alias("start_frame"), part(5).alias("kind"), "path")
    first = F.row_number().over(Window.partitionBy("construct", "subconstruct", "replica", "start_frame").orderBy("kind"))
    return files.withColumn("_n", first).where("_n = 1").drop("_n")


def listed(spark: SparkSession, base: str) -> DataFrame:
    """The data files below base, empty ones too. Only names are read, by a task for every folder in base."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for top in batch["path"]:
                for folder, _, names in os.walk(top):
                    yield pd.DataFrame({"path": [f"{folder}/{n}" for n in names if "_pairwise_dist." in n]}, dtype=object)

    tops = [(e.path,) for e in os.scandir(local(base)) if e.is_dir()]
    return discovered(spark.createDataFrame(tops, "path string").repartition(max(1, len(tops))).mapInPandas(walk, "path string"))


def local(path: str) -> str:
    """A path of the file system that driver and executors share, from its address."""
    if path.startswith("file:"):
        return "/" + unquote(path[5:]).lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: frames are read through memory maps, from a folder that all executors see")
    return path


def opened(path: str, dataset: str = "distances"):
    """(rows of a file, times stored in it or None). Raises if it cannot be read as a table of frames."""
    if path.endswith(".npy"):
        matrix, times = np.load(path, mmap_mode="r"), None
    else:
        import h5py  # only where such files are read

        file = h5py.File(path, "r")
        matrix, times = (file[dataset] if dataset in file else file["data"]), file.get("times")
    if len(matrix.shape) != 2:
        raise ValueError(f"{len(matrix.shape)} dimensions in place of 2")
    return matrix, times


def inventory(spark: SparkSession, base: str, dataset: str = "distances") -> DataFrame:
    """Every data file below base with rows, width, dtype and bytes, or the reason why it cannot be read. Headers are read by tasks."""

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path in batch["path"]:
                try:
                    matrix, _ = opened(local(path), dataset)
                    found.append((matrix.shape[0], matrix.shape[1], str(matrix.dtype), os.path.getsize(local(path)), None))
                except Exception as error:  # whatever it is, it is reported  # noqa: BLE001
                    found.append((None, None, None, None, f"{type(error).__name__}: {error}"))
            shapes = pd.DataFrame(found, columns=["rows", "width", "dtype", "bytes", "reason"], index=batch.index)
            yield pd.concat([batch, shapes.astype({"rows": "Int64", "width": "Int32", "bytes": "Int64"})], axis=1)

    return listed(spark, base).select(*NAMES, "start_frame", "kind", "path").mapInPandas(headers, INVENTORY)


def broken_files(files: DataFrame) -> DataFrame:
    """path, reason of the files of an inventory that cannot be read."""
    return files.where("reason is not null").select("path", "reason")


class Segment(InputPartition):
    """Rows start to end of one file; end None: to its end."""

    def __init__(self, row: dict, start: int, end: int | None) -> None:
        super().__init__((row, start, end))
        self.row, self.start, self.end = row, start, end


class FrameSource(DataSource):
    """Format "frames": options path, plan, rows_per_partition, skip_broken, dataset.

    plan is a stored ``inventory``: a partition is then a range of rows of a file, read through
    a memory map, so a file of any size is read in parallel and in bounded memory. Without a
    plan a partition is a file, known by its name. The folder must be one that all executors
    see. A broken file fails the query unless skip_broken is set.

    """

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options)


class FilteredFrameSource(FrameSource):
    """Format "filtered_frames": filters on the three names and on frame_number are taken over by the source.

    Names choose files, frame numbers rows within them. Spark 4.1 keeps the filters of a
    relation's last query for its next ones, so use it through ``frames`` only, which gives
    every filter a relation of its own.
    """

    @classmethod
    def name(cls) -> str:
        return "filtered_frames"

    def reader(self, schema) -> FrameReader:
        return FilteringReader(self.options)


class FrameReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.base, self.plan = local(options["path"]), options.get("plan")
        self.rows = int(options.get("rows_per_partition", 10_000))
        self.skip = str(options.get("skip_broken", "false")).lower() == "true"
        self.dataset = options.get("dataset", "distances")
        self.names: dict[str, set[str]] = {}
        self.least, self.most = 1, (1 << 63) - 1

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for row in self._planned() if self.plan else self._named():
            if all(row[c] in wanted for c, wanted in self.names.items()):
                # Only the rows whose frame numbers are asked for.
                first = max(0, self.least - 1 - row["start_frame"])
                last = max(0, self.most - row["start_frame"])
                if row["rows"] is None:
                    out.append(Segment(row, first, last))
                else:
                    last = min(last, row["rows"])
                    out += [Segment(row, a, min(a + self.rows, last)) for a in range(first, last, self.rows)]
        return out

    def _planned(self) -> Iterator[dict]:
        import pyarrow.dataset as ds

        table = ds.dataset(local(self.plan), format="parquet").to_table(columns=[*NAMES, "start_frame", "path", "rows"], filter=ds.field("reason").is_null())
        return iter(sorted(table.to_pylist(), key=lambda r: r["path"]))

    def _named(self) -> Iterator[dict]:
        import re

        best: dict[tuple, dict] = {}
        for path in sorted(str(p) for p in Path(self.base).rglob("*_pairwise_dist.*")):
            if m := re.search(PATH, path):
                key = (m[1], m[2], m[3], int(m[4]) - 1)
                if key not in best or m[5] == "h5":
                    best[key] = {**dict(zip((*NAMES, "start_frame"), key, strict=True)), "path": path, "rows": None}
        return iter(best.values())

    def read(self, part: Segment) -> Iterator[pa.RecordBatch]:
        construct, subconstruct, replica, offset = (part.row[c] for c in (*NAMES, "start_frame"))
        path = local(part.row["path"])
        try:
            matrix, inside = opened(path, self.dataset)
        except (OSError, ValueError, KeyError, EOFError):
            if self.skip:
                return
            raise
        total = matrix.shape[0]
        times = inside if inside is not None else self._times(path, offset)
        end = min(part.end, total) if part.end is not None else total
        for a in range(part.start, end, 1000):
            block = np.asarray(matrix[a : min(a + 1000, end)], np.float32)
            n = len(block)
            numbers = np.arange(a, a + n) + 1 + offset
            # Times that do not reach over the file give way to the row's place in it.
            own = None if times is None else np.asarray(times[a : a + n], float) if len(times) >= total else np.arange(a, a + n, dtype=float)
            offsets = np.arange(0, block.size + 1, block.shape[1] or 1, dtype=np.int32)
            columns = [
                pa.array([construct] * n), pa.array([subconstruct] * n), pa.array([replica] * n), pa.array(numbers, pa.int64()),
                pa.array(own, pa.float64()) if own is not None else pa.nulls(n, pa.float64()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(block.ravel())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["construct", "subconstruct", "replica", "frame_number", "time", "features"])

    def _times(self, path: str, offset: int) -> np.ndarray | None:
        """The segment's share of the times beside it, if there are any."""
        beside = Path(path).parent / TIMES
        return np.load(beside, mmap_mode="r")[offset:] if beside.exists() else None


class FilteringReader(FrameReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self._taken(f):
                yield f

    def _taken(self, f: Filter) -> bool:
        column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
        if column in (*NAMES, "frame_number") and isinstance(f, IsNotNull):
            return True  # no frame lacks them
        if column in NAMES and isinstance(f, EqualTo | EqualNullSafe | In):
            wanted = set(f.value) if isinstance(f, In) else {f.value}
            self.names[column] = self.names.get(column, wanted) & wanted
            return True
        if column == "frame_number" and isinstance(f, EqualTo | EqualNullSafe | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and f.value is not None:
            if not isinstance(f, LessThan | LessThanOrEqual):
                self.least = max(self.least, f.value + isinstance(f, GreaterThan))
            if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.most = min(self.most, f.value - isinstance(f, LessThan))
            return True
        return False


def residues(base: str, *parts: str) -> np.ndarray | None:
    """Residue ids from the first file of that name below base whose path holds all the given folders."""
    root = Path(local(base))
    for name in RESIDUES:
        for path in sorted(root.rglob(name)):
            if set(parts) <= set(path.relative_to(root).parts):
                return np.load(path).astype(int)
    return None


def frames(spark: SparkSession, base: str, constructs: list[str] | None = None, subconstructs: list[str] | None = None, min_frame: int = 0, where: str | None = None, skip_broken: bool = False, planned: bool = True, **options) -> DataFrame:
    """The frames below base as a lazy table.

    Whatever is asked for here (the lists, min_frame, and in where a condition on names and
    frame_number) is pushed into the source: other files are not opened, other rows not
    read. Filters that are added to the result run in Spark.

    Reads headers once to plan (unless planned is off, then a file is a partition). Broken
    files fail here, with their number and the first reasons, or are left out if skip_broken
    is set; ``broken_files`` names them. Turns on the session's pushdown into Python sources.
    """
    from framelens.operators.tables import by_names, from_frame

    options = {k: str(v) for k, v in options.items()} | {"path": base, "skip_broken": str(skip_broken)}
    if planned:
        options["plan"] = f"{shared_dir(spark)}/frames-{uuid.uuid4().hex}"
        inventory(spark, base, options.get("dataset", "distances")).write.parquet(options["plan"])
        if not skip_broken:
            bad = broken_files(spark.read.schema(INVENTORY).parquet(options["plan"]))
            if count := bad.count():
                raise ValueError(f"{count} files cannot be read, such as {[tuple(r) for r in bad.orderBy('path').limit(3).collect()]}; set skip_broken to leave them out")
    if constructs is None and subconstructs is None and min_frame <= 0 and where is None:
        spark.dataSource.register(FrameSource)
        return spark.read.format("frames").options(**options).load()
    spark.dataSource.register(FilteredFrameSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("filtered_frames").options(**options).load()
    df = from_frame(by_names(df, construct=constructs, subconstruct=subconstructs), min_frame)
    if where is not None:
        df = df.where(where)
    # No later filter passes a node that counts rows, so every query on the result pushes these filters and no others.
    return df.observe(f"frames_{uuid.uuid4().hex}", F.count(F.lit(1)).alias("frames"))


def trajectories(spark: SparkSession, base: str, constructs: list[str] | None = None, subconstructs: list[str] | None = None, min_frame: int = 0, n_edge: int = 3, mask_from: int | None = None, **options) -> DataFrame:
    """The frames below base without pairs near the ends of the chain or its gaps; pairs with a residue from mask_from on are null.

    Needs a file of residue ids; without one nothing is clipped or masked.
    """
    from framelens.functions.features import gather, mask_pairs, pair_names
    from framelens.operators.tables import boundary_clip

    df = frames(spark, base, constructs, subconstructs, min_frame, **options)
    own = residues(base)
    if own is None:
        return df
    pairs = pair_names(spark.createDataFrame([(int(r),) for r in own], "residue int"))
    if mask_from is not None:
        df = mask_pairs(df, pairs.where((F.col("res_i") >= mask_from) | (F.col("res_j") >= mask_from)))
    if n_edge > 0:
        kept = sorted(r["pos"] for r in boundary_clip(pairs, n_edge).collect())  # as many as a frame has features
        df = gather(df, kept)
    return df


def save_npy(df: DataFrame, base: str, rows: int = 10_000) -> int:
    """Frames as .npy files of at most rows frames each, written by tasks; the number of files.

    Frame numbers must be consecutive within a file. A file appears whole or not at all, and a
    repeated task writes the same file again.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def file(key: tuple, parts: list[pd.DataFrame]) -> pd.DataFrame:
            whole = pd.concat(parts)
            numbers = whole["frame_number"].to_numpy()
            if (np.diff(numbers) != 1).any():
                raise ValueError(f"{key}: frame numbers are not consecutive")
            folder = Path(local(base), key[0], key[1])
            folder.mkdir(parents=True, exist_ok=True)
            at = folder / f"{key[2]}_s{numbers[0]:03d}_e{numbers[-1]:03d}_pairwise_dist.npy"
            own = at.with_name(f".{at.name}.{uuid.uuid4().hex}")
            with own.open("wb") as out:
                np.save(out, np.stack(whole["features"].to_numpy()).astype(np.float32))
            os.replace(own, at)
            return pd.DataFrame({"path": [str(at)]})

        key, parts = None, []
        for batch in batches:
            for now, part in batch.groupby([*NAMES, "segment"], sort=False):
                if now != key and parts:
                    yield file(key, parts)
                    parts = []
                key = now
                parts.append(part)
        if parts:
            yield file(key, parts)

    cut = df.select(*NAMES, "frame_number", "features", F.expr(f"(frame_number - 1) div {rows}").alias("segment"))
    return cut.repartition(*NAMES, "segment").sortWithinPartitions(*NAMES, "segment", "frame_number").mapInPandas(write, "path string").count()


def file_summary(df: DataFrame) -> DataFrame:
    """One row per segment of a frame table: frames, width, first and last frame."""
    return df.groupBy("construct", "subconstruct", "replica").agg(F.count(F.lit(1)).alias("frames"), F.max(F.size("features")).alias("width"), F.min("frame_number").alias("first"), F.max("frame_number").alias("last"))


def save_frames(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Frames as Parquet, a folder per construct and subconstruct, so that filters on them prune."""
    df.write.mode(mode).partitionBy("construct", "subconstruct").option("compression", "zstd").parquet(path)


def save_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_columns(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of order parameters without its first column, the time, as a frame table with features."""
    from framelens.functions.features import to_array

    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return to_array(df.drop(df.columns[0]), df.columns[1:])
