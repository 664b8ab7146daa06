"""Folders of results: arrays as long rows, tables with two header lines, and all that a report needs of a folder.

Arrays in NumPy's file format are a data source of Spark: a partition is a slab of the array's slowest axis, read with a seek, so an array needs to fit no
task.  Files are opened with Arrow's file systems, local or remote.  What a folder lacks is None.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SLAB_BYTES, BATCH = 64 << 20, 1 << 18
INDEX = ("model", "network", "run")


def _opened(path: str) -> pa.NativeFile:
    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


def _header(path: str) -> tuple[tuple[int, ...], bool, np.dtype, int]:
    """Shape, whether the first axis is the fastest, type, and where the values begin."""
    with _opened(path) as f:
        version = np.lib.format.read_magic(f)
        read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}
        if version not in read:
            raise ValueError(f"{path} has version {version} of the format, which isn't read")
        shape, fortran, kind = read[version](f)
        if kind.kind not in "biuf":
            raise ValueError(f"{path} has values of type {kind}, not numbers")
        return shape, fortran, kind, f.tell()


class Slab(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class NpyReader(DataSourceReader):
    def __init__(self, path: str, slab_bytes: int):
        self.path = path
        self.shape, self.fortran, self.kind, self.begin = _header(path)
        self.axes = self.shape[::-1] if self.fortran else self.shape
        self.slab_bytes = slab_bytes

    def partitions(self) -> list[InputPartition]:
        if not self.axes:
            return [Slab(0, 1)]
        inner = int(np.prod(self.axes[1:], dtype=np.int64)) * self.kind.itemsize
        each = max(1, self.slab_bytes // max(inner, 1))
        return [Slab(i, min(i + each, self.axes[0])) for i in range(0, self.axes[0], each)] or [Slab(0, 0)]

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        inner = int(np.prod(self.axes[1:], dtype=np.int64))
        names = [f"d{i}" for i in range(len(self.axes))]
        with _opened(self.path) as f:
            for at in range(partition.start * inner, partition.stop * inner, BATCH):
                n = min(BATCH, partition.stop * inner - at)
                f.seek(self.begin + at * self.kind.itemsize)
                values = np.frombuffer(f.read(n * self.kind.itemsize), self.kind).astype(np.float64)
                places = np.unravel_index(np.arange(at, at + n), self.axes) if self.axes else ()
                places = places[::-1] if self.fortran else places
                yield pa.RecordBatch.from_arrays([*(pa.array(np.asarray(p, np.int64)) for p in places), pa.array(values)], [*names, "value"])


class NpySource(DataSource):
    """spark.read.format("npy").load(path): (d0, d1, ..., value) of each number of an array; the option slab_bytes bounds a partition."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return ", ".join([*(f"d{i} long" for i in range(len(_header(self.options["path"])[0]))), "value double"])

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(self.options["path"], int(self.options.get("slab_bytes", SLAB_BYTES)))


def read_npy(spark: SparkSession, path: str, slab_bytes: int = SLAB_BYTES) -> DataFrame | None:
    """(d0, d1, ..., value) of an array, or None where there is no such file."""
    system, at = fs.FileSystem.from_uri(path)
    if system.get_file_info(at).type == fs.FileType.NotFound:
        return None
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("slab_bytes", slab_bytes).load(path)


def _or_none(read):
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def read_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """A CSV with one header line; its types are found from its values."""
    return _or_none(lambda: spark.read.csv(path, header=True, inferSchema=True))


def read_summary(spark: SparkSession, path: str) -> DataFrame | None:
    """A table whose columns have two header lines (metric, mean or std) and which is indexed by model, network and run in any order: flat, as <metric>__mean."""
    lines = _or_none(lambda: spark.read.text(path).limit(3).collect())
    if lines is None:
        return None
    if len(lines) < 3:
        raise ValueError(f"{path} lacks its three header lines")
    metrics, kinds, index = (line["value"].split(",") for line in lines)
    n = len([x for x in index if x])
    if set(index[:n]) != set(INDEX):
        raise ValueError(f"{path} is indexed by {index[:n]}, not by {INDEX}")
    names = [*index[:n], *(f"{m}__{k}" for m, k in zip(metrics[n:], kinds[n:], strict=True))]
    rows = spark.read.csv(path, schema=", ".join(f"`{c}` string" for c in names))
    # the header lines have nothing where data have their model, or the index's names
    rows = rows.where(F.col("model").isNotNull() & (F.col("model") != "model"))
    return rows.select(*[F.col(c).cast("int") if c == "run" else F.col(c) if c in INDEX else F.col(f"`{c}`").cast("double").alias(c) for c in names])


def _names(spark: SparkSession, path: str) -> list[str] | None:
    rows = _or_none(lambda: spark.read.text(path).collect())
    return None if rows is None else [r["value"].strip('"') for r in rows]


def load_folder(spark: SparkSession, folder: str, atlas: str | None = None) -> dict[str, DataFrame | list[str] | str | None]:
    """What a report needs of a folder of results: tables as frames, names as lists, the task as a string."""
    at = folder.rstrip("/")
    read = {name: read_csv(spark, f"{at}/{file}.csv") for name, file in (("full", "cv_results_full"), ("predictions", "cv_predictions"), ("strengths", "cv_network_strengths"), ("p_values", "p_values"), ("insights", "data_insights/summary"), ("atlas", "-"))}
    read["atlas"] = read_csv(spark, atlas) if atlas else None
    if read["full"] is not None:
        read["full"] = read["full"].drop("run")
    for name, file in (("summary", "cv_results_summary"), ("permutations", "permutation/cv_results_summary")):
        read[name] = read_summary(spark, f"{at}/{file}.csv")
    read["stability"], read["significance"] = (read_npy(spark, f"{at}/{f}.npy") for f in ("stability_edges", "stability_edges_significance"))
    read["significance_meta"] = _or_none(lambda: spark.read.json(f"{at}/stability_edges_significance_meta.json", multiLine=True))
    for name, file in (("features", "X_names"), ("target", "y_name"), ("covariates", "covariate_names")):
        read[name] = _names(spark, f"{at}/data_insights/{file}.csv")
    read["target"] = read["target"][0] if read["target"] else None
    read["task"] = next(iter(_names(spark, f"{at}/task_type.txt") or []), "regression").strip()
    return read


def write_insights(summary: DataFrame, names: dict[str, list[str]], folder: str) -> None:
    """The folder's data_insights: the variables' names (see prepare.variable_names), a name a line, and a summary table."""
    spark, at = summary.sparkSession, f"{folder.rstrip('/')}/data_insights"
    for kind, file in (("features", "X_names"), ("target", "y_name"), ("covariates", "covariate_names")):
        spark.createDataFrame([(x,) for x in names[kind]], "name string").coalesce(1).write.mode("overwrite").text(f"{at}/{file}.csv")
    summary.write.mode("overwrite").option("header", True).csv(f"{at}/summary.csv")
