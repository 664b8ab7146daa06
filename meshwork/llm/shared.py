"""What the operators share: tables written in the cluster's shared folder, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How many edges one task contracts
EDGES_A_TASK = 1 << 20
#: Whether shuffle files go with the query that wrote them
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset (a single machine), one of our own."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="meshwork-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs here go when it has run; else they stay until the driver collects its garbage, all steps' together."""
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANED) if before is None else spark.conf.set(CLEANED, before)


def written(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage ends here, and a lost executor loses nothing.  No shuffle files stay."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/meshwork/{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Deletes tables of written() that nothing will read again."""
    for df in tables:
        if path := getattr(df, "_written", None):
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def least_connected(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of each of n numbered nodes, the least that the edges a[i], b[i] connect it with."""
    up = np.arange(n)
    while True:
        x, y = up[a], up[b]
        open_ = x != y
        if not open_.any():
            return up
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up[up] != up).any():
            up = up[up]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's edges (v, p): from each node one edge to the least node that they connect it with, itself included."""
    edges = pa.Table.from_batches(parts) if (parts := list(batches)) else None
    if edges is None or not edges.num_rows:
        return
    ends = pa.chunked_array([*edges.column("v").chunks, *edges.column("p").chunks]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(ends.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    a, b = np.split(rank[ends.indices.to_numpy()], 2)
    nodes = ends.dictionary.take(pa.array(order))
    yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(least_connected(a, b, len(order))))], ["v", "p"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component), written, of every node of edges (a, b): the least node that it is connected with.

    In turn, tasks of EDGES_A_TASK edges each contract what they have to stars, and large-star and small-star steps
    join the stars of different tasks.  Both keep what is connected, so the number of rounds grows with the logarithm of a
    component's size at most; one task's edges need no further step.  Only minima are gathered per node (with partial sums),
    never lists; a hub's edges are spread by Spark's skewed joins.  a and b have the same orderable type.
    edges is read twice: it should be a written table or cheap to make from one.
    """
    now = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("p")).where("v <> p")
    while True:
        with cleaned(now.sparkSession):
            tasks = 1 + now.count() // EDGES_A_TASK
        stars = written(now.repartition(tasks).mapInArrow(_contracted, now.schema))
        drop(now)
        if tasks == 1:
            return _renamed(stars)
        now = stars.where("v <> p")
        # done if no node has two edges down, and none has edges both up and down
        ends = now.select(F.col("v").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(now.select("p", F.lit(0), F.lit(1)))
        with cleaned(now.sparkSession):
            open_ = ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1 and down > 0").take(1)
        if not open_:
            out = written(stars.distinct())
            drop(stars)
            return _renamed(out)
        both = now.union(now.select(F.col("p").alias("v"), F.col("v").alias("p")))
        # written, so that Spark can split a hub's rows in the join
        least = written(both.groupBy("v").agg(F.least(F.min("p"), F.first("v")).alias("m")))
        large = both.join(least, "v").where("p > v").select(F.col("p").alias("v"), F.col("m").alias("p")).distinct()
        small = large.groupBy("v").agg(F.min("p").alias("m"))
        step = large.join(small, "v")
        now = written(step.select("v", F.col("m").alias("p")).union(step.where("p > m").select(F.col("p").alias("v"), F.col("m").alias("p"))).distinct())
        drop(stars, least)


def _renamed(stars: DataFrame) -> DataFrame:
    out = stars.select(F.col("v").alias("id"), F.col("p").alias("component"))
    out._written = stars._written
    return out
