"""Sources and sinks: subjects, atlases, result tables, and tables of intermediate results."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections import Counter
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of the embeddings table: how many of its dimensions are a network's edges, and which are covariates
N_EDGES, COVARIATES = 55, {"c1": 60, "c2": 61}


def materialized(df: DataFrame) -> DataFrame:
    """The rows, written under spark.checkpoint.dir and read again, so that iterations have short lineages and survive lost executors."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="meshwork-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/meshwork/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Deletes tables of materialized() that nothing will read again."""
    for df in tables:
        if path := getattr(df, "_written", None):
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def subjects_of(df: DataFrame, sample_id: str, x: str, y: Column, covariates: dict[str, Column], n_edges: int | None = None) -> DataFrame:
    """(sample_id, x, y, covariates): doubles, with null for NaN."""
    number = lambda c: F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    values = F.slice(x, 1, n_edges) if n_edges else F.col(x)
    return df.select(F.col(sample_id).alias("sample_id"), F.transform(values, number).alias("x"), number(y).alias("y"), *[number(c).alias(name) for name, c in covariates.items()])


def embedding_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table as subjects: 55 edges (11 nodes), two covariates and a planted target."""
    v = lambda i: F.col("embedding")[i].cast("double")
    y = v(0) + v(1) + v(2) - v(3) - v(4) + F.lit(0.5) * v(60)
    return subjects_of(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", y, {c: v(i) for c, i in COVARIATES.items()}, N_EDGES)


def surveyed(subjects: DataFrame, covariates: list[str], impute: bool = False, task: str | None = None) -> tuple[int, bool]:
    """How many edges samples have, and whether values are missing, from one aggregate over subjects; or a ValueError: for no samples,
    missing targets, missing values without imputation, differing or impossible numbers of edges, and a target that isn't the task's."""
    from ..operators.vectors import check_n_features

    missing = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    y = F.col("y").cast("double")
    counts = subjects.agg(
        F.count("*").alias("n"),
        F.count_if(missing("y")).alias("y"),
        F.sum(F.size(F.filter("x", lambda v: v.isNull() | F.isnan(v.cast("double"))))).alias("x"),
        F.sum(sum((missing(c).cast("int") for c in covariates), F.lit(0))).alias("c"),
        F.min(F.coalesce(F.size("x"), F.lit(-1))).alias("lo"),
        F.max(F.coalesce(F.size("x"), F.lit(-1))).alias("hi"),
        F.min(y).alias("least"),
        F.max(y).alias("most"),
        F.count_if((y != 0) & (y != 1)).alias("other"),
        F.count_if((y != -1) & (y != 1)).alias("other_signs"),
    ).first()
    if not counts["n"]:
        raise ValueError("there are no samples")
    if counts["y"]:
        raise ValueError(f"the target is missing in {counts['y']} samples")
    if counts["lo"] != counts["hi"]:
        raise ValueError(f"samples have between {max(counts['lo'], 0)} and {counts['hi']} edges")
    gaps = bool(counts["x"] or counts["c"])
    if gaps and not impute:
        raise ValueError(f"{counts['x']} edge values and {counts['c']} covariate values are missing; impute them")
    check_n_features(counts["hi"])
    if task is not None:
        if counts["least"] == counts["most"]:
            raise ValueError("the target has fewer than two values")
        found = "classification" if not counts["other"] or not counts["other_signs"] else "regression"
        if found != task:
            raise ValueError(f"the target looks like {found}, not {task}")
    return counts["hi"], gaps


def checked(subjects: DataFrame, covariates: list[str], impute: bool = False) -> DataFrame:
    """subjects, or the ValueError of surveyed()."""
    surveyed(subjects, covariates, impute)
    return subjects


ATLAS_COLUMNS = ("region", "x", "y", "z")


def read_atlas(spark: SparkSession, path: str, n_nodes: int | None = None) -> DataFrame:
    """An atlas CSV (region, x, y, z and optionally network, hemisphere, structure) with node_id, its row's number.

    One file of a few hundred rows at most; it is read by one task in the file's order.
    """
    lines = spark.read.text(path, wholetext=True).first()
    if lines is None:
        raise ValueError(f"{path} is empty")
    import csv
    import io

    rows = list(csv.DictReader(io.StringIO(lines[0])))
    return atlas_of(spark, rows, n_nodes)


def atlas_of(spark: SparkSession, rows: list[dict], n_nodes: int | None = None) -> DataFrame:
    names = list(rows[0]) if rows else []
    if lost := [c for c in ATLAS_COLUMNS if c not in names]:
        raise ValueError(f"the atlas lacks {lost}")
    if n_nodes is not None and len(rows) != n_nodes:
        raise ValueError(f"the atlas has {len(rows)} regions, the data have {n_nodes} nodes")
    try:
        data = [(i, *[float(r[c]) if c in "xyz" else r[c] for c in names]) for i, r in enumerate(rows)]
    except (TypeError, ValueError) as e:
        raise ValueError("an atlas's x, y and z must be numbers") from e
    if any(not math.isfinite(r[1 + names.index(c)]) for r in data for c in "xyz"):
        raise ValueError("an atlas's x, y and z must be finite")
    if twice := sorted(x for x, n in Counter(r["region"] for r in rows).items() if n > 1):
        raise ValueError(f"an atlas's regions must differ; {twice} are repeated")
    return spark.createDataFrame(data, "node_id int, " + ", ".join(f"{c} {'double' if c in 'xyz' else 'string'}" for c in names))


def list_atlases(spark: SparkSession, folder: str) -> list[str]:
    """The names of a folder's atlas CSVs."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path")
    return sorted(PurePosixPath(r["path"]).stem for r in files.collect())


def resolve_atlas(spark: SparkSession, atlas: str | None, folder: str | None = None, n_nodes: int | None = None) -> DataFrame | None:
    """None, a CSV file, or the name of one of a folder's atlases, whatever its case."""
    if atlas is None:
        return None
    if not isinstance(atlas, str):
        raise TypeError("an atlas is named by a string")
    if atlas.lower().endswith(".csv"):
        return read_atlas(spark, atlas, n_nodes)
    names = {n.lower(): n for n in (list_atlases(spark, folder) if folder else [])}
    if atlas.lower() not in names:
        raise ValueError(f"no atlas {atlas}; there are {sorted(names.values())}")
    return read_atlas(spark, f"{folder}/{names[atlas.lower()]}.csv", n_nodes)


def write_results(tables: dict[str, DataFrame], folder: str, csv: tuple[str, ...] = ()) -> None:
    """Each table as Parquet in a folder of its name; those named in csv as CSV with a header, too."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        if name in csv:
            df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}_csv")


def read_results(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A result table, or None if it wasn't written."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{folder}/{name}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def config_of_log(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of the settings that a run's log lists between its first two lines of =, in order of lines."""
    text = spark.read.text(path, wholetext=True).select(F.split("value", r"(?m)^=+\s*$")[1].alias("block"))
    lines = text.select(F.posexplode(F.split("block", "\n")).alias("line", "text"))
    pair = r"^\s*([^:]+):\s*(.*)$"
    return lines.where(F.col("text").rlike(pair)).select("line", F.trim(F.regexp_extract("text", pair, 1)).alias("key"), F.trim(F.regexp_extract("text", pair, 2)).alias("value"))
