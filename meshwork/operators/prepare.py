"""Preparing samples: task type, encoders, imputation, variance, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def task_type(samples: DataFrame, y: str = "y") -> str:
    """classification for a target of {0, 1} or {-1, 1}, else regression; fewer than two values are an error."""
    values = sorted(float(r[0]) for r in samples.select(F.nanvl(F.col(y).cast("double"), F.lit(None).cast("double"))).dropna().distinct().limit(3).collect())
    if len(values) < 2:
        raise ValueError("the target has fewer than two values")
    return "classification" if values in ([0.0, 1.0], [-1.0, 1.0]) else "regression"


def check_task_type(samples: DataFrame, task: str, y: str = "y") -> None:
    if (found := task_type(samples, y)) != task:
        raise ValueError(f"the target looks like {found}, not {task}")


def task_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n_values, task) of several columns, in one aggregate."""
    own = [a for c in columns for a in (F.count_distinct(c).alias(f"n_{c}"), F.min(c).cast("double").alias(f"lo_{c}"), F.max(c).cast("double").alias(f"hi_{c}"))]

    def one(c: str):
        binary = (F.col(f"n_{c}") == 2) & (F.col(f"hi_{c}") == 1) & F.col(f"lo_{c}").isin(0.0, -1.0)
        return F.struct(F.lit(c).alias("name"), F.col(f"n_{c}").alias("n_values"), F.when(F.col(f"n_{c}") < 2, "invalid").when(binary, "classification").otherwise("regression").alias("task"))

    return df.agg(*own).select(F.explode(F.array(*map(one, columns))).alias("t")).select("t.*")


def one_hot(df: DataFrame, column: str, levels: list[str] | None = None) -> DataFrame:
    """df with a column of 0 and 1 for each level of a category but the first, in order; a missing value has zeros."""
    if levels is None:
        levels = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)) for v in levels[1:]}).drop(column)


def variable_names(subjects: DataFrame, covariates: list[str], n_features: int, names: list[str] | None = None, target: str | None = None) -> dict[str, list[str]]:
    return {"features": names or [f"feature_{i}" for i in range(n_features)], "target": [target or "target"], "covariates": covariates}


def imputed(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """(fold, sample_id, edge_id, value): missing values are the edge's mean over the fold's training part.

    edges must have a row for each sample and edge; rows: fold, sample_id, is_test.  An edge that is missing throughout stays missing.
    """
    long = edges.join(rows.select("fold", "sample_id", "is_test"), "sample_id")
    means = long.where("not is_test").groupBy("fold", "edge_id").agg(F.avg("value").alias("_mean"))
    return long.join(means, ["fold", "edge_id"]).select("fold", "sample_id", "edge_id", F.coalesce("value", "_mean").alias("value"))


def imputed_covariates(rows: DataFrame, covariates: list[str]) -> DataFrame:
    """rows (run_id, fold, is_test, covariates and others) with a covariate's missing values as its mean over the fold's training part."""
    if not covariates:
        return rows
    means = rows.where("not is_test").groupBy("run_id", "fold").agg(*[F.avg(c).alias(f"_mean_{c}") for c in covariates])
    filled = rows.join(means, ["run_id", "fold"]).withColumns({c: F.coalesce(c, f"_mean_{c}") for c in covariates})
    return filled.drop(*[f"_mean_{c}" for c in covariates])


def varying_edges(edges: DataFrame, least: float = 1e-6) -> DataFrame:
    """(edge_id, variance) of edges whose sample variance is above `least`."""
    return edges.groupBy("edge_id").agg(F.var_samp("value").alias("variance")).where(F.col("variance") > least)


def data_summary(subjects: DataFrame, covariates: list[str]) -> DataFrame:
    missing = F.sum(F.size(F.filter("x", lambda v: v.isNull())) + sum((F.col(c).isNull().cast("int") for c in covariates), F.lit(0)) + F.col("y").isNull().cast("int"))
    return subjects.agg(F.count("*").alias("n_samples"), F.max(F.size("x")).cast("long").alias("n_features"), F.lit(len(covariates)).cast("long").alias("n_covariates"), missing.cast("long").alias("n_missing"))


def missing_values(subjects: DataFrame, covariates: list[str]) -> DataFrame:
    """(name, n_missing, share) of the target, each covariate and all edges together, from one pass; NaN is missing too."""
    gone = lambda v: (v.isNull() | F.isnan(v)).cast("long")
    columns = {"y": "y", **{c: c for c in covariates}}
    total = subjects.agg(F.count("*").alias("_n"), F.sum(F.size("x")).alias("_edges"), F.sum(F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + gone(v))).alias("_gone"), *[F.sum(gone(F.col(c))).alias(f"_gone_{c}") for c in columns])
    one = lambda name, n, of: F.struct(F.lit(name).alias("name"), F.coalesce(n, F.lit(0)).alias("n_missing"), F.coalesce(F.try_divide(n, of), F.lit(0.0)).alias("share"))
    rows = [one(c, F.col(f"_gone_{c}"), F.col("_n")) for c in columns] + [one("edges", F.col("_gone"), F.col("_edges"))]
    return total.select(F.explode(F.array(*rows)).alias("t")).select("t.*")


def histogram(df: DataFrame, column: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """(by, bin, n): equally wide bins from the least to the greatest value, the last one closed; without empty bins."""
    by = by or []
    ends = df.groupBy(*by).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    rows = df.join(F.broadcast(ends), by) if by else df.crossJoin(F.broadcast(ends))
    at = F.floor((F.col(column) - F.col("_lo")) * bins / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)))
    return rows.where(F.col(column).isNotNull()).groupBy(*by, F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
