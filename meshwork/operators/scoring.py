"""Metrics of predictions, as aggregates over any grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import METRIC_TINY as TINY

REGRESSION = ("explained_variance_score", "pearson_score", "mean_squared_error", "mean_absolute_error")
CLASSIFICATION = ("accuracy", "balanced_accuracy", "f1_score", "roc_auc")
BUCKETS = 1024
KEYS = ("run_id", "fold", "param_id", "inner_fold", "model", "network")


def _keys(df: DataFrame) -> list[str]:
    return [c for c in KEYS if c in df.columns]


def regression_metrics(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The four regression metrics of y_true and y_pred; a constant prediction has a correlation of 0."""
    by = _keys(predictions) if by is None else by
    y, p, n = F.col("y_true"), F.col("y_pred"), F.count("*")
    e = y - p
    positive = lambda c: F.greatest(c, F.lit(0.0))
    syy, spp, syp = positive(F.sum(y * y) - F.sum(y) * F.sum(y) / n), positive(F.sum(p * p) - F.sum(p) * F.sum(p) / n), F.sum(y * p) - F.sum(y) * F.sum(p) / n
    return predictions.groupBy(*by).agg(
        (1 - F.var_pop(e) / (F.var_pop(y) + TINY)).alias("explained_variance_score"),
        (syp / (F.sqrt(syy) * F.sqrt(spp) + TINY)).alias("pearson_score"),
        F.avg(e * e).alias("mean_squared_error"),
        F.avg(F.abs(e)).alias("mean_absolute_error"),
    )


def roc_auc(predictions: DataFrame, by: list[str]) -> DataFrame:
    """The area under the curve: of all pairs of a 1 and another, the share in which the 1 has the greater y_pred; ties count a half.

    Equal predictions are counted first, and counts are added up within BUCKETS ranges of y_pred and over them, so that no task sorts a whole
    group.  Missing predictions come first, NaN last.
    """
    up = (F.col("y_true") == 1).cast("double")
    counts = predictions.groupBy(*by, "y_pred").agg(F.sum(up).alias("_pos"), F.sum(1 - up).alias("_neg"))
    real = F.nanvl("y_pred", F.lit(None).cast("double"))
    ends = predictions.groupBy(*by).agg(F.min(real).alias("_lo"), F.max(real).alias("_hi"))
    at = F.least(F.floor((F.col("y_pred") - F.col("_lo")) * BUCKETS / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))), F.lit(BUCKETS - 1))
    place = F.when(F.col("y_pred").isNull(), -1).when(F.isnan("y_pred"), BUCKETS).otherwise(F.coalesce(at, F.lit(0))).cast("int")
    rows = (counts.join(ends, by) if by else counts.crossJoin(F.broadcast(ends))).select(*by, "y_pred", "_pos", "_neg", place.alias("_bucket"))
    before = Window.unboundedPreceding, -1
    sums = rows.groupBy(*by, "_bucket").agg(F.sum("_neg").alias("_n"))
    sums = sums.withColumn("_below", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(*before)), F.lit(0.0))).drop("_n")
    own = F.coalesce(F.sum("_neg").over(Window.partitionBy(*by, "_bucket").orderBy("y_pred").rowsBetween(*before)), F.lit(0.0))
    won = F.col("_pos") * (F.col("_own") + F.col("_below") + F.col("_neg") / 2)
    return rows.withColumn("_own", own).join(sums, [*by, "_bucket"]).groupBy(*by).agg((F.sum(won) / (F.sum("_pos") * F.sum("_neg") + TINY)).alias("roc_auc"))


def classification_metrics(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The four classification metrics of y_true (0 or 1) and the probability y_pred; above 0.5 is 1."""
    by = _keys(predictions) if by is None else by

    def count(truth: int, guess: bool) -> Column:
        return F.sum(((F.col("y_true") == truth) & ((F.col("y_pred") > 0.5) == guess)).cast("double"))

    tp, fn, fp, tn = count(1, True), count(1, False), count(0, True), count(0, False)
    tpr, tnr, precision = tp / (tp + fn + TINY), tn / (tn + fp + TINY), tp / (tp + fp + TINY)
    counts = predictions.groupBy(*by).agg(((tp + tn) / (F.count("*") + TINY)).alias("accuracy"), ((tpr + tnr) / 2).alias("balanced_accuracy"), (2 * precision * tpr / (precision + tpr + TINY)).alias("f1_score"))
    return counts.join(roc_auc(predictions, by), by)


def score(predictions: DataFrame, task: str, by: list[str] | None = None) -> DataFrame:
    if task == "regression":
        return regression_metrics(predictions, by)
    if task == "classification":
        return classification_metrics(predictions, by)
    raise ValueError(f"unknown task {task}")


def metrics_of(task: str) -> tuple[str, ...]:
    return REGRESSION if task == "regression" else CLASSIFICATION
