"""Network strengths and the model variants on them.

Design rows have a run, a fold, a sample and its role in the fold; the models' normal equations are sums over the training rows, solved as
Column expressions, and coefficients are joined back to all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.linear import gram, solved
from . import blocks

VARIANTS = ("connectome", "covariates", "full", "residuals")
NETWORKS = ("positive", "negative", "both")


def strengths(edges: DataFrame, mask: DataFrame, rows: DataFrame, subjects: DataFrame | None = None) -> DataFrame:
    """rows (run_id, fold, sample_id, ...) with the sums of each network's edges: pos and neg; an empty network gives 0.

    The mask (run_id, fold, edge_id, network) is sparse; Spark sends it to all tasks where it is small.  With subjects
    (sample_id, x array) the sums are products by blocks (see operators.blocks), for many runs.
    """
    if subjects is not None:
        return rows.join(blocks.strengths(subjects, mask), ["run_id", "fold", "sample_id"], "left").fillna(0.0, ["pos", "neg"])
    shared = ["edge_id", *[k for k in ("fold", "unit") if k in edges.columns and k in mask.columns]]  # where values depend on the fold
    sums = edges.join(mask, shared).groupBy("run_id", "fold", "sample_id").agg(F.sum(F.when(F.col("network") == "positive", F.col("value"))).alias("pos"), F.sum(F.when(F.col("network") == "negative", F.col("value"))).alias("neg"))
    return rows.join(sums, ["run_id", "fold", "sample_id"], "left").fillna(0.0, ["pos", "neg"])


def _fitted(rows: DataFrame, features: list[Column], target: Column, train: Column, by: list[str]) -> DataFrame:
    """The coefficients of target on [1, *features] over the training rows of each group."""
    zero = F.lit(0.0)
    own = [F.when(train, f).otherwise(zero) for f in (F.lit(1.0), *features)]
    return solved(rows.groupBy(*by).agg(*gram(own, F.when(train, target).otherwise(zero))), len(own))


def with_residual_strengths(rows: DataFrame, covariates: list[str]) -> DataFrame:
    """rows with pos_res and neg_res: strengths less what covariates predict of them, learnt on the training rows."""
    by, k, cov = ["run_id", "fold"], len(covariates) + 1, [F.col(c) for c in covariates]
    # one aggregate has the covariates' products, which both fits share, and those with either strength
    own = [F.when(~F.col("is_test"), f).otherwise(0.0) for f in (F.lit(1.0), *cov)]
    fit = rows.groupBy(*by).agg(*gram(own, F.when(~F.col("is_test"), F.col("pos")).otherwise(0.0)), *[F.sum(f * F.col("neg")).alias(f"c_{i}") for i, f in enumerate(own)])
    shared = {f"g_{i}_{j}": f"h_{i}_{j}" for i in range(k) for j in range(i, k)}
    fit = solved(fit.withColumns({h: F.col(g) for g, h in shared.items()}), k).withColumnsRenamed({f"beta_{i}": f"_pos{i}" for i in range(k)} | {f"c_{i}": f"b_{i}" for i in range(k)} | {h: g for g, h in shared.items()})
    fit = solved(fit, k).withColumnsRenamed({f"beta_{i}": f"_neg{i}" for i in range(k)})
    left = {f"{n}_res": F.col(n) - sum((F.col(f"_{n}{i + 1}") * c for i, c in enumerate(cov)), F.col(f"_{n}0")) for n in ("pos", "neg")}
    return rows.join(fit, by).withColumns(left).drop(*[f"_{n}{i}" for n in ("pos", "neg") for i in range(k)])


def design(rows: DataFrame, covariates: list[str]) -> DataFrame:
    """A row for each model and network, with its features f1, f2, ... (0 where a model has fewer)."""
    cov = [F.col(c) for c in covariates]
    zero = F.lit(0.0)

    def strength(network: str, pos: str, neg: str) -> list[Column]:
        return [F.col(pos) if network != "negative" else zero, F.col(neg) if network != "positive" else zero]

    kinds = []
    for network in NETWORKS:
        raw, res = strength(network, "pos", "neg"), strength(network, "pos_res", "neg_res")
        none = [zero] * len(cov)
        for model, f in (("connectome", [*raw, *none]), ("covariates", [zero, zero, *cov]), ("full", [*raw, *cov]), ("residuals", [*res, *none])):
            kinds.append(F.struct(F.lit(model).alias("model"), F.lit(network).alias("network"), *[c.cast("double").alias(f"f{i + 1}") for i, c in enumerate(f)]))
    keep = [c for c in ("run_id", "fold", "sample_id", "is_test", "y", "param_id") if c in rows.columns]
    return rows.select(*keep, F.explode(F.array(*kinds)).alias("d")).select(*keep, "d.*")


def linear_predictions(design: DataFrame, train: Column | None = None) -> DataFrame:
    """The design's test rows with y_pred, by least squares on the training rows."""
    features = sorted((c for c in design.columns if c[0] == "f" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    by = [c for c in ("run_id", "fold", "param_id", "model", "network") if c in design.columns]
    fit = _fitted(design, [F.col(f) for f in features], F.col("y"), ~F.col("is_test"), by)
    predicted = sum((F.col(f"beta_{i + 1}") * F.col(f) for i, f in enumerate(features)), F.col("beta_0"))
    return design.where("is_test").join(fit, by).select(*by, "sample_id", F.col("y").alias("y_true"), predicted.alias("y_pred"))


def residual_edges(edges: DataFrame, rows: DataFrame, covariates: list[str]) -> DataFrame:
    """(fold, sample_id, edge_id, value) of each edge less what covariates predict of it, learnt on each fold's training part; rows: fold, sample_id,
    is_test, covariates."""
    cov = [F.col(c) for c in covariates]
    shared = [k for k in ("sample_id", "fold") if k in edges.columns]  # imputed values depend on the fold
    long = edges.join(rows.select("fold", "sample_id", "is_test", *covariates), shared)
    fit = _fitted(long, cov, F.col("value"), ~F.col("is_test"), ["fold", "edge_id"])
    predicted = sum((F.col(f"beta_{i + 1}") * c for i, c in enumerate(cov)), F.col("beta_0"))
    return long.join(fit, ["fold", "edge_id"]).select("fold", "sample_id", "edge_id", (F.col("value") - predicted).alias("value"))
