"""What folds and runs add up to: increments, summaries, stability, best parameters, permutation p-values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scoring import KEYS

#: Means that agree in so many digits are equal: parameters that select the same edges differ in the order of sums only
MEAN_DIGITS = 9


def with_increment(metrics: DataFrame) -> DataFrame:
    """metrics with the model increment: each metric of full less that of covariates."""
    names = [c for c in metrics.columns if c not in KEYS]
    keys = [c for c in KEYS if c in metrics.columns and c != "model"]
    full, cov = metrics.where("model = 'full'").alias("a"), metrics.where("model = 'covariates'").alias("b")
    more = full.join(cov, keys).select(*keys, F.lit("increment").alias("model"), *[(F.col(f"a.{c}") - F.col(f"b.{c}")).alias(c) for c in names])
    return metrics.unionByName(more)


def summary(metrics: DataFrame) -> DataFrame:
    """Mean and sample standard deviation of each metric over folds: metric__mean, metric__std (null for one fold)."""
    names = [c for c in metrics.columns if c not in KEYS]
    keys = [c for c in KEYS if c in metrics.columns and c not in ("fold", "inner_fold")]
    return metrics.groupBy(*keys).agg(*[a for c in names for a in (F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std"))])


def stability(mask: DataFrame, n_folds: int) -> DataFrame:
    """(…, edge_id, network, n_selected, stability) of edges that a fold selects; the others' stability is 0."""
    keys = [c for c in ("run_id", "param_id", "edge_id", "network") if c in mask.columns]
    out = mask.groupBy(*keys).agg(F.count_distinct("fold").alias("n_selected"))
    return out.withColumn("stability", F.col("n_selected") / F.lit(float(n_folds)))


def stable_edges(stability: DataFrame, share: float, n_folds: int) -> DataFrame:
    """Edges that more than this share of the folds selects; folds are counted, so that no rounding decides."""
    import math

    return stability.where(F.col("n_selected") > math.floor(share * n_folds + 1e-9))


def best_parameters(metrics: DataFrame, metric: str) -> DataFrame:
    """The parameter with the greatest mean over folds of the connectome model on both networks; the first of those that are equal in MEAN_DIGITS digits."""
    keys = [c for c in ("run_id", "fold") if c in metrics.columns and not (c == "fold" and "inner_fold" not in metrics.columns)]
    means = metrics.where("model = 'connectome' and network = 'both'").groupBy(*keys, "param_id").agg(F.avg(metric).alias("mean"))
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("mean", MEAN_DIGITS)), "param_id")
    return means.withColumn("_i", F.row_number().over(order)).where("_i = 1").drop("_i")


def permutation_p(values: DataFrame, names: list[str]) -> DataFrame:
    """(model, network, names): (1 + permuted runs that are strictly better) / (1 + permuted runs), of a table with run_id, model, network and a
    column for each name; run 0 is as observed.  Of an error less is better; NaN never is."""
    true, null = values.where("run_id = 0").alias("t"), values.where("run_id > 0").alias("n")

    def p(name: str):
        t, v = F.col(f"t.{name}"), F.col(f"n.{name}")
        better = (v < t) if name.split("__")[0].endswith("error") else (v > t)
        better = better & ~F.isnan(v) & ~F.isnan(t)
        return ((F.sum(F.coalesce(better, F.lit(False)).cast("int")) + 1) / (F.count("*") + 1)).alias(name)

    return null.join(true, ["model", "network"]).groupBy("model", "network").agg(*map(p, names))
