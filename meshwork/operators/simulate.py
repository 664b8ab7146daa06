"""Generators of confounded data, and what an edge, a confound and both explain.

Small ground truths (coefficients, mixing matrices) are drawn on the driver; rows are drawn by Spark.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINKS = ("no_link", "direct_link", "weak_link")


def _normals(n: int, seed: int) -> list[Column]:
    return [F.randn(seed + i) for i in range(n)]


def confounded(spark: SparkSession, link: str, n_samples: int, n_features: int, seed: int = 42) -> DataFrame:
    """(sample_id, x, y, c1): a target and a covariate that are linked or not; the covariate is in all edges."""
    if link not in LINKS:
        raise ValueError(f"{link} is none of {LINKS}")
    c, e, *x = _normals(2 + n_features, seed)
    weight = {"no_link": 0.0, "direct_link": 1.0, "weak_link": 0.3}[link]
    base = spark.range(n_samples).select(F.col("id").alias("sample_id"), c.alias("c1"), e.alias("_e"), F.array(*x).alias("_x"))
    return base.select("sample_id", F.transform("_x", lambda v: v + F.col("c1")).alias("x"), (F.col("_e") + weight * F.col("c1")).alias("y"), "c1")


def binary_target(subjects: DataFrame) -> DataFrame:
    middle = subjects.agg(F.median("y").alias("_m"))
    return subjects.crossJoin(F.broadcast(middle)).withColumn("y", (F.col("y") > F.col("_m")).cast("double")).drop("_m")


@dataclass(frozen=True)
class Multivariate:
    data: DataFrame
    beta: np.ndarray
    gamma: np.ndarray
    mixing: np.ndarray


def multivariate(spark: SparkSession, n_samples: int, n_features: int, n_confounds: int, n_signal: int, rho: float = 0.3, noise: float = 1.0, seed: int = 42) -> Multivariate:
    """x = z A + e with neighbouring columns of e correlated by rho; y = x beta + z gamma + noise."""
    if not 0 <= n_signal <= n_features:
        raise ValueError("n_signal must be between 0 and the number of features")
    random = np.random.default_rng(seed)
    beta = np.zeros(n_features)
    beta[random.choice(n_features, n_signal, replace=False)] = random.normal(1, 0.2, n_signal)
    gamma, mixing = random.normal(size=n_confounds), random.normal(size=(n_confounds, n_features))
    draws = _normals(n_confounds + n_features + 1, seed)
    base = spark.range(n_samples).select(F.col("id").alias("sample_id"), F.array(*draws[:n_confounds]).alias("z"), F.array(*draws[n_confounds:-1]).alias("_u"), draws[-1].alias("_e"))
    # an AR(1) sequence over the columns
    tail = sqrt(1 - rho * rho)
    ar = F.aggregate(F.slice("_u", 2, n_features), F.array(F.col("_u")[0]), lambda a, u: F.concat(a, F.array(F.element_at(a, -1) * rho + u * tail)))
    base = base.withColumn("_ar", ar)
    x = [F.col("_ar")[j] + sum((F.col("z")[i] * float(mixing[i, j]) for i in range(n_confounds)), F.lit(0.0)) for j in range(n_features)]
    base = base.withColumn("x", F.array(*x))
    y = sum((F.col("x")[j] * float(b) for j, b in enumerate(beta) if b), F.lit(0.0)) + sum((F.col("z")[i] * float(g) for i, g in enumerate(gamma)), F.lit(0.0)) + F.col("_e") * noise
    return Multivariate(base.select("sample_id", "x", y.alias("y"), *[F.col("z")[i].alias(f"c{i + 1}") for i in range(n_confounds)]), beta, gamma, mixing)


def ar1_covariance(n: int, rho: float, variance: float = 1.0) -> np.ndarray:
    at = np.arange(n)
    return variance * rho ** np.abs(at[:, None] - at)


def rho_for_unique(r_yz: float, r_xz: float, unique: float) -> float:
    """The correlation of x and y at which x adds `unique` to what z explains of y."""
    grid = np.linspace(-0.99, 0.99, 20001)
    added = (grid - r_yz * r_xz) ** 2 / (1 - r_xz**2)
    valid = 1 + 2 * grid * r_yz * r_xz - grid**2 - r_yz**2 - r_xz**2 > 0
    if not valid.any():
        raise ValueError("no correlation is possible")
    miss = np.where(valid, np.abs(added - unique), np.inf)
    return float(grid[int(miss.argmin())])


def edge_classes(spark: SparkSession, n_samples: int, r_xy: float, r_yz: float, r_xz: float, counts: dict[str, int], seed: int = 42) -> DataFrame:
    """(sample_id, x, y, c1) with edges of four classes in order: mixed (correlated with y and z as given), signal (with y's own part),
    confound (with z only), noise; signs alternate."""
    corr = np.array([[1, r_yz, r_xy], [r_yz, 1, r_xz], [r_xy, r_xz, 1]])
    if np.linalg.eigvalsh(corr).min() <= 0:
        raise ValueError("these correlations exclude each other")
    low = np.linalg.cholesky(corr)  # order: y, z, x
    n = sum(counts.values())
    a, b, *e = _normals(2 + n, seed)
    base = spark.range(n_samples).select(F.col("id").alias("sample_id"), a.alias("_a"), b.alias("_b"), F.array(*e).alias("_e"))
    y, z = F.col("_a"), F.col("_a") * float(low[1, 0]) + F.col("_b") * float(low[1, 1])
    out, i = [], 0
    for kind, m in counts.items():
        for _ in range(m):
            own = F.col("_e")[i]
            if kind == "mixed":
                v = F.col("_a") * float(low[2, 0]) + F.col("_b") * float(low[2, 1]) + own * float(low[2, 2])
            elif kind == "signal":
                # the part of y that z leaves
                part = (y - z * r_yz) / sqrt(1 - r_yz**2)
                v = part * r_xy + own * sqrt(1 - r_xy**2)
            elif kind == "confound":
                v = z * r_xz + own * sqrt(1 - r_xz**2)
            elif kind == "noise":
                v = own
            else:
                raise ValueError(f"unknown class {kind}")
            out.append(v if i % 2 == 0 else -v)
            i += 1
    return base.select("sample_id", F.array(*out).alias("x"), y.alias("y"), z.alias("c1"))


def given_kappa(spark: SparkSession, n_samples: int, r2: float, kappa: float, counts: dict[str, int], seed: int = 42) -> DataFrame:
    """edge_classes where a share kappa of the edges' r2 with y comes through the confound."""
    if not 0 < r2 < 1 or not 0 <= kappa <= 1:
        raise ValueError("r2 must be between 0 and 1, kappa from 0 to 1")
    r_yz = sqrt(kappa * r2)
    r_xz = sqrt(kappa) if kappa < 1 else 0.99
    return edge_classes(spark, n_samples, rho_for_unique(r_yz, min(r_xz, 0.95), (1 - kappa) * r2), r_yz, min(r_xz, 0.95), counts, seed)


def scenarios() -> list[dict]:
    """The grid of a confound sweep: three r2, six kappas."""
    return [{"r2": r2, "kappa": k} for r2 in (0.1, 0.25, 0.4) for k in (0.0, 0.2, 0.4, 0.6, 0.8, 0.95)]


def explained(rows: DataFrame, by: list[str], x: str = "x", y: str = "y", c: str = "c1") -> DataFrame:
    """(by, naive, confound, full, unique): R2 of y on x, on c, on both, and full less confound."""
    cov = F.covar_pop
    sx, sy, sc = F.var_pop(x), F.var_pop(y), F.var_pop(c)
    xy, xc, yc = cov(x, y), cov(x, c), cov(y, c)
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = rows.groupBy(*by).agg(sx.alias("sx"), sy.alias("sy"), sc.alias("sc"), xy.alias("xy"), xc.alias("xc"), yc.alias("yc"))
    naive = share(F.col("xy") * F.col("xy"), F.col("sx") * F.col("sy"))
    confound = share(F.col("yc") * F.col("yc"), F.col("sc") * F.col("sy"))
    left = F.col("xy") - share(F.col("xc") * F.col("yc"), F.col("sc"))
    own = F.col("sx") - share(F.col("xc") * F.col("xc"), F.col("sc"))
    unique = share(left * left, own * F.col("sy"))
    return out.select(*by, naive.alias("naive"), confound.alias("confound"), (confound + unique).alias("full"), unique.alias("unique"))
