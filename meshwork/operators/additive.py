"""Additive models: penalised cubic B-splines of each feature, fitted from sums.

A row has four non-zero basis values for each feature, which are expressions of it; the sums of their products are one aggregate by
(group, i, j) over these few pairs, so no task holds a group's samples.  A group's summed matrix is a bounded array; solving
it for each penalty of a grid, and choosing among them by generalised cross-validation, needs no more than it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .trees import feature_names, group_keys

KNOTS, PENALTIES, TINY = 10, tuple(10.0**i for i in range(-3, 4)), 1e-6


def _with_ends(design: DataFrame) -> DataFrame:
    """design with each feature's training range."""
    by = group_keys(design)
    train = [(f, F.when(~F.col("is_test"), F.col(f))) for f in feature_names(design)]
    return design.join(design.groupBy(*by).agg(*[g(x).alias(f"{n}_{f}") for f, x in train for n, g in (("lo", F.min), ("hi", F.max))]), by)


def basis(feature: str, knots: int = KNOTS) -> tuple[Column, list[Column]]:
    """The first basis function that isn't 0 at a feature, and the values of it and the three after it; beyond the training range, those at its end."""
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col(feature) - F.col(f"lo_{feature}"), F.col(f"hi_{feature}") - F.col(f"lo_{feature}")), F.lit(0.0)))) * (knots - 3)
    first = F.least(F.floor(at), F.lit(knots - 4)).cast("int")
    u = at - first
    v = 1 - u
    return first, [v * v * v / 6, (u * u * u * 3 - u * u * 6 + 4) / 6, (v * v * v * 3 - v * v * 6 + 4) / 6, u * u * u / 6]


def _entries(features: list[str], knots: int) -> Column:
    """(i, v) of a row's basis values that may not be 0: 0 for the intercept, then knots for each feature."""
    out = [F.struct(F.lit(0).alias("i"), F.lit(1.0).alias("v"))]
    for k, f in enumerate(features):
        first, values = basis(f, knots)
        out += [F.struct((first + (1 + k * knots + j)).alias("i"), v.alias("v")) for j, v in enumerate(values)]
    return F.array(*out)


def basis_sums(design: DataFrame, knots: int = KNOTS) -> DataFrame:
    """(keys, i, j, total) over the training rows: sums of products of basis functions i <= j, of i with y where j is -1, and of y's square where
    both are."""
    by, features = group_keys(design), feature_names(design)
    rows = _with_ends(design).where("not is_test").select(*by, "y", _entries(features, knots).alias("e"))
    with_y = F.concat(F.transform("e", lambda a: F.struct(a["i"].alias("i"), F.lit(-1).alias("j"), (a["v"] * F.col("y")).alias("v"))), F.array(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j"), (F.col("y") * F.col("y")).alias("v"))))
    pairs = F.flatten(F.transform("e", lambda a, k: F.transform(F.slice("e", k + 1, F.size("e")), lambda b: F.struct(a["i"].alias("i"), b["i"].alias("j"), (a["v"] * b["v"]).alias("v")))))
    return rows.select(*by, F.explode(F.concat(pairs, with_y)).alias("p")).groupBy(*by, "p.i", "p.j").agg(F.sum("p.v").alias("total"))


def solved_sums(i: np.ndarray, j: np.ndarray, total: np.ndarray, features: int, knots: int = KNOTS, penalties: tuple[float, ...] = PENALTIES) -> tuple[np.ndarray, float]:
    """Coefficients and penalty of least generalised cross-validation, from one group's sums."""
    m = 1 + features * knots
    g, b, yy = np.zeros((m, m)), np.zeros(m), float(total[(i < 0)].sum())
    some = j >= 0
    g[i[some], j[some]] = g[j[some], i[some]] = total[some]
    own = (j < 0) & (i >= 0)
    b[i[own]] = total[own]
    rough, second = np.zeros((m, m)), np.diff(np.eye(knots), 2, axis=0)
    for k in range(features):
        at = slice(1 + k * knots, 1 + (k + 1) * knots)
        rough[at, at] = second.T @ second
    n, best = g[0, 0], None
    for penalty in penalties:
        a = g + penalty * rough + TINY * np.diag([0.0, *[1.0] * (m - 1)])
        beta = np.linalg.solve(a, b)
        left = n - np.trace(np.linalg.solve(a, g))
        score = n * max(yy - 2 * beta @ b + beta @ g @ beta, 0.0) / max(left, 1e-9) ** 2
        if best is None or score < best[0]:
            best = (score, beta, penalty)
    return best[1], best[2]


def fitted(sums: DataFrame, features: int, knots: int = KNOTS) -> DataFrame:
    """(keys, beta, penalty) of each group of basis_sums()."""
    by = [c for c in sums.columns if c not in ("i", "j", "total")]
    lists = sums.groupBy(*by).agg(F.collect_list(F.struct("i", "j", "total")).alias("s"))

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [solved_sums(*(np.array([r[c] for r in s]) for c in ("i", "j", "total")), features, knots) for s in part["s"]]
            yield part[by].assign(beta=[b.tolist() for b, _ in out], penalty=[p for _, p in out])

    schema = ", ".join(f"{c} {sums.schema[c].dataType.simpleString()}" for c in by)
    return lists.mapInPandas(solve, f"{schema}, beta array<double>, penalty double")


def additive_predictions(design: DataFrame, knots: int = KNOTS) -> DataFrame:
    """Like linear_predictions, of the models connectome and full."""
    design = design.where("model in ('connectome', 'full')")
    by, features = group_keys(design), feature_names(design)
    beta = fitted(basis_sums(design, knots), len(features), knots)
    found = F.aggregate(_entries(features, knots), F.lit(0.0), lambda a, e: a + e["v"] * F.get("beta", e["i"]))
    return _with_ends(design).where("is_test").join(beta, by).select(*by, "sample_id", F.col("y").alias("y_true"), found.alias("y_pred"))
