"""Corrections of p-values for multiple comparisons, as windows over a family.

Ties in p get equal adjusted values, whatever their order.  A family is one run's, fold's and parameter's edges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

METHODS = ("bonferroni", "sidak", "holm", "holm-sidak", "simes-hochberg", "hommel", "fdr_bh", "fdr_by", "fdr_tsbh", "fdr_tsbky")


def adjusted(df: DataFrame, method: str, by: list[str], p: str = "p", alpha: float = 0.05) -> DataFrame:
    """df with the column p_adjusted."""
    if method not in METHODS:
        raise ValueError(f"{method} is none of {METHODS}")
    w = Window.partitionBy(*by)
    up, down = w.orderBy(p, "edge_id"), w.orderBy(F.desc(p), F.desc("edge_id"))
    so_far = Window.unboundedPreceding, Window.currentRow
    df = df.withColumns({"_m": F.count("*").over(w).cast("double"), "_i": F.row_number().over(up).cast("double")})
    m, i, x = F.col("_m"), F.col("_i"), F.col(p)
    rising = lambda c: F.max(c).over(up.rowsBetween(*so_far))
    falling = lambda c: F.min(c).over(down.rowsBetween(*so_far))

    def stepped(df: DataFrame, value: Column) -> DataFrame:
        return df.withColumn("p_adjusted", F.least(F.lit(1.0), value))

    if method == "bonferroni":
        out = stepped(df, m * x)
    elif method == "sidak":
        out = stepped(df, 1 - F.pow(1 - x, m))
    elif method == "holm":
        out = stepped(df, rising((m - i + 1) * x))
    elif method == "holm-sidak":
        out = stepped(df, rising(1 - F.pow(1 - x, m - i + 1)))
    elif method == "simes-hochberg":
        out = stepped(df, falling((m - i + 1) * x))
    elif method == "fdr_bh":
        out = stepped(df, falling(m * x / i))
    elif method == "fdr_by":
        harmonic = F.sum(1 / i).over(w)
        out = stepped(df.withColumn("_h", harmonic), falling(m * x / i * F.col("_h")))
    elif method == "hommel":
        out = _hommel(df, by, p)
    else:
        out = _two_stage(df, method, w, falling, p, alpha)
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def _two_stage(df: DataFrame, method: str, w, falling, p: str, alpha: float) -> DataFrame:
    """Benjamini-Hochberg with the number of true nulls taken from a first step at alpha (tsbh) or alpha / (1 + alpha) (tsbky)."""
    m, i, x = F.col("_m"), F.col("_i"), F.col(p)
    first = alpha / (1 + alpha) if method == "fdr_tsbky" else alpha
    df = df.withColumn("_bh", F.least(F.lit(1.0), falling(m * x / i)))
    df = df.withColumn("_rejected", F.sum((F.col("_bh") <= first).cast("double")).over(w))
    factor = 1 + alpha if method == "fdr_tsbky" else 1.0
    nulls = F.when(F.col("_rejected") == 0, m).when(F.col("_rejected") == m, F.lit(0.0)).otherwise(m - F.col("_rejected"))
    # without a rejection the first step's values stay; if all are rejected there, no null is left to correct for
    scaled = F.when((F.col("_rejected") == 0) | (F.col("_rejected") == m), F.col("_bh") * factor).otherwise(F.col("_bh") * nulls / m * factor)
    return df.withColumn("p_adjusted", F.least(F.lit(1.0), scaled))


def _hommel(df: DataFrame, by: list[str], p: str) -> DataFrame:
    """Hommel's closed test: the least a such that no subset's Simes test with the edge keeps the null.

    Simes of the j largest p-values, the least of j * p(m - j + k) / k over k, says up to which a they are kept.  An
    edge is rejected at a if h(a) * p <= a, where h(a) is the largest j whose p-values are kept.  A family is one group: its p-values are one array,
    and the work on it grows with its square.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def one(family: pa.Table) -> pa.Table:
        value = family.column(p).to_numpy(zero_copy_only=False).astype(float)
        known = np.flatnonzero(~np.isnan(value))
        m, out = len(known), np.full(len(value), np.nan)
        q = np.sort(value[known])
        kept = np.array([(j * q[m - j :] / np.arange(1, j + 1)).min() for j in range(1, m + 1)])
        kept = np.maximum.accumulate(kept[::-1])[::-1]  # of j or more
        # h(a) <= j from kept[j] on; the first j for which that is not above j * p
        bound = np.append(kept[1:], 0.0) / np.arange(1, m + 1)
        j = m - np.searchsorted(bound[::-1], value[known], "right")
        out[known] = np.minimum(1.0, np.minimum((j + 1) * value[known], kept[np.minimum(j, m - 1)])) if m else out[known]
        return family.append_column("p_adjusted", pa.array(out, from_pandas=True))

    return df.groupBy(*by).applyInArrow(one, ", ".join(f"`{c}` {kind}" for c, kind in kinds.items()) + ", p_adjusted double")
