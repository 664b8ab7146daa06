"""Small linear systems as Column expressions over wide rows: one row is one system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import RIDGE


def gram(features: list[Column], target: Column) -> list[Column]:
    """Aggregates g_i_j (i <= j) of the features and b_i with the target."""
    out = [F.sum(a * features[j]).alias(f"g_{i}_{j}") for i, a in enumerate(features) for j in range(i, len(features))]
    return out + [F.sum(a * target).alias(f"b_{i}") for i, a in enumerate(features)]


def solved(df: DataFrame, k: int, ridge: float = RIDGE) -> DataFrame:
    """df with beta_0 ... beta_{k-1} in place of the columns of gram(), by Gauss-Jordan steps on (G + ridge I | b).

    A feature of zeros gets 0, an empty system zeros.
    """
    df = df.withColumns({f"m_{i}_{j}": F.col(f"g_{min(i, j)}_{max(i, j)}") + (ridge if i == j else 0.0) for i in range(k) for j in range(k)} | {f"m_{i}_{k}": F.col(f"b_{i}") for i in range(k)})
    df = df.drop(*[f"g_{i}_{j}" for i in range(k) for j in range(i, k)], *[f"b_{i}" for i in range(k)])
    for p in range(k):
        row = {j: F.try_divide(F.col(f"m_{p}_{j}"), F.col(f"m_{p}_{p}")) for j in range(p + 1, k + 1)}
        df = df.withColumns({f"r_{j}": F.coalesce(c, F.lit(0.0)) for j, c in row.items()})
        df = df.withColumns({f"m_{i}_{j}": F.col(f"r_{j}") if i == p else F.col(f"m_{i}_{j}") - F.col(f"m_{i}_{p}") * F.col(f"r_{j}") for i in range(k) for j in range(p + 1, k + 1)})
        df = df.drop(*[f"m_{i}_{p}" for i in range(k)], *[f"r_{j}" for j in range(p + 1, k + 1)])
    return df.withColumnsRenamed({f"m_{i}_{k}": f"beta_{i}" for i in range(k)})


def solved_sql(source: str, keys: str, k: int, name: str, ridge: float = RIDGE) -> str:
    """CTEs that do the same; the last is `name`, of the table `source` with g_i_j and b_i."""
    m = {(i, j): f"g_{min(i, j)}_{max(i, j)}" + (f" + CAST({ridge} AS DOUBLE)" if i == j else "") for i in range(k) for j in range(k)} | {(i, k): f"b_{i}" for i in range(k)}
    out = [f"{name}_0 AS (SELECT {keys}, " + ", ".join(f"{v} AS m_{i}_{j}" for (i, j), v in m.items()) + f" FROM {source})"]
    for p in range(k):
        cols = [f"m_{p}_{j} / m_{p}_{p} AS m_{p}_{j}" if i == p else f"m_{i}_{j} - m_{i}_{p} * m_{p}_{j} / m_{p}_{p} AS m_{i}_{j}" for i in range(k) for j in range(p + 1, k + 1)]
        out.append(f"{name}_{p + 1} AS (SELECT {keys}, {', '.join(cols)} FROM {name}_{p})")
    out.append(f"{name} AS (SELECT {keys}, " + ", ".join(f"m_{i}_{k} AS beta_{i}" for i in range(k)) + f" FROM {name}_{k})")
    return ",\n".join(out)
