"""Symmetric matrices as vectors of their upper triangle, as arrays and as long tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def infer_n_nodes(n_features: int) -> int | None:
    """The nodes of a network with so many edges; None if there is no such network."""
    if n_features < 1:
        return None
    n = (1 + math.isqrt(1 + 8 * n_features)) // 2
    return n if n * (n - 1) // 2 == n_features else None


def nodes_column(n_features: Column) -> Column:
    n = F.floor((1 + F.sqrt(1 + 8 * n_features.cast("double"))) / 2).cast("long")
    return F.when((n_features >= 1) & (n * (n - 1) / 2 == n_features), n)


def check_n_features(n_features: int) -> int:
    n = infer_n_nodes(n_features)
    if n is None:
        near = max(2, round((1 + math.sqrt(1 + 8 * max(n_features, 1))) / 2))
        raise ValueError(f"{n_features} features are no upper triangle; the nearest sizes are {sorted({m * (m - 1) // 2 for m in (near - 1, near, near + 1) if m > 1})}")
    return n


def edge_dim(spark: SparkSession, n_nodes: int) -> DataFrame:
    """(edge_id, node_i, node_j), row by row of the upper triangle."""
    i = spark.range(n_nodes - 1).select(F.col("id").cast("int").alias("node_i"))
    pairs = i.select("node_i", F.explode(F.sequence(F.col("node_i") + 1, F.lit(n_nodes - 1))).alias("node_j"))
    return pairs.select((F.col("node_i") * n_nodes - (F.col("node_i") * (F.col("node_i") + 1) / 2).cast("int") + F.col("node_j") - F.col("node_i") - 1).cast("int").alias("edge_id"), "node_i", F.col("node_j").cast("int").alias("node_j"))


def long_edges(subjects: DataFrame, x: str = "x") -> DataFrame:
    """(sample_id, edge_id, value); NaN, the mark of a missing value, becomes null."""
    long = subjects.select("sample_id", F.posexplode(x).alias("edge_id", "value"))
    return long.select("sample_id", "edge_id", F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double")).alias("value"))


def matrix_to_vector(matrix: Column) -> Column:
    """The upper triangle of an array of rows; a matrix that isn't square is an error."""
    square = F.forall(matrix, lambda row: F.size(row) == F.size(matrix))
    flat = F.flatten(F.transform(matrix, lambda row, i: F.slice(row, i + 2, F.size(matrix))))
    return F.when(square, flat).otherwise(F.raise_error(F.lit("the matrix isn't square")))


def vector_to_matrix(vector: Column, n_nodes: int) -> Column:
    """The symmetric matrix with a zero diagonal."""

    def at(i: Column, j: Column) -> Column:
        lo, hi = F.least(i, j), F.greatest(i, j)
        return F.element_at(vector, (lo * n_nodes - lo * (lo + 1) / 2 + hi - lo).cast("int"))

    nodes = F.sequence(F.lit(0), F.lit(n_nodes - 1))
    return F.transform(nodes, lambda i: F.transform(nodes, lambda j: F.when(i == j, F.lit(0.0)).otherwise(at(i, j))))


def symmetric(long: DataFrame, dim: DataFrame, value: str = "value") -> DataFrame:
    """(…, node_i, node_j, value) both ways round of a long table by edge_id."""
    up = long.join(F.broadcast(dim), "edge_id").drop("edge_id")
    return up.unionByName(up.withColumnsRenamed({"node_i": "node_j", "node_j": "node_i"}))
