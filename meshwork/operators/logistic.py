"""Logistic regression by iteratively reweighted least squares, over all groups of a design at once.

A group's training rows are packed into blocks of at most BLOCK samples.  A group of one block is fitted within one task, with all its
iterations; only a group of more needs passes: each block gives its sums for the present coefficients (a small array), the
arrays are added by group, and the coefficients, which each pass writes to the shared folder, move until none does by `near`.
Either way an iteration is the same step, from coefficients of 0, and there are at most `rounds`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import RIDGE
from ..sources.tables import dropped, materialized
from .trees import feature_names, group_keys

LEAST_WEIGHT, BLOCK = 1e-8, 1 << 16


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def sums(x: np.ndarray, y: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Weighted second moments of x, and x times what is left of y, side by side."""
    p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -700, 700)))
    w = np.maximum(p * (1 - p), LEAST_WEIGHT)
    return np.column_stack([(x * w[:, None]).T @ x, x.T @ (y - p)])


def step(total: np.ndarray) -> np.ndarray:
    return np.linalg.solve(total[:, :-1] + RIDGE * np.eye(len(total)), total[:, -1])


def _unpacked(values: pa.Scalar, k: int) -> tuple[np.ndarray, np.ndarray]:
    rows = values.values.to_numpy().reshape(-1, k)
    return np.column_stack([np.ones(len(rows)), rows[:, 1:]]), rows[:, 0]


def _with(batch: pa.RecordBatch, by: list[str], **more: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), *more.values()], [*by, *more])


def _whole(by: list[str], k: int, rounds: int, near: float):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for values in batch.column("data"):
                x, y = _unpacked(values, k)
                beta = np.zeros(k)
                for _ in range(rounds):
                    moved = step(sums(x, y, beta))
                    beta = beta + moved
                    if np.abs(moved).max() < near:
                        break
                out.append(beta.tolist())
            yield _with(batch, by, beta=pa.array(out, pa.list_(pa.float64())))

    return of


def _block_sums(by: list[str], k: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [sums(*_unpacked(v, k), b.values.to_numpy()).ravel().tolist() for v, b in zip(batch.column("data"), batch.column("beta"), strict=True)]
            yield _with(batch, by, total=pa.array(out, pa.list_(pa.float64())))

    return of


def _moved(by: list[str], k: int, near: float):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved = [step(t.values.to_numpy().reshape(k, k + 1)) for t in batch.column("total")]
            beta = [(b.values.to_numpy() + m).tolist() for b, m in zip(batch.column("beta"), moved, strict=True)]
            yield _with(batch, by, beta=pa.array(beta, pa.list_(pa.float64())), moves=pa.array([bool(np.abs(m).max() >= near) for m in moved], pa.bool_()))

    return of


def fit_logistic(design: DataFrame, by: list[str], features: list[str], rounds: int = 25, near: float = 1e-6, block: int = BLOCK) -> DataFrame:
    """(by, beta array): of the training rows' y (0 or 1) on [1, *features]; design has a sample_id."""
    k = len(features) + 1
    train = materialized(design.where("not is_test").select(*by, "sample_id", "y", *features))
    most = train.groupBy(*by).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    # blocks of half the size on average, so that few are above it
    n = 1 if most <= block else -(-2 * most // block)
    packed = train.withColumn("_block", F.pmod(F.xxhash64("sample_id"), F.lit(n))).groupBy(*by, "_block").agg(F.flatten(F.collect_list(F.array(*[F.col(c).cast("double") for c in ("y", *features)]))).alias("data"))
    keys = ", ".join(f"{c} {train.schema[c].dataType.simpleString()}" for c in by)
    if n == 1:
        return packed.select(*by, "data").mapInArrow(_whole(by, k, rounds, near), f"{keys}, beta array<double>")
    packed = materialized(packed)
    beta = materialized(packed.select(*by).distinct().withColumns({"beta": F.array(*[F.lit(0.0)] * k), "moves": F.lit(True)}))
    for _ in range(rounds):
        parts = packed.join(beta.where("moves"), by).select(*by, "data", "beta").mapInArrow(_block_sums(by, k), f"{keys}, total array<double>")
        total = parts.select(*by, F.posexplode("total")).groupBy(*by, "pos").agg(F.sum("col").alias("v")).groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("total"))
        new = total.join(beta, by).select(*by, "total", "beta").mapInArrow(_moved(by, k, near), f"{keys}, beta array<double>, moves boolean")
        before, beta = beta, materialized(new.unionByName(beta.where("not moves")))
        dropped(before)
        if not beta.where("moves").take(1):
            break
    dropped(train, packed)
    return beta.select(*by, "beta")


def logistic_predictions(design: DataFrame, rounds: int = 25, block: int = BLOCK) -> DataFrame:
    """The design's test rows with y_pred, the probability of 1."""
    by, features = group_keys(design), feature_names(design)
    fit = fit_logistic(design, by, features, rounds, block=block)
    eta = reduce(lambda a, b: a + b, (F.get("beta", F.lit(i + 1)) * F.col(f) for i, f in enumerate(features)), F.get("beta", F.lit(0)))
    return design.where("is_test").join(fit, by).select(*by, "sample_id", F.col("y").alias("y_true"), sigmoid(eta).alias("y_pred"))
