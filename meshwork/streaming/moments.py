"""Second moments kept up to date as samples arrive.

The sums that edge statistics need can be added, so a stream of samples needs no state but a table of sums per batch: each micro-batch adds
its sums as a folder of its own, written over if the batch is repeated, and readers add up the folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.edges import test_moments
from ..operators.vectors import long_edges


def keep_moments(samples: DataFrame, folder: str, checkpoint: str, covariates: list[str] | None = None, available_now: bool = True) -> StreamingQuery:
    """Starts a query over a stream of subjects (sample_id, x, y, sample_fold, covariates) that keeps `folder`."""
    covariates = covariates or []

    def add(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(F.lit(0).alias("run_id"), "sample_id", "sample_fold", "y", *covariates)
        test_moments(long_edges(batch), rows, covariates).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    writer = samples.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def kept_moments(spark: SparkSession, folder: str) -> DataFrame:
    """The sums of all batches so far, for edges.train_moments()."""
    parts = spark.read.parquet(folder).drop("batch")
    sums = [c for c in parts.columns if c not in ("run_id", "edge_id", "sample_fold")]
    return parts.groupBy("run_id", "edge_id", "sample_fold").agg(*[F.sum(c).alias(c) for c in sums])
