"""Folds and permutations that depend on a seed and the sample's id only, so that any engine can repeat them.

Ranks over all samples are taken without gathering them: by an md5 key, within buckets of its first digits, plus the
number of samples in the buckets before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _key(*parts) -> Column:
    return F.md5(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def ranked(df: DataFrame, key: Column, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """df with each row's rank from 0 in the order of key (hexadecimal, evenly spread) and sample_id, within `by`."""
    by = by or []
    df = df.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, 3))
    rows = df.withColumn("_at", F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_key", "sample_id")) - 1)
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*by, "_bucket").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    return rows.join(counts, [*by, "_bucket"]).withColumn(name, F.col("_before") + F.col("_at")).drop("_key", "_bucket", "_at", "_before")


def kfold(samples: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """samples with their fold, 0 to k - 1; sizes differ by one at most."""
    return ranked(samples, _key("fold", seed, F.col("sample_id").cast("string"))).withColumn("fold", F.pmod("rank", F.lit(k)).cast("int")).drop("rank")


def stratified_kfold(samples: DataFrame, k: int, by: str, seed: int = 42) -> DataFrame:
    return ranked(samples, _key("fold", seed, F.col("sample_id").cast("string")), [by]).withColumn("fold", F.pmod("rank", F.lit(k)).cast("int")).drop("rank")


def repeated_kfold(samples: DataFrame, k: int, repeats: int, seed: int = 42) -> DataFrame:
    """(…, repeat, fold): a row for each repeat, with a seed of its own."""
    rows = samples.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    key = _key("fold", (F.col("repeat") + seed).cast("string"), F.col("sample_id").cast("string"))
    return ranked(rows, key, ["repeat"]).withColumn("fold", F.pmod("rank", F.lit(k)).cast("int")).drop("rank")


def shuffle_split(samples: DataFrame, test_share: float, splits: int, seed: int = 42) -> DataFrame:
    """(…, split, is_test): independent random splits; the test part has ceil(share x n) samples."""
    rows = samples.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    n = samples.agg(F.count("*").alias("_n"))
    key = _key("split", (F.col("split") + seed).cast("string"), F.col("sample_id").cast("string"))
    return ranked(rows, key, ["split"]).crossJoin(F.broadcast(n)).withColumn("is_test", F.col("rank") < F.ceil(F.col("_n") * test_share)).drop("rank", "_n")


def permuted_targets(samples: DataFrame, runs: int, seed: int = 42, y: str = "y") -> DataFrame:
    """(run_id, sample_id, y): run 0 as observed, runs 1 to `runs` shuffled.

    A run gives the sample of rank q in the order of ids' keys the target of the sample of rank q in the run's order.
    """
    samples = samples.select("sample_id", F.col(y).alias("y"))
    natural = ranked(samples, F.md5(F.col("sample_id").cast("string"))).select("sample_id", "rank")
    rows = samples.withColumn("run_id", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    order = ranked(rows, _key(seed, F.col("run_id").cast("string"), F.col("sample_id").cast("string")), ["run_id"])
    shuffled = order.select("run_id", "rank", "y").join(natural, "rank").select("run_id", "sample_id", "y")
    return samples.select(F.lit(0).alias("run_id"), "sample_id", "y").unionByName(shuffled)


def with_roles(samples: DataFrame, k: int) -> DataFrame:
    """samples (with sample_fold) once for each fold: fold, is_test."""
    return samples.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("is_test", F.col("fold") == F.col("sample_fold"))


SPLITTERS = ("kfold", "stratified", "repeated", "shuffle")


def roles(samples: DataFrame, splitter: str, n: int, seed: int = 42, by: list[str] | None = None, repeats: int = 1, test_share: float = 0.2, name: str = "fold", y: str = "y") -> DataFrame:
    """(by, sample_id, name, is_test) of each split, numbered from 0, within `by`; samples: by, sample_id, y.

    kfold and stratified have n folds, repeated has repeats times n (as those of repeats seeds), shuffle has n independent splits.
    """
    if splitter not in SPLITTERS:
        raise ValueError(f"{splitter} is none of {SPLITTERS}")
    by = by or []
    outer = [F.col(c).cast("string") for c in by]
    if splitter == "shuffle":
        rows = samples.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        sizes = samples.groupBy(*by).agg(F.count("*").alias("_n")) if by else samples.agg(F.count("*").alias("_n"))
        out = ranked(rows, _key("split", (F.col(name) + seed).cast("string"), *outer, F.col("sample_id").cast("string")), [*by, name])
        out = out.join(F.broadcast(sizes), by) if by else out.crossJoin(F.broadcast(sizes))
        return out.select(*by, "sample_id", name, (F.col("rank") < F.ceil(F.col("_n") * test_share)).alias("is_test"))
    rows = samples.withColumn("_repeat", F.explode(F.sequence(F.lit(0), F.lit((repeats if splitter == "repeated" else 1) - 1))))
    within = [*by, "_repeat", *([y] if splitter == "stratified" else [])]
    own = ranked(rows, _key("fold", (F.col("_repeat") + seed).cast("string"), *outer, F.col("sample_id").cast("string")), within).withColumn("_own", F.pmod("rank", F.lit(n)))
    out = own.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out.select(*by, "sample_id", (F.col("_repeat") * n + F.col("_k")).cast("int").alias(name), (F.col("_own") == F.col("_k")).alias("is_test"))
