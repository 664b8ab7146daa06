"""Edge statistics of all folds and runs from second moments, and selection.

A statistic of a fold's training part is a function of sums over its samples.  Sums over the test parts are gathered once, with partial
sums before the shuffle; those of a training part are the total less the test part's.  Runs (permuted targets) and folds are
grouping keys, so one plan covers them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import LEAST_VARIANCE, correlation, critical_z, p_of, z_of
from ..sources.tables import materialized
from . import blocks

STATISTICS = ("pearson", "pearson_partial", "spearman", "spearman_partial", "point_biserial", "point_biserial_partial")


def _names(covariates: list[str]) -> list[str]:
    return ["x", "y", *covariates]


def _sums(variables: list[str]) -> list[Column]:
    out = [F.count("*").alias("n"), *[F.sum(v).alias(f"s_{v}") for v in variables]]
    return out + [F.sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for i, a in enumerate(variables) for b in variables[i:]]


def test_moments(edges: DataFrame, samples: DataFrame, covariates: list[str]) -> DataFrame:
    """Sums by run_id, edge_id, sample_fold; edges (sample_id, edge_id, value), samples (run_id, sample_id,
    sample_fold, y, covariates).  Missing values are left out, pair by pair."""
    used = samples.select("run_id", "sample_id", "sample_fold", "y", *covariates)
    rows = edges.withColumnRenamed("value", "x").where(F.col("x").isNotNull()).join(used, "sample_id")
    return rows.groupBy("run_id", "edge_id", "sample_fold").agg(*_sums(_names(covariates)))


def test_moments_blocked(subjects: DataFrame, samples: DataFrame, covariates: list[str]) -> DataFrame:
    """The same sums from subjects (sample_id, x array), of blocks of edges and runs; x and y must not have missing values.

    See operators.blocks: tasks multiply the samples' matrices and pass on sums, so that what is shuffled doesn't grow with the number
    of samples times edges times runs.
    """
    return blocks.unpacked(blocks.moments(subjects, samples, covariates), covariates)


def train_moments(test: DataFrame) -> DataFrame:
    """Sums of each fold's training part: the total of all folds less the fold's own."""
    sums = [c for c in test.columns if c not in ("run_id", "edge_id", "sample_fold")]
    whole = Window.partitionBy("run_id", "edge_id")
    return test.select("run_id", "edge_id", F.col("sample_fold").alias("fold"), *[(F.sum(c).over(whole) - F.col(c)).alias(c) for c in sums])


def all_moments(edges: DataFrame, samples: DataFrame, covariates: list[str], keys: tuple[str, ...] = ("run_id", "fold")) -> DataFrame:
    """Sums by the keys and edge_id of samples that already are training parts (for ranks, imputed or residual values, splits that overlap)."""
    rows = edges.withColumnRenamed("value", "x").where(F.col("x").isNotNull())
    shared = [k for k in ("sample_id", *keys) if k in rows.columns and k in samples.columns]
    return rows.join(samples, shared).groupBy(*keys, "edge_id").agg(*_sums(_names(covariates)))


def statistics(moments: DataFrame, covariates: list[str]) -> DataFrame:
    """The moments' keys with n, r (semi-partial where there are covariates), z and p.

    The intercept and then one covariate after another are swept out of all sums; a covariate that those before explain
    adds nothing.  Edges whose variance isn't above LEAST_VARIANCE get r 0 and p 1.
    """
    keys = [c for c in moments.columns if c != "n" and not c.startswith("s_")]
    variables = _names(covariates)
    pairs = [(a, b) for i, a in enumerate(variables) for b in variables[i:]]
    n = F.col("n")
    df = moments.select(*keys, "n", *[(F.col(f"s_{a}_{b}") - F.col(f"s_{a}") * F.col(f"s_{b}") / n).alias(f"v_{a}_{b}") for a, b in pairs])
    own = {c: F.col(f"v_{c}_{c}") for c in covariates}
    df = df.withColumns({"_ssy": F.col("v_y_y"), "_ssx": F.col("v_x_x"), **{f"_ss_{c}": v for c, v in own.items()}})
    left = list(variables)
    for c in covariates:
        left.remove(c)
        name = lambda a, b: f"v_{a}_{b}" if (a, b) in pairs else f"v_{b}_{a}"
        ok = F.col(f"v_{c}_{c}") > F.col(f"_ss_{c}") * 1e-10
        part = lambda a, b: F.when(ok, F.try_divide(F.col(name(a, c)) * F.col(name(b, c)), F.col(f"v_{c}_{c}"))).otherwise(0.0)  # noqa: E731, B023
        df = df.withColumns({name(a, b): F.col(name(a, b)) - part(a, b) for i, a in enumerate(left) for b in left[i:]})
    varies = F.coalesce(F.col("_ssx") / F.nullif(n - 1, F.lit(0)) > LEAST_VARIANCE, F.lit(False))
    reported = correlation(F.col("v_x_y"), F.col("v_x_x"), F.col("_ssy"))
    partial = correlation(F.col("v_x_y"), F.col("v_x_x"), F.col("v_y_y"))
    z = z_of(partial, n, len(covariates))
    return df.select(*keys, "n", F.when(varies, reported).otherwise(0.0).alias("r"), F.when(varies, z).otherwise(0.0).alias("z")).withColumn("p", p_of(F.col("z")))


def ordinal_ranks(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """rows with each column replaced by its rank from 0 within `by`; equal values in the order of sample_id."""
    return rows.withColumns({c: (F.row_number().over(Window.partitionBy(*by).orderBy(c, "sample_id")) - 1).cast("double") for c in columns})


def training_ranks(rows: DataFrame, by: list[str], columns: list[str], parts: int) -> DataFrame:
    """rows (by, sample_id, trains, columns) with each column replaced by an array: for each part its rank from 0 within the part's training
    samples, null where the sample isn't one; trains says for each part whether it is.  Equal values are in the order of sample_id.

    Rows are sorted once: a rank within a training part is the number of its samples before.
    """
    for c in columns:
        before = Window.partitionBy(*by).orderBy(c, "sample_id").rowsBetween(Window.unboundedPreceding, -1)
        trains = [F.get("trains", F.lit(k)) for k in range(parts)]
        rows = rows.select(*[x for x in rows.columns if x != c], *[F.count(F.when(t, 1)).over(before).alias(f"_{k}") for k, t in enumerate(trains)])
        rows = rows.withColumn(c, F.array(*[F.when(t, F.col(f"_{k}").cast("double")) for k, t in enumerate(trains)])).drop(*[f"_{k}" for k in range(parts)])
    return rows


def _by_part(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows of training_ranks() with a row for each part that trains on the sample, which (sample_id, part) then is a sample of."""
    rows = rows.select("*", F.posexplode("trains").alias("_k", "_in")).where("_in")
    return rows.withColumns({"sample_id": F.struct("sample_id", F.col("_k").alias("fold")), "sample_fold": F.col("_k"), **{c: F.get(c, F.col("_k")) for c in columns}}).drop("_k", "_in", "trains")


def _ranked_blocks(subjects: DataFrame, samples: DataFrame, covariates: list[str], parts: int, least_z: float | None) -> DataFrame:
    """Rank correlations by blocks: each training part's ranks, of edges once for all runs, are samples of their own.

    samples: run_id, sample_id, y, covariates, trains."""
    who = samples.where("run_id = 0").select("sample_id", "trains")
    ranked = training_ranks(subjects.select("sample_id", F.posexplode("x").alias("edge_id", "x")).join(who, "sample_id"), ["edge_id"], ["x"], parts)
    lists = ranked.groupBy("sample_id", "trains").agg(F.sort_array(F.collect_list(F.struct("edge_id", "x"))).alias("e"))
    in_part = lambda k: F.transform("e", lambda e: F.get(e["x"], F.lit(k)))
    own = materialized(_by_part(lists.select("sample_id", "trains", F.array(*map(in_part, range(parts))).alias("x")), ["x"]).select("sample_id", "x"))
    columns = ["y", *covariates]
    targets = _by_part(training_ranks(samples, ["run_id"], columns, parts), columns)
    return blocks.statistics(blocks.moments(own, targets, covariates), covariates, least_z, trained=True)


def _used(method: str, covariates: list[str] | None) -> list[str]:
    """The covariates that a method controls for."""
    if method not in STATISTICS:
        raise NotImplementedError(f"{method} is none of {STATISTICS}")
    if method.endswith("_partial") and not covariates:
        raise ValueError(f"{method} needs covariates")
    return list(covariates or []) if method.endswith("_partial") else []


def _with_p(found: DataFrame, keys: tuple[str, ...] = ("run_id", "fold")) -> DataFrame:
    return found.select(*keys, "edge_id", "n", "r", "z", p_of(F.col("z")).alias("p"))


def _swept(method: str, covariates: list[str] | None, residual: bool) -> tuple[list[str], int | None]:
    """The covariates that blocks sweep out of the edges, and how many of them the test controls for (None: all)."""
    if residual and method.startswith("spearman"):
        raise NotImplementedError("residuals have to be made to be ranked")
    used = _used(method, covariates)
    return (list(covariates or []), len(used)) if residual else (used, None)


def edge_statistic(method: str, edges: DataFrame, samples: DataFrame, covariates: list[str] | None = None, subjects: DataFrame | None = None, least_z: float | None = None, residual: bool = False) -> DataFrame:
    """run_id, edge_id, fold, n, r, z, p of each edge in the training part of each fold, by one of STATISTICS.

    samples: run_id, sample_id, sample_fold, y, covariates.  With subjects (sample_id, x array), which must not have missing values,
    sums are taken by blocks of edges and runs, and with least_z only edges whose |z| is above it are listed.  Spearman's ranks are
    those within each training part, so it has a sample's ranks once for each; without subjects it sorts each training part.
    residual (with subjects, not for ranks): of what the covariates leave of the edges, learnt on the training part.  That is never made:
    its sums with others are the edge's own, once covariates are swept out of them.
    """
    swept, controlled = _swept(method, covariates, residual)
    samples = samples.select("run_id", "sample_id", "sample_fold", "y", *swept)
    if subjects is not None and method.startswith("spearman"):
        folds = samples.agg(F.max("sample_fold")).first()[0] + 1
        trains = F.transform(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col("sample_fold"))
        return _with_p(_ranked_blocks(subjects, samples.withColumn("trains", trains).drop("sample_fold"), swept, folds, least_z))
    if subjects is not None:
        return _with_p(blocks.statistics(blocks.moments(subjects, samples, swept), swept, least_z, controlled=controlled))
    if residual:
        raise ValueError("residuals of edges as rows are made by models.residual_edges")
    if not method.startswith("spearman"):
        return statistics(train_moments(test_moments(edges, samples, swept)), swept)
    folds = samples.select(F.col("sample_fold").alias("fold")).distinct()
    train = samples.join(F.broadcast(folds), F.col("sample_fold") != F.col("fold")).drop("sample_fold")
    return training_statistic(method, edges, train, swept)


def training_statistic(method: str, values: DataFrame, train: DataFrame, covariates: list[str], keys: tuple[str, ...] = ("run_id", "fold")) -> DataFrame:
    """The keys, edge_id, n, r, z, p over training parts that are listed: values (sample_id, edge_id, value, and the keys that they
    depend on), train (keys, sample_id, y, covariates)."""
    used = _used(method, covariates)
    train = train.select(*keys, "sample_id", "y", *used)
    if method.startswith("spearman"):
        # an edge's ranks depend on who is in the training part, not on the run
        parts = [k for k in keys if k != "run_id"]
        who = train.where("run_id = 0").select(*parts, "sample_id")
        shared = [k for k in ("sample_id", *parts) if k in values.columns]
        values = ordinal_ranks(values.where(F.col("value").isNotNull()).join(who, shared), [*parts, "edge_id"], ["value"])
        train = ordinal_ranks(train, list(keys), ["y", *used])
    return statistics(all_moments(values, train, used, keys), used)


def listed_statistic(method: str, subjects: DataFrame, train: DataFrame, covariates: list[str], inner: int = 0, least_z: float | None = None, residual: bool = False) -> DataFrame:
    """The same as training_statistic() by blocks of edges and runs, where values are the subjects' own (or their residuals, see edge_statistic).

    Training parts may overlap: inner is the number of inner splits of each fold, 0 where train (run_id, fold, sample_id, y, covariates) has no inner_fold.
    All runs must have the same parts.  Sums are taken once for each part a sample is in; ranks are those of one sort.
    """
    swept, controlled = _swept(method, covariates, residual)
    part = (F.col("fold") * inner + F.col("inner_fold") if inner else F.col("fold")).cast("int")
    samples = train.select("run_id", "sample_id", part.alias("sample_fold"), "y", *swept)
    if method.startswith("spearman"):
        parts = samples.agg(F.max("sample_fold")).first()[0] + 1
        whose = samples.groupBy("run_id", "sample_id", "y", *swept).agg(F.collect_set("sample_fold").alias("_in"))
        trains = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.array_contains("_in", k))
        found = _ranked_blocks(subjects, whose.withColumn("trains", trains).drop("_in"), swept, parts, least_z)
    else:
        found = blocks.statistics(blocks.moments(subjects, samples, swept), swept, least_z, True, controlled)
    if not inner:
        return _with_p(found)
    found = found.withColumns({"fold": F.floor(F.col("fold") / inner).cast("int"), "inner_fold": F.col("fold") % inner})
    return _with_p(found, ("run_id", "fold", "inner_fold"))


def selected(statistics: DataFrame, alpha: float) -> DataFrame:
    """The keys and edge_id of edges with p below alpha, by |z|, and their network."""
    keys = [c for c in statistics.columns if c in ("run_id", "fold", "param_id", "inner_fold", "edge_id")]
    kept = statistics.where((F.abs("z") > critical_z(alpha)) & (F.col("r") != 0))
    return kept.select(*keys, F.when(F.col("r") > 0, "positive").otherwise("negative").alias("network"))


def selected_by_grid(statistics: DataFrame, alphas: list[float], first: int = 0, adjusted: bool = False) -> DataFrame:
    """selected() for each alpha, with its place in the list (from `first` on) as param_id; the statistics are worked out once.
    adjusted: p_adjusted decides."""
    params = F.array(*[F.struct(F.lit(first + i).alias("param_id"), F.lit(critical_z(a)).alias("z_min"), F.lit(a).alias("alpha")) for i, a in enumerate(alphas)])
    enough = F.col("p_adjusted") < F.col("_p.alpha") if adjusted else F.abs("z") > F.col("_p.z_min")
    rows = statistics.select("*", F.explode(params).alias("_p")).select("*", F.col("_p.param_id").alias("param_id")).where(enough & (F.col("r") != 0))
    keys = [c for c in ("run_id", "fold", "param_id", "inner_fold", "edge_id") if c in rows.columns]
    return rows.select(*keys, F.when(F.col("r") > 0, "positive").otherwise("negative").alias("network"))


def k_best(statistics: DataFrame, k: int, by: list[str]) -> DataFrame:
    """The k edges of greatest |z| of each family (an extension: the best by rank, not by p)."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.abs("z")), "edge_id"))
    return statistics.withColumn("_i", rank).where(F.col("_i") <= k).drop("_i")


def best_percent(statistics: DataFrame, percent: float, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by)
    ranked = statistics.withColumns({"_i": F.row_number().over(w.orderBy(F.desc(F.abs("z")), "edge_id")), "_n": F.count("*").over(w)})
    return ranked.where(F.col("_i") <= F.ceil(F.col("_n") * percent / 100.0)).drop("_i", "_n")
