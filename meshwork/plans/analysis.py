"""The whole analysis as one lazy plan: folds, selection, strengths, models, metrics, and permutation inference on top.

Runs (observed and permuted targets), folds and parameters are grouping keys throughout; nothing loops over them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import edges as E
from ..operators import figures, graph, models, prepare, results, scoring, splits
from ..operators.adjust import adjusted
from ..operators.logistic import logistic_predictions
from ..operators.nonlinear import nonlinear_predictions
from ..operators.vectors import check_n_features, edge_dim, long_edges
from ..sources.tables import materialized, surveyed


@dataclass(frozen=True)
class Settings:
    """An analysis: of several methods, corrections and alphas the best combination is chosen by inner folds."""

    task: str = "regression"
    method: str | tuple[str, ...] = "pearson"
    alphas: tuple[float, ...] = (0.05,)
    correction: str | None | tuple[str | None, ...] = None
    folds: int = 5
    splitter: str | None = None
    repeats: int = 1
    test_share: float = 0.2
    inner_folds: int = 0
    inner_splitter: str = "kfold"
    inner_repeats: int = 1
    inner_test_share: float = 0.2
    stable_share: float | None = None
    permutations: int = 0
    seed: int = 42
    covariates: tuple[str, ...] = ("c1", "c2")
    model: str = "linear"
    residual_edges: bool = False
    impute: bool = True
    nbs_threshold: float = 0.5
    nbs_statistic: str = "extent"
    inference: tuple[str, ...] = ("nbs", "tfce")
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if len(self.grid) > 1 and not self.inner_folds:
            raise ValueError("several alphas, corrections or methods need inner folds")
        if self.stable_share is not None and not self.inner_folds:
            raise ValueError("stable edges need inner folds")
        if self.task == "classification" and self.model not in ("linear", "logistic"):
            raise ValueError("non-linear models are for regression")
        if set(self.inference) - {"nbs", "tfce"}:
            raise ValueError(f"unknown inference {self.inference}")

    @property
    def grid(self) -> list[tuple[str, str | None, float]]:
        """(method, correction, alpha) of each param_id."""
        methods = (self.method,) if isinstance(self.method, str) else self.method
        corrections = self.correction if isinstance(self.correction, tuple) else (self.correction,)
        return [(m, c, a) for m in methods for c in corrections for a in self.alphas]

    @property
    def n_splits(self) -> int:
        return self.folds * (self.repeats if self.splitter == "repeated" else 1)

    @property
    def n_inner(self) -> int:
        return self.inner_folds * (self.inner_repeats if self.inner_splitter == "repeated" else 1)

    @property
    def partition(self) -> bool:
        """Whether each sample is in one test part."""
        return self.splitter in (None, "kfold", "stratified")


def folded(subjects: DataFrame, s: Settings) -> DataFrame:
    """(run_id, sample_id, sample_fold, y, covariates) of the observed and the permuted runs; folds are the observed run's.  Without sample_fold
    where test parts overlap."""
    base = subjects.select("sample_id", "y", *s.covariates)
    targets = splits.permuted_targets(base, s.permutations, s.seed) if s.permutations else base.select(F.lit(0).alias("run_id"), "sample_id", "y")
    if not s.partition:
        return targets.join(base.select("sample_id", *s.covariates), "sample_id")
    stratified = s.splitter == "stratified" or s.splitter is None and s.task == "classification"
    made = splits.stratified_kfold(base, s.folds, "y", s.seed) if stratified else splits.kfold(base, s.folds, s.seed)
    made = made.withColumnRenamed("fold", "sample_fold")
    return targets.join(made.select("sample_id", "sample_fold", *s.covariates), "sample_id")


def roles(samples: DataFrame, s: Settings, gaps: bool = False) -> DataFrame:
    """(run_id, fold, sample_id, is_test, y, covariates) of all runs and splits; with gaps, covariates are imputed."""
    if s.partition:
        rows = splits.with_roles(samples, s.folds)
    else:
        own = splits.roles(samples.where("run_id = 0").select("sample_id", "y"), s.splitter, s.folds, s.seed, repeats=s.repeats, test_share=s.test_share)
        rows = samples.join(own, "sample_id")
    return prepare.imputed_covariates(rows, list(s.covariates)) if gaps and s.impute else rows


def edge_values(subjects: DataFrame, rows: DataFrame, s: Settings, gaps: bool) -> DataFrame:
    """(sample_id, edge_id, value), with fold where imputed and residual values depend on it; rows: roles()."""
    values, observed = long_edges(subjects), rows.where("run_id = 0")
    if gaps and s.impute:
        values = prepare.imputed(values, observed)
    return models.residual_edges(values, observed, list(s.covariates)) if s.residual_edges else values


def edge_table(subjects: DataFrame, samples: DataFrame, s: Settings, method: str | None = None, gaps: bool = False) -> DataFrame:
    """The statistics of all runs' and splits' edges that may be selected."""
    method, cov = method or s.grid[0][0], list(s.covariates)
    if not gaps and not (s.residual_edges and method.startswith("spearman")):
        # without corrections only edges that some alpha lets pass matter
        least = None if any(c for _, c, _ in s.grid) else E.critical_z(max(s.alphas))
        if s.partition:
            return E.edge_statistic(method, long_edges(subjects), samples, cov, subjects, least, s.residual_edges)
        return E.listed_statistic(method, subjects, roles(samples, s).where("not is_test"), cov, 0, least, s.residual_edges)
    rows = roles(samples, s, gaps)
    return E.training_statistic(method, edge_values(subjects, rows, s, gaps), rows.where("not is_test"), cov)


def mask(statistics: DataFrame, s: Settings, alpha: float | None = None) -> DataFrame:
    """The selected edges of the first (method and) correction, at its first alpha or the given one."""
    return _selected(statistics, s.grid[0][1], [s.grid[0][2] if alpha is None else alpha], ["run_id", "fold"], 0).drop("param_id")


def _selected(statistics: DataFrame, correction: str | None, alphas: list[float], family: list[str], first: int) -> DataFrame:
    if not correction:
        return E.selected_by_grid(statistics, alphas, first)
    return E.selected_by_grid(adjusted(statistics, correction, family), alphas, first, True)


def grid_masks(statistic, s: Settings, family: list[str]) -> DataFrame:
    """(family, param_id, edge_id, network) of the whole grid; statistic(method) gives the family's statistics."""
    out, n, methods = None, len(s.alphas), list(dict.fromkeys(m for m, _, _ in s.grid))
    corrections = list(dict.fromkeys(c for _, c, _ in s.grid))
    for i, method in enumerate(methods):
        found = statistic(method)
        found = materialized(found) if len(corrections) > 1 else found
        for j, correction in enumerate(corrections):
            one = _selected(found, correction, list(s.alphas), family, (i * len(corrections) + j) * n)
            out = one if out is None else out.unionByName(one)
    return out


def chosen_mask(subjects: DataFrame, samples: DataFrame, s: Settings, gaps: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """The mask of each outer split, with the parameter that inner folds choose; and the choice (run_id, fold, param_id, mean)."""
    if not s.inner_folds:
        return mask(edge_table(subjects, samples, s, gaps=gaps), s), None
    best, inner = inner_search(subjects, samples, s, gaps)
    if s.stable_share is not None:
        stable = results.stability(inner.withColumnRenamed("fold", "outer").withColumnRenamed("inner_fold", "fold").withColumn("run_id", F.struct("run_id", "outer")), s.n_inner)
        stable = results.stable_edges(stable, s.stable_share, s.n_inner)
        stable = stable.select("run_id.run_id", F.col("run_id.outer").alias("fold"), "param_id", "edge_id", "network")
        return stable.join(best.select("run_id", "fold", "param_id"), ["run_id", "fold", "param_id"]).drop("param_id"), best
    masks = grid_masks(lambda method: edge_table(subjects, samples, s, method, gaps), s, ["run_id", "fold"])
    return masks.join(best.select("run_id", "fold", "param_id"), ["run_id", "fold", "param_id"]).drop("param_id"), best


def inner_search(subjects: DataFrame, samples: DataFrame, s: Settings, gaps: bool = False) -> tuple[DataFrame, DataFrame]:
    """The best parameter of each run and outer split, and the inner splits' masks.

    An inner split is one of an outer split's training part; both are keys, and statistics are worked out once for all alphas and
    corrections.  Imputed and residual values are the outer split's.
    """
    rows = roles(samples, s, gaps)
    values = edge_values(subjects, rows, s, gaps)
    blocked = None if "fold" in values.columns else subjects
    outer = rows.where("not is_test").select("run_id", "fold", "sample_id", "y", *s.covariates)
    own = splits.roles(outer.where("run_id = 0").select("fold", "sample_id", "y"), s.inner_splitter, s.inner_folds, s.seed, ["fold"], s.inner_repeats, s.inner_test_share, "inner_fold")
    inner = materialized(outer.join(own, ["fold", "sample_id"]))
    keys = ("run_id", "fold", "inner_fold")
    train = inner.where("not is_test")
    least = None if any(c for _, c, _ in s.grid) else E.critical_z(max(s.alphas))

    def statistic(method: str) -> DataFrame:
        if blocked is None:
            return E.training_statistic(method, values, train, list(s.covariates), keys)
        return E.listed_statistic(method, subjects, train, list(s.covariates), s.n_inner, least)

    masks = materialized(grid_masks(statistic, s, list(keys)))
    # a number for each run, outer and inner split, as the run that the models group by
    unit = ((F.col("run_id") * s.n_splits + F.col("fold")) * s.n_inner + F.col("inner_fold")).cast("int")
    params = F.explode(F.sequence(F.lit(0), F.lit(len(s.grid) - 1)))
    named = inner.select(unit.alias("run_id"), "sample_id", "is_test", "y", *s.covariates).withColumn("fold", params)
    if "fold" in values.columns:
        values = values.withColumnRenamed("fold", "unit")
    own_mask = masks.select(unit.alias("run_id"), F.col("fold").alias("unit"), F.col("param_id").alias("fold"), "edge_id", "network")
    found = models.strengths(values, own_mask, named, blocked)
    both = found.select("run_id", "fold", "sample_id", "is_test", "y", F.lit("connectome").alias("model"), F.lit("both").alias("network"), F.col("pos").alias("f1"), F.col("neg").alias("f2"))
    if s.task == "classification":
        guesses = logistic_predictions(both)
    else:
        guesses = models.linear_predictions(both) if s.model == "linear" else nonlinear_predictions(both, s.model)
    scores = scoring.score(guesses, s.task)
    run, fold = F.floor(F.col("run_id") / (s.n_splits * s.n_inner)).cast("int"), (F.floor(F.col("run_id") / s.n_inner) % s.n_splits).cast("int")
    scores = scores.select(run.alias("run_id"), fold.alias("outer"), (F.col("run_id") % s.n_inner).alias("inner_fold"), F.col("fold").alias("param_id"), "model", "network", *scoring.metrics_of(s.task))
    metric = "balanced_accuracy" if s.task == "classification" else "pearson_score"
    return results.best_parameters(scores.withColumnRenamed("outer", "fold"), metric), masks


def design_rows(subjects: DataFrame, samples: DataFrame, selected: DataFrame, s: Settings, gaps: bool = False) -> DataFrame:
    """Each run's and split's samples with their strengths and what covariates leave of them; written, as strengths are dear and read often.

    Strengths of residual edges aren't sums of these: a sum of residuals is the residual of the sum."""
    rows = roles(samples, s, gaps)
    if gaps:
        return models.with_residual_strengths(materialized(models.strengths(edge_values(subjects, rows, s, gaps), selected, rows)), list(s.covariates))
    own = models.with_residual_strengths(materialized(models.strengths(long_edges(subjects), selected, rows, subjects)), list(s.covariates))
    return own.withColumns({"pos": F.col("pos_res"), "neg": F.col("neg_res")}) if s.residual_edges else own


def predictions(rows: DataFrame, s: Settings) -> DataFrame:
    design = models.design(rows, list(s.covariates))
    if s.task == "classification":
        return logistic_predictions(design)
    linear = models.linear_predictions(design)
    if s.model == "linear":
        return linear
    curved = nonlinear_predictions(design, s.model)
    return linear.where("model in ('covariates', 'residuals')").unionByName(curved.select(*linear.columns))


def run(subjects: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """All result tables of an analysis: selection, strengths, predictions, metrics, summary, stability, and with permutations
    p_values, nbs_edges, nbs_components, nbs_diagnostics, tfce_edges and tfce_diagnostics; with inner folds
    parameters, what each fold chose (by name: params).

    Subjects are surveyed first, in one pass, and what can't be analysed is a ValueError (see surveyed); classes may be 0 and 1 or -1 and 1.
    Selection, strengths and metrics are written, the others are lazy.
    """
    n_edges, gaps = surveyed(subjects, list(s.covariates), s.impute, s.task)
    if s.task == "classification":
        subjects = subjects.withColumn("y", (F.col("y") > 0).cast("double"))
    samples = folded(subjects, s)
    if s.permutations or s.inner_folds:
        samples = materialized(samples)
    selected, choice = chosen_mask(subjects, samples, s, gaps)
    selected = materialized(selected)
    rows = design_rows(subjects, samples, selected, s, gaps)
    guesses = predictions(rows, s)
    metrics = materialized(results.with_increment(scoring.score(guesses, s.task)))
    summary = results.summary(metrics)
    strengths = rows.where("is_test").select("run_id", "fold", "sample_id", F.col("y").alias("y_true"), "pos", "neg", "pos_res", "neg_res")
    stability = results.stability(selected, s.n_splits)
    out = {"selection": selected, "strengths": strengths, "predictions": guesses, "metrics": metrics, "summary": summary, "stability": stability}
    if choice is not None:
        out["parameters"] = figures.named_parameters(choice, s.grid)
    if s.permutations:
        named = stability.join(F.broadcast(edge_dim(subjects.sparkSession, check_n_features(n_edges))), "edge_id")
        runs = subjects.sparkSession.range(s.permutations + 1).select(F.col("id").cast("int").alias("run_id"))
        names = [f"{m}__mean" for m in scoring.metrics_of(s.task)]
        out["p_values"] = results.permutation_p(summary, names)
        if "nbs" in s.inference:
            out["nbs_edges"], out["nbs_components"], out["nbs_critical"] = graph.nbs(named, runs, s.nbs_threshold, s.n_splits, s.nbs_statistic)
            out["nbs_diagnostics"] = graph.nbs_diagnostics(out["nbs_edges"], out["nbs_components"], out["nbs_critical"])
        if "tfce" in s.inference:
            scores = graph.tfce(named)
            out["tfce_edges"] = graph.tfce_p(scores, runs)
            out["tfce_diagnostics"] = graph.tfce_diagnostics(scores, out["tfce_edges"], runs)
    return out
