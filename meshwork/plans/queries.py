"""The registered queries of the analysis operators, on the driver's tables.

Networks are 55 dimensions of the embeddings (11 nodes), with two others as covariates and a planted target; see sources.tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import clean, p_of, z_of
from ..operators import additive, adjust, figures, graph, models, prepare, report, results, scoring, splits, trees
from ..operators import edges as E
from ..operators.logistic import fit_logistic, logistic_predictions
from ..operators.vectors import edge_dim, long_edges, matrix_to_vector, nodes_column, vector_to_matrix
from ..sources.tables import embedding_subjects, materialized, table
from . import analysis
from .analysis import Settings

K, PERMUTATIONS = 5, 20
COV = ["c1", "c2"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _clean(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: clean(F.col(n)) for n in names})


def _binary(subjects: DataFrame) -> DataFrame:
    """subjects with the target above its median or not."""
    middle = subjects.agg(F.median("y").alias("_m"))
    return subjects.crossJoin(F.broadcast(middle)).withColumn("y", (F.col("y") > F.col("_m")).cast("double")).drop("_m")


def _samples(subjects: DataFrame, **more) -> DataFrame:
    return analysis.folded(subjects, Settings(folds=K, **more))


def _mask(subjects: DataFrame, samples: DataFrame, method: str = "pearson") -> DataFrame:
    return E.selected(E.edge_statistic(method, long_edges(subjects), samples, COV, subjects, E.critical_z(0.05)), 0.05)


def _rows(spark: SparkSession, sf_dir: str, binary: bool = False) -> DataFrame:
    subjects = embedding_subjects(spark, sf_dir)
    s = Settings(folds=K, task="classification" if binary else "regression")
    subjects = _binary(subjects) if binary else subjects
    samples = analysis.folded(subjects, s)
    return analysis.design_rows(subjects, samples, _mask(subjects, samples, "point_biserial" if binary else "pearson"), s)


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.linear_predictions(models.design(_rows(spark, sf_dir), COV))


# --- vectors and preparation


@query
def edge_long(spark, sf_dir):
    return _clean(long_edges(embedding_subjects(spark, sf_dir)), "value")


@query
def edge_nodes(spark, sf_dir):
    """Each edge's nodes and mean."""
    means = long_edges(embedding_subjects(spark, sf_dir)).groupBy("edge_id").agg(F.avg("value").alias("mean"))
    return _clean(means.join(F.broadcast(edge_dim(spark, 11)), "edge_id"), "mean")


@query
def matrix_roundtrip(spark, sf_dir):
    """Vector to matrix and back: row sums of the matrix, and whether the vector returns."""
    m = embedding_subjects(spark, sf_dir).select("sample_id", "x", vector_to_matrix(F.col("x"), 11).alias("m"))
    m = m.select("sample_id", "m", (matrix_to_vector(F.col("m")) == F.col("x")).alias("same"))
    rows = m.select("sample_id", "same", F.posexplode("m").alias("node", "row"))
    return _clean(rows.select("sample_id", "same", "node", F.aggregate("row", F.lit(0.0), lambda a, v: a + v).alias("row_sum")), "row_sum")


@query
def infer_nodes(spark, sf_dir):
    """How many nodes a network has whose edges are a customer's orders."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_edges"))
    return orders.select("o_custkey", "n_edges", nodes_column(F.col("n_edges")).alias("n_nodes"))


@query
def task_type_detect(spark, sf_dir):
    s = embedding_subjects(spark, sf_dir)
    both = s.join(_binary(s).select("sample_id", F.col("y").alias("above")), "sample_id")
    return prepare.task_types(both.withColumn("side", F.col("above") * 2 - 1).withColumn("one", F.lit(1.0)), ["y", "above", "side", "one"])


@query
def data_summary(spark, sf_dir):
    return prepare.data_summary(embedding_subjects(spark, sf_dir), COV)


@query
def target_histogram(spark, sf_dir):
    return prepare.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 30)


@query
def covariate_onehot(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return prepare.one_hot(c, "c_mktsegment")


def _with_gaps(edges: DataFrame) -> DataFrame:
    return edges.withColumn("value", F.when((F.col("sample_id") * 7 + F.col("edge_id")) % 11 != 0, F.col("value")))


@query
def impute_mean(spark, sf_dir):
    s = embedding_subjects(spark, sf_dir)
    rows = splits.with_roles(_samples(s), K)
    out = prepare.imputed(_with_gaps(long_edges(s)), rows)
    return _clean(out.groupBy("fold", "edge_id").agg(F.sum("value").alias("total"), F.count("value").alias("n")), "total")


@query
def variance_filter(spark, sf_dir):
    """Edges of which every other is cut down to a constant."""
    e = long_edges(embedding_subjects(spark, sf_dir)).withColumn("value", F.when(F.col("edge_id") % 2 == 0, F.col("value")).otherwise(0.25))
    return _clean(prepare.varying_edges(e), "variance")


@query
def residualize_edges(spark, sf_dir):
    s = embedding_subjects(spark, sf_dir)
    out = models.residual_edges(long_edges(s), splits.with_roles(_samples(s), K), ["c1"])
    return _clean(out.groupBy("fold", "sample_id").agg(F.sum(F.abs("value")).alias("size")), "size")


# --- splits


@query
def kfold_assign(spark, sf_dir):
    return splits.kfold(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id")), K)


@query
def stratified_kfold(spark, sf_dir):
    return splits.stratified_kfold(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), "o_orderpriority"), K, "o_orderpriority")


@query
def repeated_kfold(spark, sf_dir):
    return splits.repeated_kfold(embedding_subjects(spark, sf_dir).select("sample_id"), K, 3)


@query
def shuffle_split(spark, sf_dir):
    return splits.shuffle_split(embedding_subjects(spark, sf_dir).select("sample_id"), 0.2, 3)


@query
def permuted_targets(spark, sf_dir):
    return _clean(splits.permuted_targets(embedding_subjects(spark, sf_dir), PERMUTATIONS), "y")


# --- edge statistics and selection


def _statistic(method: str, covariates: list[str], binary: bool = False):
    def of(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = embedding_subjects(spark, sf_dir)
        s = _binary(s) if binary else s
        # edge_pearson shows the rows, the others the blocks
        out = E.edge_statistic(method, long_edges(s), _samples(s), covariates, None if method == "pearson" else s)
        return _clean(out.select("fold", "edge_id", "n", "r", "z"), "r", "z")

    return of


for _name, _method, _cov, _bin in (
    ("edge_pearson", "pearson", [], False),
    ("edge_spearman", "spearman", [], False),
    ("edge_point_biserial", "point_biserial", [], True),
    ("edge_partial_1cov", "pearson_partial", ["c1"], False),
    ("edge_partial_2cov", "pearson_partial", COV, False),
    ("edge_spearman_partial", "spearman_partial", ["c1"], False),
    ("edge_point_biserial_partial", "point_biserial_partial", ["c1"], True),
):
    QUERIES[_name] = _statistic(_method, _cov, _bin)


@query
def edge_residual(spark, sf_dir):
    """Correlations of what covariates leave of the edges."""
    s = embedding_subjects(spark, sf_dir)
    out = E.edge_statistic("pearson", long_edges(s), _samples(s), COV, s, residual=True)
    return _clean(out.select("fold", "edge_id", "n", "r", "z"), "r", "z")


def _repeated(method: str):
    def of(spark: SparkSession, sf_dir: str) -> DataFrame:
        subjects, s = embedding_subjects(spark, sf_dir), Settings(folds=K, splitter="repeated", repeats=2)
        train = analysis.roles(analysis.folded(subjects, s), s).where("not is_test")
        return _clean(E.listed_statistic(method, subjects, train, []).select("fold", "edge_id", "n", "r", "z"), "r", "z")

    return of


QUERIES["edge_repeated_splits"] = _repeated("pearson")
QUERIES["edge_repeated_splits_spearman"] = _repeated("spearman")


@query
def edge_pearson_blocked(spark, sf_dir):
    """The same as edge_pearson, by matrix products within tasks."""
    s = embedding_subjects(spark, sf_dir)
    samples = _samples(s)
    out = E.edge_statistic("pearson", long_edges(s), samples, subjects=s)
    return _clean(out.select("fold", "edge_id", "n", "r", "z"), "r", "z")


def _pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = embedding_subjects(spark, sf_dir)
    return E.edge_statistic("pearson", long_edges(s), _samples(s))


@query
def edge_pvalue(spark, sf_dir):
    return _clean(_pearson(spark, sf_dir).select("fold", "edge_id", "p"), "p")


@query
def edge_select(spark, sf_dir):
    return E.selected(_pearson(spark, sf_dir), 0.05).drop("run_id")


@query
def edge_select_grid(spark, sf_dir):
    return E.selected_by_grid(_pearson(spark, sf_dir), [0.05, 0.01, 0.001]).drop("run_id")


@query
def edge_k_best(spark, sf_dir):
    return E.k_best(_pearson(spark, sf_dir), 5, ["run_id", "fold"]).select("fold", "edge_id")


@query
def edge_best_percent(spark, sf_dir):
    return E.best_percent(_pearson(spark, sf_dir), 10.0, ["run_id", "fold"]).select("fold", "edge_id")


def _adjusted(method: str):
    def of(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _clean(adjust.adjusted(_pearson(spark, sf_dir), method, ["run_id", "fold"]).select("fold", "edge_id", "p_adjusted"), "p_adjusted")

    return of


for _method in adjust.METHODS:
    QUERIES[f"padj_{_method.replace('-', '_')}"] = _adjusted(_method)


# --- models


@query
def network_strength(spark, sf_dir):
    return _clean(_rows(spark, sf_dir).select("fold", "sample_id", "is_test", "pos", "neg"), "pos", "neg")


@query
def residualized_strength(spark, sf_dir):
    return _clean(_rows(spark, sf_dir).where("is_test").select("fold", "sample_id", "pos_res", "neg_res"), "pos_res", "neg_res")


def _predicted(model: str):
    def of(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = models.linear_predictions(models.design(_rows(spark, sf_dir), COV).where(F.col("model") == model))
        return _clean(p.select("fold", "network", "sample_id", "y_true", "y_pred"), "y_true", "y_pred")

    return of


for _model in models.VARIANTS:
    QUERIES[f"cv_pred_{_model}"] = _predicted(_model)


@query
def logistic_irls(spark, sf_dir):
    """Classification metrics of the logistic variants, out of sample."""
    p = logistic_predictions(models.design(_rows(spark, sf_dir, binary=True), COV))
    return _clean(scoring.classification_metrics(p).drop("run_id"), *scoring.CLASSIFICATION)


@query
def logistic_coefficients(spark, sf_dir):
    """Coefficients on both strengths after four iterations."""
    d = models.design(_rows(spark, sf_dir, binary=True), COV).where("model = 'connectome' and network = 'both'")
    fit = fit_logistic(d, ["fold"], ["f1", "f2"], rounds=4, near=0.0)
    return _clean(fit.select("fold", *[F.col("beta")[i].alias(f"beta_{i}") for i in range(3)]), *[f"beta_{i}" for i in range(3)])


def _curved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.design(_rows(spark, sf_dir), COV).where("model in ('connectome', 'full')")


def _nonlinear(predict):
    def of(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _clean(scoring.regression_metrics(predict(_curved(spark, sf_dir))).drop("run_id"), *scoring.REGRESSION)

    return of


QUERIES["nonlinear_tree"] = _nonlinear(lambda d: trees.tree_predictions(d, depth=4))
QUERIES["nonlinear_forest"] = _nonlinear(lambda d: trees.tree_predictions(d, trees=10, depth=3))
QUERIES["nonlinear_additive"] = _nonlinear(additive.additive_predictions)


@query
def additive_sums(spark, sf_dir):
    """What additive models are fitted from."""
    return _clean(additive.basis_sums(_curved(spark, sf_dir)).drop("run_id"), "total")


# --- metrics and results


@query
def cv_metrics_regression(spark, sf_dir):
    return _clean(scoring.regression_metrics(_predictions(spark, sf_dir)).drop("run_id"), *scoring.REGRESSION)


@query
def metrics_large(spark, sf_dir):
    """Regression metrics of line items' prices against those of their quantities' mean price."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("y_true"), (F.col("l_quantity") * 1500.0).alias("y_pred"))
    return _clean(scoring.regression_metrics(li, ["l_returnflag"]), *scoring.REGRESSION)


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_returnflag", (F.col("l_extendedprice") > 40000.0).cast("double").alias("y_true"), (F.col("l_quantity") / 50.0).alias("y_pred"))


@query
def metrics_classification(spark, sf_dir):
    return _clean(scoring.classification_metrics(_classified(spark, sf_dir), ["l_returnflag"]), *scoring.CLASSIFICATION)


@query
def roc_auc_midrank(spark, sf_dir):
    return _clean(scoring.roc_auc(_classified(spark, sf_dir), ["l_returnflag"]), "roc_auc")


@query
def cv_increment(spark, sf_dir):
    m = results.with_increment(scoring.regression_metrics(_predictions(spark, sf_dir)))
    return _clean(m.where("model = 'increment'").drop("run_id", "model"), *scoring.REGRESSION)


@query
def residual_cv_metrics(spark, sf_dir):
    """Metrics where edges are those without what covariates explain."""
    out = analysis.run(embedding_subjects(spark, sf_dir), Settings(folds=K, residual_edges=True))
    return _clean(out["metrics"].drop("run_id"), *scoring.REGRESSION)


@query
def cv_summary(spark, sf_dir):
    out = results.summary(results.with_increment(scoring.regression_metrics(_predictions(spark, sf_dir)))).drop("run_id")
    return _clean(out, *[c for c in out.columns if "__" in c])


@query
def edge_stability(spark, sf_dir):
    s = embedding_subjects(spark, sf_dir)
    return results.stability(_mask(s, _samples(s)), K).drop("run_id")


@query
def stable_edges(spark, sf_dir):
    s = embedding_subjects(spark, sf_dir)
    return results.stable_edges(results.stability(_mask(s, _samples(s)), K), 0.6, K).select("edge_id", "network", "n_selected")


_NESTED = Settings(folds=3, inner_folds=3, alphas=(0.05, 0.01))


@query
def inner_cv_best_param(spark, sf_dir):
    s = embedding_subjects(spark, sf_dir)
    best, _ = analysis.inner_search(s, analysis.folded(s, _NESTED), _NESTED)
    return _clean(best.select("fold", "param_id", "mean"), "mean")


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = embedding_subjects(spark, sf_dir)
    best, _ = analysis.inner_search(s, analysis.folded(s, _NESTED), _NESTED)
    return figures.named_parameters(best, _NESTED.grid)


@query
def report_parameters(spark, sf_dir):
    return figures.parameter_table(_chosen(spark, sf_dir))


@query
def report_parameter_summary(spark, sf_dir):
    out = figures.parameter_summary(_chosen(spark, sf_dir))
    return _clean(out, "mean", "std", "least", "lower", "median", "upper", "greatest")


@query
def nested_cv_metrics(spark, sf_dir):
    """Metrics where inner folds choose alpha."""
    return _clean(analysis.run(embedding_subjects(spark, sf_dir), _NESTED)["metrics"].drop("run_id"), *scoring.REGRESSION)


def _nested(name: str, **more) -> None:
    def of(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = Settings(**{"folds": 3, "inner_folds": 3, "alphas": (0.05, 0.01), **more})
        return _clean(analysis.run(embedding_subjects(spark, sf_dir), s)["metrics"].drop("run_id"), *scoring.REGRESSION)

    QUERIES[name] = of


_nested("nested_cv_spearman", method="spearman")
_nested("nested_cv_corrected", correction="fdr_bh")


@query
def stable_edges_metrics(spark, sf_dir):
    """Metrics where edges are those that most inner folds select."""
    s = Settings(folds=3, inner_folds=3, alphas=(0.05,), stable_share=0.6)
    return _clean(analysis.run(embedding_subjects(spark, sf_dir), s)["metrics"].drop("run_id"), *scoring.REGRESSION)


# --- permutation inference


def _permuted_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = embedding_subjects(spark, sf_dir)
    samples = materialized(_samples(s, permutations=PERMUTATIONS))
    return E.selected(E.edge_statistic("pearson", long_edges(s), samples), 0.05)


def _permuted_stability(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    stability = results.stability(_permuted_mask(spark, sf_dir), K).join(F.broadcast(edge_dim(spark, 11)), "edge_id")
    return materialized(stability), spark.range(PERMUTATIONS + 1).select(F.col("id").cast("int").alias("run_id"))


@query
def perm_pvalues(spark, sf_dir):
    s = embedding_subjects(spark, sf_dir)
    set_ = Settings(folds=K, permutations=PERMUTATIONS)
    samples = materialized(analysis.folded(s, set_))
    rows = analysis.design_rows(s, samples, _mask(s, samples), set_)
    metrics = results.with_increment(scoring.regression_metrics(models.linear_predictions(models.design(rows, COV))))
    names = [f"{m}__mean" for m in scoring.REGRESSION]
    return _clean(results.permutation_p(results.summary(metrics), names), *names)


@query
def edge_components(spark, sf_dir):
    stability, _ = _permuted_stability(spark, sf_dir)
    return graph.components(stability.where("n_selected >= 3"), ["run_id", "network"])


def _nbs(which: int, statistic: str = "extent"):
    def of(spark: SparkSession, sf_dir: str) -> DataFrame:
        stability, runs = _permuted_stability(spark, sf_dir)
        out = graph.nbs(stability, runs, 0.5, K, statistic)[which]
        return _clean(out, *[c for c in ("p_value", "statistic", "critical_value") if c in out.columns])

    return of


QUERIES["nbs_extent_edges"] = _nbs(0)
QUERIES["nbs_extent_components"] = _nbs(1)
QUERIES["nbs_intensity_components"] = _nbs(1, "intensity")
QUERIES["nbs_critical_value"] = _nbs(2)


@query
def nbs_diagnostics(spark, sf_dir):
    stability, runs = _permuted_stability(spark, sf_dir)
    return _clean(graph.nbs_diagnostics(*graph.nbs(stability, runs, 0.5, K)), "critical_value", "observed_max")


@query
def report_null_histogram(spark, sf_dir):
    stability, runs = _permuted_stability(spark, sf_dir)
    _, found, _ = graph.nbs(stability, runs, 0.5, K)
    return _clean(report.null_histogram(graph.null_maxima(stability, runs, 0.5, K), found), "lo", "hi", "observed")


@query
def report_placed_edges(spark, sf_dir):
    """The observed run's edges, with a circle's coordinates for its nodes."""
    stability, _ = _permuted_stability(spark, sf_dir)
    angle = F.col("id") * (2 * 3.141592653589793 / 11)
    circle = spark.range(11).select(F.col("id").cast("int").alias("node_id"), F.cos(angle).alias("x"), F.sin(angle).alias("y"), F.lit(0.0).alias("z"))
    out = report.placed_edges(stability.where("run_id = 0").select("network", "node_i", "node_j", "stability"), circle)
    return _clean(out, "stability", *[f"{c}_{k}" for k in "ij" for c in "xyz"])


@query
def tfce_scores(spark, sf_dir):
    return _clean(graph.tfce(_permuted_stability(spark, sf_dir)[0]), "score")


@query
def tfce_pvalues(spark, sf_dir):
    stability, runs = _permuted_stability(spark, sf_dir)
    return _clean(graph.tfce_p(graph.tfce(stability), runs), "score", "p_value")


@query
def tfce_diagnostics(spark, sf_dir):
    stability, runs = _permuted_stability(spark, sf_dir)
    scores = graph.tfce(stability)
    return _clean(graph.tfce_diagnostics(scores, graph.tfce_p(scores, runs), runs), "critical_value", "observed_max")


# --- report tables


def _groups(spark: SparkSession) -> DataFrame:
    return spark.range(11).select(F.col("id").cast("int").alias("node_id"), F.concat(F.lit("N"), (F.col("id") % 3).cast("string")).alias("group"), F.concat(F.lit("R"), F.col("id").cast("string")).alias("region"))


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observed run's edges with their p-values: those of the network-based statistic, 1 where it has none."""
    stability, runs = _permuted_stability(spark, sf_dir)
    edges, _, _ = graph.nbs(stability, runs, 0.5, K)
    seen = stability.where("run_id = 0").drop("run_id").join(edges, ["network", "node_i", "node_j"], "left")
    return seen.withColumn("p_value", F.round(F.coalesce("p_value", F.lit(1.0)), 6))


@query
def report_edge_table(spark, sf_dir):
    return report.edge_table(_observed(spark, sf_dir), _groups(spark)).withColumns({c: clean(F.col(c), 5) for c in ("stability", "p_value")})


@query
def report_signed_stability(spark, sf_dir):
    return _clean(report.signed_stability(_observed(spark, sf_dir)), "signed")


@query
def report_shown_edges(spark, sf_dir):
    return report.shown_edges(_observed(spark, sf_dir)).select("edge_id", "network")


@query
def report_group_summary(spark, sf_dir):
    return _clean(report.by_group(report.signed_stability(_observed(spark, sf_dir)), _groups(spark)), "mean")


@query
def report_node_degrees(spark, sf_dir):
    return report.node_degrees(_observed(spark, sf_dir), 5)


@query
def report_matrix_order(spark, sf_dir):
    """Nations in the order of their regions, as matrix rows."""
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("node_id"), F.col("n_regionkey").cast("string").alias("group"))
    return report.matrix_order(nodes)


@query
def report_metrics_melt(spark, sf_dir):
    long = report.melted(scoring.regression_metrics(_predictions(spark, sf_dir)), ["fold", "model", "network"], list(scoring.REGRESSION))
    return _clean(long, "value")


@query
def report_metrics_box(spark, sf_dir):
    long = report.melted(scoring.regression_metrics(_predictions(spark, sf_dir)), ["fold", "model", "network"], list(scoring.REGRESSION))
    return _clean(report.boxes(long, ["model", "network", "metric"]), "least", "lower", "median", "upper", "greatest")


@query
def report_quantiles(spark, sf_dir):
    """Exact quantiles of prices by return flag."""
    out = figures.quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.05, 0.5, 0.95])
    return _clean(out.select("l_returnflag", "n", *[F.col("quantiles")[i].alias(c) for i, c in enumerate(("low", "median", "high"))]), "low", "median", "high")


@query
def report_cells(spark, sf_dir):
    """Quantities against prices, a facet for each return flag."""
    return _clean(figures.cells(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"), "share")


@query
def report_predictions_facets(spark, sf_dir):
    """How many predictions each column of cells has, in the facets of the network's model and the covariates'."""
    p = _predictions(spark, sf_dir)
    both = figures.predictions_facets(p).unionByName(figures.predictions_facets(p, "covariates"))
    return both.groupBy("model", "network", "x_bin").agg(F.sum("n").alias("n"))


@query
def report_strengths_facets(spark, sf_dir):
    rows = _rows(spark, sf_dir).where("is_test").withColumnRenamed("y", "y_true")
    return figures.strengths_facets(rows).groupBy("model", "network", "y_bin").agg(F.sum("n").alias("n"))


@query
def report_class_histogram(spark, sf_dir):
    """How prices are distributed for each status of an order, in bins that all share."""
    return figures.histogram_by(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderstatus")


@query
def report_class_probabilities(spark, sf_dir):
    """Guesses that depend on quantity, by whether the price is high."""
    guesses = _classified(spark, sf_dir).select(F.lit(0).alias("run_id"), F.lit("connectome").alias("model"), F.col("l_returnflag").alias("network"), "y_true", "y_pred")
    return figures.class_probabilities(guesses)


@query
def report_pair_plot(spark, sf_dir):
    return figures.pair_plot(table(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey", "o_orderstatus", "o_orderpriority"], 10)


@query
def report_shares(spark, sf_dir):
    return _clean(figures.shares(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus"), "share")


@query
def missing_values(spark, sf_dir):
    """Of subjects with holes in every eleventh edge and some covariates."""
    s = embedding_subjects(spark, sf_dir)
    holes = s.withColumns({"x": F.transform("x", lambda v, i: F.when((F.col("sample_id") * 7 + i) % 11 != 0, v)), "c1": F.when(F.col("sample_id") % 3 != 0, F.col("c1"))})
    return _clean(prepare.missing_values(holes, COV), "share")


@query
def report_fit_lines(spark, sf_dir):
    return _clean(report.fit_lines(_predictions(spark, sf_dir).where("model <> 'covariates'"), ["model", "network"]), "r", "slope", "intercept", "x_min", "x_max")


@query
def report_strength_histogram(spark, sf_dir):
    return prepare.histogram(table(spark, sf_dir, "events"), "value", 30, ["event_type"])


@query
def report_crosstab(spark, sf_dir):
    return report.crosstab(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


@query
def report_pair_correlations(spark, sf_dir):
    return _clean(report.pair_correlations(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), "r")


@query
def report_apa(spark, sf_dir):
    """Mean and deviation as text, with the p-value of the mean correlation, in display order."""
    summary = results.summary(scoring.regression_metrics(_predictions(spark, sf_dir))).drop("run_id")
    n = embedding_subjects(spark, sf_dir).agg(F.count("*").alias("n"))
    summary = summary.crossJoin(F.broadcast(n))
    p = F.round(p_of(z_of(F.col("pearson_score__mean"), F.col("n"))), 6)
    rows = report.in_order(summary).select("position", "model", "network", report.apa(F.col("mean_absolute_error__mean"), F.col("mean_absolute_error__std")).alias("mae"), report.apa_p(p).alias("p"))
    return rows


@query
def confound_r2s(spark, sf_dir):
    """How much of the target an edge, a covariate and both explain, and what the edge adds."""
    e = long_edges(embedding_subjects(spark, sf_dir)).withColumnRenamed("value", "x").join(embedding_subjects(spark, sf_dir).select("sample_id", "y", "c1"), "sample_id")
    from ..operators.simulate import explained

    return _clean(explained(e, ["edge_id"]), "naive", "confound", "full", "unique")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validated metrics of all models and networks."""
    return QUERIES["cv_summary"](spark, sf_dir)


