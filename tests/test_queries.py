"""Queries against their SQL, on the smallest tables where they are there."""

import os

import duckdb
import pytest

import __spark_entry__ as registry

DATA = "/root/testdata/sf0.001"
NAMES = "edge_residual edge_repeated_splits edge_repeated_splits_spearman residual_cv_metrics report_parameters report_parameter_summary tfce_diagnostics nbs_diagnostics report_quantiles report_cells report_predictions_facets report_strengths_facets report_class_histogram report_class_probabilities report_pair_plot report_shares missing_values logistic_coefficients nonlinear_tree nonlinear_forest additive_sums edge_pearson edge_pearson_blocked edge_spearman_partial edge_partial_2cov edge_select_grid padj_holm_sidak padj_hommel cv_pred_full cv_summary stable_edges inner_cv_best_param perm_pvalues nbs_intensity_components tfce_pvalues metrics_classification stratified_kfold permuted_targets report_shown_edges report_metrics_box report_apa confound_r2s nested_cv_metrics nested_cv_spearman nested_cv_corrected stable_edges_metrics roc_auc_midrank".split()


def same(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    return tuple(map(same, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(same(r[c]) for c in columns) for r in df.collect()), key=repr)
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{DATA}/{file}'")
    cur = con.execute(registry.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(cur.description)}
    assert sorted(at) == columns
    assert got == sorted((tuple(same(r[at[c]]) for c in columns) for r in cur.fetchall()), key=repr)


def test_every_oracle_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
