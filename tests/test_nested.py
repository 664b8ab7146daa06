"""Nested cross-validation with every setting, against NumPy on the same splits; imputation, splitters, and the blocked products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwork.functions.stats import critical_z
from meshwork.operators import blocks, edges, models, results, splits
from meshwork.operators.vectors import long_edges
from meshwork.plans import analysis
from meshwork.plans.analysis import Settings


@pytest.fixture(scope="module")
def subjects(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 10))
    c = rng.normal(size=(60, 2))
    y = x[:, 0] + 0.6 * x[:, 1] - 0.8 * x[:, 2] + 0.4 * c[:, 0] + 0.7 * rng.normal(size=60)
    rows = [(i, [float(v) for v in x[i]], float(y[i]), float(c[i, 0]), float(c[i, 1])) for i in range(60)]
    return spark.createDataFrame(rows, "sample_id long, x array<double>, y double, c1 double, c2 double").cache()


@pytest.fixture(scope="module")
def gappy(subjects):
    gone = (F.col("sample_id") * 7) % 11 == 0
    return subjects.withColumns({"x": F.transform("x", lambda v, i: F.when(((F.col("sample_id") + i) % 9 == 0) & (i < 4), F.lit(None)).otherwise(v)), "c1": F.when(~gone, F.col("c1"))}).cache()


def ranks(v):
    out = np.empty(len(v))
    out[np.argsort(v, kind="stable")] = np.arange(len(v))
    return out


def without(v, c):
    d = np.column_stack([np.ones(len(c)), c])
    return v - d @ np.linalg.lstsq(d, v, rcond=None)[0]


def selected(x, y, c, method, correction, alpha):
    """1, -1 or 0 for each edge."""
    if method.startswith("spearman"):
        x, y, c = np.apply_along_axis(ranks, 0, x), ranks(y), np.apply_along_axis(ranks, 0, c)
    k = c.shape[1] if method.endswith("partial") else 0
    rx, ry = (without(x, c), without(y, c)) if k else (x - x.mean(0), y - y.mean())
    r = (rx * ry[:, None]).sum(0) / np.sqrt((rx**2).sum(0) * (ry**2).sum())
    df = len(y) - 2 - k
    z = r * np.sqrt(df / (1 - r**2)) / np.sqrt(df / (df + 1))
    if not correction:
        return np.sign(r) * (np.abs(z) > critical_z(alpha))
    p = np.array([math.erfc(abs(v) / math.sqrt(2)) for v in z])
    order, m = np.argsort(p), len(p)
    q = p[order]
    fixed = np.maximum.accumulate((m - np.arange(m)) * q) if correction == "holm" else np.minimum.accumulate((m / np.arange(1, m + 1) * q)[::-1])[::-1]
    out = np.empty(m)
    out[order] = np.minimum(fixed, 1)
    return np.sign(r) * (out < alpha)


def fitted(x, y, net, new):
    """Predictions of the connectome model on both networks."""
    f = lambda v: np.column_stack([np.ones(len(v)), v @ (net > 0), v @ (net < 0)])
    a = f(x)
    return f(new) @ np.linalg.solve(a.T @ a + 1e-8 * np.eye(3), a.T @ y)


def pearson(a, b):
    return ((a - a.mean()) * (b - b.mean())).sum() / (math.sqrt(((a - a.mean()) ** 2).sum() * ((b - b.mean()) ** 2).sum()) + 1e-8)


def brute(subjects, s):
    """By fold: the best parameter and the test part's correlation."""
    rows = subjects.orderBy("sample_id").collect()
    x0, y, c0 = np.array([[np.nan if v is None else v for v in r.x] for r in rows]), np.array([r.y for r in rows]), np.array([[np.nan if v is None else v for v in (r.c1, r.c2)] for r in rows])
    outer = analysis.roles(analysis.folded(subjects, s), s)
    test = {}
    for r in outer.collect():
        test.setdefault(r.fold, np.zeros(len(y), bool))[r.sample_id] = r.is_test
    train = outer.where("not is_test").select("fold", "sample_id", "y")
    part = {}
    for r in splits.roles(train, s.inner_splitter, s.inner_folds, s.seed, ["fold"], s.inner_repeats, s.inner_test_share, "inner_fold").collect():
        part.setdefault((r.fold, r.inner_fold), {})[r.sample_id] = r.is_test
    out = {}
    for fold, is_test in test.items():
        x, c = x0.copy(), c0.copy()
        for v in (x, c):
            hole = np.isnan(v)
            v[hole] = np.broadcast_to(np.nanmean(v[~is_test], 0), v.shape)[hole]
        if s.residual_edges:
            d = np.column_stack([np.ones(len(c)), c])
            x = x - d @ np.linalg.lstsq(d[~is_test], x[~is_test], rcond=None)[0]
        scores, masks = np.zeros((s.n_inner, len(s.grid))), {}
        for i in range(s.n_inner):
            ids = np.array(sorted(part[fold, i]))
            inner = np.array([part[fold, i][j] for j in ids])
            a, b = ids[~inner], ids[inner]
            for j, (method, correction, alpha) in enumerate(s.grid):
                masks[i, j] = selected(x[a], y[a], c[a], method, correction, alpha)
                scores[i, j] = pearson(fitted(x[a], y[a], masks[i, j], x[b]), y[b])
        best = int(scores.mean(0).argmax())
        net = selected(x[~is_test], y[~is_test], c[~is_test], *s.grid[best])
        if s.stable_share is not None:
            votes = [sum(masks[i, best] == sign for i in range(s.n_inner)) / s.n_inner > s.stable_share + 1e-9 for sign in (1, -1)]
            net = votes[0] * 1.0 - votes[1] * 1.0
        out[fold] = best, pearson(fitted(x[~is_test], y[~is_test], net, x[is_test]), y[is_test])
    return out


CASES = {
    "alphas": {"alphas": (0.05, 0.005)},
    "spearman": {"method": "spearman", "alphas": (0.1, 0.01)},
    "spearman_partial": {"method": "spearman_partial", "alphas": (0.1, 0.01)},
    "corrected": {"correction": "fdr_bh", "alphas": (0.2, 0.01)},
    "whole_grid": {"method": ("pearson", "pearson_partial"), "correction": (None, "holm"), "alphas": (0.2, 0.01)},
    "stable": {"stable_share": 0.5, "inner_folds": 4},
    "residual": {"residual_edges": True, "alphas": (0.1, 0.01)},
    "repeated_outer": {"splitter": "repeated", "repeats": 2, "alphas": (0.1, 0.01)},
    "shuffled_both": {"splitter": "shuffle", "inner_splitter": "shuffle", "inner_test_share": 0.3, "alphas": (0.1, 0.01)},
    "repeated_inner": {"inner_splitter": "repeated", "inner_repeats": 2, "inner_folds": 2, "alphas": (0.1, 0.01)},
}


def check(subjects, s):
    out = analysis.run(subjects, s)
    want = brute(subjects, s)
    best = {r.fold: r.param_id for r in out["parameters"].collect()}
    got = {r.fold: r.pearson_score for r in out["metrics"].where("model = 'connectome' and network = 'both'").collect()}
    assert best == {f: b for f, (b, _) in want.items()}
    assert got == pytest.approx({f: v for f, (_, v) in want.items()}, abs=1e-5)


@pytest.mark.parametrize("case", CASES)
def test_nested(subjects, case):
    check(subjects, Settings(**{"folds": 3, "inner_folds": 3, **CASES[case]}))


@pytest.mark.parametrize("more", [{}, {"residual_edges": True, "method": "pearson_partial"}])
def test_nested_with_missing_values(gappy, more):
    check(gappy, Settings(folds=3, inner_folds=2, alphas=(0.1, 0.01), **more))


def test_nested_trees(subjects):
    out = analysis.run(subjects, Settings(folds=3, inner_folds=2, alphas=(0.1, 0.01), model="tree"))
    assert {r.fold for r in out["parameters"].collect()} == {0, 1, 2} and out["metrics"].where("model = 'full'").count() == 9


def test_overlapping_splits(spark):
    s = spark.range(40).select(F.col("id").alias("sample_id"), (F.col("id") % 4 == 0).cast("int").alias("y"), (F.col("id") % 2).alias("side"))
    r = splits.roles(s, "repeated", 4, by=["side"], repeats=3).collect()
    assert len(r) == 40 * 12 and {v.fold for v in r} == set(range(12))
    for side in (0, 1):
        for k in range(3):
            tested = sorted(v.sample_id for v in r if v.side == side and v.fold // 4 == k and v.is_test)
            assert tested == list(range(side, 40, 2))
    assert splits.roles(s, "shuffle", 5, test_share=0.25).where("is_test").groupBy("fold").count().collect()[0]["count"] == 10
    assert {v.n for v in splits.roles(s, "stratified", 5).where("is_test").join(s, "sample_id").groupBy("fold").agg(F.sum("y").alias("n")).collect()} == {2}
    with pytest.raises(ValueError):
        splits.roles(s, "leave_one_out", 2)


def test_blocks_of_many_runs(subjects, monkeypatch):
    """Blocks smaller than the data, and samples of several tasks."""
    for name, v in (("EDGES_A_BLOCK", 4), ("RUNS_A_BLOCK", 3), ("SAMPLES_A_TASK", 20)):
        monkeypatch.setattr(blocks, name, v)
    samples = analysis.folded(subjects, Settings(folds=3, permutations=7)).cache()
    rows = lambda df, keys: {tuple(r[k] for k in keys): [r[c] for c in sorted(df.columns)] for r in df.collect()}
    keys = ["run_id", "edge_id", "sample_fold"]
    a, b = rows(edges.test_moments(long_edges(subjects), samples, ["c1", "c2"]), keys), rows(edges.test_moments_blocked(subjects, samples, ["c1", "c2"]), keys)
    assert a.keys() == b.keys() and len(a) == 8 * 10 * 3 and all(a[k] == pytest.approx(b[k]) for k in a)
    mask = edges.selected(edges.edge_statistic("pearson", long_edges(subjects), samples, subjects=subjects), 0.2).cache()
    roles = splits.with_roles(samples, 3)
    keys = ["run_id", "fold", "sample_id"]
    a, b = (rows(models.strengths(long_edges(subjects), mask, roles, x).select(*keys, "pos", "neg"), keys) for x in (None, subjects))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


@pytest.mark.parametrize("case", ["pearson", "pearson_partial", "spearman", "spearman_partial"])
def test_blocks_of_listed_parts_and_residuals(subjects, case):
    """Blocks and rows agree for overlapping and inner splits, and for edges without what covariates explain."""
    key = lambda r: tuple(r[k] for k in ("run_id", "fold", "inner_fold", "edge_id") if k in r)

    def same(a, b):
        a, b = sorted(a.collect(), key=key), sorted(b.collect(), key=key)
        assert a and [(key(r), r.n) for r in a] == [(key(r), r.n) for r in b]
        assert [r.r for r in a] == pytest.approx([r.r for r in b], abs=1e-9) and [r.z for r in a] == pytest.approx([r.z for r in b], abs=1e-7)

    cov, long = ["c1", "c2"], long_edges(subjects)
    for more in ({"splitter": "repeated", "repeats": 2}, {"splitter": "shuffle", "test_share": 0.3}):
        s = Settings(folds=3, permutations=2, method=case, **more)
        rows = analysis.roles(analysis.folded(subjects, s), s).cache()
        train = rows.where("not is_test")
        same(edges.training_statistic(case, long, train, cov), edges.listed_statistic(case, subjects, train, cov))
        if not case.startswith("spearman"):
            made = models.residual_edges(long, rows.where("run_id = 0"), cov)
            same(edges.training_statistic(case, made, train, cov), edges.listed_statistic(case, subjects, train, cov, residual=True))
    own = splits.roles(train.where("run_id = 0").select("fold", "sample_id", "y"), "shuffle", 2, by=["fold"], name="inner_fold")
    inner = train.join(own.where("not is_test").drop("is_test"), ["fold", "sample_id"])
    keys = ("run_id", "fold", "inner_fold")
    same(edges.training_statistic(case, long, inner, cov, keys), edges.listed_statistic(case, subjects, inner, cov, 2))


@pytest.mark.parametrize("more", [{}, {"splitter": "repeated", "repeats": 2}])
def test_strengths_of_residual_edges_are_residual_strengths(subjects, more):
    s = Settings(folds=3, permutations=1, residual_edges=True, alphas=(0.3,), **more)
    out = analysis.run(subjects, s)
    rows = analysis.roles(analysis.folded(subjects, s), s)
    made = models.residual_edges(long_edges(subjects), rows.where("run_id = 0"), list(s.covariates))
    want = models.strengths(made, out["selection"], rows).where("is_test")
    at = lambda df: {(r.run_id, r.fold, r.sample_id): (r.pos, r.neg) for r in df.collect()}
    a, b = at(want), at(out["strengths"])
    assert a.keys() == b.keys() and any(p for p, _ in a.values()) and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_ranks_of_residuals_need_rows(subjects):
    with pytest.raises(NotImplementedError):
        edges.listed_statistic("spearman", subjects, subjects, ["c1"], residual=True)
    assert analysis.run(subjects, Settings(folds=3, method="spearman", residual_edges=True))["metrics"].count() == 45


def test_parameters_that_differ_by_rounding_are_equal(spark):
    scores = [(0, 0, 0.2), (0, 1, 0.2 + 1e-15), (1, 0, 0.2), (1, 1, 0.2 + 1e-6), (2, 0, 0.3), (2, 1, 0.3 - 1e-15), (3, 0, math.nan), (3, 1, math.nan)]
    rows = [(fold, inner, param, "connectome", "both", v) for fold, param, v in scores for inner in range(3)]
    metrics = spark.createDataFrame(rows, "fold int, inner_fold int, param_id int, model string, network string, pearson_score double")
    best = results.best_parameters(metrics, "pearson_score").orderBy("fold").collect()
    assert [(r.fold, r.param_id) for r in best] == [(0, 0), (1, 1), (2, 0), (3, 0)]
