"""Operators that SQL cannot check, and their properties, against NumPy."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshwork.functions.stats import critical_z, erfc
from meshwork.operators import additive, adjust, edges, graph, models, nonlinear, prepare, report, results, scoring, simulate, splits, trees
from meshwork.operators.logistic import fit_logistic, logistic_predictions
from meshwork.operators.vectors import check_n_features, edge_dim, infer_n_nodes, long_edges, matrix_to_vector, vector_to_matrix
from meshwork.plans import analysis
from meshwork.plans.analysis import Settings
from meshwork.sources import tables
from meshwork.streaming.moments import keep_moments, kept_moments


@pytest.fixture(scope="module")
def subjects(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(120, 15))
    y = x[:, 0] + x[:, 1] - x[:, 2] + 0.3 * rng.normal(size=120)
    c = rng.normal(size=(120, 2))
    rows = [(i, [float(v) for v in x[i]], float(y[i]), float(c[i, 0]), float(c[i, 1])) for i in range(120)]
    return spark.createDataFrame(rows, "sample_id long, x array<double>, y double, c1 double, c2 double").cache()


def arrays(subjects):
    r = subjects.orderBy("sample_id").collect()
    return np.array([v.x for v in r]), np.array([v.y for v in r]), np.array([[v.c1, v.c2] for v in r])


def test_node_counts():
    assert [infer_n_nodes(n) for n in (1, 6, 45, 1225, 5, 400, 0)] == [2, 4, 10, 50, None, None, None]
    assert check_n_features(45) == 10
    with pytest.raises(ValueError, match="nearest"):
        check_n_features(44)


def test_vectors_and_matrices(spark):
    at = [(r.node_i, r.node_j) for r in edge_dim(spark, 7).orderBy("edge_id").collect()]
    assert at == list(zip(*(v.tolist() for v in np.triu_indices(7, 1)), strict=True))
    df = spark.range(1).select(F.array(*[F.lit(float(i)) for i in range(21)]).alias("v"))
    m = df.select("v", vector_to_matrix(F.col("v"), 7).alias("m")).select("m", matrix_to_vector(F.col("m")).alias("back")).first()
    assert m.back == [float(i) for i in range(21)] and np.array_equal(np.array(m.m), np.array(m.m).T)
    with pytest.raises(Exception, match="square"):
        spark.range(1).select(matrix_to_vector(F.array(F.array(F.lit(1.0)), F.array(F.lit(1.0))))).collect()


def test_erfc(spark):
    xs = [0.0, 0.1, 0.5, 1.0, 2.0, 4.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(erfc(F.col("x"))).collect()]
    assert got == pytest.approx([math.erfc(x) for x in xs], rel=2e-7)
    assert critical_z(0.05) == pytest.approx(1.959964)


def test_splits_partition_the_samples(spark):
    s = spark.range(103).withColumnRenamed("id", "sample_id").withColumn("y", F.col("sample_id") % 2)
    sizes = sorted(r["count"] for r in splits.kfold(s, 5).groupBy("fold").count().collect())
    assert sizes == [20, 20, 21, 21, 21]
    by = splits.stratified_kfold(s, 5, "y").groupBy("fold").agg(F.sum("y").alias("n")).collect()
    assert {r.n for r in by} <= {10, 11}
    assert splits.shuffle_split(s, 0.25, 2).where("is_test").groupBy("split").count().collect()[0]["count"] == 26
    p = splits.permuted_targets(s.withColumn("y", F.col("sample_id").cast("double")), 3)
    assert [sorted(r.y for r in p.where(f"run_id = {k}").collect()) for k in range(4)] == [[float(i) for i in range(103)]] * 4
    assert p.where("run_id = 1 and y <> sample_id").count() > 80


@pytest.mark.parametrize("method", edges.STATISTICS)
def test_statistics(subjects, method):
    x, y, c = arrays(subjects)
    if method.startswith("point"):
        subjects = simulate.binary_target(subjects)
        y = (y > np.median(y)).astype(float)
    samples = analysis.folded(subjects, Settings(folds=3)).cache()
    fold = np.array([r.sample_fold for r in samples.orderBy("sample_id").collect()])
    partial = method.endswith("partial")
    got = {(r.fold, r.edge_id): r for r in edges.edge_statistic(method, long_edges(subjects), samples, ["c1", "c2"]).collect()}
    rank = lambda v: np.argsort(np.argsort(v, axis=0, kind="stable"), axis=0).astype(float)
    for f in range(3):
        t = fold != f
        xs, ys, cs = x[t], y[t], c[t]
        if method.startswith("spearman"):
            xs, ys, cs = rank(xs), rank(ys), rank(cs)
        z = np.column_stack([np.ones(len(ys)), cs]) if partial else np.ones((len(ys), 1))
        res = lambda v, z=z: v - z @ np.linalg.lstsq(z, v, rcond=None)[0]
        for e in range(15):
            rx, ry, yc = res(xs[:, e]), res(ys), ys - ys.mean()
            r, pr = rx @ ry / np.sqrt(rx @ rx * (yc @ yc)), rx @ ry / np.sqrt(rx @ rx * (ry @ ry))
            df = len(ys) - 2 - (2 if partial else 0)
            zz = pr * np.sqrt(df / (1 - pr**2)) / np.sqrt(df / (df + 1))
            assert (got[f, e].r, got[f, e].z, got[f, e].p) == pytest.approx((r, zz, math.erfc(abs(zz) / 2**0.5)), abs=1e-6)


def test_constant_edges_and_collinear_covariates(subjects):
    flat = subjects.withColumn("x", F.transform("x", lambda v, i: F.when(i == 3, F.lit(1.0)).otherwise(v))).withColumn("c2", F.col("c1") * 2)
    samples = analysis.folded(flat, Settings(folds=3))
    got = edges.edge_statistic("pearson_partial", long_edges(flat), samples, ["c1", "c2"]).where("edge_id = 3").collect()
    assert {(r.r, r.p) for r in got} == {(0.0, 1.0)}
    one = {(r.fold, r.edge_id): r.r for r in edges.edge_statistic("pearson_partial", long_edges(flat), samples, ["c1"]).collect()}
    two = {(r.fold, r.edge_id): r.r for r in edges.edge_statistic("pearson_partial", long_edges(flat), samples, ["c1", "c2"]).collect()}
    assert two == pytest.approx(one)
    with pytest.raises(NotImplementedError):
        edges.edge_statistic("kendall", long_edges(flat), samples)


def test_blocked_moments_are_the_same(subjects):
    samples = analysis.folded(subjects, Settings(folds=3, permutations=2)).cache()
    plain = edges.test_moments(long_edges(subjects), samples, ["c1"])
    rows = lambda df: {(r.run_id, r.edge_id, r.sample_fold): [r[c] for c in sorted(df.columns)] for r in df.collect()}
    a, b = rows(plain), rows(edges.test_moments_blocked(subjects, samples, ["c1"]))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def closed_hommel(p):
    from itertools import combinations

    m = len(p)
    out = []
    for i in range(m):
        worst = 0.0
        for k in range(1, m + 1):
            for rest in combinations([j for j in range(m) if j != i], k - 1):
                q = sorted(p[j] for j in (*rest, i))
                worst = max(worst, min(k * v / (j + 1) for j, v in enumerate(q)))
        out.append(min(1.0, worst))
    return out


def test_adjustments(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205]
    df = spark.createDataFrame(list(enumerate(p)), "edge_id int, p double").withColumn("run_id", F.lit(0))
    get = lambda m: [r.p_adjusted for r in adjust.adjusted(df, m, ["run_id"]).orderBy("edge_id").collect()]
    assert get("hommel") == pytest.approx(closed_hommel(p))
    bh = [0.008, 0.032, 0.0672, 0.0672, 0.0672, 0.08, 0.0845714, 0.205]
    assert get("fdr_bh") == pytest.approx(bh, abs=1e-6)
    assert get("fdr_tsbh") == pytest.approx([b * 6 / 8 for b in bh], abs=1e-6)
    assert all(a >= b - 1e-12 for a, b in zip(get("holm"), get("simes-hochberg"), strict=True))
    with pytest.raises(ValueError):
        adjust.adjusted(df, "nothing", [])


def test_models_against_least_squares(subjects):
    s = Settings(folds=3)
    samples = analysis.folded(subjects, s).cache()
    mask = edges.selected(edges.edge_statistic("pearson", long_edges(subjects), samples), 0.05).cache()
    rows = analysis.design_rows(subjects, samples, mask, s).cache()
    got = {(r.fold, r.model, r.network, r.sample_id): r.y_pred for r in analysis.predictions(rows, s).collect()}
    t = rows.toPandas().sort_values("sample_id")
    for f, g in t.groupby("fold"):
        tr, te = g[~g.is_test], g[g.is_test]
        for model, cols in (("connectome", ["pos", "neg"]), ("covariates", ["c1", "c2"]), ("full", ["pos", "neg", "c1", "c2"]), ("residuals", ["pos_res", "neg_res"])):
            a = lambda d, cols=cols: np.column_stack([np.ones(len(d)), d[cols]])
            want = a(te) @ np.linalg.lstsq(a(tr), tr.y, rcond=None)[0]
            assert [got[f, model, "both", i] for i in te.sample_id] == pytest.approx(list(want), abs=1e-5)
        assert abs((tr.pos_res * tr.c1).sum()) < 1e-5
    empty = analysis.design_rows(subjects, samples, mask.where("1 = 0"), s)
    flat = analysis.predictions(empty, s).where("model = 'connectome'").agg(F.stddev_pop("y_pred")).first()[0]
    assert flat < 1.0


def test_logistic_against_newton(spark):
    rng = np.random.default_rng(0)
    f = rng.normal(size=(200, 2))
    y = (rng.random(200) < 1 / (1 + np.exp(-(0.5 + f @ [1.0, -2.0])))).astype(float)
    rows = [(0, 0, "connectome", "both", i, i % 4 == 0, float(y[i]), float(f[i, 0]), float(f[i, 1])) for i in range(200)]
    df = spark.createDataFrame(rows, "run_id int, fold int, model string, network string, sample_id long, is_test boolean, y double, f1 double, f2 double")
    got = [r.y_pred for r in logistic_predictions(df).orderBy("sample_id").collect()]
    # a group of several blocks
    assert [r.y_pred for r in logistic_predictions(df, block=40).orderBy("sample_id").collect()] == pytest.approx(got, abs=1e-7)
    t = np.arange(200) % 4 != 0
    a, b = np.column_stack([np.ones(200), f]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-a[t] @ b))
        b += np.linalg.solve(a[t].T @ (a[t] * (p * (1 - p))[:, None]), a[t].T @ (y[t] - p))
    assert got == pytest.approx(list(1 / (1 + np.exp(-a[~t] @ b))), abs=1e-5)


def test_logistic_over_many_runs(spark):
    """A hundred permuted targets; runs of different classes stop on their own, separable ones at the last round."""
    rng = np.random.default_rng(2)
    f = rng.normal(size=(60, 2))
    ys = {run: (rng.random(60) < 0.5).astype(float) for run in range(100)}
    ys[100] = (f[:, 0] > 0).astype(float)
    rows = [(run, 0, "connectome", "both", i, i % 3 == 0, float(y[i]), *map(float, f[i])) for run, y in ys.items() for i in range(60)]
    df = spark.createDataFrame(rows, DESIGN)
    got = {r.run_id: r.beta for r in fit_logistic(df, ["run_id"], ["f1", "f2"]).collect()}
    t, x = np.arange(60) % 3 != 0, np.column_stack([np.ones(60), f])
    assert len(got) == 101 and abs(got[100][1]) > 20
    for run in range(100):
        p = 1 / (1 + np.exp(-x[t] @ got[run]))
        assert x[t].T @ (ys[run][t] - p) == pytest.approx([0, 0, 0], abs=1e-5)


DESIGN = "run_id int, fold int, model string, network string, sample_id long, is_test boolean, y double, f1 double, f2 double"


def curved(spark, n=300):
    rng = np.random.default_rng(1)
    x = rng.uniform(-2, 2, size=(n, 2))
    y = np.sin(2 * x[:, 0]) + x[:, 1] ** 2
    rows = [(run, 0, model, "both", i, i % 3 == 0, float(y[i]), *map(float, x[i])) for run in (0, 1) for model in ("connectome", "covariates") for i in range(n)]
    return spark.createDataFrame(rows, DESIGN).repartition(3), x, y


@pytest.mark.parametrize("method", list(nonlinear.METHODS))
def test_nonlinear_fits(spark, method):
    df, x, y = curved(spark)
    predict = (lambda d: trees.tree_predictions(d, trees=15)) if method == "forest" else method
    got = nonlinear.nonlinear_predictions(df, predict).collect()
    assert len(got) == 200 and {r.model for r in got} == {"connectome"}
    for run in (0, 1):
        own = {r.sample_id: r for r in got if r.run_id == run}
        assert np.corrcoef([r.y_true for r in own.values()], [r.y_pred for r in own.values()])[0, 1] > 0.85
    assert {(r.sample_id, round(r.y_pred, 9)) for r in got if r.run_id == 0} == {(r.sample_id, round(r.y_pred, 9)) for r in got if r.run_id == 1}


def test_trees_against_growing_one_by_one(spark):
    df, x, y = curved(spark)
    test, bins = np.arange(len(y)) % 3 == 0, 8
    lo, hi = x[~test].min(0), x[~test].max(0)
    b = np.clip(np.floor((x - lo) * bins / (hi - lo)), 0, bins - 1).astype(int)

    def draw(tree, i):
        u = int(hashlib.md5(f"tree:42:{tree}:{i}".encode()).hexdigest()[:8], 16) / 2**32
        return sum(u >= p for p in trees.POISSON)

    def guess(rows, w, who, depth):
        mean = (w[rows] * y[rows]).sum() / w[rows].sum()
        best = (1e-6, None)
        for f in range(2):
            for cut in np.unique(b[rows, f])[:-1]:
                left = b[rows, f] <= cut
                n, s = [w[rows][m].sum() for m in (left, ~left)], [(w[rows] * y[rows])[m].sum() for m in (left, ~left)]
                gain = round(s[0] ** 2 / n[0] + s[1] ** 2 / n[1] - sum(s) ** 2 / sum(n), 6)
                if gain > best[0]:
                    best = (gain, (f, cut))
        if depth == 0 or best[1] is None:
            return dict.fromkeys(who, mean)
        f, cut = best[1]
        out = {}
        for side in (True, False):
            out |= guess(rows[(b[rows, f] <= cut) == side], w, [i for i in who if (b[i, f] <= cut) == side], depth - 1)
        return out

    for n in (1, 3):
        w = [np.array([draw(t, i) if n > 1 else 1 for i in range(len(y))]) for t in range(n)]
        each = [guess(np.flatnonzero(~test & (w[t] > 0)), w[t], np.flatnonzero(test).tolist(), 3) for t in range(n)]
        got = trees.tree_predictions(df, trees=n, depth=3, bins=bins).where("run_id = 0").collect()
        assert [r.y_pred for r in sorted(got, key=lambda r: r.sample_id)] == pytest.approx([np.mean([e[i] for e in each]) for i in np.flatnonzero(test)])


def test_trees_deal_small_tables_to_all_cores(spark, monkeypatch):
    made, keep = [], trees.materialized
    monkeypatch.setattr(trees, "materialized", lambda df: made.append(keep(df)) or made[-1])
    trees.tree_predictions(curved(spark)[0].coalesce(1), trees=2, depth=1)
    rows = [df for df in made if "bin" in df.columns]
    assert [len(df.inputFiles()) for df in rows] == [spark.sparkContext.defaultParallelism]


def test_trees_shuffle_cells_not_rows():
    rng, n = np.random.default_rng(3), 5000
    g, y, place, w, node = rng.choice([7, 1 << 40], n), rng.normal(size=n), rng.integers(0, 4, (n, 2)), rng.integers(0, 3, (n, 3)), rng.integers(1, 4, (n, 3))
    for some in (n, 3):  # many rows of few cells, and the other way round
        columns = [pa.array(g[:some]), pa.array(y[:some]), *[pa.array(v[:some].astype(np.int32).tolist(), pa.list_(pa.int32())) for v in (place, w, node)]]
        got = [r for b in trees.added_up(2)(iter([pa.RecordBatch.from_arrays(columns, ["g", "y", "place", "w", "node"])])) for r in b.to_pylist()]
        want = {}
        for i in range(some):
            for t in range(3):
                for f in range(2):
                    if w[i, t] and node[i, t] >= 2:
                        cell = want.setdefault((g[i], t, node[i, t], f, place[i, f]), [0, 0.0])
                        cell[0], cell[1] = cell[0] + w[i, t], cell[1] + w[i, t] * y[i]
        assert len(got) == len(want) <= 2 * 3 * 2 * 2 * 4
        for r in got:
            assert [r["n"], r["s"]] == pytest.approx(want[r["g"], r["tree"], r["node"], r["feature"], r["b"]])


def test_trees_of_constant_and_empty_designs(spark):
    df, _, _ = curved(spark, 30)
    flat = trees.tree_predictions(df.withColumns({"f1": F.lit(1.0), "f2": F.lit(0.0)})).collect()
    mean = df.where("not is_test and run_id = 0 and model = 'connectome'").agg(F.avg("y")).first()[0]
    assert len(flat) == 20 and all(r.y_pred == pytest.approx(mean) for r in flat)
    assert trees.tree_predictions(df.limit(0), trees=2).count() == additive.additive_predictions(df.limit(0)).count() == 0


def test_additive_against_a_dense_solve(spark):
    df, x, y = curved(spark)
    t, knots = np.arange(len(y)) % 3 != 0, 10
    b = np.zeros((len(y), 1 + 2 * knots))
    b[:, 0] = 1
    for f in range(2):
        at = np.clip((x[:, f] - x[t, f].min()) / np.ptp(x[t, f]), 0, 1) * (knots - 3)
        for j in range(knots):  # a cubic B-spline as a sum of truncated cubes
            b[:, 1 + f * knots + j] = sum((-1) ** i * c * np.maximum(at + 3 - j - i, 0) ** 3 for i, c in enumerate((1, 4, 6, 4, 1))) / 6
    assert b[:, 1 : 1 + knots].sum(1) == pytest.approx(np.ones(len(y)))
    rough, second = np.zeros((21, 21)), np.diff(np.eye(knots), 2, axis=0)
    for f in range(2):
        rough[1 + f * knots : 1 + (f + 1) * knots, 1 + f * knots : 1 + (f + 1) * knots] = second.T @ second
    best = None
    for penalty in additive.PENALTIES:
        a = b[t].T @ b[t] + penalty * rough + np.diag([0.0] + [1e-6] * 20)
        hat = b[t] @ np.linalg.solve(a, b[t].T)
        score = t.sum() * ((y[t] - hat @ y[t]) ** 2).sum() / (t.sum() - np.trace(hat)) ** 2
        if best is None or score < best[0]:
            best = (score, b[~t] @ np.linalg.solve(a, b[t].T @ y[t]))
    got = additive.additive_predictions(df).where("run_id = 0").orderBy("sample_id").collect()
    assert [r.y_pred for r in got] == pytest.approx(best[1], abs=1e-5)


def test_metrics(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 2.0, 5.0), ("b", 1.0, 1.0), ("b", 3.0, 3.0)], "network string, y_true double, y_pred double")
    got = {r.network: r for r in scoring.regression_metrics(df, ["network"]).collect()}
    assert got["a"].pearson_score == 0 and got["b"].pearson_score == pytest.approx(1) and got["b"].mean_squared_error == 0
    probs = spark.createDataFrame([(1.0, 0.9), (1.0, 0.5), (0.0, 0.5), (0.0, 0.2)], "y_true double, y_pred double").withColumn("g", F.lit(1))
    m = scoring.classification_metrics(probs, ["g"]).first()
    assert (m.accuracy, m.balanced_accuracy, m.roc_auc) == pytest.approx((0.75, 0.75, 0.875), abs=1e-6)
    with pytest.raises(ValueError):
        scoring.score(df, "ranking")


def test_permutation_p(spark):
    def rows(name, true, null):
        return spark.createDataFrame([(k, "m", "both", v) for k, v in enumerate([true, *null])], f"run_id int, model string, network string, {name} double")

    get = lambda name, true, null: results.permutation_p(rows(name, true, null), [name]).first()[name]
    assert get("pearson_score", 0.5, [0.3, 0.6, 0.4, 0.7]) == pytest.approx(3 / 5)
    assert get("mean_squared_error", 1.5, [1.4, 1.6, 1.5, 1.7]) == pytest.approx(2 / 5)
    assert get("pearson_score", 0.0, [0.5, 0.6, 0.7]) == 1
    assert get("pearson_score", 0.5, [float("nan"), 0.6]) == pytest.approx(2 / 3)


def test_clique_is_found(spark):
    """A clique of six nodes, stable in all folds, among permuted runs of single edges."""
    clique = [(0, "positive", i, j, 9, 0.9) for i in range(6) for j in range(i + 1, 6)] + [(0, "positive", 10, 11, 8, 0.8)]
    null = [(r, "positive", r % 7, 8 + r % 9, 6, 0.6) for r in range(1, 40)]
    stability = spark.createDataFrame(clique + null, "run_id int, network string, node_i int, node_j int, n_selected long, stability double")
    runs = spark.range(40).select(F.col("id").cast("int").alias("run_id"))
    found, comps, critical = graph.nbs(stability, runs, 0.5, 10)
    p = {(r.node_i, r.node_j): r.p_value for r in found.collect()}
    assert len(p) == 16 and p[0, 1] == pytest.approx(1 / 40) and p[10, 11] == 1
    top = comps.orderBy(F.desc("statistic")).first()
    assert (top.n_edges, top.n_nodes, top.statistic, top.significant) == (15, 6, 15, True)
    assert {r.network: r.critical_value for r in critical.collect()} == {"positive": 1.0, "negative": 0.0}
    scores = {(r.run_id, r.node_i, r.node_j): r.score for r in graph.tfce(stability).collect()}
    assert scores[0, 0, 1] == pytest.approx(sum(15**0.5 * (0.1 * k) ** 2 * 0.1 for k in range(1, 10)))
    q = {(r.node_i, r.node_j): r.p_value for r in graph.tfce_p(graph.tfce(stability), runs).collect()}
    assert q[0, 1] == pytest.approx(1 / 40)
    with pytest.raises(ValueError):
        graph.nbs(stability, runs, 0.5, 10, "size")


def test_whole_analysis(subjects):
    out = analysis.run(subjects, Settings(folds=4, permutations=9, nbs_threshold=0.75))
    top = {(r.model, r.network): r for r in out["summary"].where("run_id = 0").collect()}
    assert top["connectome", "both"].pearson_score__mean > 0.8 and abs(top["covariates", "both"].pearson_score__mean) < 0.5
    p = {(r.model, r.network): r for r in out["p_values"].collect()}
    assert p["connectome", "both"].pearson_score__mean == pytest.approx(0.1)
    kept = {(r.edge_id, r.network): r.stability for r in out["stability"].where("run_id = 0").collect()}
    assert kept[0, "positive"] == kept[1, "positive"] == kept[2, "negative"] == 1
    assert out["nbs_edges"].count() >= 3 and out["tfce_edges"].count() >= 3


def test_nested_and_classification(subjects):
    nested = analysis.run(subjects, Settings(folds=3, inner_folds=2, alphas=(0.05, 0.001)))
    assert {r.fold for r in nested["parameters"].collect()} == {0, 1, 2}
    classes = analysis.run(simulate.binary_target(subjects), Settings(folds=3, task="classification", method="point_biserial"))
    best = classes["summary"].where("model = 'connectome' and network = 'both'").first()
    assert best.roc_auc__mean > 0.85
    for wrong in ({"alphas": (0.05, 0.01)}, {"stable_share": 0.5}, {"task": "classification", "model": "tree"}):
        with pytest.raises(ValueError):
            Settings(**wrong)


def test_preparation(spark, subjects):
    assert prepare.task_type(subjects) == "regression" and prepare.task_type(simulate.binary_target(subjects)) == "classification"
    with pytest.raises(ValueError):
        prepare.check_task_type(subjects, "classification")
    df = spark.createDataFrame([("b", 1.0), ("a", 2.0), (None, 3.0), ("c", 4.0)], "cat string, num double")
    hot = prepare.one_hot(df, "cat")
    assert hot.columns == ["num", "cat_b", "cat_c"] and [tuple(r) for r in hot.orderBy("num").collect()] == [(1.0, 1.0, 0.0), (2.0, 0.0, 0.0), (3.0, 0.0, 0.0), (4.0, 0.0, 1.0)]
    assert tables.checked(subjects, ["c1", "c2"]) is subjects
    gap = subjects.withColumn("x", F.transform("x", lambda v, i: F.when((i == 0) & (F.col("sample_id") == 3), F.lit(None)).otherwise(v)))
    with pytest.raises(ValueError, match="missing"):
        tables.checked(gap, ["c1"])
    tables.checked(gap, ["c1"], impute=True)
    with pytest.raises(ValueError, match="target"):
        tables.checked(subjects.withColumn("y", F.lit(None).cast("double")), [])


def test_atlases(spark, tmp_path):
    (tmp_path / "Small.csv").write_text("region,x,y,z,network\nA,1,2,3,n1\nB,4,5,6,n2\n")
    got = tables.resolve_atlas(spark, "small", str(tmp_path), 2).orderBy("node_id").collect()
    assert [(r.node_id, r.region, r.z) for r in got] == [(0, "A", 3.0), (1, "B", 6.0)]
    assert tables.resolve_atlas(spark, None) is None and tables.list_atlases(spark, str(tmp_path)) == ["Small"]
    for wrong, kind in ((3, TypeError), ("none", ValueError)):
        with pytest.raises(kind):
            tables.resolve_atlas(spark, wrong, str(tmp_path))
    with pytest.raises(ValueError, match="regions"):
        tables.resolve_atlas(spark, f"{tmp_path}/Small.csv", n_nodes=5)
    (tmp_path / "bad.csv").write_text("region,x,y\nA,1,2\n")
    with pytest.raises(ValueError, match="lacks"):
        tables.read_atlas(spark, f"{tmp_path}/bad.csv")


def test_results_round_trip_and_report(spark, subjects, tmp_path):
    out = analysis.run(subjects, Settings(folds=3))
    tables.write_results({"summary": out["summary"]}, str(tmp_path), csv=("summary",))
    assert tables.read_results(spark, str(tmp_path), "summary").count() == 15
    assert tables.read_results(spark, str(tmp_path), "absent") is None
    many = report.html("Long", {"rows": spark.range(7)}, most_rows=5)
    assert many.count("<tr>") == 6 and "and 2 more rows" in many
    p = spark.createDataFrame([("connectome", "both", 0.01)], "model string, network string, pearson_score__mean double")
    one = report.verdict(out["summary"], p, out["stability"]).first()
    assert one.p == "0.010*" and one.significant and one.value > 0.8 and one.n_stable_edges == out["stability"].count()
    page = report.html("Analysis", {"summary": report.in_order(out["summary"])})
    assert page.count("<tr>") == 16 and "pearson_score__mean" in page
    (tmp_path / "log.txt").write_text("start\n=====\nfolds: 3\nmethod: pearson\n=====\nend\n")
    assert [(r.key, r.value) for r in tables.config_of_log(spark, f"{tmp_path}/log.txt").orderBy("line").collect()] == [("folds", "3"), ("method", "pearson")]


def test_simulated_confounding(spark):
    data = simulate.given_kappa(spark, 3000, 0.36, 0.6, {"mixed": 2, "signal": 2, "confound": 2, "noise": 2}).cache()
    long = long_edges(data).withColumnRenamed("value", "x").join(data.select("sample_id", "y", "c1"), "sample_id")
    got = {r.edge_id: r for r in simulate.explained(long, ["edge_id"]).collect()}
    assert all(abs(got[e].unique - 0.144) < 0.05 for e in (0, 1))
    assert all(got[e].unique < 0.02 for e in (4, 5, 6, 7))
    assert abs(got[0].confound - 0.216) < 0.05
    for wrong in ({"r2": 2.0, "kappa": 0.5}, {"r2": 0.3, "kappa": 2.0}):
        with pytest.raises(ValueError):
            simulate.given_kappa(spark, 10, counts={"noise": 1}, **wrong)
    m = simulate.multivariate(spark, 50, 6, 2, 3)
    assert m.data.count() == 50 and (m.beta != 0).sum() == 3
    with pytest.raises(ValueError):
        simulate.confounded(spark, "no", 5, 3)


def test_streamed_moments(spark, subjects, tmp_path):
    samples = analysis.folded(subjects, Settings(folds=3)).select("sample_id", "sample_fold")
    rows = subjects.join(samples, "sample_id").cache()
    for i in range(3):
        rows.where(F.col("sample_id") % 3 == i).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    keep_moments(stream, f"{tmp_path}/sums", f"{tmp_path}/check", ["c1"]).awaitTermination()
    whole = edges.test_moments(long_edges(subjects), rows.withColumn("run_id", F.lit(0)), ["c1"])
    pairs = kept_moments(spark, f"{tmp_path}/sums").alias("a").join(whole.alias("b"), ["edge_id", "sample_fold"])
    assert pairs.where(F.abs(F.col("a.s_x_y") - F.col("b.s_x_y")) + F.abs(F.col("a.n") - F.col("b.n")) > 1e-6).count() == 0 and pairs.count() == 45


def test_masks_and_models_are_lazy(subjects):
    rows = models.strengths(long_edges(subjects), subjects.sparkSession.createDataFrame([(0, 0, 1, "positive")], "run_id int, fold int, edge_id int, network string"), subjects.select(F.lit(0).alias("run_id"), F.lit(0).alias("fold"), "sample_id"))
    assert rows.where("neg <> 0").count() == 0 and rows.count() == 120


def test_ranks_of_training_parts_by_one_sort(spark, subjects):
    """Blocks and rows agree on all runs, with ties, and the analysis takes the blocks."""
    tied = subjects.withColumns({"x": F.transform("x", lambda v: F.round(v, 1)), "c1": F.round("c1", 0), "y": F.round("y", 1)})
    samples = analysis.folded(tied, Settings(folds=4, permutations=3))
    for method in ("spearman", "spearman_partial"):
        rows, packed = (edges.edge_statistic(method, long_edges(tied), samples, ["c1"], s).collect() for s in (None, tied))
        key = lambda r: (r.run_id, r.fold, r.edge_id)
        a, b = sorted(rows, key=key), sorted(packed, key=key)
        assert [(key(r), r.n) for r in a] == [(key(r), r.n) for r in b]
        assert [r.r for r in a] == pytest.approx([r.r for r in b]) and [r.z for r in a] == pytest.approx([r.z for r in b])
        some = edges.edge_statistic(method, long_edges(tied), samples, ["c1"], tied, 2.0).collect()
        assert {key(r) for r in some} == {key(r) for r in a if abs(r.z) > 2.0}
