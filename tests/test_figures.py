"""Figures' tables against plain counting, with missing values, ties, heavy values and nothing at all."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwork.operators import figures, prepare, report

SHARES = [0.95, 0.0, 0.25, 0.5, 1.0]


@pytest.mark.parametrize("accuracy", [50, 10000])
def test_quantiles_are_exact(spark, monkeypatch, accuracy):
    monkeypatch.setattr(figures, "ACCURACY", accuracy)
    draw = random.Random(3)
    groups = {
        "spread": [draw.gauss(0, 1) for _ in range(3000)],
        "tied": [float(draw.randrange(4)) for _ in range(2000)],
        "one_value": [2.5] * 700,
        "mostly_one": [1.0] * 900 + [draw.random() for _ in range(60)],
        "few": [3.0, 1.0, 2.0],
        "single": [7.0],
        None: [draw.random() for _ in range(400)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("few", None), ("few", float("nan")), ("nothing", None)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r.g: (r.n, r.quantiles) for r in figures.quantiles(df, ["g"], "v", SHARES).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        assert got[g][0] == len(vs) and got[g][1] == pytest.approx(np.quantile(vs, SHARES).tolist())
    whole = figures.quantiles(df.where("g = 'spread'"), [], "v", [0.5]).collect()
    assert whole[0].quantiles == pytest.approx([np.median(groups["spread"])])
    assert figures.quantiles(df.limit(0), ["g"], "v", SHARES).count() == 0
    assert {r.g: r.median for r in report.boxes(df, ["g"], "v").collect()}["tied"] == np.median(groups["tied"])


def test_cells_points_and_histograms(spark):
    rows = [(i, "a" if i % 3 else None, float(i % 10), None if i == 5 else float(i)) for i in range(60)] + [(60, "flat", 1.0, 1.0), (61, "flat", 1.0, float("nan"))]
    df = spark.createDataFrame(rows, "id long, g string, x double, y double")
    cells = figures.cells(df, ["g"], "x", "y", 5).collect()
    assert sum(r.n for r in cells if r.g == "a") == 39 and sum(r.n for r in cells if r.g is None) == 20
    assert [(r.x_bin, r.y_bin, r.n, r.share) for r in cells if r.g == "flat"] == [(0, 0, 1, 1.0)]
    assert sum(r.share for r in cells if r.g == "a") == pytest.approx(1) and max(r.x_bin for r in cells) == 4
    drawn = figures.points(df, ["g"], "id", 7)
    assert {r["g"]: r["count"] for r in drawn.groupBy("g").count().collect()} == {"a": 7, None: 7, "flat": 2}
    assert sorted(r.id for r in drawn.collect()) == sorted(r.id for r in figures.points(df.repartition(5), ["g"], "id", 7).collect())
    bars = {(r.g, r.bin): r.n for r in figures.histogram_by(df, "x", "g", 10).collect()}
    assert bars["a", 9] == 4 and bars[None, 9] == 2 and bars["flat", 1] == 2
    shares = {(r.g, r.x): r.share for r in figures.shares(df, "g", "x").collect()}
    assert shares["flat", 1.0] == 1.0 and sum(v for (g, _), v in shares.items() if g is None) == pytest.approx(1)
    for empty in (figures.cells(df.limit(0), ["g"], "x", "y"), figures.histogram_by(df.limit(0), "x", "g"), figures.pair_plot(df.limit(0), ["x", "g"])):
        assert empty.count() == 0


def test_pair_plot(spark):
    rows = [(1.0, 10, "u", "s"), (2.0, None, "u", "t"), (3.0, 30, None, "t"), (None, 20, "v", "s")]
    got = {(r.a, r.b, r.x, r.y): r.n for r in figures.pair_plot(spark.createDataFrame(rows, "p double, q int, c string, d string"), ["p", "q", "c", "d"], 2).collect()}
    assert {k: n for k, n in got.items() if k[:2] == ("p", "p")} == {("p", "p", "0", None): 1, ("p", "p", "1", None): 2}
    assert {k: n for k, n in got.items() if k[:2] == ("p", "q")} == {("p", "q", "0", "0"): 1, ("p", "q", "1", "1"): 1}
    assert {k: n for k, n in got.items() if k[:2] == ("q", "c")} == {("q", "c", "0", "u"): 1, ("q", "c", "1", "v"): 1}
    assert {k: n for k, n in got.items() if k[:2] == ("c", "d")} == {("c", "d", "u", "s"): 1, ("c", "d", "u", "t"): 1, ("c", "d", "v", "s"): 1}


def test_parameters(spark):
    rows = [(0, 0, {"alpha": "0.1", "kind": "b", "depth": "3"}), (0, 1, {"alpha": "0.3", "kind": "a"}), (0, 2, {"alpha": "0.2", "kind": "7", "depth": None}), (1, 0, {"alpha": "9"})]
    named = spark.createDataFrame(rows, "run_id int, fold int, params map<string,string>")
    got = {r.name: r for r in figures.parameter_summary(named).collect()}
    alpha, kind, depth = got["alpha"], got["kind"], got["depth"]
    assert (alpha.n, alpha.mean, alpha.std, alpha.lower, alpha.greatest) == (3, pytest.approx(0.2), pytest.approx(0.1), pytest.approx(0.15), 0.3) and alpha.top is None
    assert (kind.n, kind.mean, kind.n_values, kind.top, kind.n_top) == (3, None, 3, "7", 1)
    assert (depth.n, depth.median, depth.std) == (1, 3.0, None)
    assert {r.fold: r.params for r in figures.parameter_table(named).collect()}[1] == "alpha: 0.3\nkind: a"
    chosen = figures.named_parameters(spark.createDataFrame([(0, 0, 1)], "run_id int, fold int, param_id int"), [("pearson", None, 0.05), ("spearman", "holm", 0.01)])
    assert chosen.first().params == {"method": "spearman", "correction": "holm", "threshold": "0.01"}


def test_facets_count_every_row_once(spark):
    p = spark.range(300).select((F.col("id") % 2).cast("int").alias("run_id"), F.element_at(F.array(F.lit("connectome"), F.lit("covariates")), (F.col("id") % 5 % 2 + 1).cast("int")).alias("model"), F.element_at(F.array(*map(F.lit, ("positive", "negative", "both"))), (F.col("id") % 3 + 1).cast("int")).alias("network"), (F.col("id") % 7 % 2).cast("double").alias("y_true"), (F.col("id") / 299).alias("y_pred"))
    for model, more in (("connectome", "true"), ("covariates", "network = 'both'")):
        assert figures.predictions_facets(p, model).agg(F.sum("n")).first()[0] == p.where(f"run_id = 0 and model = '{model}' and {more}").count()
    bars = figures.class_probabilities(p)
    assert bars.agg(F.sum("n"), F.max("bin")).first() == (p.where("run_id = 0 and model = 'connectome'").count(), 19)
    s = p.select("run_id", F.lit(0).alias("fold"), F.monotonically_increasing_id().alias("sample_id"), "y_true", *[(F.col("y_pred") * i).alias(c) for i, c in enumerate(("pos", "neg", "pos_res", "neg_res"), 1)])
    assert figures.strengths_facets(s).agg(F.sum("n")).first()[0] == 4 * s.where("run_id = 0").count()


def test_missing_values(spark):
    df = spark.createDataFrame([([1.0, None], 1.0, None), ([float("nan"), 2.0], None, 2.0), ([3.0, 4.0], 2.0, float("nan"))], "x array<double>, y double, c1 double")
    assert {r.name: (r.n_missing, round(r.share, 4)) for r in prepare.missing_values(df, ["c1"]).collect()} == {"y": (1, 0.3333), "c1": (2, 0.6667), "edges": (2, 0.3333)}
    assert {(r.name, r.n_missing, r.share) for r in prepare.missing_values(df.limit(0), ["c1"]).collect()} == {(n, 0, 0.0) for n in ("y", "c1", "edges")}


def test_texts_of_reports(spark):
    edges = spark.createDataFrame([("positive", 0, 1, 0.01), ("negative", 1, 2, 0.5)], "network string, node_i int, node_j int, p_value double")
    assert [r.node_j for r in report.significant_edges(edges).collect()] == [1]
    summary = spark.createDataFrame([("full", "both", 0.5)], "model string, network string, r__mean double")
    p = spark.createDataFrame([("full", "both", 0.04), ("connectome", "both", 0.2)], "model string, network string, r__mean double")
    assert {(r.model, r.r__mean, r.r__mean__p) for r in report.combined(summary, p).collect()} == {("full", 0.5, 0.04), ("connectome", None, 0.2)}
    signed = spark.createDataFrame([(0, 1, 0.5), (1, 2, -0.25), (0, 2, 0.0)], "node_i int, node_j int, signed double")
    groups = spark.createDataFrame([(0, "A"), (1, "B"), (2, "C")], "node_id int, group string")
    assert {r.group: r.weight for r in report.chord_groups(report.by_group(signed, groups)).collect()} == {"A": 0.5, "B": 0.75, "C": 0.25}
    assert report.method_text({"method": "tfce", "n_permutations": 9}).endswith("9 permutations") and "0.5" in report.method_text({"component_stat": "extent", "threshold": 0.5, "n_permutations": 9})
