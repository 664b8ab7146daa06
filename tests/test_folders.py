"""Validation in the entry point, and folders of results."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meshwork.operators import prepare
from meshwork.plans import analysis
from meshwork.plans.analysis import Settings
from meshwork.sources import folders, tables


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 6))
    y = x[:, 0] - x[:, 1] + 0.2 * rng.normal(size=40)
    rows = [(i, x[i].tolist(), float(y[i]), float(rng.normal())) for i in range(40)]
    return spark.createDataFrame(rows, "sample_id long, x array<double>, y double, c1 double").cache()


def test_run_raises_for_what_it_cannot_analyse(people):
    s = Settings(folds=4, covariates=("c1",))
    last = F.col("sample_id") == 39
    wrong = [
        (people.withColumn("y", F.when(~last, F.col("y"))), s, "target is missing in 1"),
        (people.withColumn("y", F.when(~last, F.col("y")).otherwise(float("nan"))), s, "target is missing in 1"),
        (people.withColumn("x", F.when(last, F.slice("x", 1, 3)).otherwise(F.col("x"))), s, "between 3 and 6"),
        (people.withColumn("x", F.when(~last, F.col("x"))), s, "between 0 and 6"),
        (people.withColumn("x", F.slice("x", 1, 5)), s, "5"),
        (people.where("false"), s, "no samples"),
        (people.withColumn("y", F.lit(2.0)), s, "fewer than two"),
        (people, Settings(folds=4, covariates=("c1",), task="classification"), "looks like regression"),
        (people.withColumn("y", (F.col("y") > 0).cast("double")), s, "looks like classification"),
    ]
    gap = people.withColumn("x", F.when(last, F.transform("x", lambda v, i: F.when(i > 0, v))).otherwise(F.col("x")))
    wrong += [(gap, Settings(folds=4, covariates=("c1",), impute=False), "1 edge values and 0 covariate"), (people.withColumn("c1", F.when(~last, F.col("c1"))), Settings(folds=4, covariates=("c1",), impute=False), "0 edge values and 1 covariate")]
    for subjects, settings, message in wrong:
        with pytest.raises(ValueError, match=message):
            analysis.run(subjects, settings)
    assert analysis.run(gap, s)["metrics"].count() > 0


def test_classes_of_either_sign_are_the_same(people):
    s = Settings(folds=3, covariates=("c1",), task="classification", method="point_biserial")
    one, other = (analysis.run(people.withColumn("y", F.when(F.col("y") > 0, 1.0).otherwise(no)), s)["summary"].orderBy("model", "network").collect() for no in (0.0, -1.0))
    assert one == other


def test_atlases_are_checked(spark):
    row = {"region": "a", "x": "1", "y": "2", "z": "3"}
    assert tables.atlas_of(spark, [row, row | {"region": "b"}]).count() == 2
    for wrong, message in (([row, row], "repeated"), ([row | {"x": "nan"}], "finite"), ([row | {"x": "left"}], "numbers"), ([{"region": "a"}], "lacks")):
        with pytest.raises(ValueError, match=message):
            tables.atlas_of(spark, wrong)


@pytest.mark.parametrize("order", "CF")
def test_arrays_are_read_by_slabs(spark, tmp_path, order):
    for k, a in enumerate((np.random.default_rng(0).normal(size=(7, 5, 3)), np.arange(11, dtype=np.int32), np.zeros((0, 4)), np.array(2.5))):
        path = f"{tmp_path}/{order}{k}.npy"
        np.save(path, np.asarray(a, order=order))
        df = folders.read_npy(spark, path, slab_bytes=100)
        got = {tuple(r)[:-1]: r.value for r in df.collect()}
        assert got == {i: v for i, v in np.ndenumerate(a)}
        if a.size > 100:
            assert df.rdd.getNumPartitions() > 1
    assert folders.read_npy(spark, f"{tmp_path}/none.npy") is None
    np.save(f"{tmp_path}/words.npy", np.array(["a"]))
    with pytest.raises(Exception, match="not numbers"):
        folders.read_npy(spark, f"{tmp_path}/words.npy").collect()


def results(at):
    """A folder in the layout that is read."""
    index = pd.MultiIndex.from_product([["full", "connectome"], ["both", "positive"], [0]], names=["model", "network", "run"])
    columns = pd.MultiIndex.from_product([["pearson_score", "mean_squared_error"], ["mean", "std"]])
    summary = pd.DataFrame(np.arange(16.0).reshape(4, 4), index, columns)
    (at / "permutation").mkdir()
    (at / "data_insights").mkdir()
    summary.to_csv(at / "cv_results_summary.csv")
    summary.reorder_levels(["network", "run", "model"]).to_csv(at / "permutation/cv_results_summary.csv")
    pd.DataFrame({"fold": [0, 1], "run": [0, 0], "model": "full", "network": "both", "pearson_score": [0.5, 0.25]}).to_csv(at / "cv_results_full.csv", index=False)
    pd.DataFrame({"sample_index": [0], "y_pred": [1.5], "y_true": [1]}).to_csv(at / "cv_predictions.csv", index=False)
    pd.DataFrame({"y_true": [1.0], "network_strength": [2.0]}).to_csv(at / "cv_network_strengths.csv", index=False)
    np.save(at / "stability_edges.npy", np.eye(4)[:, :, None])
    (at / "stability_edges_significance_meta.json").write_text(json.dumps({"method": "nbs", "threshold": 0.5, "networks": {"positive": {"max_null": [1, 2]}}}, indent=1))
    for name, values in (("X_names", ["a", "b"]), ("y_name", ["age"]), ("covariate_names", ["sex"])):
        pd.Series(values).to_csv(at / f"data_insights/{name}.csv", header=False, index=False)
    (at / "task_type.txt").write_text("classification\n")
    return summary


def test_a_folder_is_loaded(spark, tmp_path):
    summary = results(tmp_path)
    got = folders.load_folder(spark, str(tmp_path))
    for name in ("summary", "permutations"):
        rows = {(r.model, r.network, r.run): (r.pearson_score__mean, r.pearson_score__std, r.mean_squared_error__mean, r.mean_squared_error__std) for r in got[name].collect()}
        assert rows == {k: tuple(v) for k, v in zip(summary.index, summary.to_numpy(), strict=True)}
    assert sorted(tuple(r) for r in got["full"].collect()) == [(0, "full", "both", 0.5), (1, "full", "both", 0.25)] and "run" not in got["full"].columns
    assert got["predictions"].first().y_pred == 1.5 and got["strengths"].first().network_strength == 2
    assert got["stability"].agg(F.sum("value"), F.count("*")).first()[:] == (4.0, 16)
    assert got["significance_meta"].first().networks.positive.max_null == [1, 2]
    assert (got["features"], got["target"], got["covariates"], got["task"]) == (["a", "b"], "age", ["sex"], "classification")
    assert all(got[k] is None for k in ("significance", "p_values", "insights", "atlas"))
    (tmp_path / "none").mkdir()
    nothing = folders.load_folder(spark, str(tmp_path / "none"))
    assert nothing.pop("task") == "regression" and not any(v is not None for v in nothing.values())
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="header"):
        folders.read_summary(spark, f"{tmp_path}/bad.csv")


def test_insights_are_written_and_read(spark, people, tmp_path):
    names = prepare.variable_names(people, ["c1"], 6, target="age")
    folders.write_insights(prepare.data_summary(people, ["c1"]), names, str(tmp_path))
    got = folders.load_folder(spark, str(tmp_path))
    assert (got["features"], got["target"], got["covariates"]) == (names["features"], "age", ["c1"])
    assert got["insights"].first().n_samples == 40
