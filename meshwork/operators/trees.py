"""Regression trees and forests on strengths, grown level by level for all runs, folds, models, networks and trees at once.

A level is one aggregate: sums of weights and targets by (group, tree, node, feature, bin).  Tasks add up their rows' batches first, so
what is shuffled are cells and not rows; a node's best cut follows by cumulative sums over its bins.  No task holds a group's samples.  Trees
are maps from a node's number (1 is the root, those below node i are 2i and 2i + 1) to its cut; a row walks down them within one expression.

Features are cut into `bins` equal ranges between the least and greatest training values.  A forest's trees see each sample
as often as a Poisson draw of mean 1 says, from a hash of tree and sample: no sample is drawn on the driver, and any task draws the same.
A sample's draws are made once and go with its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import dropped, materialized

BINS, DEPTH, SEED, LEAST_GAIN = 32, 5, 42, 1e-6
#: How many rows one task adds up, where there are more than one for each core
ROWS_A_TASK = 1 << 17
#: The distribution function of a Poisson variable of mean 1
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)


def feature_names(design: DataFrame) -> list[str]:
    return sorted((c for c in design.columns if c[0] == "f" and c[1:].isdigit()), key=lambda c: int(c[1:]))


def group_keys(design: DataFrame) -> list[str]:
    return [c for c in ("run_id", "fold", "param_id", "model", "network") if c in design.columns]


def draws(tree: Column, sample: Column, seed: int = SEED) -> Column:
    """How often a tree sees a sample."""
    key = F.concat_ws(":", F.lit("tree"), F.lit(seed).cast("string"), tree.cast("string"), sample.cast("string"))
    u = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 4294967296.0
    return reduce(lambda a, p: a + (u >= p).cast("int"), POISSON, F.lit(0))


def binned(design: DataFrame, bins: int = BINS) -> DataFrame:
    """The keys, sample_id, is_test, y and bin (an array, a number for each feature) of each row; ranges are those of the training rows."""
    by, features = group_keys(design), feature_names(design)
    train = [F.when(~F.col("is_test"), F.col(f)) for f in features]
    ends = design.groupBy(*by).agg(*[g(x).alias(f"_{n}{i}") for i, x in enumerate(train) for n, g in (("lo", F.min), ("hi", F.max))])
    place = [F.coalesce(F.floor(F.try_divide((F.col(f) - F.col(f"_lo{i}")) * bins, F.col(f"_hi{i}") - F.col(f"_lo{i}"))), F.lit(0)) for i, f in enumerate(features)]
    return design.join(ends, by).select(*by, "sample_id", "is_test", "y", F.array(*[F.greatest(F.lit(0), F.least(F.lit(bins - 1), p)).cast("int") for p in place]).alias("bin"))


def _node(cuts: Column, bin_: Column, depth: int) -> Column:
    """The node that a row reaches in one tree, after `depth` steps at most."""

    def step(node: Column, _: Column) -> Column:
        cut = F.element_at(cuts, node)
        return F.when(cut.isNull(), node).otherwise(node * 2 + (F.get(bin_, cut["feature"]) > cut["cut"]).cast("int"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), step) if depth else F.lit(1)


def weighed(rows: DataFrame, trees: int = 1, seed: int = SEED, count: int = 0) -> DataFrame:
    """binned() rows with w, how often each tree sees the sample, written; with one tree each sample counts once.

    Rows are dealt out by their number (count), not by bytes: a few MB of them are work for all cores.  A group's are beside each other in a file."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, 1 + count // ROWS_A_TASK)
    dealt = rows.repartition(parts, "sample_id")
    if trees == 1:
        dealt = dealt.withColumn("w", F.array(F.lit(1)))
    else:
        drawn = F.array(*[draws(F.lit(t), F.col("sample_id"), seed) for t in range(trees)])
        dealt = dealt.join(rows.select("sample_id").distinct().withColumn("w", drawn), "sample_id")
    return materialized(dealt.sortWithinPartitions(*group_keys(rows)))


def added_up(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: (g, y, place, w, node), the last three arrays of a number for each feature, tree and tree, to a batch's sums (g, tree, node, feature, b, n, s)
    over the nodes from least on."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            place, w, node = (batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.int64) for c in ("place", "w", "node"))
            g, group = np.unique(batch.column("g").to_numpy(), return_inverse=True)
            y = batch.column("y").fill_null(0.0).to_numpy()
            row, tree = np.nonzero((w > 0) & (node >= least))
            if not len(row):
                continue
            n, at = w[row, tree], node[row, tree] - least
            shape = (len(g), w.shape[1], int(at.max()) + 1, place.shape[1], int(place.max()) + 1)
            cell = (group[row] * shape[1] + tree) * shape[2] + at
            cell = ((cell[:, None] * shape[3] + np.arange(shape[3])) * shape[4] + place[row]).reshape(-1)
            size = int(np.prod(shape))
            used = np.arange(size)
            if size > 4 * len(cell):
                used, cell = np.unique(cell, return_inverse=True)
            total = np.bincount(cell, np.repeat(n * y[row], shape[3]), len(used))
            n = np.bincount(cell, np.repeat(n, shape[3]), len(used))
            some = np.flatnonzero(n)
            group, tree, at, feature, b = np.unravel_index(used[some], shape)
            whole = [pa.array(v.astype(np.int32)) for v in (tree, at + least, feature, b)]
            yield pa.RecordBatch.from_arrays([pa.array(g[group]), *whole, pa.array(n[some].astype(np.int64)), pa.array(total[some])], ["g", "tree", "node", "feature", "b", "n", "s"])

    return of


def _sums(train: DataFrame, forest: DataFrame, by: list[str], depth: int, place: Column, least: int) -> DataFrame:
    """(g, tree, node, feature, b, n, s): sums over the nodes that rows reach after `depth` steps at most."""
    nodes = F.transform("trees", lambda t: _node(t, F.col("bin"), depth))
    seen = train.join(forest.select(*by, "g", "trees"), by).select("g", F.col("y").cast("double").alias("y"), place.alias("place"), "w", nodes.alias("node"))
    parts = seen.mapInArrow(added_up(least), "g long, tree int, node int, feature int, b int, n long, s double")
    return parts.groupBy("g", "tree", "node", "feature", "b").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def _best_cuts(sums: DataFrame) -> DataFrame:
    """(g, tree, node, feature, cut) of nodes that a cut makes better; of equal ones the first feature and bin."""
    keys = ["g", "tree", "node"]
    own = Window.partitionBy(*keys, "feature")
    sums = sums.withColumns({"n0": F.sum("n").over(own), "s0": F.sum("s").over(own), "n1": F.sum("n").over(own.orderBy("b")), "s1": F.sum("s").over(own.orderBy("b"))}).where("n1 < n0")
    left, right = F.col("s1") * F.col("s1") / F.col("n1"), (F.col("s0") - F.col("s1")) * (F.col("s0") - F.col("s1")) / (F.col("n0") - F.col("n1"))
    gain = F.round(left + right - F.col("s0") * F.col("s0") / F.col("n0"), 6)
    best = sums.groupBy(*keys).agg(F.max(F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("b")).alias("b"))).alias("x"))
    return best.where(F.col("x.gain") > LEAST_GAIN).select(*keys, (-F.col("x.f")).alias("feature"), (-F.col("x.b")).alias("cut"))


def grown(rows: DataFrame, by: list[str], trees: int = 1, depth: int = DEPTH) -> DataFrame:
    """(by, g, trees, values), written: of each group its number, its trees' cuts and their nodes' means; rows: weighed() ones."""
    train = rows.where("not is_test").drop("is_test", "sample_id")
    start = F.array(*[F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<struct<feature:int,cut:int>>"))] * trees)
    forest = materialized(train.select(*by).distinct().select(*by, F.monotonically_increasing_id().alias("g"), start.alias("trees")))
    for level in range(depth):
        cuts = _best_cuts(_sums(train, forest, by, level, F.col("bin"), 1 << level)).groupBy("g", "tree").agg(F.map_from_entries(F.collect_list(F.struct("node", F.struct("feature", "cut")))).alias("m"))
        cuts = cuts.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("tree", "m"))).alias("more"))
        both = F.transform("trees", lambda t, i: F.map_concat(t, F.coalesce(F.element_at("more", i), F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<struct<feature:int,cut:int>>")))))
        before, forest = forest, materialized(forest.join(cuts, "g", "left").select(*by, "g", F.when(F.col("more").isNull(), F.col("trees")).otherwise(both).alias("trees")))
        dropped(before)
    means = _sums(train, forest, by, depth, F.array(F.lit(0)), 1).select("g", "tree", "node", (F.col("s") / F.col("n")).alias("mean"))
    means = means.groupBy("g", "tree").agg(F.map_from_entries(F.collect_list(F.struct("node", "mean"))).alias("m")).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("tree", "m"))).alias("values"))
    before, forest = forest, materialized(forest.join(means, "g").select(*by, "g", "trees", "values"))
    dropped(before)
    return forest


def tree_predictions(design: DataFrame, trees: int = 1, depth: int = DEPTH, bins: int = BINS, seed: int = SEED) -> DataFrame:
    """Like linear_predictions, of the models connectome and full: the test rows with y_pred, the mean of the trees' means."""
    by = group_keys(design)
    design = materialized(design.where("model in ('connectome', 'full')"))
    rows = weighed(binned(design, bins), trees, seed, design.count())
    dropped(design)
    forest = grown(rows, by, trees, depth)
    each = F.transform("trees", lambda t, i: F.element_at(F.element_at("values", i), _node(t, F.col("bin"), depth)))
    mean = F.aggregate(each, F.lit(0.0), lambda a, v: a + v) / trees
    return rows.where("is_test").join(forest, by).select(*by, "sample_id", F.col("y").alias("y_true"), mean.alias("y_pred"))
