"""What figures show, as tables of bounded size: cells and points of scatter plots, histograms by class, quantiles, parameters.

None has a row for each sample: rows are counted in cells, and what is drawn as points is a sample of a stated size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

# of the sketch: at most a group's rows / ACCURACY lie between a quantile and what the sketch takes for it
ACCURACY = 10000


def _bin(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equally wide bins from lo to hi, the last one closed; 0 where all values are equal."""
    return F.least(F.coalesce(F.floor((value - lo) * bins / F.nullif(hi - lo, F.lit(0.0))), F.lit(0)), F.lit(bins - 1)).cast("int")


def _number(column: str) -> Column:
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(by, n, quantiles): exact quantiles in the order of shares, between two values in proportion, as an array.

    A mergeable sketch brackets each quantile; rows within a bracket are counted by value, those between brackets together, and a
    running count finds the ranks.  What is sorted for a group is its brackets' distinct values, not its rows.  Missing values and NaN
    don't count; a group without numbers has no row.
    """
    order = sorted(shares)
    rows = df.select(*by, _number(value).alias("_v")).where("_v is not null")
    ends = [min(1.0, max(0.0, p + side * 4.0 / ACCURACY)) for p in order for side in (-1, 1)]
    sketch = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx("_v", ends, ACCURACY).alias("_e"))
    # of a small group everything is within
    sketch = sketch.withColumn("_e", F.when(F.col("_n") > ACCURACY, F.col("_e")))
    joined = _joined(rows, sketch, by)
    within = reduce(lambda a, b: a | b, [F.col("_v").between(F.get("_e", F.lit(2 * i)), F.get("_e", F.lit(2 * i + 1))) for i in range(len(order))])
    inside = F.coalesce(within, F.lit(True))
    above = sum((F.coalesce((F.col("_v") > F.get("_e", F.lit(2 * i + 1))).cast("int"), F.lit(0)) for i in range(len(order))), F.lit(0))
    counts = joined.groupBy(*by, above.alias("_zone"), F.when(inside, F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))
    upto = Window.partitionBy(*by).orderBy("_zone", F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_upto", F.sum("_c").over(upto))
    place = lambda p: F.lit(p) * (F.col("_n") - 1)
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_v")))
    found = counts.groupBy(*by).agg(F.first("_n").alias("n"), *[f.alias(f"_{i}{side}") for i, p in enumerate(shares) for side, f in (("a", at(F.floor(place(p)))), ("b", at(F.ceil(place(p)))))])
    part = [F.lit(p) * (F.col("n") - 1) - F.floor(F.lit(p) * (F.col("n") - 1)) for p in shares]
    return found.select(*by, "n", F.array(*[F.col(f"_{i}a") + (F.col(f"_{i}b") - F.col(f"_{i}a")) * part[i] for i in range(len(shares))]).alias("quantiles"))


def _joined(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """rows with their group's columns; groups whose key is missing are groups as well."""
    if not by:
        return rows.crossJoin(F.broadcast(groups))  # one row
    named = groups.withColumnsRenamed({c: f"_by_{c}" for c in by})
    return rows.join(named, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])).drop(*[f"_by_{c}" for c in by])


def cells(df: DataFrame, by: list[str], x: str, y: str, bins: int = 20) -> DataFrame:
    """(by, x_bin, y_bin, n, share): how many rows, and what part of the group's, lie in each cell of a facet's grid; cells without rows have none.

    A facet's grid goes from its least to its greatest values.  Rows without a number in x or y don't count.
    """
    rows = df.select(*by, _number(x).alias("_x"), _number(y).alias("_y")).where("_x is not null and _y is not null")
    ends = rows.groupBy(*by).agg(F.count("*").alias("_n"), *[f(c).alias(f"{c}_{f.__name__}") for c in ("_x", "_y") for f in (F.min, F.max)])
    at = [_bin(F.col(c), F.col(f"{c}_min"), F.col(f"{c}_max"), bins).alias(f"{c[1:]}_bin") for c in ("_x", "_y")]
    return _joined(rows, ends, by).groupBy(*by, *at).agg(F.count("*").alias("n"), (F.count("*") / F.first("_n")).alias("share"))


def points(df: DataFrame, by: list[str], key: str, k: int = 500, seed: int = 42) -> DataFrame:
    """k rows of each group to draw as points: those whose hashed keys are least, the same ones on every run; all of a group with fewer."""
    draw = F.xxhash64(F.lit(seed), F.col(key))
    return df.withColumn("_draw", F.row_number().over(Window.partitionBy(*by).orderBy(draw, key))).where(F.col("_draw") <= k).drop("_draw")


def histogram_by(df: DataFrame, column: str, hue: str, bins: int = 20, by: list[str] | None = None, ends: tuple[float, float] | None = None) -> DataFrame:
    """(by, hue, bin, n): how a number is distributed in each class, in bins that all classes share; ends: the first and last one's, else
    the least and greatest value.  A missing class is a class."""
    by = by or []
    rows = df.select(*by, hue, _number(column).alias("_v")).where("_v is not null")
    if ends:
        return rows.groupBy(*by, hue, _bin(F.col("_v"), F.lit(ends[0]), F.lit(ends[1]), bins).alias("bin")).agg(F.count("*").alias("n"))
    wide = rows.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    return _joined(rows, wide, by).groupBy(*by, hue, _bin(F.col("_v"), F.col("_lo"), F.col("_hi"), bins).alias("bin")).agg(F.count("*").alias("n"))


def shares(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, share): a crosstab with each cell's part of its row."""
    n = df.groupBy(a, b).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(a)))


def pair_plot(df: DataFrame, columns: list[str], bins: int = 20) -> DataFrame:
    """(a, b, x, y, n): the counts behind each panel of a pair plot, of all panels in one pass.

    x and y are bins (from 0) of numbers and levels of other columns, as text; a panel of a column with itself has y null.  Two numbers
    give cells, a number and a class a histogram by class, two classes a crosstab.  Rows that miss one of both don't count.
    """
    numbers = [c for c in columns if isinstance(df.schema[c].dataType, NumericType)]
    rows = df.select(*[_number(c).alias(c) if c in numbers else F.col(c).cast("string").alias(c) for c in columns])
    if numbers:
        rows = rows.crossJoin(F.broadcast(rows.agg(*[f(c).alias(f"_{c}_{f.__name__}") for c in numbers for f in (F.min, F.max)])))
    # a missing number has no bin
    level = {c: F.when(F.col(c).isNotNull(), _bin(F.col(c), F.col(f"_{c}_min"), F.col(f"_{c}_max"), bins).cast("string")) if c in numbers else F.col(c) for c in columns}
    panels = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), level[a].alias("x"), (level[b] if a != b else F.lit(None).cast("string")).alias("y")) for i, a in enumerate(columns) for b in columns[i:]]
    long = rows.select(F.explode(F.array(*panels)).alias("p")).select("p.*")
    return long.where(F.col("x").isNotNull() & (F.col("y").isNotNull() | (F.col("a") == F.col("b")))).groupBy("a", "b", "x", "y").agg(F.count("*").alias("n"))


def named_parameters(choice: DataFrame, grid: list[tuple[str, str | None, float]]) -> DataFrame:
    """choice (run_id, fold, param_id, ...) with params: a map of the chosen method, correction and threshold, as text."""
    text = lambda v: F.lit("none" if v is None else str(v))
    each = F.array(*[F.create_map(*[x for k, v in zip(("method", "correction", "threshold"), p, strict=True) for x in (F.lit(k), text(v))]) for p in grid])
    return choice.withColumn("params", F.get(each, F.col("param_id")))


def parameter_table(named: DataFrame) -> DataFrame:
    """(fold, params) of the observed run: a line for each parameter, by name."""
    lines = F.transform(F.array_sort(F.map_entries("params")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return named.where("run_id = 0").select("fold", F.array_join(lines, "\n").alias("params"))


def parameter_summary(named: DataFrame) -> DataFrame:
    """What the observed run's folds chose, a row for each parameter (any names): its count, and of numbers mean, std, least, lower, median, upper, greatest, of text
    the number of different values, the most frequent one (of equals the first) and its count.  A parameter is a number if all its values are."""
    long = named.where("run_id = 0").select(F.explode("params").alias("name", "value")).where("value is not null").withColumn("number", F.expr("try_cast(value as double)"))
    kinds = long.groupBy("name").agg(F.count("*").alias("n"), F.bool_and(F.col("number").isNotNull()).alias("numeric"), F.avg("number").alias("mean"), F.stddev_samp("number").alias("std"), F.count_distinct("value").alias("n_values"))
    often = long.groupBy("name", "value").agg(F.count("*").alias("c")).groupBy("name").agg(F.min(F.struct((-F.col("c")).alias("c"), F.col("value"))).alias("_t"))
    q = quantiles(long, ["name"], "number", [0.0, 0.25, 0.5, 0.75, 1.0]).drop("n")
    number, text = lambda c: F.when(F.col("numeric"), c), lambda c: F.when(~F.col("numeric"), c)
    places = [number(F.col("quantiles")[i]).alias(c) for i, c in enumerate(("least", "lower", "median", "upper", "greatest"))]
    all_ = kinds.join(often, "name").join(q, "name", "left")
    return all_.select("name", "n", number(F.col("mean")).alias("mean"), number(F.col("std")).alias("std"), *places, text(F.col("n_values")).alias("n_values"), text(F.col("_t.value")).alias("top"), text(-F.col("_t.c")).alias("n_top"))


def predictions_facets(predictions: DataFrame, model: str = "connectome", bins: int = 20) -> DataFrame:
    """Cells of predicted against true targets, a facet for each network of the observed run's model (covariates have one facet)."""
    rows = predictions.where("run_id = 0").where(F.col("model") == model)
    return cells(rows if model != "covariates" else rows.where("network = 'both'"), ["model", "network"], "y_true", "y_pred", bins)


def strengths_long(strengths: DataFrame) -> DataFrame:
    """(sample_id, fold, model, network, strength, y_true) of the observed run: strengths as they are (connectome) and without what covariates
    explain (residuals)."""
    kinds = [F.struct(F.lit(m).alias("model"), F.lit(n).alias("network"), F.col(c).alias("strength")) for m, n, c in (("connectome", "positive", "pos"), ("connectome", "negative", "neg"), ("residuals", "positive", "pos_res"), ("residuals", "negative", "neg_res"))]
    return strengths.where("run_id = 0").select("sample_id", "fold", "y_true", F.explode(F.array(*kinds)).alias("_k")).select("sample_id", "fold", "_k.*", "y_true")


def strengths_facets(strengths: DataFrame, bins: int = 20) -> DataFrame:
    """Cells of targets against strengths, a facet for each of two models and networks."""
    return cells(strengths_long(strengths), ["model", "network"], "strength", "y_true", bins)


def class_probabilities(predictions: DataFrame, model: str = "connectome", bins: int = 20) -> DataFrame:
    """(network, y_true, bin, n): how the observed run's predicted probabilities are distributed in each class, in bins of 0 to 1."""
    return histogram_by(predictions.where("run_id = 0").where(F.col("model") == model), "y_pred", "y_true", bins, ["network"], (0.0, 1.0))
