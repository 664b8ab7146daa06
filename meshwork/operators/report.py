"""Report tables: relational forms of what figures and text show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .figures import quantiles

# Display order
MODEL_ORDER = ("covariates", "connectome", "full", "residuals", "increment")
NETWORK_ORDER = ("positive", "negative", "both")


def _order(column: str, order: tuple[str, ...]) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(column)), F.lit(len(order) + 1))


def edge_table(edges: DataFrame, atlas: DataFrame | None = None) -> DataFrame:
    """(region_a, region_b, stability, p_value) of edges (node_i < node_j, stability, p_value) with a stability above 0; a
    is the node of the larger index."""
    rows = edges.where(F.col("stability") > 0)
    if atlas is None:
        name = lambda c: F.concat(F.lit("Region "), F.col(c).cast("string"))
        rows = rows.select(name("node_j").alias("region_a"), name("node_i").alias("region_b"), "stability", "p_value")
    else:
        a, b = (F.broadcast(atlas.select(F.col("node_id").alias(c), F.col("region").alias(r))) for c, r in (("node_j", "region_a"), ("node_i", "region_b")))
        rows = rows.join(a, "node_j").join(b, "node_i").select("region_a", "region_b", "stability", "p_value")
    return rows.withColumns({c: F.round(c, 5) for c in ("stability", "p_value")}).orderBy("p_value", F.desc("stability"), "region_a", "region_b")


def significant_edges(edges: DataFrame, alpha: float = 0.05) -> DataFrame:
    return edges.where(F.col("p_value") < alpha)


def combined(summary: DataFrame, p_values: DataFrame) -> DataFrame:
    """summary and p-values side by side; p-values' columns get __p."""
    p = p_values.withColumnsRenamed({c: f"{c}__p" for c in p_values.columns if c not in ("model", "network")})
    return summary.join(p, ["model", "network"], "full_outer")


def apa(mean: Column, std: Column) -> Column:
    return F.format_string("%.3f [%.3f]", mean, std)


def apa_p(p: Column) -> Column:
    return F.when(p < 0.001, "<0.001**").when(p < 0.01, F.concat(F.format_string("%.3f", p), F.lit("**"))).when(p < 0.05, F.concat(F.format_string("%.3f", p), F.lit("*"))).otherwise(F.format_string("%.3f", p))


def in_order(table: DataFrame) -> DataFrame:
    """table with the row numbers of the display order."""
    return table.withColumn("position", _order("model", MODEL_ORDER) * 10 + _order("network", NETWORK_ORDER)).orderBy("position")


def signed_stability(stability: DataFrame) -> DataFrame:
    """(node_i, node_j, signed): positive less negative stability."""
    signed = F.when(F.col("network") == "positive", F.col("stability")).otherwise(-F.col("stability"))
    return stability.groupBy("node_i", "node_j").agg(F.sum(signed).alias("signed"))


def shown_edges(edges: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Edges to draw: of each network the significant ones, or all stable ones if none is."""
    stable = edges.where(F.col("stability") > 1e-9).withColumn("_keep", F.coalesce(F.col("p_value") < alpha, F.lit(False)))
    return stable.withColumn("_any", F.max("_keep").over(Window.partitionBy("network"))).where(F.col("_keep") | ~F.col("_any")).drop("_keep", "_any")


def by_group(signed: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_a <= group_b, mean, n) of signed stability between groups; groups: node_id, group."""
    a, b = (F.broadcast(groups.select(F.col("node_id").alias(c), F.col("group").alias(g))) for c, g in (("node_i", "_a"), ("node_j", "_b")))
    rows = signed.join(a, "node_i").join(b, "node_j")
    return rows.groupBy(F.least("_a", "_b").alias("group_a"), F.greatest("_a", "_b").alias("group_b")).agg(F.avg("signed").alias("mean"), F.count("*").alias("n"))


def chord_groups(grouped: DataFrame) -> DataFrame:
    """Groups with any weight: (group, weight)."""
    ends = grouped.select(F.col("group_a").alias("group"), F.abs("mean").alias("w")).unionByName(grouped.where("group_a <> group_b").select(F.col("group_b").alias("group"), F.abs("mean").alias("w")))
    return ends.groupBy("group").agg(F.sum("w").alias("weight")).where(F.col("weight") > 1e-9)


def node_degrees(edges: DataFrame, k: int = 15) -> DataFrame:
    """(node, n_positive, n_negative, total) of the k nodes with most edges."""
    ends = edges.select("network", F.explode(F.array("node_i", "node_j")).alias("node"))
    count = lambda network: F.count_if(F.col("network") == network)
    degrees = ends.groupBy("node").agg(count("positive").alias("n_positive"), count("negative").alias("n_negative"), F.count("*").alias("total"))
    return degrees.orderBy(F.desc("total"), F.desc("node")).limit(k)


def matrix_order(groups: DataFrame) -> DataFrame:
    """(node_id, group, place, starts_block): nodes in the order of groups; groups has a row for each node of a network."""
    w = Window.orderBy("group", "node_id")
    return groups.select("node_id", "group", (F.row_number().over(w) - 1).alias("place"), F.coalesce(F.lag("group").over(w) != F.col("group"), F.lit(True)).alias("starts_block"))


def melted(table: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return table.unpivot(keys, metrics, "metric", "value")


def boxes(long: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """(by, least, lower, median, upper, greatest): what box plots show, exactly (see quantiles)."""
    found = quantiles(long, by, value, [0.0, 0.25, 0.5, 0.75, 1.0])
    return found.select(*by, *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("least", "lower", "median", "upper", "greatest"))])


def fit_lines(df: DataFrame, by: list[str], y: str = "y_true", x: str = "y_pred") -> DataFrame:
    """What a scatter plot is annotated with: n, r (0 for a constant), line, ends."""
    n = F.count("*")
    cov = F.covar_pop(x, y)
    r = F.coalesce(F.try_divide(cov, F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))
    return df.groupBy(*by).agg(n.alias("n"), r.alias("r"), F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"), F.coalesce(F.regr_intercept(y, x), F.avg(y)).alias("intercept"), F.min(x).alias("x_min"), F.max(x).alias("x_max"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def pair_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of each two columns, from one pass of sums."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0)).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs])).alias("t")).select("t.*")


def method_text(meta: dict) -> str:
    """One sentence on how edges were judged."""
    if meta.get("method") == "tfce":
        return f"Threshold-free cluster enhancement over {meta['n_permutations']} permutations"
    return f"Network-based statistic ({meta['component_stat']}) at stability {meta['threshold']:g} over {meta['n_permutations']} permutations"


def null_histogram(maxima: DataFrame, observed: DataFrame) -> DataFrame:
    """(network, bin, lo, hi, n, observed) of the permuted runs' greatest statistics (network, run_id, top): as many equally wide bins as there are distinct values,
    10 at least and 40 at most; observed: network, statistic."""
    seen = observed.groupBy("network").agg(F.max("statistic").cast("double").alias("observed"))
    ends = maxima.groupBy("network").agg(F.min("top").alias("_lo"), F.max("top").alias("_hi"), F.least(F.lit(40), F.greatest(F.lit(10), F.count_distinct("top"))).alias("_bins"))
    width = (F.col("_hi") - F.col("_lo")) / F.col("_bins")
    at = F.least(F.coalesce(F.floor((F.col("top") - F.col("_lo")) / F.nullif(width, F.lit(0.0))), F.lit(0)), F.col("_bins") - 1).cast("int")
    counts = maxima.join(F.broadcast(ends), "network").groupBy("network", at.alias("bin"), (F.col("_lo") + at * width).alias("lo"), (F.col("_lo") + (at + 1) * width).alias("hi")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(seen), "network", "left").withColumn("observed", F.coalesce("observed", F.lit(0.0)))


def placed_edges(edges: DataFrame, atlas: DataFrame, value: str = "stability", least: float = 1e-9) -> DataFrame:
    """edges (node_i, node_j, value and others) whose value isn't 0, with the coordinates of both ends; atlas: node_id, x, y, z."""
    ends = [F.broadcast(atlas.select(F.col("node_id").alias(f"node_{k}"), *[F.col(c).alias(f"{c}_{k}") for c in "xyz"])) for k in "ij"]
    return edges.where(F.abs(value) > least).join(ends[0], "node_i").join(ends[1], "node_j")


def verdict(summary: DataFrame, p_values: DataFrame, stable: DataFrame, task: str = "regression") -> DataFrame:
    """One row: the headline metric of the connectome model on both networks, its permutation p-value as text, and how many edges are stable."""
    metric = "pearson_score__mean" if task == "regression" else "roc_auc__mean"
    own = "model = 'connectome' and network = 'both'"
    value = summary.where("run_id = 0").where(own).select(F.lit(metric).alias("metric"), F.col(metric).alias("value"))
    p = p_values.where(own).select(apa_p(F.col(metric)).alias("p"), (F.col(metric) < 0.05).alias("significant"))
    return value.crossJoin(F.broadcast(p)).crossJoin(F.broadcast(stable.agg(F.count("*").alias("n_stable_edges"))))


def html(title: str, sections: dict[str, DataFrame], most_rows: int = 200) -> str:
    """A self-contained page of small tables; of longer ones, the first rows, and how many more there are."""
    from html import escape

    out = [f"<!doctype html><meta charset='utf-8'><title>{escape(title)}</title><h1>{escape(title)}</h1>"]
    for name, df in sections.items():
        rows = df.limit(most_rows).collect()
        head = "".join(f"<th>{escape(c)}" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{escape(str(v))}" for v in r) for r in rows)
        more = df.count() - len(rows) if len(rows) == most_rows else 0
        out.append(f"<h2>{escape(name)}</h2><table><tr>{head}{body}</table>" + (f"<p>and {more} more rows</p>" if more > 0 else ""))
    return "".join(out)
