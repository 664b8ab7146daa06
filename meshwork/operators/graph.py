"""Components of selected edges: network-based statistic and threshold-free cluster enhancement.

Runs, networks and heights are keys of one iteration, so all their graphs are labelled together: labels spread to neighbours' least
label and then to the label's own label, which halves distances; a round is two aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import dropped, materialized


def components(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, component) of the nodes of edges (by, node_i, node_j): the least node it is connected with."""
    both = materialized(edges.select(*by, F.col("node_i").alias("node"), F.col("node_j").alias("other")).unionByName(edges.select(*by, F.col("node_j").alias("node"), F.col("node_i").alias("other"))).distinct())
    held = label = materialized(both.groupBy(*by, "node").agg(F.least(F.first("node"), F.min("other")).alias("component")))
    while True:
        near = both.join(label.withColumnRenamed("node", "other"), [*by, "other"]).groupBy(*by, "node").agg(F.min("component").alias("_near"))
        jump = label.select(*by, F.col("node").alias("component"), F.col("component").alias("_jump"))
        new = label.join(near, [*by, "node"], "left").join(jump, [*by, "component"], "left")
        least = F.least("component", "_near", "_jump")
        new = materialized(new.select(*by, "node", "component", least.alias("new")))
        changed = bool(new.where("new < component").take(1))
        label = new.select(*by, "node", F.col("new").alias("component"))
        dropped(held)
        held = new
        if not changed:
            dropped(both)
            return label


def component_sizes(edges: DataFrame, by: list[str], value: Column) -> tuple[DataFrame, DataFrame]:
    """edges with their component, and (by, component, n_edges, n_nodes, statistic): statistic sums value over edges."""
    label = components(edges, by)
    named = edges.join(label.withColumnRenamed("node", "node_i"), [*by, "node_i"])
    nodes = label.groupBy(*by, "component").agg(F.count("*").alias("n_nodes"))
    sizes = named.groupBy(*by, "component").agg(F.count("*").alias("n_edges"), F.sum(value).alias("statistic"))
    return named, sizes.join(nodes, [*by, "component"])


def _exceeding(observed: DataFrame, null: DataFrame, statistic: str, keys: list[str]) -> DataFrame:
    """observed with p: the share of permuted runs whose maximum is at least the statistic, the observed run among them; null (keys, run_id, top)."""
    tops = null.groupBy(*keys).agg(F.collect_list("top").alias("_tops"))  # a number for each permuted run
    count = F.size(F.filter("_tops", lambda t: t >= F.col(statistic) - 1e-12))
    return observed.join(tops, keys, "left").withColumn("p_value", (F.coalesce(count, F.lit(0)) + 1) / (F.coalesce(F.size("_tops"), F.lit(0)) + 1)).drop("_tops")


def _maxima(stats: DataFrame, runs: DataFrame, value: str) -> DataFrame:
    """(network, run_id, top) of all permuted runs and networks; 0 where a run has none."""
    networks = runs.where("run_id > 0").crossJoin(F.broadcast(runs.sparkSession.createDataFrame([("positive",), ("negative",)], "network string")))
    tops = stats.groupBy("run_id", "network").agg(F.max(value).alias("top"))
    return networks.join(tops, ["run_id", "network"], "left").select("network", "run_id", F.coalesce(F.col("top").cast("double"), F.lit(0.0)).alias("top"))


def nbs(stability: DataFrame, runs: DataFrame, threshold: float, n_folds: int, statistic: str = "extent", alpha: float = 0.05) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Network-based statistic: edges (network, node_i, node_j, p_value) of run 0, its components with p-values, and each
    network's critical value.

    stability: run_id, network, node_i, node_j, n_selected, stability; runs: run_id of all runs.  Folds are counted against the threshold.
    """
    if statistic not in ("extent", "intensity"):
        raise ValueError(f"unknown statistic {statistic}")
    import math

    kept = stability.where(F.col("n_selected") >= math.ceil(threshold * n_folds - 1e-9))
    value = F.lit(1.0) if statistic == "extent" else F.col("stability") - threshold
    named, sizes = component_sizes(kept, ["run_id", "network"], value)
    null = _maxima(sizes, runs, "statistic")
    found = _exceeding(sizes.where("run_id = 0").drop("run_id"), null, "statistic", ["network"])
    found = found.withColumn("significant", F.col("p_value") < alpha)
    edges = named.where("run_id = 0").select("network", "node_i", "node_j", "component").join(found.select("network", "component", "p_value"), ["network", "component"])
    critical = null.groupBy("network").agg(F.expr(f"percentile(top, {1 - alpha})").alias("critical_value"))
    return edges.select("network", "node_i", "node_j", "p_value"), found, critical


def null_maxima(stability: DataFrame, runs: DataFrame, threshold: float, n_folds: int) -> DataFrame:
    """(network, run_id, top): each permuted run's most edges in a component of nbs()."""
    import math

    kept = stability.where(F.col("n_selected") >= math.ceil(threshold * n_folds - 1e-9))
    return _maxima(component_sizes(kept, ["run_id", "network"], F.lit(1.0))[1], runs, "statistic")


def nbs_diagnostics(edges: DataFrame, found: DataFrame, critical: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(network, critical_value, observed_max, n_significant_edges, largest_component_edges, n_significant_components) of what nbs() returns; 0 where a network
    has no component."""
    own = found.groupBy("network").agg(F.max("statistic").cast("double").alias("observed_max"), F.max("n_edges").alias("largest_component_edges"), F.count_if("significant").alias("n_significant_components"))
    count = edges.where(F.col("p_value") < alpha).groupBy("network").agg(F.count("*").alias("n_significant_edges"))
    out = critical.join(own, "network", "left").join(count, "network", "left").fillna(0, ["n_significant_edges", "largest_component_edges", "n_significant_components"])
    return out.select("network", "critical_value", F.coalesce("observed_max", F.lit(0.0)).alias("observed_max"), "n_significant_edges", "largest_component_edges", "n_significant_components")


def tfce(stability: DataFrame, n_steps: int = 10, e: float = 0.5, h: float = 2.0) -> DataFrame:
    """(run_id, network, node_i, node_j, score): at each height, an edge of at least that stability adds extent^e * height^h * step."""
    step = 1.0 / n_steps
    heights = F.transform(F.sequence(F.lit(1), F.lit(n_steps)), lambda i: i)
    rows = stability.select("run_id", "network", "node_i", "node_j", "stability", F.explode(heights).alias("step")).where(F.col("stability") >= F.col("step") * step - step * 1e-6)
    named, sizes = component_sizes(rows, ["run_id", "network", "step"], F.lit(1.0))
    both = named.join(sizes.select("run_id", "network", "step", "component", "n_edges"), ["run_id", "network", "step", "component"])
    return both.groupBy("run_id", "network", "node_i", "node_j").agg(F.sum(F.pow(F.col("n_edges").cast("double"), e) * F.pow(F.col("step") * step, h) * step).alias("score"))


def tfce_p(scores: DataFrame, runs: DataFrame) -> DataFrame:
    """(network, node_i, node_j, score, p_value) of run 0."""
    return _exceeding(scores.where("run_id = 0 and score > 0").drop("run_id"), _maxima(scores, runs, "score"), "score", ["network"])


def tfce_diagnostics(scores: DataFrame, edges: DataFrame, runs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(network, critical_value, observed_max, n_significant_edges) of scores of all runs and the edges of tfce_p(); 0 where a network has no edge."""
    critical = _maxima(scores, runs, "score").groupBy("network").agg(F.expr(f"percentile(top, {1 - alpha})").alias("critical_value"))
    own = edges.groupBy("network").agg(F.max("score").alias("observed_max"), F.count_if(F.col("p_value") < alpha).alias("n_significant_edges"))
    return critical.join(own, "network", "left").select("network", "critical_value", F.coalesce("observed_max", F.lit(0.0)).alias("observed_max"), F.coalesce("n_significant_edges", F.lit(0)).alias("n_significant_edges"))
