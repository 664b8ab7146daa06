"""The non-linear models of connectome and full designs, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame

from .additive import additive_predictions
from .trees import tree_predictions

METHODS: dict[str, Callable[[DataFrame], DataFrame]] = {"tree": tree_predictions, "forest": partial(tree_predictions, trees=50), "additive": additive_predictions}


def nonlinear_predictions(design: DataFrame, method: str | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Like linear_predictions, for regression, of the models connectome and full; method: one of METHODS, or any such function of a design."""
    return (METHODS[method] if isinstance(method, str) else method)(design)
