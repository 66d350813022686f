"""Evaluation of predictions: tasks, bundles and the table of results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graincart.operators import manifests as M
from graincart.operators.metrics import local_bundle, track_bundle
from graincart.operators.sampling import first_rows

#: Tasks by name, each with its bundle. A new task is added here.
TASKS: dict[str, Callable[[DataFrame, list[str]], DataFrame]] = {"local_holdout": local_bundle, "mirage_mmst": track_bundle, "mirage_mmmt": track_bundle}


def predictions_for(rows: DataFrame, mode: str, given: DataFrame | None = None) -> DataFrame:
    """sample_id, prediction: the targets themselves (oracle), the last message (echo), or given ones (model)."""
    if mode == "oracle":
        return M.oracle_predictions(rows)
    if mode == "model":
        if given is None:
            raise ValueError("mode model needs predictions")
        return given.select("sample_id", "prediction")
    return M.echo_predictions(rows)


def run_task(name: str, rows: DataFrame, mode: str, given: DataFrame | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(metrics in one row, prediction rows) of a task over the first `most` rows."""
    rows = first_rows(rows, most)
    predictions = predictions_for(rows, mode, given)
    joined = rows.join(predictions, "sample_id").withColumn("task", F.lit(name))
    return TASKS[name](joined, ["task"]), M.prediction_rows(rows, predictions)


def results_table(metrics: Sequence[DataFrame]) -> DataFrame:
    """The metrics of several tasks or runs one below the other; a metric that a task lacks is null."""
    table = metrics[0]
    for more in metrics[1:]:
        table = table.unionByName(more, allowMissingColumns=True)
    return table
