"""Sample matching target category proportions.

Hierarchical top-down allocation over the tree source - task type - split: a cell's part of the sample is its
target, at least its minimum; unmet quota goes to the siblings (other splits of the same source and task) first,
then to the cousins (other tasks of the source), then to all. At a leaf the records come by their dense rank in a
seeded permutation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graincart.functions.hashing import stable_hex
from graincart.functions.text import name_key, normalize_split_name
from graincart.llm.budget import Leaf, allocate
from graincart.operators.selection import hex_bucket, prefix
from graincart.session import hinted

CELL = ["source_dataset", "task_type", "split"]
REPORT = "source_dataset string, task_type string, split string, target_permille int, min_records int, records bigint, demand bigint, given bigint, unmet boolean"


def plan_sample(records: DataFrame, targets: DataFrame, size: int | None = None) -> DataFrame:
    """One row for each cell of `targets`: what it holds, should give, gives, and whether it cannot meet its target.

    `size` is that of the sample, by default a tenth of the records, rounded down. A cell is unmet if the allocation finds it below its minimum,
    or lacking a part of its share of the size. Repeated cells count with their largest figures, null figures as 0.
    Collected to the driver: the cells of `targets`.
    """
    counts = records.groupBy(*CELL).agg(F.count(F.lit(1)).alias("records"))
    wanted = targets.groupBy(name_key("source_dataset").alias("source_dataset"), name_key("task_type").alias("task_type"), normalize_split_name("split").alias("split")).agg(
        F.greatest(F.coalesce(F.max("target_permille"), F.lit(0)), F.lit(0)).alias("target_permille"), F.greatest(F.coalesce(F.max("min_records"), F.lit(0)), F.lit(0)).alias("min_records")
    )
    rows = wanted.join(counts, CELL, "left").collect()
    rows.sort(key=lambda r: (r.source_dataset, r.task_type, r.split))
    if size is None:
        size = records.count() // 10
    leaves = [Leaf((r.source_dataset, r.task_type, r.split), r.target_permille, r.records or 0, r.min_records) for r in rows]
    allocate(leaves, size, 1000)
    data = []
    for r, x in zip(rows, leaves):
        data.append((r.source_dataset, r.task_type, r.split, r.target_permille, r.min_records, x.capacity, x.demand, x.given, x.below or x.lacks > 0))
    return records.sparkSession.createDataFrame(data, REPORT)


def draw(records: DataFrame, report: DataFrame, seed: int = 29) -> DataFrame:
    """The sampled rows of `records`, as many of each cell as the report gives it."""
    cell = F.concat_ws("\x1f", *CELL)
    plan = hinted(report.where("given > 0").select(cell.alias("_key"), F.col("given").alias("_quota")))
    rows = records.withColumn("_cell", cell).join(plan, F.col("_cell") == F.col("_key")).drop("_key")
    return prefix(rows, "_cell", "_quota", stable_hex(F.col("sample_id"), str(seed)), "sample_id", hex_bucket(F.col("_order"))).drop("_cell", "_quota")
