"""Mixing sources to target weights.

Hierarchical budgeting over the tree root - task family - language - source. Budgets follow the targets from the root down, a source's target
being spread over its languages as its records are; what a leaf cannot give even with its repeats is taken from its siblings (other sources in that
language and family), then from the family's other languages, before other families. Records have a size, by default 1, or their number of
tokens. A leaf of size n with a budget b gives floor(b / n) whole epochs and, of one more epoch, the longest prefix
within the b mod n that is left, each epoch being its own permutation by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graincart.functions.hashing import stable_hex
from graincart.functions.text import name_key
from graincart.llm.budget import Leaf, allocate
from graincart.llm.common import first_deliveries
from graincart.llm.pairs import language, question_texts, words
from graincart.operators.selection import hex_bucket, mark_prefix
from graincart.session import hinted

REPORT = "source_dataset string, task_family string, language string, target_permille int, records bigint, size bigint, capacity bigint, demand bigint, given bigint, falls_short boolean"


def mixable(manifest: DataFrame) -> DataFrame:
    """sample_id, source_dataset, task_type, language, text of each record; the language is that of question and answer together, "" if nothing tells it."""
    text = F.concat_ws("\n", question_texts(), F.col("target.answer_text"))
    rows = first_deliveries(manifest, source_dataset=name_key("source_dataset"), task_type=name_key("task_type"), text=text)

    def tell(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(language=[language(t, words(t))[0] for t in part["text"]])

    return rows.mapInPandas(tell, "sample_id string, source_dataset string, task_type string, text string, language string")


def budgets(records: DataFrame, targets: DataFrame, registry: DataFrame, total: int | None = None, size: str | None = None) -> DataFrame:
    """One row for each source of `targets` and language of its records: records, size, capacity (size x max_repeats), demand, budget given, falls_short.

    `size` names the column of the records' sizes; without it each counts 1. `total` is the size of the mix, by default that of the records of any
    source. Sources with a null name have no target; repeated rows of a source count with their largest share and repeats; a
    negative or null share, repeat count or size is 0. A leaf falls short if it lacks a part of its share of the total, which all
    leaves of a source do or none. Collected to the driver: the targets with their languages and counts.
    """
    of = F.lit(1) if size is None else F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0))
    said = F.col("language") if "language" in records.columns else F.lit("")
    sizes = hinted(records.groupBy("source_dataset", said.alias("language")).agg(F.count(F.lit(1)).alias("records"), F.sum(of).cast("bigint").alias("size")))
    wanted = targets.groupBy(name_key("source_dataset").alias("source_dataset")).agg(
        F.greatest(F.coalesce(F.max("target_permille"), F.lit(0)), F.lit(0)).alias("target_permille"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(0)), F.lit(0)).alias("max_repeats")
    ).where("source_dataset <> ''")
    families = registry.groupBy(name_key("source_dataset").alias("source_dataset")).agg(F.min("task_family").alias("task_family"))
    rows = wanted.join(families, "source_dataset", "left").join(sizes, "source_dataset", "left").collect()
    rows.sort(key=lambda r: (r.source_dataset, r.language or ""))
    if total is None:
        total = sizes.agg(F.sum("size")).first()[0] or 0
    whole: dict[str, int] = {}
    languages: dict[str, int] = {}
    for r in rows:
        whole[r.source_dataset] = whole.get(r.source_dataset, 0) + (r.size or 0)
        languages[r.source_dataset] = languages.get(r.source_dataset, 0) + 1
    leaves = []
    for r in rows:
        part = Fraction(r.size or 0, whole[r.source_dataset]) if whole[r.source_dataset] else Fraction(1, languages[r.source_dataset])
        leaves.append(Leaf((r.task_family or "", r.language or "", r.source_dataset), r.target_permille * part, (r.size or 0) * r.max_repeats))
    allocate(leaves, total, 1000)
    data = [(r.source_dataset, r.task_family, r.language or "", r.target_permille, r.records or 0, r.size or 0, x.capacity, x.demand, x.given, x.lacks > 0) for r, x in zip(rows, leaves)]
    return records.sparkSession.createDataFrame(data, REPORT)


def mix(records: DataFrame, report: DataFrame, seed: int = 17, size: str | None = None) -> DataFrame:
    """`records` with `copies`, the times each is used (at least once; unused records are left out)."""
    leaf = F.concat_ws("\x1f", "source_dataset", F.coalesce("language", F.lit(""))) if "language" in records.columns else F.concat("source_dataset", F.lit("\x1f"))
    plan = report.where("given > 0").select(F.concat_ws("\x1f", "source_dataset", "language").alias("_source"), "given", F.col("size").alias("_whole"))
    rows = records.withColumn("_leaf", leaf).join(hinted(plan), F.col("_leaf") == F.col("_source"))
    rows = rows.withColumn("_full", F.expr("given div _whole")).withColumn("_rest", F.expr("given % _whole")).drop("_source", "given", "_whole")
    order = stable_hex(F.col("sample_id"), F.concat(F.lit(f"{seed}:"), F.col("_full").cast("string")))
    marked = mark_prefix(rows, "_leaf", "_rest", order, "sample_id", hex_bucket(F.col("_order")), "_extra", None if size is None else F.col(size))
    return marked.withColumn("copies", F.col("_full") + F.col("_extra").cast("bigint")).where("copies > 0").drop("_leaf", "_full", "_rest", "_extra")


def shares(mixed: DataFrame, report: DataFrame, size: str | None = None) -> DataFrame:
    """Actual share of the mix by source, and by source and task type (null task type: the source as a whole)."""
    used = F.col("copies") if size is None else F.col("copies") * F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0))
    rows = mixed.groupBy("source_dataset", "task_type").agg(F.sum(used).alias("uses"), F.count(F.lit(1)).alias("records"))
    rows = hinted(rows.rollup("source_dataset", "task_type").agg(F.sum("uses").alias("uses"), F.sum("records").alias("records"), F.grouping_id().alias("_level")))
    total = rows.where("_level = 3").select("uses").first()
    total = (total and total[0]) or 0
    wanted = report.groupBy(F.col("source_dataset").alias("_source")).agg(F.max("target_permille").alias("target_permille"))
    rows = rows.where("_level < 3").join(wanted, F.col("source_dataset") == F.col("_source"), "left")
    return rows.select(
        "source_dataset", F.when(F.col("_level") == 0, F.coalesce("task_type", F.lit(""))).alias("task_type"), "uses", "records",
        F.when(F.lit(total) > 0, F.round(F.col("uses") * 1000 / F.lit(max(total, 1)), 3)).alias("actual_permille"), F.when(F.col("_level") == 1, F.col("target_permille")).alias("target_permille"),
    )
