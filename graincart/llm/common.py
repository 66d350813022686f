"""What the operators for training data share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graincart.functions.text import name_key, normalize_split_name
from graincart.session import hinted


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def first_deliveries(manifest: DataFrame, **columns: Column) -> DataFrame:
    """One row (`sample_id` and the given columns) for each record: its first delivery, by `ord`; of several at one `ord`, the smallest row.

    The ids alone are counted and the repeated ones written out. Records delivered once pass on from the scan, without a shuffle where the repeated
    ids are few enough to be broadcast; only rows of repeated ids are aggregated. Rows without a `sample_id` are no
    records; a null `ord` comes last.
    """
    order = F.coalesce(F.col("ord"), F.lit(2**63 - 1))
    rows = manifest.where(F.col("sample_id").isNotNull())
    repeats = rows.select("sample_id", order.alias("_ord")).groupBy("sample_id").agg(F.count(F.lit(1)).alias("_n"), F.min("_ord").alias("_first")).where("_n > 1").select(F.col("sample_id").alias("_id"), "_first")
    repeats = hinted(repeats)
    made = [c.alias(n) for n, c in columns.items()]
    once = rows.join(repeats, F.col("sample_id") == F.col("_id"), "left_anti").select("sample_id", *made)
    again = rows.join(repeats, (F.col("sample_id") == F.col("_id")) & (order == F.col("_first")), "left_semi").select("sample_id", F.struct(*made).alias("_row"))
    again = again.groupBy("sample_id").agg(F.min("_row").alias("_row"))
    return once.unionByName(again.select("sample_id", *[F.col("_row")[n].alias(n) for n in columns]))


def cells(manifest: DataFrame) -> DataFrame:
    """sample_id, source_dataset, task_type and split of each record, names in their canonical form."""
    return first_deliveries(manifest, source_dataset=name_key("source_dataset"), task_type=name_key("task_type"), split=normalize_split_name("split"))


def letters(text: Column) -> Column:
    """Letters and digits only, in lower case: the form in which paths and ids compare."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", "")
