"""Exact prefixes of orders within groups, without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graincart.session import hinted

BUCKETS = 4096


def hash_bucket(order: Column, buckets: int = BUCKETS) -> Column:
    """A bucket from the middle bits of a 64-bit hash."""
    return F.pmod(F.shiftrightunsigned(order, 40), F.lit(buckets)).cast("int")


def hex_bucket(order: Column) -> Column:
    """One of 4096 buckets from the first digits of a hash in hex; it follows the order of the hashes."""
    return F.conv(F.substring(order, 1, 3), 16, 10).cast("int")


def position_bucket(df: DataFrame, order: str, buckets: int = BUCKETS) -> Column:
    """A bucket from a row's position, by equal widths between the lowest and the highest one (looked up here); it follows the positions."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    low, width = low or 0, max(1, (high or 0) - (low or 0) + 1)
    return F.floor((F.col(order) - F.lit(low)).cast("double") * buckets / F.lit(width)).cast("int")


def mark_prefix(df: DataFrame, group: str, quota: str, order: Column, tie: str, bucket: Column, name: str = "taken", size: Column | None = None, groups: int | None = None) -> DataFrame:
    """`df` with a boolean: whether a row is in the longest prefix of its group by (`bucket`, `order`, `tie`) whose sizes sum up to `quota` at most.

    Without `size` each row counts 1, so these are the first `quota` rows; a null or negative size counts 0. `bucket` is a small
    integer over which a group's rows spread evenly, `tie` a unique column without nulls. A group's quota stands in each of its
    rows; null or less than one takes nothing. Rows are counted by group and bucket, and only the bucket that the quota cuts is
    ranked row by row, so that a group with a third of all rows gives a task no more than its share of one bucket. The last row
    taken of each group then marks the rest; these, one a group, are broadcast if they are few, which `groups` may tell. The names `_order`, `_b` and
    `_size` are used and dropped.
    """
    rows = df.withColumn("_order", order).withColumn("_b", bucket).withColumn("_size", F.lit(1) if size is None else F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)))
    slim = rows.select(F.col(group).alias("_g"), F.col(quota).alias("_q"), "_order", F.col(tie).alias("_t"), "_b", "_size")
    counts = slim.groupBy("_g", "_b").agg(F.sum("_size").alias("_n"), F.max("_q").alias("_q"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the first bucket that goes beyond the quota; a group without one is taken whole
    last = counts.withColumn("_before", before).where("_before <= _q AND _before + _n > _q").select(F.col("_g").alias("_lg"), F.col("_b").alias("_lb"), (F.col("_q") - F.col("_before")).alias("_k"))
    last = hinted(last, known=groups)
    within = slim.drop("_q").join(last, F.col("_g").eqNullSafe(F.col("_lg")) & (F.col("_b") == F.col("_lb")))
    sum_ = F.sum("_size").over(Window.partitionBy("_g", "_b").orderBy("_order", "_t").rowsBetween(Window.unboundedPreceding, 0))
    ends = within.withColumn("_sum", sum_).where("_sum <= _k").groupBy("_g").agg(F.max(F.struct("_order", "_t")).alias("_last"))
    cut = last.join(ends, F.col("_lg").eqNullSafe(F.col("_g")), "left").select(F.col("_lg").alias("_group"), "_lb", "_last")
    joined = rows.join(hinted(cut, known=groups), F.col(group).eqNullSafe(F.col("_group")), "left")
    inside = F.coalesce(F.struct("_order", F.col(tie).alias("_t")) <= F.col("_last"), F.lit(False))
    taken = F.when(F.coalesce(F.col(quota), F.lit(0)) < 1, F.lit(False)).when(F.col("_lb").isNull(), F.lit(True)).otherwise((F.col("_b") < F.col("_lb")) | ((F.col("_b") == F.col("_lb")) & inside))
    return joined.withColumn(name, taken).drop("_order", "_b", "_size", "_group", "_lb", "_last")


def prefix(df: DataFrame, group: str, quota: str, order: Column, tie: str, bucket: Column, groups: int | None = None) -> DataFrame:
    """The rows that mark_prefix marks."""
    return mark_prefix(df, group, quota, order, tie, bucket, "_taken", groups=groups).where("_taken").drop("_taken")
