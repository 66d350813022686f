"""Quotas, hash orders and stratified samples. Rows carry their position in `ord`, since list order decides ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graincart.functions.hashing import is_holdout, stable_hex
from graincart.operators.selection import hex_bucket, position_bucket, prefix
from graincart.session import cut_lineage, hinted


def prefix_quota(rows: DataFrame, group: str, fraction: float, order: str = "ord") -> DataFrame:
    """The first max(1, floor(n x fraction)) rows of each group by a unique position. Groups are few; rows are ranked only where a quota cuts."""
    if not 0 < fraction <= 1:
        raise ValueError("the fraction must be over 0 and at most 1")
    sizes = rows.groupBy(F.col(group).alias("_g")).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * F.lit(fraction)).cast("bigint")).alias("_quota"))
    sized = rows.join(sizes, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    return prefix(sized, group, "_quota", F.col(order), order, position_bucket(rows, order)).drop("_quota")


def first_n(rows: DataFrame, group: str, n: int | None, order: str = "ord") -> DataFrame:
    """The first n rows of each group; all without n. Spark limits each task to n rows of a group before the shuffle."""
    if not n:
        return rows
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def first_rows(rows: DataFrame, n: int | None, order: str = "ord") -> DataFrame:
    """The first n rows of all; a top-k, not a sort of everything."""
    return rows.orderBy(order).limit(n) if n else rows


def hash_shuffled(rows: DataFrame, salt: str, key: str = "sample_id") -> DataFrame:
    """A fixed shuffle: the order of SHA-256(salt::key)."""
    return rows.orderBy(stable_hex(F.col(key), salt), key)


def holdout(rows: DataFrame, key: Column, salt: str, ratio: float) -> DataFrame:
    """Rows outside `test` whose hashed key falls below `ratio`, their split overwritten with `holdout`.

    If none does, the first eligible row (by `ord`) is taken.
    """
    eligible = rows.where(F.coalesce(F.col("split"), F.lit("")) != "test").withColumn("_in", is_holdout(key, salt, ratio)).withColumn("split", F.lit("holdout"))
    chosen = eligible.where("_in").drop("_in")
    if not chosen.isEmpty():
        return chosen
    return eligible.drop("_in").orderBy("ord").limit(1)


def _python_repr(fields: list[str]) -> Column:
    """The text of a Python tuple of the fields, which salts the order inside a stratum. Quotes within values are not handled."""
    parts = [F.concat(F.lit("'"), F.coalesce(F.col(f).cast("string"), F.lit("None")), F.lit("'")) for f in fields]
    inner = F.concat(parts[0], F.lit(",")) if len(parts) == 1 else F.concat_ws(", ", *parts)
    return F.concat(F.lit("("), inner, F.lit(")"))


def stratified_sample(rows: DataFrame, target: int, fields: list[str], floor: int, salt: str, key: str = "sample_id") -> DataFrame:
    """`target` rows: `floor` of each stratum as far as it goes, the rest in proportion by largest remainder.

    Floors go to the larger strata first (ties: the stratum seen first). The leftover goes to the largest remainder,
    then the most spare rows, then the largest key. Within a stratum rows come by their salted hash. All rows come
    back where `target` is not positive or not below their number. Column `rank` is the place in the salted order of the result.
    The place, stratum and hash of each row are written out once, and all that follows reads them. The strata table has one row for each
    combination of fields; its windows run in one task, and it is broadcast if it is small.
    """
    order = stable_hex(F.col(key), salt)
    keys = [f"_f{i}" for i in range(len(fields))]
    named = [F.coalesce(F.col(f).cast("string"), F.lit("None")).alias(k) for k, f in zip(keys, fields)]
    slim = rows.select("ord", F.col(key).alias("_id"), *named).withColumn("_stratum", _python_repr(keys))
    slim = cut_lineage(slim.withColumn("_inner", stable_hex(F.col("_id"), F.concat(F.lit(f"{salt}::"), F.col("_stratum")))).drop("_id"))
    total = slim.count()
    if target <= 0 or total <= target:
        return rows.withColumn("order_key", order)
    strata = slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("seen"))
    ahead = Window.orderBy(F.desc("n"), "seen").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    share = F.least(F.lit(floor), F.col("n"))
    strata = strata.withColumn("t1", F.least(share, F.greatest(F.lit(target) - F.coalesce(F.sum(share).over(ahead), F.lit(0)), F.lit(0))))
    strata = strata.withColumn("cap", F.col("n") - F.col("t1")).withColumn("rem", F.lit(target) - F.sum("t1").over(everything)).withColumn("tot", F.sum("cap").over(everything))
    strata = strata.withColumn("raw", F.when((F.col("rem") > 0) & (F.col("cap") > 0), F.col("rem").cast("double") * F.col("cap") / F.col("tot").cast("double")).otherwise(F.lit(0.0)))
    strata = strata.withColumn("t2", F.least(F.col("cap"), F.floor("raw"))).withColumn("spare", F.col("cap") - F.col("t2")).withColumn("left", F.col("rem") - F.sum("t2").over(everything))
    names = [F.desc(f"_f{i}") for i in range(len(fields))]
    place = F.row_number().over(Window.orderBy(F.desc(F.col("spare") > 0), F.desc(F.col("raw") - F.col("t2")), F.desc("spare"), *names))
    strata = strata.withColumn("alloc", F.col("t1") + F.col("t2") + F.when((F.col("spare") > 0) & (place <= F.col("left")), 1).otherwise(0))
    strata = cut_lineage(strata.select(*keys, "alloc"))
    groups = strata.count()
    marked = slim.join(hinted(strata, known=groups), keys)
    kept = prefix(marked, "_stratum", "alloc", F.col("_inner"), "ord", hex_bucket(F.col("_order")), groups).select(F.col("ord").alias("_kept"))
    return rows.join(hinted(kept, known=target), F.col("ord") == F.col("_kept"), "left_semi").withColumn("order_key", order)


def mode_first_seen(rows: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group; ties go to the value seen first, at one place to the larger value. Two aggregations, no window."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    return counts.groupBy(*group).agg(F.max_by(value, F.struct(F.col("_n"), -F.col("_first"), F.col(value))).alias("mode"), F.max("_n").alias("n"))


def mode_of_array(values: Column) -> Column:
    """The most frequent element of an array, the earliest one on ties; null for an empty array."""
    distinct = F.array_distinct(values)
    counts = F.transform(distinct, lambda v: F.size(F.filter(values, lambda x: x == v)))
    return F.get(distinct, F.array_position(counts, F.array_max(counts)).cast("int") - 1)
