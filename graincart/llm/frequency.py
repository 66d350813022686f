"""Frequency of every distinct value or term.

Each record gives its distinct values with their counts; Spark's hash aggregate combines them before the shuffle,
so that a value held by a third of the records reaches the network once for each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graincart.functions.text import normalize_label
from graincart.session import cut_lineage

RARE_BELOW = 3
COMMON_SHARE = 20


def term_frequencies(records: DataFrame, values: dict[str, Column], terms: dict[str, Column], rare_below: int = RARE_BELOW, common_share: int = COMMON_SHARE) -> DataFrame:
    """field_name, value, occurrences, records, mark over all rows of `records` (one row a record).

    `values` are whole values, `terms` are split into words; both are compared in label form. Null is no value, nor
    is one without a letter or digit left. mark is `rare` below `rare_below` records, `common` if more than one in
    `common_share` of all records has the value (rare wins on tables that small), else null. An empty table gives
    no rows. Only the number of records goes to the driver.
    """

    def words(name: str, label: Column) -> Column:
        every = F.filter(F.split(label, " "), lambda w: w != "")
        return F.transform(F.array_distinct(every), lambda w: F.struct(F.lit(name).alias("field_name"), w.alias("value"), F.size(F.filter(every, lambda x: x == w)).alias("n")))

    def whole(name: str, label: Column) -> Column:
        return F.array(F.struct(F.lit(name).alias("field_name"), label.alias("value"), F.lit(1).alias("n")))

    # a term without a field stands for each record, so that one pass counts these too
    everyone = F.array(F.struct(F.lit("").alias("field_name"), F.lit("").alias("value"), F.lit(0).alias("n")))
    parts = [whole(n, normalize_label(c)) for n, c in values.items()] + [words(n, normalize_label(c)) for n, c in terms.items()]
    rows = records.select(F.explode(F.concat(everyone, *parts)).alias("t")).select("t.*").where("value <> '' OR field_name = ''")
    counts = cut_lineage(rows.groupBy("field_name", "value").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("records")))
    row = counts.where("field_name = ''").first()
    total = row.records if row else 0
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") * common_share > total, "common")
    return counts.where("field_name <> ''").withColumn("mark", mark)
