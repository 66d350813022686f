"""Counts and tables about manifests, data sets and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def summarize(rows: DataFrame) -> DataFrame:
    """field, value, n: rows by source, by task type and by split, in one pass of grouping sets."""
    names = ("source_dataset", "task_type", "split")
    grouped = rows.groupingSets([[n] for n in names], *names).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_which"))
    # the bit of a field that is grouped by is 0
    which = F.when(F.col("_which") == 3, names[0]).when(F.col("_which") == 5, names[1]).otherwise(names[2])
    value = F.when(F.col("_which") == 3, F.col(names[0])).when(F.col("_which") == 5, F.col(names[1])).otherwise(F.col(names[2]))
    return grouped.select(which.alias("field"), value.alias("value"), "n")


def value_counts(rows: DataFrame, field: str) -> DataFrame:
    """value, n; nulls count as the empty string."""
    return rows.groupBy(F.coalesce(F.col(field).cast("string"), F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def image_histogram(rows: DataFrame) -> DataFrame:
    """images, n: rows by their number of images; null arrays have none."""
    return rows.groupBy(F.coalesce(F.size("images"), F.lit(0)).alias("images")).agg(F.count(F.lit(1)).alias("n"))


def unique_images(rows: DataFrame) -> DataFrame:
    """image, first_ord: each image path once, with the first row that has it."""
    return rows.select("ord", F.explode("images").alias("image")).groupBy("image").agg(F.min("ord").alias("first_ord"))


def image_errors(rows: DataFrame, checked: DataFrame) -> DataFrame:
    """`rows` with `errors`, one for each of its images that `checked` (image, error) has an error for; a row without images has one error.

    Images are checked once each, not once a row; the errors, which are few, are joined back and gathered by row.
    """
    shown = rows.select("ord", F.posexplode("images").alias("_pos", "image"))
    bad = shown.join(checked.where("error IS NOT NULL").select("image", "error"), "image")
    gathered = bad.groupBy("ord").agg(F.sort_array(F.collect_list(F.struct("_pos", "image", "error"))).alias("_e"))
    none = F.struct(F.lit(None).cast("string").alias("image"), F.lit("row is missing images").alias("error"))
    errors = F.transform("_e", lambda e: F.struct(e["image"].alias("image"), e["error"].alias("error")))
    missing = F.coalesce(F.size("images"), F.lit(0)) < 1
    empty = F.array().cast("array<struct<image:string,error:string>>")
    return rows.join(gathered, "ord", "left").withColumn("errors", F.when(missing, F.array(none)).otherwise(F.coalesce(errors, empty))).drop("_e")


def validation_summary(marked: DataFrame) -> DataFrame:
    """rows, invalid_rows, images, invalid_images of each source. A row without images is invalid but adds no invalid image."""
    source = F.coalesce(F.nullif(F.col("source_dataset"), F.lit("")), F.lit("unknown"))
    shown = F.coalesce(F.size("images"), F.lit(0))
    return marked.groupBy(source.alias("source_dataset")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.size("errors") > 0).alias("invalid_rows"),
        F.sum(F.greatest(shown, F.lit(0))).cast("bigint").alias("images"), F.sum(F.when(shown > 0, F.size("errors")).otherwise(0)).cast("bigint").alias("invalid_images"),
    )


def header_error(header: Column) -> Column:
    """Null for the first bytes of a JPEG, PNG, BMP or WEBP file, else what is wrong with them."""
    start = F.hex(F.substring(header, 1, 16))
    good = start.startswith("FFD8FF") | start.startswith("89504E470D0A1A0A") | start.startswith("424D") | (start.startswith("52494646") & (F.substring(start, 17, 8) == "57454250"))
    wrong = F.when(start.startswith("25504446"), F.lit("unsupported image signature: PDF document")).otherwise(F.concat(F.lit("unsupported image signature: "), F.lower(F.substring(start, 1, 16))))
    return F.when(header.isNull(), F.lit("missing file")).when(~good, wrong)


def dataset_report(registry: DataFrame, normalized: DataFrame, downloads: DataFrame) -> DataFrame:
    """Each data set of the registry with its rows and status.

    `normalized` has source_dataset and rows, `downloads` source_dataset and manual_required. A data set with rows is
    normalized; else, with a download, manual_required or downloaded_only; else missing.
    """
    joined = registry.join(normalized, "source_dataset", "left").join(downloads, "source_dataset", "left")
    status = F.when(F.col("rows").isNotNull(), "normalized").when(F.col("manual_required"), "manual_required").when(F.col("manual_required").isNotNull(), "downloaded_only").otherwise("missing")
    return joined.select("source_dataset", "task_family", F.coalesce("rows", F.lit(0)).alias("normalized_rows"), status.alias("status"))


def readiness(paths: DataFrame) -> DataFrame:
    """name, readiness_status, missing: from (name, implementation_status, path, required, exists), one row a path."""
    lacking = F.col("required") & ~F.col("exists")
    grouped = paths.groupBy("name", "implementation_status").agg(F.count_if(lacking).alias("missing"), F.array_join(F.sort_array(F.collect_set(F.when(lacking, F.col("path")))), "<br>").alias("missing_paths"))
    done = F.col("implementation_status") == "implemented"
    status = F.when(done & (F.col("missing") == 0), "ready").when(done, "missing_data").otherwise("planned_or_blocked")
    return grouped.select("name", "implementation_status", status.alias("readiness_status"), "missing", "missing_paths")


def pivot_metrics(tasks: DataFrame, keys: list[str], names: list[str] | None = None) -> DataFrame:
    """One row for each of `keys`, its map column `metrics` spread to columns metric_<name>; names are found by a pass if not given."""
    long = tasks.select(*keys, F.explode("metrics").alias("key", "value")).withColumn("key", F.concat(F.lit("metric_"), "key"))
    pivoted = long.groupBy(*keys).pivot("key", [f"metric_{n}" for n in names] if names else None)
    return pivoted.agg(F.first("value"))


def numeric_keys(rows: DataFrame, json: str) -> DataFrame:
    """key, n: the keys of JSON objects that have numbers as values; booleans are none, and `global_step` is left out."""
    entries = rows.select(F.explode(F.from_json(json, "map<string,variant>")).alias("key", "value"))
    kind = F.schema_of_variant("value")
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT") | kind.startswith("DECIMAL")
    return entries.where(numeric & (F.col("key") != "global_step")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def matching_keys(keys: list[str], needles: list[str]) -> list[str]:
    """The keys that contain one of the needles, case aside."""
    return [k for k in keys if any(n in k.lower() for n in needles)]


def numeric_columns(rows: DataFrame) -> list[str]:
    """Names of the numeric columns, sorted; `global_step` is left out."""
    return sorted(f.name for f in rows.schema if isinstance(f.dataType, T.NumericType) and f.name != "global_step")


def table_columns(columns: list[str]) -> list[str]:
    """The order of a results table: what is known first, the rest sorted."""
    known = ["model_name", "task", "checkpoint_path", "prediction_mode", "num_predictions", "manifest_path", "metrics_path", "predictions_path"]
    return [c for c in known if c in columns] + sorted(c for c in columns if c not in known)
