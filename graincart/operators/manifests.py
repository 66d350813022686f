"""Relational operators on manifests: merges, filters, and joins that keep evaluation data out of training."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graincart.functions.hashing import group_key
from graincart.functions.text import word_count
from graincart.operators.sampling import first_n
from graincart.session import cut_lineage


def merge(sources: Sequence[DataFrame], tasks: Sequence[str] = (), without_splits: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """The sources one after the other (`source_ord`), filtered, at most `most` rows of each after the filters. Nothing is deduplicated.

    Empty lists filter nothing. Filters stand on the scans, so that Parquet sources skip what they can.
    """
    parts = []
    for i, rows in enumerate(sources):
        if tasks:
            rows = rows.where(F.col("task_type").isin(*tasks))
        if without_splits:
            rows = rows.where(~F.coalesce(F.col("split"), F.lit("")).isin(*without_splits))
        parts.append(rows.withColumn("source_ord", F.lit(i)))
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return first_n(merged, "source_ord", most)


def rewardable(rows: DataFrame, modes: Sequence[str], most_words: int, most_images: int | None = None) -> DataFrame:
    """Rows whose verifier has one of the modes and whose answer (else label) has at most `most_words` words."""
    answer = F.coalesce(F.nullif(F.col("target.answer_text"), F.lit("")), F.col("target.canonical_label"), F.lit(""))
    kept = rows.where(F.col("verifier.mode").isin(*modes) & (word_count(answer) <= most_words))
    return kept if most_images is None else max_images(kept, most_images)


def max_images(rows: DataFrame, most: int) -> DataFrame:
    return rows.where(F.size(F.coalesce(F.col("images"), F.array().cast("array<string>"))) <= most)


def with_group(rows: DataFrame) -> DataFrame:
    """`rows` with `group_key`, the source and picture that training and evaluation must not share."""
    return rows.withColumn("group_key", group_key(F.col("source_dataset"), F.get_json_object("metadata", "$.source_image_id"), F.col("images")))


def eval_pool(holdout: DataFrame, source: DataFrame, splits: Sequence[str], most_images: int) -> DataFrame:
    """Holdout rows, the last one of each id, and source rows of `splits` whose id the holdout lacks, the first one of each.

    `pool_ord` is the place at which an id first came, holdout before source.
    """
    by_id = Window.partitionBy("sample_id")
    held = max_images(holdout, most_images).withColumn("_at", F.min("ord").over(by_id)).withColumn("_rank", F.row_number().over(by_id.orderBy(F.desc("ord")))).where("_rank = 1").withColumn("_side", F.lit(0))
    more = max_images(source, most_images).where(F.col("split").isin(*splits)).join(held.select("sample_id"), "sample_id", "left_anti")
    more = more.withColumn("_at", F.col("ord")).withColumn("_rank", F.row_number().over(by_id.orderBy("ord"))).where("_rank = 1").withColumn("_side", F.lit(1))
    both = held.unionByName(more, allowMissingColumns=True)
    return both.withColumn("pool_ord", F.struct("_side", "_at")).drop("_rank", "_at", "_side")


def train_rows(source: DataFrame, pool: DataFrame, splits: Sequence[str], most_images: int) -> DataFrame:
    """`source` with the reason why a row is no training row: max_images, split, eval_overlap, or null for one that stays.

    Two joins, by id and by group, in place of one with an OR that would compare all with all. The keys of the pool
    are written once and made distinct; their number follows the pool, so Spark decides how to join them.
    """
    rows = with_group(source)
    marked = cut_lineage(with_group(pool).select("sample_id", "group_key"))
    ids = marked.select("sample_id").distinct().withColumn("_same_id", F.lit(True))
    groups = marked.select("group_key").distinct().withColumn("_same_group", F.lit(True))
    joined = rows.join(ids, "sample_id", "left").join(groups, "group_key", "left")
    reason = (
        F.when(F.size(F.coalesce(F.col("images"), F.array().cast("array<string>"))) > most_images, "max_images")
        .when(~F.coalesce(F.col("split").isin(*splits), F.lit(False)), "split")
        .when(F.col("_same_id").isNotNull() | F.col("_same_group").isNotNull(), "eval_overlap")
    )
    return joined.withColumn("reason", reason).drop("_same_id", "_same_group")


def overlap_counts(train: DataFrame, other: DataFrame) -> DataFrame:
    """One row: distinct ids and distinct groups that both sides have."""
    a, b = with_group(train), with_group(other)
    ids = a.select("sample_id").intersect(b.select("sample_id")).select(F.lit("id").alias("k"))
    groups = a.select("group_key").intersect(b.select("group_key")).select(F.lit("group").alias("k"))
    return ids.unionByName(groups).agg(F.count_if(F.col("k") == "id").alias("exact_sample_id"), F.count_if(F.col("k") == "group").alias("group_key"))


def assert_no_overlap(train: DataFrame, other: DataFrame) -> None:
    """ValueError if the two sides share an id or a group."""
    row = overlap_counts(train, other).first()
    if row.exact_sample_id or row.group_key:
        raise ValueError(f"train and eval overlap: {row.exact_sample_id} ids, {row.group_key} groups")


def route_tracks(rows: DataFrame) -> DataFrame:
    """`rows` with `track`: mmmt if the benchmark track says so or the task is to clarify, else mmst."""
    track = F.lower(F.coalesce(F.get_json_object("metadata", "$.benchmark_track"), F.lit("")))
    return rows.withColumn("track", F.when(F.contains(track, F.lit("mmmt")) | (F.col("task_type") == "clarify_or_respond"), "mmmt").otherwise("mmst"))


def target_text(target: Column) -> Column:
    """A target as text: answer, label, labels, decision with content, decision, content, first acceptable answer; null if none.

    JSON is written with sorted keys and a space after `:` and `,`; `structured` is taken as it stands in the row.
    """
    none = F.array().cast("array<string>")
    structured = F.when(~F.regexp_replace(F.coalesce(target["structured"], F.lit("")), r"\s", "").isin("", "{}", "null"), target["structured"])
    decision = F.nullif(target["decision"], F.lit(""))
    labels, answers = F.coalesce(target["canonical_labels"], none), F.coalesce(target["acceptable_answers"], none)
    return F.coalesce(
        F.nullif(target["answer_text"], F.lit("")),
        F.nullif(target["canonical_label"], F.lit("")),
        F.when(F.size(labels) > 0, F.array_join(labels, ", ")),
        F.concat(F.lit('{"content": '), structured, F.lit(', "decision": "'), decision, F.lit('"}')),
        decision,
        structured,
        F.get(answers, F.lit(0)),
    )


def training_messages(rows: DataFrame) -> DataFrame:
    """`rows` whose messages end with the target as the assistant's turn."""
    turn = F.struct(F.lit("assistant").alias("role"), F.array(F.struct(F.lit("text").alias("type"), target_text(F.col("target")).alias("text"), F.lit(None).cast("string").alias("image"))).alias("content"))
    return rows.withColumn("messages", F.concat("messages", F.array(turn)))


def prompt_messages(rows: DataFrame) -> DataFrame:
    """`rows` without the assistant's turns."""
    return rows.withColumn("messages", F.filter("messages", lambda m: m["role"] != "assistant"))


def rl_records(rows: DataFrame) -> DataFrame:
    """The prompt and the row's parts as JSON, which is what a reinforcement trainer hands back to the rewards. Null fields are left out of the prompt."""
    keep = {"ignoreNullFields": "false"}
    return rows.select(
        "sample_id", "task_type", F.to_json(F.filter("messages", lambda m: m["role"] != "assistant")).alias("prompt"), F.to_json("target", keep).alias("target_json"),
        F.to_json("verifier", keep).alias("verifier_json"), F.to_json("reward_meta", keep).alias("reward_meta_json"), F.to_json("images").alias("images_json"),
    )


def prediction_rows(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """The twelve fields of a prediction: `rows` joined with predictions (sample_id, prediction) by id."""
    target = F.col("target")
    return rows.join(predictions.select("sample_id", "prediction"), "sample_id").select(
        "sample_id", "source_dataset", "task_type", "split", "images", "prediction", target_text(target).alias("reference_text"), target["answer_text"].alias("answer_text"),
        target["canonical_label"].alias("canonical_label"), target["acceptable_answers"].alias("acceptable_answers"), target["decision"].alias("decision"), "metadata",
    )


def oracle_predictions(rows: DataFrame) -> DataFrame:
    """sample_id and the target's own text as the prediction."""
    return rows.select("sample_id", target_text(F.col("target")).alias("prediction"))


def echo_predictions(rows: DataFrame) -> DataFrame:
    """sample_id and the last text of the last message as the prediction."""
    return rows.select("sample_id", F.try_element_at(F.try_element_at("messages", F.lit(-1))["content"], F.lit(-1))["text"].alias("prediction"))
