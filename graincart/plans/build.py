"""Training, reinforcement and evaluation manifests from normalised ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graincart.operators import manifests as M
from graincart.operators.reports import image_histogram, value_counts
from graincart.operators.sampling import holdout, stratified_sample
from graincart.session import cut_lineage

#: What the builds filter by.
SFT_TASKS = ("classification", "vqa", "consultation", "symptom_explanation", "clarify_or_respond")
RL_TASKS = ("classification", "vqa", "consultation", "clarify_or_respond")
RL_MODES = ("label", "exact_match", "synonym", "structured", "clarify")
RL_MOST_WORDS, RL_MOST_IMAGES, HOLDOUT_RATIO = 80, 1, 0.1
STRATA = ("source_dataset", "task_type", "split")


def build_sft(sources: Sequence[DataFrame], tasks: Sequence[str] = SFT_TASKS, without: Sequence[str] = ("test",), most: int | None = None) -> DataFrame:
    return M.merge(sources, tasks, without, most)


def build_rl(sources: Sequence[DataFrame], tasks: Sequence[str] = RL_TASKS, without: Sequence[str] = ("test",), modes: Sequence[str] = RL_MODES, most_words: int = RL_MOST_WORDS, most_images: int | None = RL_MOST_IMAGES) -> DataFrame:
    return M.rewardable(M.merge(sources, tasks, without), modes, most_words, most_images)


def build_eval(benchmark: DataFrame | None, sources: Mapping[str, DataFrame], salt: str, ratio: float = HOLDOUT_RATIO) -> dict[str, DataFrame]:
    """mmst and mmmt tracks of the benchmark, and the local holdout of the sources.

    The holdout hashes the configured name of a source with its picture, so that all rows of a picture fall on one side.
    """
    out: dict[str, DataFrame] = {}
    if benchmark is not None:
        routed = M.route_tracks(benchmark)
        out |= {track: routed.where(F.col("track") == track).drop("track") for track in ("mmst", "mmmt")}
    parts = [rows.withColumn("_name", F.lit(name)).withColumn("_source", F.lit(i)) for i, (name, rows) in enumerate(sources.items())]
    if parts:
        merged = M.merge(parts)
        picture = F.coalesce(F.nullif(F.get_json_object("metadata", "$.source_image_id"), F.lit("")), F.get("images", F.lit(0)), F.lit(""))
        merged = merged.withColumn("ord", F.struct("_source", "ord"))
        held = holdout(merged, F.concat("_name", F.lit("::"), picture), salt, ratio)
        out["local_holdout"] = held.withColumn("ord", F.col("ord.ord")).drop("_name", "_source", "source_ord")
    return out


def build_train_eval(
    source: DataFrame, held: DataFrame, salt: str, train_splits: Sequence[str] = ("train",), eval_splits: Sequence[str] = ("validation", "dev"), most_images: int = 1, sample: int = 512, floor: int = 16
) -> tuple[DataFrame, DataFrame, dict[str, Any]]:
    """(train, eval, summary): training rows that share neither id nor picture with the evaluation pool, and a stratified sample of that pool.

    Both inputs have `ord`. The whole pool is kept out of training, not only the sample. Nothing left on a side is a
    ValueError, as is an overlap.
    """
    pool = cut_lineage(M.eval_pool(held, source, eval_splits, most_images))
    marked = cut_lineage(M.train_rows(source, pool, train_splits, most_images))
    train = marked.where("reason IS NULL").drop("reason")
    if train.isEmpty():
        raise ValueError("no training rows remain")
    if pool.isEmpty():
        raise ValueError("no evaluation rows were selected")
    chosen = stratified_sample(pool.drop("ord").withColumnRenamed("pool_ord", "ord"), sample, list(STRATA), floor, salt)
    M.assert_no_overlap(train, pool)

    def counts(rows: DataFrame, field: str) -> dict[str, int]:
        return {r.value: r.n for r in value_counts(rows, field).collect()}

    summary = {
        "train_rows": train.count(), "eval_pool_rows": pool.count(), "eval_rows": chosen.count(), "train_splits": list(train_splits), "eval_splits": list(eval_splits),
        "max_images_per_sample": most_images, "eval_sample_size": sample, "min_eval_samples_per_stratum": floor, "excluded": counts(marked.where("reason IS NOT NULL"), "reason"),
        "train_by_dataset": counts(train, "source_dataset"), "train_by_task_type": counts(train, "task_type"), "eval_by_dataset": counts(chosen, "source_dataset"),
        "eval_by_task_type": counts(chosen, "task_type"), "eval_by_split": counts(chosen, "split"), "overlap": {"exact_sample_id": 0, "group_key": 0},
    }
    return train, chosen.orderBy("order_key"), summary


def dry_run_summary(train: DataFrame, other: DataFrame | None = None) -> dict[str, Any]:
    """Rows, tasks and image counts of what a trainer would read; with `other`, after the check that the two share nothing."""
    if other is not None:
        M.assert_no_overlap(train, other)
    out: dict[str, Any] = {}
    for name, rows in (("train", train), ("eval", other)):
        if rows is not None:
            out[f"{name}_rows"] = rows.count()
            out[f"{name}_task_types"] = {r.value: r.n for r in value_counts(rows, "task_type").collect()}
            out[f"{name}_images"] = {str(r.images): r.n for r in image_histogram(rows).collect()}
    return out
