"""The queries of the operators for training data: name -> (session, folder of tables) -> DataFrame."""

from __future__ import annotations

import functools
import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graincart.llm import dedup, frequency, grouping, mixing, overlap, packing, pairs, quota, skeleton, tokens
from graincart.llm.common import cells, first_deliveries, read
from graincart.llm.oracle import ORACLE as ORACLE
from graincart.session import cut_lineage, ship_package

#: Environment variable with the folder of the tokenizers' files; by default the installed package `public_tokenizers`.
TOKENIZERS = "GRAINCART_TOKENIZERS"
VOCABULARY = "byte_bpe_50k.tiktoken"


def tokenizer_path(name: str = VOCABULARY) -> str:
    folder = os.environ.get(TOKENIZERS)
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, name)


# 1 -----------------------------------------------------------------------------------------------------------


def _cross(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.cross_split_pairs(read(spark, folder, "manifest"), read(spark, folder, "image_index"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = _cross(spark, folder)
    return rows.select(F.least("train_id", "other_id").alias("sample_id_a"), F.greatest("train_id", "other_id").alias("sample_id_b"))


def p1_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs and records that a train record also shows, by split and source."""
    rows = _cross(spark, folder)
    return rows.groupBy(F.col("other_split").alias("split"), F.col("other_source").alias("source_dataset")).agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("other_id").alias("records"))


def p1_pictures(spark: SparkSession, folder: str) -> DataFrame:
    """The pictures that both sides show, with the number of records on each: the pairs before they are expanded."""
    return overlap.shared_pictures(read(spark, folder, "manifest"), read(spark, folder, "image_index"))


# 2 -----------------------------------------------------------------------------------------------------------


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.defective_pairs(read(spark, folder, "manifest"))


# 3 -----------------------------------------------------------------------------------------------------------


def _mix(spark: SparkSession, folder: str, size: str | None = None) -> tuple[DataFrame, DataFrame]:
    records = mixing.mixable(read(spark, folder, "manifest"))
    if size is None:
        records = cut_lineage(records.drop("text"))
    else:
        records = cut_lineage(records)
        counts = tokens.token_counts(records, tokenizer_path(), "sample_id").withColumnRenamed("tokens", size)
        records = cut_lineage(records.drop("text").join(counts, "sample_id"))
    return records, mixing.budgets(records, read(spark, folder, "mix_targets"), read(spark, folder, "dataset_registry"), size=size)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    report = _mix(spark, folder)[1]
    return report.where("falls_short").select("source_dataset").distinct()


def p3_mix(spark: SparkSession, folder: str) -> DataFrame:
    records, report = _mix(spark, folder)
    return mixing.mix(records, report).select("sample_id", "source_dataset", "task_type", "copies")


def p3_shares(spark: SparkSession, folder: str) -> DataFrame:
    records, report = _mix(spark, folder)
    return mixing.shares(mixing.mix(records, report), report)


def p3_token_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares of a mix whose sizes are tokens of question and answer instead of records."""
    records, report = _mix(spark, folder, "tokens")
    return mixing.shares(mixing.mix(records, report, size="tokens"), report, "tokens")


def p3_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the mix, by source: no more uses than it can give, its share unless it falls short, and a mix as large as it can be."""
    records, report = _mix(spark, folder)
    report = cut_lineage(report)
    used = mixing.mix(records, report).groupBy("source_dataset").agg(F.sum("copies").alias("uses"), F.max("copies").alias("most"))
    whole = cut_lineage(used).agg(F.sum("uses").alias("uses")).first().uses or 0
    able, wanted = report.agg(F.sum("capacity").alias("n")).first().n or 0, records.count()
    sources = report.groupBy("source_dataset").agg(F.sum("records").alias("records"), F.sum("capacity").alias("capacity"), F.bool_or("falls_short").alias("falls_short"), F.max("target_permille").alias("target_permille"))
    uses = F.coalesce("uses", F.lit(0))
    return sources.join(used, "source_dataset", "left").select(
        "source_dataset", "records", "capacity", "falls_short", (uses <= F.col("capacity")).alias("within"), (F.col("falls_short") | (uses >= F.floor(F.col("target_permille") * wanted / 1000))).alias("met"),
        F.lit(whole == min(able, wanted)).alias("whole"),
    )


# 4 -----------------------------------------------------------------------------------------------------------


def _related(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    records = cut_lineage(grouping.related_by(read(spark, folder, "manifest")))
    return records, grouping.components(records)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    records, groups = _related(spark, folder)
    return grouping.divided_groups(records, groups).select("group_id", "sample_id")


def p4_splits(spark: SparkSession, folder: str) -> DataFrame:
    records, groups = _related(spark, folder)
    return grouping.assign_splits(records, groups, read(spark, folder, "split_targets"))


def p4_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the splits, in one row: every record has one, no group is parted, and the shares are within a hundredth of the targets."""
    records, groups = _related(spark, folder)
    rows = cut_lineage(grouping.assign_splits(records, groups, read(spark, folder, "split_targets")))
    wanted = read(spark, folder, "split_targets").select("split", F.col("target_permille") / 1000)
    total = rows.count()
    shares = wanted.toDF("split", "share").join(rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")), "split", "full").agg(F.bool_and(F.abs(F.col("n") / max(total, 1) - F.col("share")) <= 0.01)).first()[0]
    by_group = rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("split").alias("splits"))
    counts = by_group.agg(F.sum("n").alias("records"), F.count_if(F.col("n") > 1).alias("groups"), F.count_if(F.col("splits") > 1).alias("parted"))
    return counts.select(F.coalesce("records", F.lit(0)).alias("records"), "groups", "parted", F.lit(shares is not False).alias("within"))


# 5 -----------------------------------------------------------------------------------------------------------


def _frequencies(spark: SparkSession, folder: str) -> DataFrame:
    records = first_deliveries(read(spark, folder, "manifest"), label=F.col("target.canonical_label"), task=F.col("task_type"))
    return frequency.term_frequencies(records, {"canonical_label": F.col("label"), "task_type": F.col("task")}, {"label_term": F.col("label")})


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _frequencies(spark, folder).where("mark IS NOT NULL").select("field_name", "value", "mark")


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _frequencies(spark, folder)


# 6 -----------------------------------------------------------------------------------------------------------


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = dedup.copies(read(spark, folder, "manifest"))
    return rows.where("group_id <> sample_id").select(F.col("group_id").alias("sample_id_a"), F.col("sample_id").alias("sample_id_b"))


def p6_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record that stays, with the number of records it stands for."""
    manifest = read(spark, folder, "manifest")
    groups = dedup.copies(manifest)
    everyone = manifest.where("sample_id IS NOT NULL").select("sample_id").distinct()
    return everyone.join(groups, "sample_id", "left").where("group_id IS NULL OR group_id = sample_id").select("sample_id", F.coalesce("copies", F.lit(1)).alias("copies"))


# 7 -----------------------------------------------------------------------------------------------------------


def _quota(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    records = cut_lineage(cells(read(spark, folder, "manifest")))
    return records, quota.plan_sample(records, read(spark, folder, "sample_targets"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _quota(spark, folder)[1].where("unmet").select("source_dataset", "task_type", "split")


def p7_sample(spark: SparkSession, folder: str) -> DataFrame:
    records, report = _quota(spark, folder)
    return quota.draw(records, report)


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return _quota(spark, folder)[1]


def p7_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the sample, by cell: no more rows than there are, its minimum unless it is unmet, and no record twice."""
    records, report = _quota(spark, folder)
    drawn = quota.draw(records, report).groupBy(*quota.CELL).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sample_id").alias("ids"))
    n = F.coalesce("n", F.lit(0))
    return report.join(drawn, quota.CELL, "left").select(
        *quota.CELL, "records", "unmet", (n <= F.col("records")).alias("within"), (F.col("unmet") | (n >= F.col("min_records"))).alias("least"), (n == F.coalesce("ids", F.lit(0))).alias("once"), (n == F.col("given")).alias("given"),
    )


# 8 -----------------------------------------------------------------------------------------------------------


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(read(spark, folder, "documents"), tokenizer_path())


def p8_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The texts again, from their ids; a null text comes back empty."""
    path = tokenizer_path()
    return tokens.decode(tokens.encode(read(spark, folder, "documents"), path), path)


# 9 -----------------------------------------------------------------------------------------------------------


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(cut_lineage(tokens.token_counts(read(spark, folder, "documents"), tokenizer_path())))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return packing.divided(_packed(spark, folder))


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder)


def p9_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, tokens in them, and the share of their room in use."""
    rows = _packed(spark, folder).where("container IS NOT NULL").groupBy("container").agg(F.sum("tokens").alias("tokens"))
    total = rows.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return total.withColumn("used", F.when(F.col("containers") > 0, F.col("tokens") / (F.col("containers") * packing.CAPACITY)))


def p9_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the containers, in one row: every document is placed, none is too full, and they are nearly as few as can be."""
    rows = cut_lineage(_packed(spark, folder))
    filled = rows.where("container IS NOT NULL").groupBy("container").agg(F.sum("tokens").alias("tokens"))
    held = filled.agg(F.count(F.lit(1)).alias("n"), F.max("tokens").alias("most"), F.sum("tokens").alias("tokens")).first()
    fits, tight = (held.most or 0) <= packing.CAPACITY, held.n <= -(-(held.tokens or 0) // packing.CAPACITY) * 1.02 + 1
    return rows.agg(F.countDistinct("doc_id").alias("documents")).select("documents", F.lit(fits).alias("fits"), F.lit(tight).alias("tight"))


# 10 ---------------------------------------------------------------------------------------------------------


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return skeleton.look_alike_pairs(read(spark, folder, "documents"))


def p10_forms(spark: SparkSession, folder: str) -> DataFrame:
    return skeleton.with_skeleton(read(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "skeleton")


def p10_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each document that another one looks like: the smallest id of its look, and how many documents with other strings look the same."""
    return skeleton.look_alike_members(read(spark, folder, "documents"))


def _with_workers(f):
    """The query, after the package has been sent to Python workers that cannot import it."""

    @functools.wraps(f)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return f(spark, folder)

    return run


QUERIES = {
    f.__name__: _with_workers(f)
    for f in (
        p1_found, p1_counts, p1_pictures, p2_found, p3_found, p3_mix, p3_shares, p3_token_shares, p3_checks, p4_found, p4_splits, p4_checks, p5_found, p5_counts, p6_found, p6_records,
        p7_found, p7_sample, p7_report, p7_checks, p8_ids, p8_round_trip, p9_found, p9_containers, p9_fill, p9_checks, p10_found, p10_forms,
        p10_classes,
    )
}
