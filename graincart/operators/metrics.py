"""Evaluation metrics as single passes over predictions; every metric of an empty input is 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graincart.functions.rewards import EVALUATION_MODULES, RewardInput, composite
from graincart.functions.text import best_exact_match, infer_decision, normalize_label


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def accuracy(reference: Column, prediction: Column, where: Column) -> Column:
    """Aggregate: share of the rows of `where` whose label forms agree."""
    return _ratio(F.count_if(where & (normalize_label(reference) == normalize_label(prediction))).cast("double"), F.count_if(where))


def macro_f1(rows: DataFrame, reference: str, prediction: str, by: list[str]) -> DataFrame:
    """`by` and label_macro_f1: the mean F1 over the labels that references or predictions have.

    Each row adds to its two labels at most, so that one aggregation by label does for all of them.
    """
    ref, pred = normalize_label(reference), normalize_label(prediction)
    one, zero = F.lit(1), F.lit(0)

    def part(label: Column, tp: Column, fp: Column, fn: Column) -> Column:
        return F.struct(label.alias("label"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))

    both = F.when(ref == pred, F.array(part(ref, one, zero, zero))).otherwise(F.array(part(ref, zero, zero, one), part(pred, zero, one, zero)))
    labels = rows.select(*by, F.explode(both).alias("x")).groupBy(*by, "x.label").agg(F.sum("x.tp").alias("tp"), F.sum("x.fp").alias("fp"), F.sum("x.fn").alias("fn"))
    f1 = F.when(F.col("tp") > 0, F.col("tp") * 2.0 / (F.col("tp") * 2 + F.col("fp") + F.col("fn"))).otherwise(F.lit(0.0))
    return labels.groupBy(*by).agg(F.avg(f1).alias("label_macro_f1"))


def exact_match_rate(references: Column, prediction: Column, where: Column) -> Column:
    """Aggregate: mean of the best exact match over the rows of `where`."""
    return F.coalesce(F.avg(F.when(where, best_exact_match(references, prediction))), F.lit(0.0))


def decision_metrics(reference: Column, prediction: Column, where: Column) -> dict[str, Column]:
    """Aggregates of clarify against everything else."""
    expected, said = reference == "clarify", infer_decision(prediction) == "clarify"
    tp, fp, fn, tn = (F.count_if(where & a & b).cast("double") for a, b in ((expected, said), (~expected, said), (expected, ~said), (~expected, ~said)))
    total = tp + fp + fn + tn
    return {
        "clarify_accuracy": _ratio(tp + tn, total), "clarify_precision": _ratio(tp, tp + fp), "clarify_recall": _ratio(tp, tp + fn), "unnecessary_clarification_rate": _ratio(fp, fp + tn),
        "premature_answer_rate": _ratio(fn, tp + fn), "predicted_clarify_rate": _ratio(tp + fp, total), "expected_clarify_rate": _ratio(tp + fn, total),
    }


def _references(answer: Column, acceptable: Column, default: Column) -> Column:
    return F.when(F.coalesce(F.size(acceptable), F.lit(0)) > 0, acceptable).otherwise(F.array(default))


def local_bundle(rows: DataFrame, by: list[str]) -> DataFrame:
    """The metrics of the local holdout for each group `by`, over rows with target, verifier, reward_meta and prediction.

    Decision metrics are null where no row has a decision, as if they were left out.
    """
    target, said = F.col("target"), F.coalesce(F.col("prediction"), F.lit(""))
    label, answer, decision = target["canonical_label"], target["answer_text"], target["decision"]
    has_label, has_answer, has_decision = (F.coalesce(c, F.lit("")) != "" for c in (label, answer, decision))
    reward = composite(RewardInput.of(said, target, F.col("verifier"), F.col("reward_meta")), EVALUATION_MODULES)["total"]
    keys = by or ["_all"]
    rows = rows if by else rows.withColumn("_all", F.lit(1))
    some = F.count_if(has_decision) > 0
    plain = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_examples"), accuracy(label, said, has_label).alias("label_accuracy"), exact_match_rate(_references(answer, target["acceptable_answers"], answer), said, has_answer).alias("answer_exact_match"),
        F.avg(reward).alias("average_reward"), *[F.when(some, c).alias(n) for n, c in decision_metrics(decision, said, has_decision).items()],
    )
    f1 = macro_f1(rows.where(has_label).withColumn("_ref", label).withColumn("_said", said), "_ref", "_said", keys)
    joined = plain.join(f1, keys, "left").withColumn("label_macro_f1", F.coalesce("label_macro_f1", F.lit(0.0)))
    return joined if by else joined.drop("_all")


def track_bundle(rows: DataFrame, by: list[str]) -> DataFrame:
    """The metrics of a benchmark track: exact match over all rows, and decisions where there are any."""
    target, said = F.col("target"), F.coalesce(F.col("prediction"), F.lit(""))
    decision = target["decision"]
    has = F.coalesce(decision, F.lit("")) != ""
    references = _references(target["answer_text"], target["acceptable_answers"], F.coalesce(target["answer_text"], F.lit("")))
    some = F.count_if(has) > 0
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_examples"), exact_match_rate(references, said, F.lit(True)).alias("answer_exact_match"),
        *[F.when(some, c).alias(n) for n, c in decision_metrics(decision, said, has).items()],
    )
