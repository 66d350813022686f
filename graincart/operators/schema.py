"""The unified row: its types and the check of every rule on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graincart.functions.text import normalize_edges

#: Fixed values of the unified row.
TASK_TYPES = ("classification", "vqa", "symptom_explanation", "consultation", "clarify_or_respond")
SPLITS = ("train", "validation", "test", "holdout", "dev")
ROLES = ("system", "user", "assistant")
DECISIONS = ("clarify", "respond")
VERIFIER_MODES = ("none", "exact_match", "label", "synonym", "structured", "clarify")

MESSAGES = "array<struct<role:string,content:array<struct<type:string,text:string,image:string>>>>"
TARGET = "struct<answer_text:string,canonical_label:string,canonical_labels:array<string>,decision:string,structured:string,acceptable_answers:array<string>>"
VERIFIER = (
    "struct<mode:string,accepted_answers:array<string>,accepted_labels:array<string>,synonyms:map<string,array<string>>,required_sections:array<string>,"
    "expected_decision:string,management_keywords:array<string>,forbidden_claims:array<string>,uncertainty_required:boolean>"
)
REWARD_META = "struct<weights:map<string,double>,task_difficulty:string,allow_clarification:boolean,structured_output_required:boolean>"
FIELDS = {
    "sample_id": "string", "source_dataset": "string", "task_type": "string", "split": "string", "images": "array<string>",
    "messages": MESSAGES, "target": TARGET, "metadata": "string", "verifier": VERIFIER, "reward_meta": REWARD_META,
}
#: `metadata` and `target.structured` are JSON text, since their keys are free.
UNIFIED = ", ".join(f"{name} {kind}" for name, kind in FIELDS.items())


def unified_type() -> T.StructType:
    return T.StructType([T.StructField(name, T.DataType.fromDDL(kind)) for name, kind in FIELDS.items()])


def _full(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def _any(array: Column, test) -> Column:
    return F.coalesce(F.exists(array, test), F.lit(False))


def violations() -> Column:
    """Codes of the rules that a row breaks, in a fixed order; an empty array for a valid one."""
    none = F.array().cast("array<string>")

    def bad_part(p: Column) -> Column:
        kind = F.coalesce(p["type"], F.lit(""))
        return ~kind.isin("text", "image") | ((kind == "text") & ~_full(p["text"])) | ((kind == "image") & ~_full(p["image"]))

    target, verifier = F.col("target"), F.col("verifier")
    structured = F.regexp_replace(F.coalesce(target["structured"], F.lit("")), r"\s", "")
    said = _full(target["answer_text"]) | _full(target["canonical_label"]) | (F.size(F.coalesce(target["canonical_labels"], none)) > 0) | _full(target["decision"]) | ~structured.isin("", "{}", "null") | (F.size(F.coalesce(target["acceptable_answers"], none)) > 0)
    rules = [
        ("sample_id", normalize_edges("sample_id") == ""),
        ("source_dataset", normalize_edges("source_dataset") == ""),
        ("task_type", ~F.coalesce(F.col("task_type"), F.lit("")).isin(*TASK_TYPES)),
        ("split", ~F.coalesce(F.col("split"), F.lit("")).isin(*SPLITS)),
        ("images_empty", F.size(F.coalesce(F.col("images"), none)) < 1),
        ("images_blank", _any(F.col("images"), lambda p: ~_full(p))),
        ("messages_empty", F.coalesce(F.size("messages"), F.lit(0)) < 1),
        ("role", _any(F.col("messages"), lambda m: ~F.coalesce(m["role"], F.lit("")).isin(*ROLES))),
        ("content_empty", _any(F.col("messages"), lambda m: F.coalesce(F.size(m["content"]), F.lit(0)) < 1)),
        ("content", _any(F.col("messages"), lambda m: _any(m["content"], bad_part))),
        ("target_empty", ~F.coalesce(said, F.lit(False))),
        ("decision", F.coalesce(~target["decision"].isin(*DECISIONS), F.lit(False))),
        ("verifier_mode", F.coalesce(~verifier["mode"].isin(*VERIFIER_MODES), F.lit(False))),
        ("expected_decision", F.coalesce(~verifier["expected_decision"].isin(*DECISIONS), F.lit(False))),
    ]
    return F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in rules]))


def unknown_keys(json_text: Column, known: tuple[str, ...] = tuple(FIELDS)) -> Column:
    """Keys of a raw row that the schema lacks; each is an error. Broken JSON has none."""
    return F.array_except(F.coalesce(F.json_object_keys(json_text), F.array().cast("array<string>")), F.array(*[F.lit(k) for k in known]))


def with_violations(rows: DataFrame) -> DataFrame:
    """`rows` with the ids stripped of white space and a column `violations`."""
    return rows.withColumn("violations", violations()).withColumns({c: normalize_edges(c) for c in ("sample_id", "source_dataset")})


def validate(rows: DataFrame) -> DataFrame:
    """`rows` with stripped ids; the first row that breaks a rule makes the job fail."""
    checked = with_violations(rows)
    message = F.concat(F.lit("invalid row "), F.coalesce(F.col("sample_id"), F.lit("")), F.lit(": "), F.array_join("violations", ", "))
    kept = F.when(F.size("violations") > 0, F.raise_error(message).cast("string")).otherwise(F.col("sample_id"))
    return checked.withColumn("sample_id", kept).drop("violations")
