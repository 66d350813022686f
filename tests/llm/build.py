"""Small tables in the shape of the test tables."""

import json
import zlib

from pyspark.sql import functions as F

MANIFEST = (
    "ord bigint, sample_id string, source_dataset string, task_type string, split string, images array<string>, messages array<struct<role:string,content:array<struct<type:string,text:string,image:string>>>>, "
    "target struct<answer_text:string,canonical_label:string,canonical_labels:array<string>,decision:string,structured:string,acceptable_answers:array<string>>, metadata string, ingested_at timestamp"
)
SCHEMAS = {
    "manifest": MANIFEST,
    "image_index": "image_path string, content_sha string, fingerprint bigint, width int, height int, n_bytes bigint, captured_at timestamp",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, doc_kind string, crop string, published_at timestamp",
    "dataset_registry": "source_dataset string, task_family string, normalizer string, default_task_type string, include_in_sft boolean, include_in_rl boolean, include_in_eval boolean",
    "mix_targets": "source_dataset string, target_permille int, max_repeats int",
    "split_targets": "split string, target_permille int",
    "sample_targets": "source_dataset string, task_type string, split string, target_permille int, min_records int",
}


def record(i, question="Which crop is shown?", answer="It is a tomato plant.", images=("a.jpg",), source="src", task="vqa", split="train", label=None, meta=None, ord=None):
    return {
        "ord": len(str(i)) * 1000 + zlib.crc32(str(i).encode()) % 1000 if ord is None else ord, "sample_id": f"s{i}", "source_dataset": source, "task_type": task, "split": split, "images": None if images is None else list(images),
        "messages": [{"role": "system", "content": [{"type": "text", "text": "Answer."}]}, {"role": "user", "content": [*[{"type": "image", "image": p} for p in images or ()], {"type": "text", "text": question}]}],
        "target": {"answer_text": answer, "canonical_label": label}, "metadata": json.dumps(meta or {}), "ingested_at": None,
    }


def frame(spark, name, rows):
    lines = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    return lines.select(F.from_json("value", SCHEMAS[name]).alias("r")).select("r.*")


def folder(spark, path, extra=None, **tables):
    """A folder of tables; those not given are empty. `extra` adds columns to each."""
    for name in SCHEMAS:
        df = frame(spark, name, tables.get(name, []))
        for column in extra or ():
            if column not in df.columns:
                df = df.withColumn(column, F.lit(1))
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


TARGETS = {
    "mix_targets": [{"source_dataset": "src", "target_permille": 600, "max_repeats": 2}, {"source_dataset": "Other ", "target_permille": 400, "max_repeats": 1}],
    "dataset_registry": [{"source_dataset": "src", "task_family": "sft"}, {"source_dataset": "other", "task_family": "sft"}],
    "split_targets": [{"split": "train", "target_permille": 800}, {"split": "validation", "target_permille": 100}, {"split": "test", "target_permille": 100}],
    "sample_targets": [{"source_dataset": "src", "task_type": "vqa", "split": "train", "target_permille": 700, "min_records": 1}, {"source_dataset": "other", "task_type": "vqa", "split": "dev", "target_permille": 300, "min_records": 2}],
}
