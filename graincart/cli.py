"""Commands: python -m graincart.cli <command> ... Each prints a JSON summary and exits with 0, or 1 on a failed check."""

from __future__ import annotations

import argparse
import datetime
import json
import os
import shutil
import socket
import sys
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graincart.operators import reports
from graincart.plans import build, evaluate, normalize, runs
from graincart.session import build_session
from graincart.sources import files, paths


def _write(rows: DataFrame, path: str) -> int:
    files.write_manifest(rows, path)
    return rows.count()


def _scope(a: argparse.Namespace) -> tuple[str, str]:
    """Subset tag and data root of a command; what isn't given is the registry's default."""
    settings = paths.runtime_settings(files.load_yaml(a.config).get("defaults") or {}, ".", a.mode, a.fraction, root=a.data_root)
    a.mode, a.fraction = settings["download_mode"], settings["sample_fraction"]
    return settings["subset_tag"], settings["data_root"]


def _manifests(spark: SparkSession, given: list[str]) -> tuple[list[DataFrame], list[str]]:
    found = [p for p in given if os.path.exists(p)]
    return [files.read_manifest(spark, p) for p in found], [p for p in given if p not in found]


def run_normalize(spark: SparkSession, a: argparse.Namespace) -> tuple[dict[str, Any], int]:
    """Every data set of the registry: raw records to a manifest. Missing raw data is a status, anything else, a missing picture too, an error."""
    specs, (tag, root) = paths.load_registry(a.config), _scope(a)
    out: dict[str, Any] = {}
    for name in a.datasets or list(specs):
        spec = specs[name]
        where = {"data_root": root, "subset_tag": tag, "dataset_name": name}
        raw, target = paths.render(spec.raw_dir, **where), paths.render(spec.interim_path, **where)
        record_file = files.find_records_file(raw) if os.path.isdir(raw) else None
        prefix = paths.relative_posix(raw, ".") + "/"
        options = {"prefix": prefix, "license_name": spec.license_name, "provenance": files.provenance(raw) if os.path.isdir(raw) else {}}
        if os.path.exists(os.path.join(raw, "train.txt")):
            rows = normalize.split_lists(files.read_split_lists(spark, raw), files.read_class_list(spark, raw), name, **options)
        elif record_file:
            rows = files.read_payloads(spark, record_file)
            rows = normalize.normalize(rows, name, spec.normalizer, spec.default_task_type, **options)
        elif files.has_raw_data(raw):
            pictures = files.scan_images(spark, raw).select(F.expr(f"substring(path, instr(path, '{raw}') + {len(raw) + 1})").alias("path"))
            rows = normalize.classification_directory(files.with_index(pictures), name, f"{name}-v1", pest=spec.normalizer == "ip102", **options)
        else:
            out[name] = {"status": "missing_raw", "reason": raw}
            continue
        # written once beside its place, and moved there if its pictures are all there
        made = f"{target}.new"
        files.write_manifest(rows, made)
        written = spark.read.schema("sample_id string, images array<string>").json(made)
        try:
            files.require_images(written, os.getcwd())
            n = written.count()
            shutil.rmtree(target, ignore_errors=True)
            os.rename(made, target)
        finally:
            shutil.rmtree(made, ignore_errors=True)
        out[name] = {"status": "normalized", "rows": n, "path": target}
    return {"subset_tag": tag, "download_mode": a.mode, "sample_fraction": a.fraction, "summary": out}, 0


def run_build_sft(spark: SparkSession, a: argparse.Namespace) -> tuple[dict[str, Any], int]:
    sources, missing = _manifests(spark, a.sources)
    return {"rows": _write(build.build_sft(sources, most=a.max_per_source), a.output), "missing": missing}, 0


def run_build_rl(spark: SparkSession, a: argparse.Namespace) -> tuple[dict[str, Any], int]:
    sources, missing = _manifests(spark, a.sources)
    return {"rows": _write(build.build_rl(sources, most_words=a.max_words, most_images=a.max_images), a.output), "missing": missing}, 0


def run_build_eval(spark: SparkSession, a: argparse.Namespace) -> tuple[dict[str, Any], int]:
    named = dict(s.split("=", 1) for s in a.sources)
    there = {k: files.read_manifest(spark, p) for k, p in named.items() if os.path.exists(p)}
    bench = files.read_manifest(spark, a.benchmark) if a.benchmark and os.path.exists(a.benchmark) else None
    made = build.build_eval(bench, there, a.salt, a.ratio)
    return {"rows": {k: _write(v, os.path.join(a.output, k)) for k, v in made.items()}, "missing": [k for k in named if k not in there]}, 0


def run_build_train_eval(spark: SparkSession, a: argparse.Namespace) -> tuple[dict[str, Any], int]:
    train, chosen, summary = build.build_train_eval(files.read_manifest(spark, a.source), files.read_manifest(spark, a.holdout), a.salt, sample=a.sample, floor=a.floor)
    keep = [f for f in train.columns if f not in ("group_key", "reason")]
    files.write_manifest(train.select(*keep), a.train_output)
    files.write_manifest(chosen.select(*[f for f in keep if f in chosen.columns and f != "ord"]), a.eval_output)
    return summary, 0


def run_validate_images(spark: SparkSession, a: argparse.Namespace) -> tuple[dict[str, Any], int]:
    rows = files.read_manifest(spark, a.manifest, checked=False)
    root = os.path.abspath(a.root)
    wanted = reports.unique_images(rows).select("image", F.concat(F.lit(root + "/"), "image").alias("full"))
    checked = wanted.join(files.file_errors(wanted, "full").withColumnRenamed("path", "full"), "full").select("image", "error")
    marked = reports.image_errors(rows, checked)
    if a.valid_output and a.invalid_output:
        files.write_valid_and_invalid(marked, a.valid_output, a.invalid_output)
    by = {r.source_dataset: r.asDict() for r in reports.validation_summary(marked).collect()}
    bad = sum(r["invalid_rows"] for r in by.values())
    return {"by_dataset": by, "total_rows": sum(r["rows"] for r in by.values()), "invalid_rows": bad}, int(bool(bad) and not (a.allow_invalid and a.invalid_output))


def run_evaluate(spark: SparkSession, a: argparse.Namespace) -> tuple[dict[str, Any], int]:
    """Tasks given as name=manifest, with predictions read from JSONL in mode model. The run leaves what it was given and where its outputs are."""
    artifacts = runs.prepare_run("evaluate", a.output, {k: v for k, v in vars(a).items() if k != "run"})
    given = spark.read.json(a.predictions) if a.predictions else None
    tasks = []
    for entry in a.tasks:
        name, path = entry.split("=", 1)
        metrics, rows = evaluate.run_task(name, files.read_manifest(spark, path), a.mode, given, a.max_examples)
        found = metrics.first()
        values = {k: v for k, v in (found.asDict() if found else {"num_examples": 0}).items() if v is not None and k != "task"}
        target = os.path.join(a.output, name)
        files.write_json(os.path.join(target, "metrics.json"), values)
        files.write_jsonl(rows, os.path.join(target, "predictions"))
        tasks.append({"task": name, "manifest_path": path, "metrics_path": os.path.join(target, "metrics.json"), "predictions_path": os.path.join(target, "predictions"), "num_predictions": rows.count(), "metrics": values})
    summary = {"created_at_utc": datetime.datetime.now(datetime.timezone.utc).isoformat(), "hostname": socket.gethostname(), "prediction_mode": a.mode, "checkpoint_path": a.checkpoint, "tasks": tasks}
    files.write_json(os.path.join(a.output, "summary.json"), summary)
    runs.write_run_manifest(artifacts, {"tasks": [t["task"] for t in tasks]})
    return summary, 0


def run_export_tables(spark: SparkSession, a: argparse.Namespace) -> tuple[dict[str, Any], int]:
    """Summaries given as model=path, to one table in CSV and Markdown."""
    rows = []
    for entry in a.runs:
        model, path = entry.split("=", 1)
        path = os.path.join(path, "summary.json") if os.path.isdir(path) else path
        with open(path, encoding="utf-8") as f:
            summary = json.load(f)
        for t in summary.get("tasks") or []:
            metrics = {k: float(v) for k, v in (t.get("metrics") or {}).items()}
            rows.append((model, t.get("task"), summary.get("checkpoint_path"), summary.get("prediction_mode"), t.get("num_predictions"), t.get("manifest_path"), t.get("metrics_path"), t.get("predictions_path"), metrics))
    if not rows:
        raise ValueError("no task in the given summaries")
    keys = ["model_name", "task", "checkpoint_path", "prediction_mode", "num_predictions", "manifest_path", "metrics_path", "predictions_path"]
    long = spark.createDataFrame(rows, "model_name string, task string, checkpoint_path string, prediction_mode string, num_predictions bigint, manifest_path string, metrics_path string, predictions_path string, metrics map<string,double>")
    wide = reports.pivot_metrics(long, keys, sorted({k for r in rows for k in r[-1]}))
    files.write_table(wide, os.path.join(a.output, "csv"))
    shown = ["model_name", "task", "num_predictions", *[c for c in wide.columns if c.startswith("metric_")]]
    with open(os.path.join(a.output, "results.md"), "w", encoding="utf-8") as f:
        f.write("# Benchmark Results\n\n" + files.markdown_table(wide, shown))
    return {"rows": len(rows)}, 0


#: What the names of a group's metrics contain.
METRIC_GROUPS = {"loss": ["loss"], "reward": ["reward"], "accuracy": ["accuracy", "exact_match", "f1"], "learning_rate": ["learning_rate"]}


def run_export_metrics(spark: SparkSession, a: argparse.Namespace) -> tuple[dict[str, Any], int]:
    """A trainer's JSONL log to a CSV table, with the metrics by group."""
    log = spark.read.json(a.log)
    if log.isEmpty():
        raise ValueError(f"{a.log} is empty")
    names = files.write_metrics_table(log, a.output)
    return {"available_numeric_metrics": names, "groups": {g: reports.matching_keys(names, n) for g, n in METRIC_GROUPS.items()}}, 0


#: Made-up records for a trial of the whole chain, by normaliser.
SMOKE = {
    "classification_records": [{"id": "a", "image": "images/a.jpg", "label": "Apple___Scab", "split": "train"}, {"id": "b", "image": "images/b.jpg", "all_labels": ["Rust", "Rust", "Mildew"], "split": "validation"}],
    "vqa_records": [{"id": "a", "image": "images/a.jpg", "question": "Is it ill?", "answer": "yes", "split": "train"}, {"id": "b", "images": ["images/a.jpg", "images/b.jpg"], "query": "Which crop?", "response": "apple", "decision": "clarify", "task_type": "clarify_or_respond", "split": "test"}],
    "consultation_records": [{"id": "a", "image": "images/a.jpg", "question": "What now?", "diagnosis": "Scab", "management_steps": ["prune", "mulch"], "split": "train"}],
}


#: A grey picture of one pixel.
SMOKE_PICTURE = bytes.fromhex("89504e470d0a1a0a0000000d49484452000000010000000108000000003a7e9b550000000a49444154789c63680000008200817746a4ef0000000049454e44ae426082")


def run_prepare_slots(spark: SparkSession, a: argparse.Namespace) -> tuple[dict[str, Any], int]:
    """A folder with a note for every data set that has no raw data yet, or with made-up records."""
    specs, (tag, root) = paths.load_registry(a.config), _scope(a)
    out = {}
    for name, spec in specs.items():
        raw = paths.render(spec.raw_dir, data_root=root, subset_tag=tag, dataset_name=name)
        if files.has_raw_data(raw):
            out[name] = "present"
        elif a.with_smoke_data:
            records = SMOKE.get(spec.normalizer, SMOKE["classification_records"])
            files.write_sidecar(raw, {"dataset_name": name, "subset_tag": tag, "download_mode": a.mode, "sample_fraction": a.fraction, "source_type": "smoke", "materialized": True, "manual_required": False, "saved_rows": len(records)})
            files.first_of_stream(records, None, os.path.join(raw, "records.jsonl"))
            for picture in {p for r in records for p in [r.get("image"), *r.get("images", [])] if p}:
                os.makedirs(os.path.dirname(os.path.join(raw, picture)), exist_ok=True)
                with open(os.path.join(raw, picture), "wb") as f:
                    f.write(SMOKE_PICTURE)
            out[name] = "smoke"
        else:
            files.manual_slot(raw, name, "its raw files are not here yet")
            out[name] = "manual_required"
    return out, 0


def run_benchmark_status(spark: SparkSession, a: argparse.Namespace) -> tuple[dict[str, Any], int]:
    """Benchmarks of a YAML file: ready if implemented and no required path is missing."""
    data = files.load_yaml(a.config)
    tag, root = _scope(a)
    rows = [
        (b["name"], b.get("implementation_status", "planned"), (at := paths.render(p["path"], data_root=root, subset_tag=tag)), bool(p.get("required", True)), os.path.exists(at))
        for b in data.get("benchmarks") or [] for p in b.get("readiness_paths") or [{"path": root, "required": False}]
    ]
    table = reports.readiness(spark.createDataFrame(rows, "name string, implementation_status string, path string, required boolean, exists boolean"))
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write("# Benchmark Status\n\n" + files.markdown_table(table, table.columns))
    return {"subset_tag": tag, "benchmarks": [r.asDict() for r in table.orderBy("name").collect()]}, 0


def run_dataset_report(spark: SparkSession, a: argparse.Namespace) -> tuple[dict[str, Any], int]:
    specs, (tag, root) = paths.load_registry(a.config), _scope(a)
    counts, downloads = [], []
    for name, spec in specs.items():
        where = {"data_root": root, "subset_tag": tag, "dataset_name": name}
        raw, target = paths.render(spec.raw_dir, **where), paths.render(spec.interim_path, **where)
        if os.path.exists(target):
            counts.append((name, files.read_manifest(spark, target, checked=False).count()))
        if sidecar := files.read_sidecar(raw):
            downloads.append((name, bool(sidecar.get("manual_required"))))
    report = reports.dataset_report(paths.registry_table(spark, specs), spark.createDataFrame(counts, "source_dataset string, rows bigint"), spark.createDataFrame(downloads, "source_dataset string, manual_required boolean"))
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(f"# Dataset Report\n\nSubset tag: `{tag}`\n\n" + files.markdown_table(report.orderBy("source_dataset"), report.columns))
    return {"subset_tag": tag, "datasets": {r.source_dataset: r.asDict() for r in report.collect()}}, 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="graincart", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, run, *arguments: tuple[str, dict[str, Any]]) -> None:
        p = commands.add_parser(name, help=(run.__doc__ or "").strip().split("\n")[0])
        p.set_defaults(run=run)
        for flag, options in arguments:
            p.add_argument(flag, **options)

    need, many, whole = {"required": True}, {"nargs": "+", "required": True}, {"type": int}
    scope = (("--mode", {}), ("--fraction", {"type": float}), ("--data-root", {}))
    add("normalize", run_normalize, ("--config", need), ("--datasets", {"nargs": "*"}), *scope)
    add("build-sft", run_build_sft, ("--sources", many), ("--output", need), ("--max-per-source", whole))
    add("build-rl", run_build_rl, ("--sources", many), ("--output", need), ("--max-words", {**whole, "default": build.RL_MOST_WORDS}), ("--max-images", {**whole, "default": build.RL_MOST_IMAGES}))
    add("build-eval", run_build_eval, ("--benchmark", {}), ("--sources", {"nargs": "*", "default": []}), ("--output", need), ("--salt", need), ("--ratio", {"type": float, "default": build.HOLDOUT_RATIO}))
    add("build-train-eval", run_build_train_eval, ("--source", need), ("--holdout", need), ("--train-output", need), ("--eval-output", need), ("--salt", need), ("--sample", {**whole, "default": 512}), ("--floor", {**whole, "default": 16}))
    add("validate-images", run_validate_images, ("--manifest", need), ("--root", {"default": "."}), ("--valid-output", {}), ("--invalid-output", {}), ("--allow-invalid", {"action": "store_true"}))
    add("evaluate", run_evaluate, ("--tasks", many), ("--mode", {"default": "oracle", "choices": ["oracle", "model", "echo"]}), ("--predictions", {}), ("--checkpoint", {}), ("--max-examples", {**whole, "default": 0}), ("--output", need))
    add("export-tables", run_export_tables, ("--runs", many), ("--output", need))
    add("export-metrics", run_export_metrics, ("--log", need), ("--output", need))
    add("prepare-slots", run_prepare_slots, ("--config", need), ("--with-smoke-data", {"action": "store_true"}), *scope)
    add("benchmark-status", run_benchmark_status, ("--config", need), ("--output", {}), *scope)
    add("dataset-report", run_dataset_report, ("--config", need), ("--output", {}), *scope)
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    session = spark or build_session()
    try:
        summary, code = a.run(session, a)
        print(json.dumps(summary, indent=2, sort_keys=True, default=str))
        return code
    finally:
        if spark is None:
            session.stop()


if __name__ == "__main__":
    sys.exit(main())
