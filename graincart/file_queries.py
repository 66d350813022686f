"""Readers, writers and commands as queries: rows of the test tables are written to files in a scratch folder and read again.

The SQL states on the tables what must come back.
"""

from __future__ import annotations

import argparse
import atexit
import json
import os
import shutil
import tarfile
import uuid
import zipfile
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graincart import cli
from graincart.functions import rewards as R
from graincart.operators import manifests as M
from graincart.operators import sampling as S
from graincart.operators.schema import FIELDS, SPLITS, TASK_TYPES, with_violations
from graincart.plans import normalize as N
from graincart.plans import runs, stage
from graincart.queries import _RULES, _SCORED, _in, _nl, _raw, _scored, _vqa_sql, query, read
from graincart.session import ensure_checkpoint_dir, ship_package
from graincart.sources import files, paths
from graincart.streaming import metrics_log

_MADE: list[str] = []
#: First bytes of pictures and of what isn't one.
HEADS = {"jpeg": "FFD8FFE000104A46", "png": "89504E470D0A1A0A0000", "bmp": "424D36000C00", "webp": "524946462400000057454250", "riff": "524946462400000057415645", "pdf": "255044462D312E37", "gif": "474946383961"}


@atexit.register
def _clean() -> None:
    for folder in _MADE:
        shutil.rmtree(folder, ignore_errors=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder of checkpoints, deleted at the end of the process."""
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    folder = os.path.join("/" + root.lstrip("/"), f"{name}-{uuid.uuid4().hex}")
    os.makedirs(folder)
    _MADE.append(folder)
    return folder


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _write(path: str, content: str | bytes) -> str:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content.encode() if isinstance(content, str) else content)
    return path


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    """Rows of a fixed table (nations, regions, the registry), which has the same few rows at every scale."""
    return [r.asDict(recursive=True) for r in df.collect()]


# ---------------------------------------------------------------- scans


@query("SELECT doc_id, text, lang FROM documents")
def scan_jsonl(spark: SparkSession, folder: str) -> DataFrame:
    at = scratch(spark, "jsonl")
    files.write_jsonl(read(spark, folder, "documents").select("doc_id", "text", "lang"), at)
    return files.read_jsonl(spark, at, "doc_id bigint, text string, lang string").drop("ord")


@query("SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) * 2 - 1 AS ord FROM nation")
def scan_jsonl_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Blank lines give no rows, but count as lines."""
    made = _rows(read(spark, folder, "nation").orderBy("n_nationkey"))
    path = _write(os.path.join(scratch(spark, "lines"), "a.jsonl"), "".join(json.dumps(r) + "\n \n" for r in made))
    return files.read_jsonl(spark, path, "n_nationkey int, n_name string").select("n_nationkey", "n_name", "ord")


@query("SELECT n_nationkey, n_name, row_number() OVER (PARTITION BY kind ORDER BY n_nationkey) AS ord, kind FROM nation, (VALUES ('list'), ('data')) t(kind)")
def scan_json(spark: SparkSession, folder: str) -> DataFrame:
    """A list, and an object with one; what is no object is dropped."""
    made, at = _rows(read(spark, folder, "nation").orderBy("n_nationkey")), scratch(spark, "json")
    files.write_json(os.path.join(at, "list.json"), [x for r in made for x in (1, r, "x")])
    files.write_json(os.path.join(at, "data.json"), {"data": [*made, None]})
    both = [files.read_records(spark, os.path.join(at, f"{k}.json"), "n_nationkey int, n_name string").withColumn("kind", F.lit(k)) for k in ("list", "data")]
    return both[0].unionByName(both[1])


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand, kind FROM part, (VALUES ('csv'), ('tsv')) t(kind)")
def scan_csv(spark: SparkSession, folder: str) -> DataFrame:
    at, rows = scratch(spark, "csv"), read(spark, folder, "part").select("p_partkey", "p_name", "p_brand")
    both = []
    for kind, sep in (("csv", ","), ("tsv", "\t")):
        rows.write.csv(os.path.join(at, f"rows.{kind}"), header=True, sep=sep, quote='"', escape='"')
        both.append(files.read_records(spark, os.path.join(at, f"rows.{kind}"), "").withColumn("kind", F.lit(kind)))
    return both[0].unionByName(both[1])


_NAMES = ["records.jsonl", "records.json", "annotations.jsonl", "annotations.json", "dataset.jsonl", "dataset.json"]


@query(
    f"SELECT n_nationkey, CASE WHEN n_nationkey % 8 < 6 THEN {_in(_NAMES).replace('(', '[').replace(')', ']')}[n_nationkey % 8 + 1] WHEN n_nationkey % 8 = 6 THEN 'sub/a.csv' END AS found, n_nationkey % 8 < 7 OR n_nationkey % 2 = 1 AS raw FROM nation"
)
def record_files(spark: SparkSession, folder: str) -> DataFrame:
    """The file of records found in each of several folders, and whether there is raw data: the preferred names in their order, else the first one below, sidecars never."""
    out, at = [], scratch(spark, "found")
    for r in _rows(read(spark, folder, "nation")):
        key = r["n_nationkey"]
        root = os.path.join(at, str(key))
        _write(os.path.join(root, "DOWNLOAD_INFO.json"), "{}")
        for name in _NAMES[key % 8 :] if key % 8 < 6 else ["sub/b.json", "sub/a.csv"] if key % 8 == 6 else ["im/p.PNG"] if key % 2 else []:
            _write(os.path.join(root, name), "")
        found = files.find_records_file(root)
        out.append((key, found and os.path.relpath(found, root), files.has_raw_data(root)))
    return _table(spark, out, "n_nationkey int, found string, raw boolean")


_HEAD_SQL = "CASE n_nationkey % 7 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(HEADS.values())) + " END"


def _pictures(spark: SparkSession, folder: str, at: str) -> None:
    for r in _rows(read(spark, folder, "nation")):
        suffix = (".jpg", ".PNG", ".webp", ".txt")[r["n_nationkey"] % 4]
        _write(os.path.join(at, r["n_name"].split()[0], f"{r['n_nationkey']:03}{suffix}"), bytes.fromhex(list(HEADS.values())[r["n_nationkey"] % 7]))


_PICTURE = "split_part(n_name, ' ', 1) || '/' || lpad(n_nationkey::VARCHAR, 3, '0') || ['.jpg', '.PNG', '.webp', '.txt'][n_nationkey % 4 + 1]"


@query(f"SELECT {_PICTURE} AS path, row_number() OVER (ORDER BY {_PICTURE}) - 1 AS index, len({_HEAD_SQL}) // 2 AS length FROM nation WHERE n_nationkey % 4 < 3")
def scan_images(spark: SparkSession, folder: str) -> DataFrame:
    """The pictures below a folder in the order of their paths, numbered."""
    at = scratch(spark, "images")
    _pictures(spark, folder, at)
    rows = files.with_index(files.scan_images(spark, at))
    return rows.select(F.expr(f"substring(path, instr(path, '{at}') + {len(at) + 1})").alias("path"), "index", "length")


@query(
    f"WITH h AS (SELECT {_PICTURE} AS path, {_HEAD_SQL} AS h FROM nation) SELECT path, CASE WHEN starts_with(h, 'FFD8FF') OR starts_with(h, '89504E470D0A1A0A') OR starts_with(h, '424D') OR (starts_with(h, '52494646') AND substr(h, 17, 8) = '57454250') THEN NULL "
    "WHEN starts_with(h, '25504446') THEN 'unsupported image signature: PDF document' ELSE 'unsupported image signature: ' || lower(substr(h, 1, 16)) END AS error FROM h UNION ALL SELECT 'none.jpg', 'missing file' UNION ALL SELECT 'sub', 'not a file'"
)
def image_headers(spark: SparkSession, folder: str) -> DataFrame:
    """The first bytes of files, of one that isn't there and of a folder."""
    at = scratch(spark, "headers")
    _pictures(spark, folder, at)
    os.makedirs(os.path.join(at, "sub"))
    listed = files.check_images(spark, at).select("path").unionByName(_table(spark, [(f"{at}/none.jpg",), (f"{at}/sub",)], "path string"))
    return files.file_errors(listed).select(F.expr(f"substring(path, {len(at) + 2})").alias("path"), "error")


_VALID = "len(list_filter([" + ", ".join(f"coalesce({bad}, false)" for _, bad in _RULES) + "], lambda x: x)) = 0"


@query(f"SELECT sample_id, task_type, split, len(images)::INTEGER AS images, target.answer_text AS answer, verifier.mode AS mode, reward_meta.task_difficulty AS difficulty FROM manifest WHERE {_VALID}")
def manifest_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Valid rows, written and read with every rule checked both times."""
    rows, at = with_violations(read(spark, folder, "manifest")).where("size(violations) = 0").select(*FIELDS), scratch(spark, "manifest")
    files.write_manifest(rows, at)
    return files.read_manifest(spark, at).select("sample_id", "task_type", "split", F.size("images").alias("images"), F.col("target.answer_text").alias("answer"), F.col("verifier.mode").alias("mode"), F.col("reward_meta.task_difficulty").alias("difficulty"))


@query(f"SELECT 'valid' AS side, count(*) AS n, count(*) FILTER (WHERE task_type IN {_in(TASK_TYPES)} AND split IN {_in(SPLITS)}) AS known FROM manifest WHERE {_VALID} UNION ALL SELECT 'invalid', count(*), count(*) FILTER (WHERE task_type IN {_in(TASK_TYPES)} AND split IN {_in(SPLITS)}) FROM manifest WHERE NOT ({_VALID})")
def valid_and_invalid(spark: SparkSession, folder: str) -> DataFrame:
    """Rows without and with errors in two files, read without checks; each file's rows are counted by its reader too."""
    at = scratch(spark, "both")
    marked = with_violations(read(spark, folder, "manifest")).select(*FIELDS, F.col("violations").alias("errors"))
    files.write_valid_and_invalid(marked, f"{at}/valid", f"{at}/invalid")
    sides = [files.read_manifest(spark, f"{at}/{side}", checked=False).agg(F.count_if(F.col("task_type").isin(*TASK_TYPES) & F.col("split").isin(*SPLITS)).alias("known")).select(F.lit(side).alias("side"), F.lit(files.manifest_rows(spark, f"{at}/{side}")).alias("n"), "known") for side in ("valid", "invalid")]
    return sides[0].unionByName(sides[1])


@query(
    "SELECT CASE n_regionkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split, 'im/' || n_nationkey || '.jpg' AS path, CASE WHEN n_nationkey % 5 < 4 THEN (n_nationkey % 5)::VARCHAR END AS label_id, "
    "CASE WHEN n_nationkey % 5 < 4 THEN r_name END AS label FROM nation LEFT JOIN region ON r_regionkey = n_nationkey % 5 AND r_regionkey < 4"
)
def scan_split_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Split lists with a class list beside them; blank lines of a class list have no number."""
    at = scratch(spark, "lists")
    lines: dict[int, list[str]] = {}
    for r in _rows(read(spark, folder, "nation")):
        key = r["n_nationkey"]
        lines.setdefault(r["n_regionkey"] % 3, []).append(f" {key}.jpg" + (f"\t{key % 5} \n\n" if key % 5 < 4 else "\n"))
    for i, name in enumerate(("train", "val", "test")):
        _write(os.path.join(at, f"{name}.txt"), "".join(lines[i]))
    _write(os.path.join(at, "class_names.txt"), "".join(f"\n{r['r_name']}\n" for r in _rows(read(spark, folder, "region").orderBy("r_regionkey")) if r["r_regionkey"] < 4))
    rows = stage.rewrite_split_lists(files.read_split_lists(spark, at), "im/")
    return N.with_labels(rows, files.read_class_list(spark, at)).select("split", "path", "label_id", "label")


# ---------------------------------------------------------------- configurations and sidecars

_REGISTRY = "source_dataset, task_family, normalizer, default_task_type"


@query(f"SELECT {_REGISTRY}, task_family = 'eval' AS eval_only FROM dataset_registry")
def registry_yaml(spark: SparkSession, folder: str) -> DataFrame:
    """The registry as YAML: what most entries have stands in the defaults."""
    path = os.path.join(scratch(spark, "registry"), "registry.yaml")
    entries = [{"name": r["source_dataset"], "normalizer": r["normalizer"], "default_task_type": r["default_task_type"], "eval_only": r["task_family"] == "eval", **({} if r["task_family"] == "sft" else {"task_family": r["task_family"]})} for r in _rows(read(spark, folder, "dataset_registry"))]
    files.write_yaml(path, {"defaults": {"task_family": "sft", "access": "public"}, "datasets": entries})
    return paths.registry_table(spark, paths.load_registry(path))


@query("SELECT source_dataset, 'partial_10pct' AS subset_tag, CASE WHEN include_in_rl THEN 'public' END AS access, NULL::VARCHAR AS source_type, include_in_eval AS manual FROM dataset_registry")
def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """What downloads leave about themselves, and what of it is passed on to rows: nulls are not, nor is anything of a slot to be filled by hand."""
    out, at = [], scratch(spark, "sidecars")
    for r in _rows(read(spark, folder, "dataset_registry")):
        root = os.path.join(at, r["source_dataset"])
        if r["include_in_eval"]:
            files.manual_slot(root, r["source_dataset"], "by hand", "https://example.org")
        files.write_sidecar(root, {**files.read_sidecar(root), "subset_tag": "partial_10pct", "access": "public" if r["include_in_rl"] else None, "other": 1})
        found = files.provenance(root)
        out.append((r["source_dataset"], found["subset_tag"], found.get("access"), found.get("source_type"), bool(files.read_sidecar(root).get("manual_required")) and os.path.exists(os.path.join(root, "README.md"))))
    return _table(spark, out, "source_dataset string, subset_tag string, access string, source_type string, manual boolean")


_FRACTION = "[0.01, 0.125, 0.135, 0.3, 1.0][n_nationkey % 5 + 1]::DOUBLE"
_MODE = "CASE WHEN n_regionkey = 0 THEN ' FULL' WHEN n_regionkey = 1 THEN NULL ELSE 'partial' END"


@query(
    f"SELECT n_nationkey, CASE WHEN n_regionkey = 0 OR n_nationkey % 5 = 4 THEN 'full' ELSE 'partial_' || [1, 12, 14, 30][n_nationkey % 5 + 1] || 'pct' END AS tag, CASE WHEN n_regionkey = 0 THEN NULL ELSE greatest(1, floor(n_nationkey * {_FRACTION}))::BIGINT END AS first_rows, "
    "'/data/raw/' || n_name || '/x.jsonl' AS path, 'raw/' || n_name || '/x.jsonl' AS relative, CASE WHEN n_regionkey = 3 THEN 'partial_25pct' ELSE 'full' END AS by_default FROM nation"
)
def subset_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Tags (rounded half to even), prefix limits and paths of settings; an empty fraction is the registry's default."""
    out = []
    for r in _rows(read(spark, folder, "nation")):
        key, region = r["n_nationkey"], r["n_regionkey"]
        mode, fraction = " FULL" if region == 0 else None if region == 1 else "partial", (0.01, 0.125, 0.135, 0.3, 1.0)[key % 5]
        path = paths.render("{data_root}/raw/{name}/x.jsonl", data_root=paths.data_root("/repo", "/data"), name=r["n_name"])
        settings = paths.runtime_settings({"download_mode": "full", "sample_fraction": 0.25}, "/repo", "partial" if region == 3 else "", 0.0 if region != 4 else None, root="/data")
        out.append((key, paths.subset_tag(mode, fraction), paths.prefix_limit(key, mode, fraction), path, paths.relative_posix(path, "/data"), settings["subset_tag"]))
    return _table(spark, out, "n_nationkey int, tag string, first_rows bigint, path string, relative string, by_default string")


@query("SELECT source_dataset, include_in_sft AS available FROM dataset_registry")
def available_sources(spark: SparkSession, folder: str) -> DataFrame:
    at, given = scratch(spark, "sources"), {}
    for r in _rows(read(spark, folder, "dataset_registry")):
        given[r["source_dataset"]] = os.path.join(at, f"{r['source_dataset']}.jsonl")
        if r["include_in_sft"]:
            _write(given[r["source_dataset"]], "{}\n")
    found, missing = paths.existing_sources(given)
    return _table(spark, [*((n, True) for n in found), *((n, False) for n in missing)], "source_dataset string, available boolean")


@query("SELECT n_nationkey, n_name AS run, 'checkpoint-' || [900, 1000][n_regionkey % 2 + 1] AS latest, CASE WHEN n_regionkey % 2 = 0 THEN 'checkpoint-1000,checkpoint-900' ELSE 'checkpoint-1000' END AS listed, n_nationkey AS seed FROM nation")
def run_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """Runs with their settings, metadata and list of outputs; the latest checkpoint is the last one by name."""
    out, at = [], scratch(spark, "runs")
    for r in _rows(read(spark, folder, "nation")):
        run = runs.prepare_run("sft", os.path.join(at, r["n_name"]), {"seed": r["n_nationkey"]})
        for step in (900, 1000) if r["n_regionkey"] % 2 == 0 else (1000,):
            os.makedirs(run.at(f"checkpoint-{step}"))
        with open(runs.write_run_manifest(run), encoding="utf-8") as f:
            listed = json.load(f)
        latest = files.resume_checkpoint(run.folder, "auto")
        out.append((r["n_nationkey"], listed["run_name"], os.path.basename(latest or ""), ",".join(listed["checkpoints"]), files.load_yaml(listed["resolved_config"])["settings"]["seed"]))
    return _table(spark, out, "n_nationkey int, run string, latest string, listed string, seed int")


# ---------------------------------------------------------------- sinks


@query("SELECT event_type, model_name, task, metric_n, metric_total FROM (SELECT event_type, 'm' AS model_name, 't-' || event_type AS task, count(*)::VARCHAR AS metric_n, round(max(value), 3)::VARCHAR AS metric_total FROM events GROUP BY event_type)")
def results_csv(spark: SparkSession, folder: str) -> DataFrame:
    """A results table as CSV, known columns first, read again."""
    at = os.path.join(scratch(spark, "table"), "csv")
    rows = read(spark, folder, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("metric_n"), F.round(F.max("value"), 3).alias("metric_total"))
    files.write_table(rows.withColumns({"task": F.concat(F.lit("t-"), "event_type"), "model_name": F.lit("m")}), at)
    back = spark.read.csv(at, header=True)
    if back.columns[:2] != ["model_name", "task"]:
        raise AssertionError(back.columns)
    return back


@query("SELECT i::BIGINT AS line, CASE i WHEN 0 THEN '| r_regionkey | r_name |' WHEN 1 THEN '| --- | --- |' ELSE '| ' || r_regionkey || ' | ' || r_name || ' |' END AS value FROM (SELECT unnest(range(7)) AS i) LEFT JOIN region ON r_regionkey = i - 2")
def markdown_tables(spark: SparkSession, folder: str) -> DataFrame:
    text = files.markdown_table(read(spark, folder, "region").orderBy("r_regionkey"), ["r_regionkey", "r_name"])
    return _table(spark, list(enumerate(text.splitlines())), "line bigint, value string")


@query("SELECT run_name, count(*) * 2 AS logged, count(*) AS mirrored, round(avg(length(coalesce(prediction, ''))), 6) AS mean FROM predictions GROUP BY run_name")
def metric_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics added to a log and its mirror; only the first process writes."""
    at = scratch(spark, "log")
    rows = read(spark, folder, "predictions").select("run_name", F.length(F.coalesce("prediction", F.lit(""))).alias("value"))
    files.append_metrics(rows, [f"{at}/a", f"{at}/b"])
    files.append_metrics(rows, [f"{at}/a"])
    files.append_metrics(rows, [f"{at}/a", f"{at}/b"], rank=1)
    a, b = (spark.read.json(f"{at}/{x}").groupBy("run_name").agg(F.count(F.lit(1)).alias(n), F.round(F.avg("value"), 6).alias("mean")) for x, n in (("a", "logged"), ("b", "mirrored")))
    return a.join(b.drop("mean"), "run_name").select("run_name", "logged", "mirrored", "mean")


@query("SELECT 'global_step' AS name, count(*) AS rows, NULL::DOUBLE AS total FROM events UNION ALL SELECT 'value', count(*), round(sum(value), 2) FROM events")
def metric_table(spark: SparkSession, folder: str) -> DataFrame:
    """A log's numeric columns as CSV; text is left out."""
    at = scratch(spark, "metrics")
    log = read(spark, folder, "events").select(F.col("event_id").alias("global_step"), "value", "event_type")
    names = files.write_metrics_table(log, f"{at}/csv")
    back = spark.read.csv(f"{at}/csv", header=True)
    total = back.agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum(F.col("value").cast("double")), 2).alias("total"))
    return total.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), "rows", (F.col("total") if c in names else F.lit(None).cast("double")).alias("total")) for c in back.columns])).alias("x")).select("x.*")


# ---------------------------------------------------------------- staging


@query(
    "SELECT CASE WHEN n_regionkey % 2 = 0 THEN 'train' ELSE 'validation' END AS split, CASE WHEN n_regionkey % 2 = 0 THEN 'train' ELSE 'valid' END || '-' || lpad(n_nationkey::VARCHAR, 6, '0') AS id, r_name AS label, "
    "CASE WHEN n_nationkey % 2 = 0 THEN r_name || ',' || n_name || ',' || n_name ELSE '' END AS labels FROM nation JOIN region ON r_regionkey = n_nationkey % 5"
)
def materialized_records(spark: SparkSession, folder: str) -> DataFrame:
    """Record files of two data sets by the materialisers of their kinds; class ids are decoded by a list of names, also within lists."""
    at = scratch(spark, "records")
    names = [r["r_name"] for r in _rows(read(spark, folder, "region").orderBy("r_regionkey"))]
    nation = read(spark, folder, "nation").withColumn("index", F.col("n_nationkey").cast("bigint"))
    single = nation.select("index", "n_regionkey", F.to_json(F.struct((F.col("n_nationkey") % 5).alias("label"))).alias("payload"))
    many = nation.where("n_nationkey % 2 = 0").select("index", F.to_json(F.struct(F.concat(F.lit("k"), "n_nationkey").alias("image_id"), F.struct(F.array((F.col("n_nationkey") % 5).cast("string"), "n_name", "n_name").alias("category")).alias("objects"))).alias("payload"))
    stage.materialize("single_label", [(single.where(f"n_regionkey % 2 = {i}").drop("n_regionkey"), {"split": s, "names": names}) for i, s in enumerate(("train", "valid"))], f"{at}/one")
    stage.materialize("multi_label", [(many, {"split": "train", "names": names})], f"{at}/many")
    one = files.read_jsonl(spark, files.require_records_file(f"{at}/one"), "id string, label string, split string").drop("ord")
    lists = files.read_jsonl(spark, files.require_records_file(f"{at}/many"), "id string, label string, all_labels array<string>")
    lists = lists.select(F.concat(F.lit("k"), F.substring_index("id", "k", -1)).alias("_id"), F.array_join("all_labels", ",").alias("labels"))
    key = F.concat(F.lit("k"), F.substring_index("id", "-", -1).cast("int").cast("string"))
    return one.join(lists, key == F.col("_id"), "left").select("split", "id", "label", F.coalesce("labels", F.lit("")).alias("labels"))


@query("SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_name END), ''), CASE WHEN c_custkey % 2 = 0 THEN '0' ELSE c_mktsegment END) AS first_value, (c_custkey % 4 <> 3) AS has_picture FROM customer")
def first_values(spark: SparkSession, folder: str) -> DataFrame:
    """The first field that says something (0 does, blanks and empty lists don't), and whether a row has a column of pictures."""
    rows = read(spark, folder, "customer")
    value = F.when(F.col("c_custkey") % 2 == 0, F.lit("0")).otherwise(F.concat(F.lit('"'), "c_mktsegment", F.lit('"')))
    made = rows.select("c_custkey", F.concat(F.lit('{"a": [], "b": "'), F.when(F.col("c_custkey") % 3 == 0, F.lit(" ")).otherwise(F.col("c_name")), F.lit('", "c": '), value, F.lit("}")).alias("payload"))
    kinds = {i: bool(stage.image_columns([n])) for i, n in enumerate(("image", "PNG", "image_12", "image_x"))}
    has = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), (F.col("c_custkey") % 4).cast("int"))
    return N.parsed(made).select("c_custkey", N.text_of(stage.first_non_empty("a", "b", "c")).alias("first_value"), has.alias("has_picture"))


_ARCHIVE = "SELECT n_nationkey AS ord, CASE n_regionkey WHEN 0 THEN '' WHEN 1 THEN 'val' WHEN 2 THEN 'test' ELSE 'train' END AS split, 'D/P' || (n_nationkey % 10) || '.JPG' AS image_path FROM nation"


@query(
    f"WITH t AS (SELECT ord, CASE split WHEN '' THEN 'train' WHEN 'val' THEN 'validation' ELSE split END AS split, image_path FROM ({_ARCHIVE})), k AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY ord) AS k, count(*) OVER (PARTITION BY split) AS n FROM t) "
    "SELECT split, n AS rows, count(*) FILTER (WHERE k <= greatest(1, floor(n * 0.5::DOUBLE))) AS taken, count(DISTINCT image_path) FILTER (WHERE k <= greatest(1, floor(n * 0.5::DOUBLE))) AS pictures FROM k GROUP BY split, n"
)
def archive_pictures(spark: SparkSession, folder: str) -> DataFrame:
    """Half of each split of an archive's table, with its pictures found by their base names whatever the case, and unpacked once each."""
    at = scratch(spark, "archive")
    rows = [(r["n_nationkey"], ("", "val", "test", "train", "train")[r["n_regionkey"]], f"D/P{r['n_nationkey'] % 10}.JPG", f"i{r['n_nationkey']}", "q", "a", None) for r in _rows(read(spark, folder, "nation"))]
    table = _table(spark, rows, "ord bigint, split string, image_path string, image_id string, question string, answer string, question_type string")
    with zipfile.ZipFile(os.path.join(at, "a.zip"), "w") as z:
        for i in range(10):
            z.writestr(f"z/p{i}.jpg", bytes.fromhex(HEADS["jpeg"]))
        z.writestr("z/notes.csv", "x")
    members = _table(spark, [(m,) for m in stage.archive_members(os.path.join(at, "a.zip"))], "member string")
    records = stage.archive_records(table, members, "partial", 0.5)
    stage.extract_pictures(os.path.join(at, "a.zip"), records, at)
    unpacked = files.scan_images(spark, os.path.join(at, "images")).select(F.element_at(F.split("path", "/"), -2).alias("split")).groupBy("split").agg(F.count(F.lit(1)).alias("pictures"))
    taken = N.parsed(records).groupBy(N.text_of(N.pick("split")).alias("split")).agg(F.count(F.lit(1)).alias("taken"))
    return stage.split_sizes(table).withColumnRenamed("n", "rows").join(taken, "split").join(unpacked, "split").select("split", "rows", "taken", "pictures")


@query("SELECT n_name, n_nationkey % 2 = 0 AS list, CASE WHEN n_regionkey = 0 THEN 'parts' WHEN n_regionkey = 1 THEN 'zip' ELSE 'tar' END AS kind, true AS once FROM nation")
def extracted_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Archives unpacked once each: zip, tar, and tar cut into parts; what was unpacked is a split list or not."""
    out, at = [], scratch(spark, "extract")
    for r in _rows(read(spark, folder, "nation")):
        root, kind = os.path.join(at, r["n_name"]), {0: "parts", 1: "zip"}.get(r["n_regionkey"], "tar")
        inner = _write(os.path.join(root, "in.txt"), "\n a/b.JPG 1\n" if r["n_nationkey"] % 2 == 0 else "\nno list\n")
        packed = os.path.join(root, f"a.{kind}")
        if kind == "zip":
            with zipfile.ZipFile(packed, "w") as z:
                z.write(inner, "x/in.txt")
        else:
            with tarfile.open(packed, "w:gz") as t:
                t.add(inner, "x/in.txt")
        if kind == "parts":
            with open(packed, "rb") as f:
                content = f.read()
            parts = [_write(f"{packed}.{i:03}", content[i * 50 : (i + 1) * 50]) for i in range(-(-len(content) // 50))]
            unpack = lambda: stage.extract_parts_once(parts, os.path.join(root, "out"), ".done")  # noqa: E731, B023
        else:
            unpack = lambda: stage.extract_once(packed, os.path.join(root, "out"), ".done")  # noqa: E731, B023
        once = unpack() and not unpack()
        out.append((r["n_name"], stage.looks_like_split_list(os.path.join(root, "out", "x", "in.txt")), kind, once))
    return _table(spark, out, "n_name string, list boolean, kind string, once boolean")


@query("SELECT source_dataset, CASE WHEN task_family = 'eval' THEN 'manual_required' WHEN include_in_rl THEN 'downloaded' ELSE 'manual_required' END AS status, CASE WHEN include_in_rl AND task_family <> 'eval' THEN 25 END::BIGINT AS saved_rows FROM dataset_registry")
def acquisition(spark: SparkSession, folder: str) -> DataFrame:
    """Data sets acquired one after the other: one without a source, or whose source fails, becomes a slot to be filled by hand."""
    at, registry = scratch(spark, "acquire"), _rows(read(spark, folder, "dataset_registry"))
    specs = {r["source_dataset"]: paths.DatasetSpec(r["source_dataset"], r["normalizer"], source_type="manual" if r["task_family"] == "eval" else "hub", extra={"fails": not r["include_in_rl"]}) for r in registry}
    rows = read(spark, folder, "nation").select(F.col("n_nationkey").cast("bigint").alias("index"), F.to_json(F.struct(F.col("n_name").alias("question"), F.lit("a").alias("answer"))).alias("payload"))

    def materialize(spec: paths.DatasetSpec) -> dict[str, Any]:
        if spec.extra["fails"]:
            raise RuntimeError("offline")
        return stage.materialize("questions", [(rows, {"split": "train"})], os.path.join(at, spec.name))

    got = stage.acquire(specs, materialize, lambda spec: os.path.join(at, spec.name))
    return _table(spark, [(n, v["status"], v.get("saved_rows")) for n, v in got.items()], "source_dataset string, status string, saved_rows bigint")


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 10")
def stream_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """The first tenth of a stream of 100 rows (the nations over and over), which is the feature; no row behind it is taken."""
    made, taken = _rows(read(spark, folder, "nation").orderBy("n_nationkey")), []

    def stream():
        for i in range(100):
            taken.append(i)
            yield made[i % len(made)]

    path = os.path.join(scratch(spark, "stream"), "records.jsonl")
    files.first_of_stream(stream(), paths.prefix_limit(100, "partial", 0.1), path)
    return files.read_jsonl(spark, path, "n_nationkey int, n_name string").where(F.lit(len(taken) == 10)).drop("ord")


@query("SELECT rows, count(*) AS batches FROM (SELECT k // 64 AS b, count(*) AS rows FROM (SELECT row_number() OVER () - 1 AS k FROM documents) GROUP BY 1) GROUP BY rows")
def model_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in batches of 64 for a model, the last one smaller. One partition, so that the sizes are the same on any machine."""

    def size(parts):
        for batch in files.in_batches(parts, 64):
            yield batch.iloc[:1][["doc_id"]].assign(rows=len(batch))

    ship_package(spark)
    made = read(spark, folder, "documents").select("doc_id").coalesce(1).mapInPandas(size, "doc_id bigint, rows bigint")
    return made.groupBy("rows").agg(F.count(F.lit(1)).alias("batches"))


# ---------------------------------------------------------------- rows


@query(_vqa_sql("plantvillage_vqa", "vqa"))
def normalizer_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    """The normaliser that the registry names for a data set."""
    spec = [r for r in _rows(read(spark, folder, "dataset_registry")) if r["source_dataset"] == "plantvillage_vqa"][0]
    rows = N.normalize(_raw(spark, folder, "plantvillage_vqa"), "plantvillage_vqa", "vqa_records", spec["default_task_type"], strict=False)
    question = F.element_at("messages", 2)["content"]
    return rows.select("sample_id", "task_type", "split", F.size("images").alias("images"), F.element_at(question, -1)["text"].alias("question"), F.col("target.answer_text").alias("answer"), F.col("target.decision").alias("decision"), "error")


_ITEM = "CASE (ord % 4)::INT WHEN 0 THEN target.answer_text WHEN 1 THEN target.canonical_label WHEN 2 THEN NULL ELSE '' END"


@query(f"SELECT ord, coalesce({_ITEM}, CASE WHEN ord % 2 = 0 THEN split END, '') AS said FROM manifest")
def completion_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The text of completions: their content, else that of their last turn, else nothing."""
    turns = F.when(F.col("ord") % 2 == 0, F.array(F.struct(F.lit("first").alias("content")), F.struct(F.col("split").alias("content"))))
    return read(spark, folder, "manifest").select("ord", R.completion_text(F.expr(_ITEM), turns).alias("said"))


@query(f"WITH {_SCORED} SELECT run_name, count(*) AS n, round(sum(CASE WHEN t.canonical_label <> '' AND {_nl('t.canonical_label')} = {_nl('said')} THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS total FROM s WHERE t.canonical_labels IS NULL OR len(t.canonical_labels) = 0 GROUP BY run_name")
def reward_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Rewards of batches as a trainer asks for them, which is by lists on the driver; here of the runs' different predictions, counted."""
    rows = _scored(spark, folder).where("target.canonical_labels IS NULL OR size(target.canonical_labels) = 0")
    groups = rows.groupBy("run_name", F.coalesce("prediction", F.lit("")).alias("said"), F.to_json("target").alias("t"), F.to_json("verifier").alias("v")).agg(F.count(F.lit(1)).alias("n")).collect()
    shapes = [lambda x: x, lambda x: {"content": x}, lambda x: [{"content": "no"}, {"content": x}]]
    got = R.batch_rewards(spark, [shapes[i % 3](g.said) for i, g in enumerate(groups)], [g.t for g in groups], [g.v for g in groups], ["{}"] * len(groups), ["normalized_label"])
    made = _table(spark, [(g.run_name, g.n, g.n * x) for g, x in zip(groups, got)], "run_name string, n bigint, total double")
    return made.groupBy("run_name").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 6).alias("total"))


@query("SELECT sample_id, len(list_filter(flatten(list_transform(messages, lambda m: m.content)), lambda p: p.type = 'text' AND p.text IS NOT NULL))::INTEGER AS texts, 0 AS nulls FROM manifest")
def prompts_without_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """Fields without a value are left out of the prompts of reinforcement records, at every depth."""
    rows = M.rl_records(read(spark, folder, "manifest").withColumn("messages", F.transform("messages", lambda m: F.struct(F.lit("user").alias("role"), m["content"].alias("content")))))
    parts = F.flatten(F.transform(F.from_json("prompt", "array<struct<role:string,content:array<map<string,string>>>>"), lambda m: m["content"]))
    return rows.select(
        "sample_id", F.size(F.filter(parts, lambda p: (p["type"] == "text") & F.map_contains_key(p, "text"))).alias("texts"),
        F.size(F.filter(parts, lambda p: F.exists(F.map_values(p), lambda v: v.isNull()))).alias("nulls"),
    )


@query(
    "WITH e AS (SELECT DISTINCT image_path AS path FROM image_index WHERE n_bytes % 2 = 0), k AS (SELECT DISTINCT ord FROM (SELECT ord, unnest(images) AS path FROM manifest) JOIN e USING (path)) SELECT (SELECT count(*) FROM k) AS kept, (SELECT count(*) FROM manifest) - (SELECT count(*) FROM k) AS skipped"
)
def staged_and_skipped(spark: SparkSession, folder: str) -> DataFrame:
    """Question-answer rows whose pictures aren't there are skipped, and counted."""
    rows = read(spark, folder, "manifest").select(F.col("ord").alias("index"), F.to_json(F.struct("images", F.lit("x").alias("faq-id"))).alias("payload"))
    existing = read(spark, folder, "image_index").where("n_bytes % 2 = 0").select(F.col("image_path").alias("path")).distinct()
    kept, skipped = N.question_answer_records(rows, existing, "staged")
    return skipped.withColumn("kept", F.lit(kept.count()))


@query("SELECT 'talks-' || lpad(n_nationkey::VARCHAR, 6, '0') AS id, 'Img/' || n_name || '.jpg' AS image, n_name AS question, 'region ' || n_regionkey AS diagnosis, 'train' AS split FROM nation")
def staged_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """The first two turns of talks as question and answer."""
    turns = F.array(F.struct(F.concat(F.lit(" "), "n_name").alias("value")), F.struct(F.concat(F.lit("region "), "n_regionkey", F.lit("\n")).alias("value")), F.struct(F.lit("more").alias("value")))
    rows = read(spark, folder, "nation").select(F.col("n_nationkey").alias("index"), F.to_json(F.struct(F.concat(F.lit("a/b/"), "n_name", F.lit(".jpg")).alias("image"), turns.alias("conversations"))).alias("payload"))
    made = F.from_json("payload", "id string, image string, question string, diagnosis string, split string")
    return N.conversation_records(rows, "talks", "Img/").select(made.alias("r")).select("r.*")


@query("SELECT source_dataset, CASE WHEN normalizer = 'consultation_records' THEN 1 ELSE 2 END::BIGINT AS rows, true AS validated FROM dataset_registry")
def smoke_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Made-up records for every data set of the registry, normalised by the commands, their pictures looked for, and their manifests read with checks."""
    at, registry = scratch(spark, "smoke"), _rows(read(spark, folder, "dataset_registry"))
    config = os.path.join(at, "registry.yaml")
    files.write_yaml(config, {"datasets": [{"name": r["source_dataset"], "normalizer": r["normalizer"], "default_task_type": r["default_task_type"]} for r in registry]})
    given = argparse.Namespace(config=config, mode=None, fraction=None, data_root=os.path.join(at, "data"), with_smoke_data=True, datasets=None)
    cli.run_prepare_slots(spark, given)
    made = cli.run_normalize(spark, given)[0]["summary"]
    out = [(name, m["rows"], files.read_manifest(spark, m["path"]).count() == m["rows"]) for name, m in made.items()]
    return _table(spark, out, "source_dataset string, rows bigint, validated boolean")


@query(
    "SELECT n_nationkey AS ord, 'z/' || lower(n_name) || '.jpg' AS member FROM nation"
)
def archive_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Members of an archive found by the lower case of their base names."""
    nation = read(spark, folder, "nation")
    table = nation.select(F.col("n_nationkey").cast("bigint").alias("ord"), F.lit("").alias("split"), F.concat(F.lit("Q/"), F.upper("n_name"), F.lit(".JPG")).alias("image_path"), F.col("n_name").alias("image_id"), F.lit("q").alias("question"), F.lit("a").alias("answer"), F.lit(None).cast("string").alias("question_type"))
    members = nation.select(F.concat(F.lit("z/"), F.lower("n_name"), F.lit(".jpg")).alias("member"))
    records = stage.archive_records(table, members, "full", 1.0)
    path = F.get_json_object("payload", "$.image")
    return records.select(F.col("index").cast("int").alias("ord"), F.concat(F.lit("z/"), F.lower(F.element_at(F.split(path, "/"), -1))).alias("member"))


@query("SELECT ord, sample_id, 'holdout' AS split FROM manifest WHERE coalesce(split, '') <> 'test' ORDER BY ord LIMIT 1")
def holdout_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """A share so small that no row falls below it: the first eligible row is held out."""
    rows = read(spark, folder, "manifest").select("ord", "sample_id", "split")
    return S.holdout(rows, F.col("sample_id"), "none", 1e-15)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a stream, counted by hour; everything there is when the query starts is taken, in one batch."""
    at, name = scratch(spark, "stream"), f"windows_{uuid.uuid4().hex}"
    source = os.path.join(scratch(spark, "events"), "in")
    read(spark, folder, "events").write.parquet(source)
    events = spark.readStream.schema(read(spark, folder, "events").schema).parquet(source)
    counts = metrics_log.windowed_counts(events.withColumn("at", F.col("ts").cast("timestamp")), "at", "event_type")
    counts.writeStream.format("memory").queryName(name).option("checkpointLocation", at).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@query("SELECT record_id, row_number() OVER (ORDER BY record_id, payload, source_dataset) - 1 AS index FROM (SELECT record_id, source_dataset, payload FROM raw_records)")
def running_index(spark: SparkSession, folder: str) -> DataFrame:
    """Rows in an order with their numbers from 0, without gaps however many partitions they have."""
    rows = read(spark, folder, "raw_records").select("record_id", "source_dataset", "payload").repartition(5).orderBy("record_id", "payload", "source_dataset")
    return files.with_index(rows).select("record_id", "index")


@query("SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS index FROM nation")
def record_ordinals(spark: SparkSession, folder: str) -> DataFrame:
    """The place of records in a file, which blank lines don't count towards."""
    made = _rows(read(spark, folder, "nation").orderBy("n_nationkey"))
    path = _write(os.path.join(scratch(spark, "ordinals"), "a.jsonl"), "\n".join(json.dumps(r) + ("\n  " if r["n_nationkey"] % 3 == 0 else "") for r in made))
    rows = files.read_payloads(spark, path)
    return rows.select(F.get_json_object("payload", "$.n_nationkey").cast("int").alias("n_nationkey"), "index")
