"""Every query of the core against its SQL, and what the repository promises of itself."""

import os
import re
import subprocess
import sys

import duckdb
import pytest

import graincart.file_queries  # noqa: F401
from graincart import queries as core

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def tables(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return con


def compare(spark, folder, con, query, sql):
    df = query(spark, folder)
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(row[names.index(c)] for c in sorted(names)) for row in cur.fetchall()), key=str)
    got = sorted((tuple(row[c] for c in sorted(names)) for row in df.collect()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_query_equals_sql(spark, folder, tables, name):
    compare(spark, folder, tables, core.QUERIES[name], core.ORACLE[name])


def test_every_query_has_sql():
    assert set(core.QUERIES) == set(core.ORACLE)


def test_core_stands_alone():
    """Nothing outside the subpackage for training data imports it, and the entry works without it."""
    for folder, _, names in os.walk(os.path.join(ROOT, "graincart")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    assert not re.search(r"import.*\bllm\b|from graincart\.llm", open(os.path.join(folder, name), encoding="utf-8").read()), name
    code = "import sys; sys.modules['graincart.llm'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.stdout.strip() == str(len(core.QUERIES)), done.stderr


def test_merge_takes_every_source_without_a_cap(spark, tmp_path):
    rows = [(i, f"s{i}", name, "vqa", "train") for i, name in enumerate(["plantdoc"] * 201 + [" PlantDoc ", "agrillava", "mirage", "elsewhere"])]
    spark.createDataFrame(rows, "ord bigint, sample_id string, source_dataset string, task_type string, split string").write.parquet(f"{tmp_path}/manifest.parquet")
    spark.createDataFrame([("plantdoc", True), ("mirage", False), ("agrillava", True)], "source_dataset string, include_in_sft boolean").coalesce(1).write.parquet(f"{tmp_path}/dataset_registry.parquet")
    got = sorted((r.source_ord, r.ord) for r in core.QUERIES["merge_filter"](spark, str(tmp_path)).collect())
    assert got == [(0, i) for i in range(202)] + [(1, 202)]


def test_builds_and_holdout_take_every_source_and_spelling(spark, tmp_path):
    names = [" PlantDoc " if i % 2 else "plantdoc" for i in range(100)] + ["plantvillage", "agrillava", "mirage"]
    rows = [(i, f"s{i}", name, "vqa", "train", [f"{i // 2}.jpg"], ("yes", None), "{}", ("label",)) for i, name in enumerate(names)]
    manifest = "ord bigint, sample_id string, source_dataset string, task_type string, split string, images array<string>, target struct<answer_text: string, canonical_label: string>, metadata string, verifier struct<mode: string>"
    spark.createDataFrame(rows, manifest).write.parquet(f"{tmp_path}/manifest.parquet")
    registry = [("plantvillage", "sft", True, False), ("plantdoc", "sft", True, True), ("mirage", "eval", True, True), ("agrillava", "sft", False, False)]
    spark.createDataFrame(registry, "source_dataset string, task_family string, include_in_rl boolean, include_in_eval boolean").coalesce(1).write.parquet(f"{tmp_path}/dataset_registry.parquet")

    def run(name):
        return core.QUERIES[name](spark, str(tmp_path)).collect()

    assert sorted((r.source_ord, r.ord) for r in run("rewardable_filter")) == [(0, 100), *((1, i) for i in range(100)), (2, 102)]
    held = {r.ord for r in run("holdout_rows")}
    assert held and max(held) < 100 and {i ^ 1 for i in held} == held
    assert {r.ord for r in run("eval_pool")} == held
    assert {r.ord for r in run("leak_safe_train") if r.reason == "eval_overlap"} == held
    assert {(r.source_dataset, r.reason): r.n for r in run("rejection_counts")}["plantdoc", "eval_overlap"] == len(held)


def test_reports_count_every_row(spark, tmp_path):
    rows = [("mirage", "test", "consultation"), (" Mirage ", "train", "vqa"), ("ip102", "holdout", "classification")]
    spark.createDataFrame(rows, "source_dataset string, split string, task_type string").write.parquet(f"{tmp_path}/manifest.parquet")
    spark.createDataFrame([("agbase", "{}"), ("Agrillava", "{}"), ("agrillava", "{")], "source_dataset string, payload string").write.parquet(f"{tmp_path}/raw_records.parquet")
    registry = [(n, "sft", True) for n in ("mirage", "ip102", "agbase", "agrillava", "plantdoc")]
    spark.createDataFrame(registry, "source_dataset string, task_family string, include_in_eval boolean").write.parquet(f"{tmp_path}/dataset_registry.parquet")
    got = {r.source_dataset: (r.normalized_rows, r.status) for r in core.QUERIES["dataset_report"](spark, str(tmp_path)).collect()}
    assert got == {"mirage": (2, "normalized"), "ip102": (1, "normalized"), "agbase": (0, "manual_required"), "agrillava": (0, "downloaded_only"), "plantdoc": (0, "missing")}
    row = core.QUERIES["readiness_status"](spark, str(tmp_path)).first()
    assert (row.readiness_status, row.missing, row.missing_paths) == ("missing_data", 3, "agbase<br>agrillava<br>plantdoc")
