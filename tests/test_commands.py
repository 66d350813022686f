import json
import os

import pytest
from pyspark.sql import functions as F

from graincart import cli
from graincart.functions.rewards import TRAINING_WEIGHTS, batch_rewards
from graincart.plans import stage
from graincart.sources import files, paths
from tests.test_operators import numbered, unified
from tests.test_sources import raw


def run(spark, capsys, *arguments):
    code = cli.main([str(a) for a in arguments], spark)
    return json.loads(capsys.readouterr().out), code


def test_from_raw_records_to_results(spark, tmp_path, capsys):
    data = tmp_path / "data"
    for name, records in {
        "plantdoc": [{"id": i, "image": f"p{i}.jpg", "label": "Apple___scab", "split": "train" if i % 2 else "val"} for i in range(6)],
        "talks": [{"id": i, "image": f"t{i}.jpg", "question": "q?", "answer": f"a {i}", "split": "train"} for i in range(4)],
    }.items():
        folder = data / "raw" / name / "partial_10pct"
        folder.mkdir(parents=True)
        (folder / "records.jsonl").write_text("\n".join(json.dumps(r) for r in records) + "\n\n")
        for r in records:
            (folder / r["image"]).write_bytes(b"\xff\xd8\xff")
    config = tmp_path / "registry.yaml"
    files.write_yaml(str(config), {"datasets": [{"name": "plantdoc", "normalizer": "classification_records"}, {"name": "talks", "normalizer": "vqa_records"}, {"name": "gone", "normalizer": "vqa_records"}]})
    out, code = run(spark, capsys, "normalize", "--config", config, "--data-root", data)
    assert code == 0 and {k: v.get("rows", v["status"]) for k, v in out["summary"].items()} == {"plantdoc": 6, "talks": 4, "gone": "missing_raw"}
    interim = [out["summary"][n]["path"] for n in ("plantdoc", "talks")]
    shown = files.read_manifest(spark, interim[0]).first().images[0]
    assert os.path.exists(shown) and not os.path.isabs(shown)
    (data / "raw" / "talks" / "partial_10pct" / "t1.jpg").unlink()
    with pytest.raises(FileNotFoundError, match="t1.jpg"):
        cli.main(["normalize", "--config", str(config), "--data-root", str(data), "--datasets", "talks"], spark)
    report, _ = run(spark, capsys, "dataset-report", "--config", config, "--data-root", data, "--output", tmp_path / "r.md")
    assert {k: (v["status"], v["normalized_rows"]) for k, v in report["datasets"].items()} == {"plantdoc": ("normalized", 6), "talks": ("normalized", 4), "gone": ("missing", 0)}
    sft, _ = run(spark, capsys, "build-sft", "--sources", *interim, tmp_path / "none", "--output", tmp_path / "sft")
    assert sft == {"rows": 10, "missing": [str(tmp_path / "none")]}
    assert run(spark, capsys, "build-rl", "--sources", *interim, "--output", tmp_path / "rl")[0]["rows"] == 10
    made, _ = run(spark, capsys, "build-eval", "--benchmark", interim[1], "--sources", f"plantdoc={interim[0]}", "--output", tmp_path / "eval", "--salt", "s", "--ratio", "0.3")
    assert made["rows"]["mmst"] == 4 and made["rows"]["mmmt"] == 0 and made["rows"]["local_holdout"] >= 1
    both, _ = run(spark, capsys, "build-train-eval", "--source", tmp_path / "sft", "--holdout", tmp_path / "eval" / "local_holdout", "--train-output", tmp_path / "train", "--eval-output", tmp_path / "held", "--salt", "s")
    assert both["overlap"] == {"exact_sample_id": 0, "group_key": 0} and spark.read.json(str(tmp_path / "train")).count() == both["train_rows"]
    result, _ = run(spark, capsys, "evaluate", "--tasks", f"local_holdout={tmp_path / 'held'}", "--output", tmp_path / "run")
    assert result["tasks"][0]["metrics"]["label_accuracy"] == 1.0
    with open(tmp_path / "run" / "artifact_manifest.json", encoding="utf-8") as f:
        listed = json.load(f)
    assert listed["tasks"] == ["local_holdout"] and files.load_yaml(listed["resolved_config"])["settings"]["mode"] == "oracle"
    assert run(spark, capsys, "export-tables", "--runs", f"m={tmp_path / 'run'}", "--output", tmp_path / "tables")[0] == {"rows": 1}
    assert "| m | local_holdout |" in (tmp_path / "tables" / "results.md").read_text()


def test_checks(spark, tmp_path, capsys):
    (tmp_path / "good.jpg").write_bytes(b"\xff\xd8\xff\xe0 ")
    (tmp_path / "bad.jpg").write_bytes(b"%PDF-1.7")
    files.write_jsonl(numbered(spark, [unified(1, images=["good.jpg"]), unified(2, images=["bad.jpg", "none.jpg"])]), str(tmp_path / "m"))
    out, code = run(spark, capsys, "validate-images", "--manifest", tmp_path / "m", "--root", tmp_path, "--valid-output", tmp_path / "v", "--invalid-output", tmp_path / "i")
    assert code == 1 and out["invalid_rows"] == 1 and out["by_dataset"]["plantdoc"]["invalid_images"] == 2
    assert sorted(e.error for e in spark.read.json(str(tmp_path / "i")).first().errors) == ["missing file", "unsupported image signature: PDF document"]
    config = tmp_path / "b.yaml"
    files.write_yaml(str(config), {"benchmarks": [{"name": "a", "implementation_status": "implemented", "readiness_paths": [{"path": str(tmp_path / "m")}]}, {"name": "b", "implementation_status": "implemented", "readiness_paths": [{"path": "{data_root}/x"}]}, {"name": "c"}]})
    status, _ = run(spark, capsys, "benchmark-status", "--config", config, "--output", tmp_path / "s.md")
    assert [b["readiness_status"] for b in status["benchmarks"]] == ["ready", "missing_data", "planned_or_blocked"]


def test_batch_rewards(spark):
    target, verifier = json.dumps({"answer_text": "yes", "canonical_label": "leaf spot"}), json.dumps({"mode": "label"})
    got = batch_rewards(spark, ["yes", {"content": "Leaf_Spot"}, [{"content": "no"}]], [target] * 3, [verifier] * 3, [json.dumps({"weights": {"exact_match": 0.5}})] * 3, ["exact_match", "normalized_label"])
    assert got == [0.5, 1.0, 0.0] and batch_rewards(spark, [], [], [], [], list(TRAINING_WEIGHTS)) == []


def payloads(df):
    return [json.loads(r.payload) for r in df.orderBy("index").collect()]


def test_materialised_records(spark):
    one = payloads(stage.single_label_records(raw(spark, [{"label": 1}, {"label": "Corn__rust"}]), "valid", ["a", "Apple___scab"]))
    assert [(r["id"], r["label"], r["split"], r["crop"]) for r in one] == [("valid-000000", "Apple___scab", "validation", "Apple"), ("valid-000001", "Corn__rust", "validation", "Corn")]
    many = payloads(stage.multi_label_records(raw(spark, [{"objects": {"category": [0, 1, 1]}, "image_id": 9}]), "test", ["x", "y"]))
    assert (many[0]["id"], many[0]["label"], many[0]["all_labels"]) == ("9", "y", ["x", "y", "y"])
    with pytest.raises(Exception, match="missing object categories"):
        stage.multi_label_records(raw(spark, [{"objects": {}}]), "test", ["x"]).collect()
    vqa = payloads(stage.vqa_source_records(raw(spark, [{"question": " ", "query": " q ", "answer": 0, "crop": "fig"}]), "dev", "vqa", images=2))
    assert (vqa[0]["question"], vqa[0]["answer"], vqa[0]["images"][1], vqa[0]["crop"], vqa[0]["split"]) == ("q", "0", "images/dev/dev-000000-02.png", "fig", "dev")
    bench = payloads(stage.benchmark_records(raw(spark, [{"dialog_context": "c", "utterance": "u", "decision": "<Clarify>", "goals": "g"}, {"question": "q", "answer": "a"}]), "MMMT_x", "test"))
    assert [(r["task_type"], r["decision"], r["management_keywords"], r["benchmark_track"]) for r in bench] == [("clarify_or_respond", "clarify", ["g"], "mmmt"), ("consultation", None, [], "mmmt")]
    assert stage.image_columns(["id", "image", "image_2", "Image_x", "PNG"]) == ["image", "image_2", "PNG"]


def test_archive(spark, tmp_path):
    table = spark.createDataFrame([(i, "val" if i % 2 else "", f"dir/P{i // 2}.JPG", f"i{i}", "q", "a", None) for i in range(8)], "ord bigint, split string, image_path string, image_id string, question string, answer string, question_type string")
    members = spark.createDataFrame([(f"z/p{i}.jpg",) for i in range(4)] + [("z/notes.csv",)], "member string")
    full = payloads(stage.archive_records(table, members, "full", 1.0))
    assert len(full) == 8 and full[0]["image"] == "images/train/P0.JPG" and full[1]["split"] == "validation" and full[1]["id"] == "i1-000001"
    assert len(payloads(stage.archive_records(table, members, "partial", 0.5))) == 4
    with pytest.raises(Exception, match="no such picture in the archive"):
        stage.archive_records(table, members.limit(2), "full", 1.0).collect()
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/y.txt", "hello .jpg\n")
    assert stage.archive_members(str(tmp_path / "a.zip")) == ["x/y.txt"]
    assert stage.extract_once(str(tmp_path / "a.zip"), str(tmp_path / "out"), ".done") and not stage.extract_once(str(tmp_path / "a.zip"), str(tmp_path / "out"), ".done")
    assert stage.looks_like_split_list(str(tmp_path / "out/x/y.txt")) and not stage.looks_like_split_list(str(tmp_path / "none"))
    lines = spark.createDataFrame([("a.jpg",), ("b/c.jpg",)], "path string")
    assert [r.path for r in stage.rewrite_split_lists(lines, "im/").collect()] == ["im/a.jpg", "b/c.jpg"]


def test_acquisition_never_ends_early(tmp_path):
    specs = {n: paths.DatasetSpec(n, "vqa_records", source_type=t) for n, t in (("a", "hub"), ("b", "hub"), ("c", "manual"))}

    def materialize(spec):
        if spec.name == "a":
            raise RuntimeError("offline")
        return {"saved_rows": 3}

    root = lambda spec: str(tmp_path / spec.name)
    got = stage.acquire(specs, materialize, root)
    assert {k: v["status"] for k, v in got.items()} == {"a": "manual_required", "b": "downloaded", "c": "manual_required"}
    assert files.read_sidecar(root(specs["a"]))["manual_required"] and files.read_sidecar(root(specs["b"]))["saved_rows"] == 3
    assert stage.acquire(specs, materialize, root, dry_run=True)["b"]["status"] == "dry_run" and os.path.exists(root(specs["c"]))


def test_payloads_of_any_file(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('\n{"a": 1}\n\n{"a": 2}\n')
    (tmp_path / "a.json").write_text('[1, {"a": 1}, {"a": 2}]')
    (tmp_path / "a.csv").write_text("a\n1\n2\n")
    for name in ("a.jsonl", "a.json", "a.csv"):
        rows = files.read_payloads(spark, str(tmp_path / name)).select("index", F.get_json_object("payload", "$.a").alias("a")).orderBy("index").collect()
        assert [tuple(r) for r in rows] == [(0, "1"), (1, "2")], name


def test_slots_smoke_and_metrics(spark, tmp_path, capsys):
    config, data = tmp_path / "r.yaml", tmp_path / "data"
    files.write_yaml(str(config), {"datasets": [{"name": n, "normalizer": n} for n in ("classification_records", "vqa_records", "consultation_records")]})
    assert set(run(spark, capsys, "prepare-slots", "--config", config, "--data-root", data)[0].values()) == {"manual_required"}
    report, _ = run(spark, capsys, "dataset-report", "--config", config, "--data-root", data)
    assert {d["status"] for d in report["datasets"].values()} == {"manual_required"}
    other = tmp_path / "other"
    assert set(run(spark, capsys, "prepare-slots", "--config", config, "--data-root", other, "--with-smoke-data")[0].values()) == {"smoke"}
    made, _ = run(spark, capsys, "normalize", "--config", config, "--data-root", other)
    assert {k: v["rows"] for k, v in made["summary"].items()} == {"classification_records": 2, "vqa_records": 2, "consultation_records": 1}
    first = files.read_manifest(spark, made["summary"]["vqa_records"]["path"]).orderBy("sample_id").first()
    assert json.loads(first.metadata)["source_type"] == "smoke" and files.manifest_rows(spark, made["summary"]["vqa_records"]["path"]) == 2 and files.manifest_rows(spark, "/none") == 0
    (tmp_path / "log.jsonl").write_text('{"global_step": 1, "loss": 2.5, "note": "x"}\n{"global_step": 2, "loss": 1.5, "reward": 1}\n')
    out, _ = run(spark, capsys, "export-metrics", "--log", tmp_path / "log.jsonl", "--output", tmp_path / "csv")
    assert out["available_numeric_metrics"] == ["loss", "reward"] and out["groups"]["loss"] == ["loss"]
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["global_step", "loss", "reward"]


def test_decode_mode_needs_a_library(spark, tmp_path):
    import importlib.util

    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8\xff\xe0")
    if importlib.util.find_spec("PIL") is None:
        with pytest.raises(RuntimeError):
            files.check_images(spark, str(tmp_path), "decode")
    assert files.check_images(spark, str(tmp_path)).first().error is None
    with pytest.raises(ValueError):
        files.check_images(spark, str(tmp_path), "other")


def test_materialisers_write_and_unpack(spark, tmp_path):
    import tarfile
    import zipfile

    nested = stage.single_label_records(raw(spark, [{"label": [0, [1, "x"], 9]}]), "train", ["a", "b"])
    assert json.loads(payloads(nested)[0]["label"]) == ["a", '["b","x"]', None]
    rows = raw(spark, [{"question": "q", "answer": "a"}])
    assert stage.materialize("questions", [(rows, {"split": "train"}), (rows, {"split": "val"})], str(tmp_path / "q")) == {"saved_rows": 2, "parts": 2}
    assert files.find_records_file(str(tmp_path / "q")).endswith("records.jsonl") and files.read_payloads(spark, str(tmp_path / "q" / "records.jsonl")).count() == 2
    with pytest.raises(KeyError):
        stage.materialize("unknown", [(rows, {})], str(tmp_path))
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("x/A.JPG", b"1")
    table = spark.createDataFrame([(i, "", "d/a.jpg", "", "q", "a", None) for i in range(3)], "ord bigint, split string, image_path string, image_id string, question string, answer string, question_type string")
    records = stage.archive_records(table, spark.createDataFrame([("x/A.JPG",)], "member string"), "full", 1.0, dataset="d")
    assert stage.extract_pictures(str(tmp_path / "p.zip"), records, str(tmp_path)) == 1 and (tmp_path / "images" / "train" / "a.jpg").read_bytes() == b"1"
    assert payloads(records)[2]["id"] == "d-000002"
    assert {(r.split, r.n) for r in stage.split_sizes(spark.createDataFrame([("Val",), ("valid",), (None,), ("",)], "split string")).collect()} == {("validation", 2), ("train", 2)}
    (tmp_path / "in.txt").write_bytes(bytes(range(256)) * 100)
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        t.add(tmp_path / "in.txt", "in.txt")
    content = (tmp_path / "a.tar").read_bytes()
    parts = []
    for i in range(0, len(content), 7000):
        parts.append(tmp_path / f"a.tar.{i:06}")
        parts[-1].write_bytes(content[i : i + 7000])
    assert stage.extract_parts_once([str(p) for p in reversed(parts)], str(tmp_path / "out"), ".done") and not stage.extract_parts_once([], str(tmp_path / "out"), ".done")
    assert (tmp_path / "out" / "in.txt").read_bytes() == (tmp_path / "in.txt").read_bytes()


def test_rar_needs_a_program(tmp_path, monkeypatch):
    monkeypatch.setattr(stage.shutil, "which", lambda name: None)
    with pytest.raises(RuntimeError, match="unpacks"):
        stage.extract_rar_once("a.rar", str(tmp_path), ".done")
