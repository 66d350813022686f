import json
import os

import pytest
from pyspark.sql import functions as F

from graincart.operators.schema import UNIFIED
from graincart.plans import normalize as N
from graincart.sources import files, paths
from graincart.streaming import metrics_log
from tests.test_operators import numbered, unified


def test_jsonl_scan(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a": 1, "b": "x"}\n\n   \n{"b": "y"}\n', encoding="utf-8")
    rows = files.read_jsonl(spark, str(path), "a int, b string").orderBy("ord").collect()
    assert [(r.a, r.b, r.ord) for r in rows] == [(1, "x", 1), (None, "y", 4)]
    for bad in ("nope", "[1]", '"x"'):
        path.write_text('{"a": 1}\n' + bad + "\n", encoding="utf-8")
        with pytest.raises(Exception, match="line 2"):
            files.read_jsonl(spark, str(path), "a int").collect()


def test_line_numbers_across_blocks(spark, tmp_path):
    path = tmp_path / "long.txt"
    path.write_text("".join(f"line {i}\n" for i in range(1, 2001)), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048b")
    try:
        rows = files.read_lines(spark, str(path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 2000 and all(r.value == f"line {r.line}" for r in rows)


def test_json_and_tables(spark, tmp_path):
    listed, nested, other = tmp_path / "l.json", tmp_path / "n.json", tmp_path / "o.json"
    listed.write_text('[{"a": 1}, 5, "x", {"a": 2}]')
    nested.write_text('{"data": [{"a": 3}]}')
    other.write_text('{"rows": []}')
    assert [r.a for r in files.read_records(spark, str(listed), "a int").orderBy("ord").collect()] == [1, 2]
    assert [r.a for r in files.read_records(spark, str(nested), "a int").collect()] == [3]
    with pytest.raises(Exception, match="must be a list"):
        files.read_records(spark, str(other), "a int").collect()
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx y\n")
    (tmp_path / "t.csv").write_text('a,b\n01,"x,y"\n')
    assert files.read_records(spark, str(tmp_path / "t.tsv"), "").collect()[0].asDict() == {"a": "1", "b": "x y"}
    assert files.read_records(spark, str(tmp_path / "t.csv"), "").collect()[0].asDict() == {"a": "01", "b": "x,y"}
    with pytest.raises(ValueError):
        files.read_records(spark, "x.xml", "")


def test_discovery(tmp_path):
    root = str(tmp_path)
    assert files.find_records_file(root) is None and not files.has_raw_data(root)
    with pytest.raises(FileNotFoundError):
        files.require_records_file(root)
    (tmp_path / "DOWNLOAD_INFO.json").write_text("{}")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.csv").write_text("a\n")
    assert files.find_records_file(root).endswith("sub/b.csv")
    (tmp_path / "annotations.json").write_text("[]")
    assert files.find_records_file(root).endswith("annotations.json")
    for name in ("checkpoint-900", "checkpoint-1000"):
        (tmp_path / name).mkdir()
    assert files.latest_checkpoint(root).endswith("checkpoint-900") and files.resume_checkpoint(root, None) is None
    assert files.resume_checkpoint(root, "auto").endswith("900") and files.resume_checkpoint(root, root + "/none") is None


def test_manifest_round_trip(spark, tmp_path):
    rows = numbered(spark, [unified(1, metadata='{"x": null}'), unified(2, verifier={"synonyms": {"a": ["b"]}})])
    out = str(tmp_path / "m")
    files.write_manifest(rows, out)
    text = "".join(open(os.path.join(out, f), encoding="utf-8").read() for f in os.listdir(out) if f.endswith(".json"))
    assert '"decision":null' in text and list(json.loads(text.splitlines()[0])) == sorted(UNIFIED_NAMES)
    back = files.read_manifest(spark, out).orderBy("sample_id").drop("ord").collect()
    assert [r.asDict(True) for r in back] == [r.asDict(True) for r in rows.orderBy("sample_id").drop("ord").collect()]
    with pytest.raises(Exception, match="invalid row"):
        files.write_manifest(numbered(spark, [unified(3, images=[])]), out)


UNIFIED_NAMES = [part.strip().split(" ")[0] for part in ("sample_id, source_dataset, task_type, split, images, messages, target, metadata, verifier, reward_meta").split(",")]


def test_images_and_sidecars(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "b.JPG").write_bytes(b"\xff\xd8\xff\xe0")
    (tmp_path / "a.png").write_bytes(b"%PDF-1.7")
    (tmp_path / "c.txt").write_text("no")
    assert [os.path.basename(r.path) for r in files.scan_images(spark, str(tmp_path)).collect()] == ["a.png", "b.JPG"]
    errors = {os.path.basename(r.path): r.error for r in files.check_image_headers(spark, str(tmp_path)).collect()}
    assert errors["b.JPG"] is None and "PDF" in errors["a.png"]
    files.manual_slot(str(tmp_path), "x", "licence")
    assert files.read_sidecar(str(tmp_path))["manual_required"] is True and files.provenance(str(tmp_path)) == {}
    files.write_sidecar(str(tmp_path), {"subset_tag": "full", "access": None, "other": 1})
    assert files.provenance(str(tmp_path)) == {"subset_tag": "full"}


def test_valid_invalid_and_tables_out(spark, tmp_path):
    marked = spark.createDataFrame([(1, []), (2, ["bad"])], "ord int, errors array<string>")
    files.write_valid_and_invalid(marked, str(tmp_path / "v"), str(tmp_path / "i"))
    assert spark.read.json(str(tmp_path / "v")).count() == 1 and spark.read.json(str(tmp_path / "i")).first().ord == 2
    table = spark.createDataFrame([("m", 0.5, "t")], "model_name string, metric_a double, task string")
    files.write_table(table, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["model_name", "task", "metric_a"]
    assert files.markdown_table(table, ["model_name", "metric_a"]).splitlines()[2] == "| m | 0.5 |"
    files.append_metrics(table, [str(tmp_path / "l1"), str(tmp_path / "l2")])
    files.append_metrics(table, [str(tmp_path / "l1")], rank=1)
    files.append_metrics(table, [str(tmp_path / "l1")])
    assert spark.read.json(str(tmp_path / "l1")).count() == 2 and spark.read.json(str(tmp_path / "l2")).count() == 1


def test_registry_and_tags(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "r.yaml")
    files.write_yaml(path, {"defaults": {"access": "public"}, "datasets": [{"name": "a", "normalizer": "vqa_records", "odd": 1}]})
    spec = paths.load_registry(path)["a"]
    assert (spec.access, spec.extra) == ("public", {"odd": 1}) and paths.registry_table(spark, {"a": spec}).first().normalizer == "vqa_records"
    (tmp_path / "l.yaml").write_text("- 1\n")
    with pytest.raises(ValueError):
        files.load_yaml(str(tmp_path / "l.yaml"))
    assert [paths.subset_tag("partial", f) for f in (0.1, 0.125, 0.135, 1.0)] == ["partial_10pct", "partial_12pct", "partial_14pct", "full"]
    assert paths.subset_tag("FULL ", 0.5) == "full" and paths.download_mode(None) == "partial"
    for bad in (0, 1.5):
        with pytest.raises(ValueError):
            paths.sample_fraction(bad)
    monkeypatch.setenv(paths.DATA_ROOT, "/elsewhere")
    assert paths.data_root("/repo") == "/elsewhere" and paths.data_root("/repo", "/own") == "/own"
    assert paths.render("{a}/x", a="/r") == "/r/x" and paths.relative_posix("/r/a/b", "/r") == "a/b"
    assert paths.existing_sources({"x": path, "y": "/none"}) == ({"x": path}, ["y"])


def raw(spark, rows):
    return spark.createDataFrame([(i, json.dumps(r) if isinstance(r, dict) else r) for i, r in enumerate(rows)], "index bigint, payload string")


def test_classification_records(spark):
    rows = raw(spark, [
        {"id": "r1", "image": "a.jpg", "label": "Tomato___Early_Blight", "split": "val", "crop": ""},
        {"images": ["a", "b"], "all_labels": ["x_y", "z", "z"], "split": None},
        {"image": "a"}, "{broken", {"label": "x"},
    ])
    got = N.classification(rows, "ds", license_name="cc", provenance={"subset_tag": "full", "crop": "none"}, strict=False).orderBy("ord").collect()
    assert (got[0].sample_id, got[0].split, got[0].target.canonical_label) == ("ds-r1", "validation", "tomato early blight")
    meta = json.loads(got[0].metadata)
    assert (meta["crop"], meta["disease"], meta["license"], meta["subset_tag"], meta["source_image_id"]) == ("Tomato", "Early Blight", "cc", "full", "a.jpg")
    # the canonical label is the first of the list, the stated one its most common
    assert (got[1].sample_id, got[1].target.canonical_label, json.loads(got[1].metadata)["original_label"]) == ("ds-1", "x y", "z")
    assert [r.error for r in got] == [None, None, "classification record is missing a label", "payload is no JSON", "row is missing image fields"]
    assert got[0].verifier.mode == "label" and got[0].reward_meta.weights == {"normalized_label": 1.0, "hallucination_penalty": 1.0}
    with pytest.raises(Exception, match="missing a label"):
        N.classification(rows.where("index = 2"), "ds").collect()
    pest = N.normalize(rows.where("index = 1"), "ip102", "ip102").first()
    assert pest.target.canonical_label == "x y" and json.loads(pest.metadata)["pest"] == "x y"


def test_vqa_records(spark):
    rows = raw(spark, [
        {"id": 7, "img": "a", "query": "q?", "response": ["yes", "no"], "split": "test"},
        {"image": "a", "question": "", "instruction": "do", "answer": "", "label": "lab", "task_type": "clarify_or_respond", "decision": "<Ask>", "management_keywords": ["k"]},
        {"image": "a", "question": "q", "answer": 0}, {"image": "a", "question": "q", "answer": [None, "x"]}, {"image": "a", "question": "q", "answer": [3]},
    ])
    got = N.vqa(rows, "v", strict=False).orderBy("ord").collect()
    assert (got[0].sample_id, got[0].target.answer_text, got[0].verifier.mode, got[0].messages[1].content[-1].text) == ("v-7", "yes", "exact_match", "q?")
    assert (got[1].target.answer_text, got[1].target.decision, got[1].verifier.expected_decision, got[1].verifier.management_keywords) == ("lab", "clarify", "clarify", ["k"])
    assert got[2].error == got[3].error == "row is missing an answer" and got[4].target.answer_text == "3"


def test_consultation_records(spark):
    rows = raw(spark, [
        {"image": "a", "diagnosis": " rust ", "management_steps": "spray", "uncertainty_required": False},
        {"image": "a", "answer": "x", "answer_text": "given", "required_sections": ["A"], "reward_weights": {"m": 2}},
    ])
    got = N.consultation(rows, "c").orderBy("ord").collect()
    assert got[0].target.answer_text.startswith("Diagnosis: rust\nEvidence: ") and "Management: spray" in got[0].target.answer_text
    assert json.loads(got[0].target.structured) == {"diagnosis": "rust", "management_steps": ["spray"]}
    assert (got[0].verifier.uncertainty_required, got[0].verifier.management_keywords, len(got[0].verifier.required_sections)) == (False, ["spray"], 5)
    assert (got[1].target.answer_text, got[1].verifier.required_sections, got[1].reward_meta.weights, got[1].verifier.uncertainty_required) == ("given", ["A"], {"m": 2.0}, True)


def test_directories_and_split_lists(spark, tmp_path):
    tree = spark.createDataFrame([(0, "train/Apple___scab/1.jpg"), (1, "x/Army-worm/2.jpg")], "index bigint, path string")
    rows = N.classification_directory(tree, "d", "d-v1", "data/").orderBy("ord").collect()
    assert (rows[0].split, rows[0].target.canonical_label, rows[0].images, rows[0].sample_id) == ("train", "apple scab", ["data/train/Apple___scab/1.jpg"], "d-train-apple-scab-1-jpg")
    assert N.classification_directory(tree, "d", "d-v1", pest=True).orderBy("ord").collect()[1].target.canonical_label == "Army worm"
    (tmp_path / "train.txt").write_text("im/worm/1.jpg 0\n\n im/fly_x/2.jpg 9\n")
    (tmp_path / "test.txt").write_text("im/fly_x/3.jpg\n")
    (tmp_path / "species.txt").write_text("\nred-worm\n")
    lines, classes = files.read_split_lists(spark, str(tmp_path)), files.read_class_list(spark, str(tmp_path))
    got = {r.images[0]: (r.split, r.target.canonical_label) for r in N.split_lists(lines, classes, "p").collect()}
    assert got == {"im/worm/1.jpg": ("train", "red worm"), "im/fly_x/2.jpg": ("train", "fly x"), "im/fly_x/3.jpg": ("test", "fly x")}
    assert {r.target.canonical_label for r in N.split_lists(lines, None, "p").collect()} == {"worm", "fly x"}
    listing = spark.createDataFrame([("im/worm/1.jpg",)], "path string")
    assert N.missing_files(N.split_lists(lines, None, "p"), listing).count() == 2


def test_staged_sources(spark):
    source = raw(spark, [
        {"faq-id": 3, "images": ["a", "gone"], "finetuning qa": {"species": {"a": " fig "}, "management instructions": {"a": "prune"}}},
        {"images": ["gone"]},
    ])
    kept, skipped = N.question_answer_records(source, spark.createDataFrame([("a",)], "path string"), "agbase")
    record = json.loads(kept.first().payload)
    assert (record["id"], record["diagnosis"], record["answer_text"], record["management_steps"], record["images"]) == ("agbase-3", "fig", "Species: fig\nManagement: prune", ["prune"], ["a"])
    assert skipped.first().skipped == 1
    talk = raw(spark, [{"image": "x/y.jpg", "conversations": [{"value": " q "}, {"value": "a"}]}])
    record = json.loads(N.conversation_records(talk, "agrillava", "Img/").first().payload)
    assert (record["id"], record["image"], record["question"], record["diagnosis"]) == ("agrillava-000000", "Img/y.jpg", "q", "a")
    with pytest.raises(Exception, match="missing question"):
        N.conversation_records(raw(spark, [{"image": "x", "conversations": [{"value": "q"}]}]), "d").collect()


def test_indices_do_not_depend_on_partitions(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id", "sha(cast(id as string)) AS h")
    got = [[(r["id"], r["index"]) for r in files.with_index(rows.repartition(n).orderBy("h")).orderBy("index").collect()] for n in (1, 8)]
    assert got[0] == got[1] and [i for _, i in got[0]] == list(range(1000))
    path = tmp_path / "r.jsonl"
    path.write_text("".join(f'{{"a": {i}}}\n' + "\n" * (i % 3) for i in range(3000)), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("4096b", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = files.read_payloads(spark, str(path))
            assert sorted((r["index"], json.loads(r.payload)["a"]) for r in rows.collect()) == [(i, i) for i in range(3000)]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_readers_do_not_shuffle_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a": 1}\n' * 10)
    plan = files.read_jsonl(spark, str(path), "a int")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "rangepartitioning" not in plan


def test_missing_pictures_fail(spark, tmp_path):
    (tmp_path / "there.jpg").write_bytes(b"\xff\xd8\xff")
    (tmp_path / "folder").mkdir()
    rows = spark.createDataFrame([("a", ["there.jpg", "gone.jpg"]), ("b", [str(tmp_path / "there.jpg"), "folder"]), ("c", None)], "sample_id string, images array<string>")
    assert {tuple(r) for r in files.missing_images(rows, str(tmp_path)).collect()} == {("gone.jpg", "a"), ("folder", "b")}
    with pytest.raises(FileNotFoundError, match="folder, gone.jpg"):
        files.require_images(rows, str(tmp_path))
    files.require_images(rows.where("sample_id = 'c'"), str(tmp_path))


def test_batches_and_streams_of_rows(tmp_path):
    import pandas as pd

    parts = [pd.DataFrame({"a": range(n)}) for n in (3, 0, 8, 1)]
    got = list(files.in_batches(iter(parts), 5))
    assert [len(x) for x in got] == [5, 5, 2] and [v for x in got for v in x["a"]] == [v for x in parts for v in x["a"]] and list(files.in_batches(iter([]), 5)) == []
    endless = iter(lambda: {"b": "é"}, None)
    assert files.first_of_stream(endless, 3, str(tmp_path / "x" / "a.jsonl")) == 3 and (tmp_path / "x" / "a.jsonl").read_text(encoding="utf-8") == '{"b": "é"}\n' * 3
    assert paths.prefix_limit(5, "partial", 0.1) == 1 and paths.prefix_limit(None, "partial", 0.1) is None and paths.prefix_limit(5, "full", 0.1) is None
    settings = paths.runtime_settings({"sample_fraction": 0.25}, "/r", None, 0.0, root="/d")
    assert settings == {"download_mode": "partial", "sample_fraction": 0.25, "subset_tag": "partial_25pct", "data_root": "/d"}


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "log")
    for i in range(3):
        one = spark.createDataFrame([(i, 0.5, 0.1, f"2024-01-01 0{i}:10:00")], "global_step bigint, loss double, learning_rate double, t string")
        files.append_metrics(one.select("global_step", "loss", "learning_rate", F.col("t").cast("timestamp").alias("logged_at")), [folder])
    stream = metrics_log.metrics_stream(spark, folder)
    counts = metrics_log.windowed_counts(stream.withColumn("run", F.lit("a")), "logged_at", "run")
    q = counts.writeStream.format("memory").queryName("metric_counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("metric_counts").agg(F.sum("n")).first()[0] == 3
    unique = metrics_log.first_deliveries_stream(stream, "learning_rate", "logged_at")
    q = unique.writeStream.format("memory").queryName("firsts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("firsts").count() == 1
