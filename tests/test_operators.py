import json
import random

import pytest
from pyspark.sql import functions as F

from graincart.functions import rewards as R
from graincart.operators import manifests as M
from graincart.operators import metrics as E
from graincart.operators import reports as P
from graincart.operators import sampling as S
from graincart.operators.schema import FIELDS, UNIFIED, unified_type, unknown_keys, validate, with_violations
from graincart.operators.selection import hash_bucket, mark_prefix, position_bucket, prefix
from graincart.plans import build as B
from graincart.plans.evaluate import results_table, run_task
from tests import plain


def unified(i, source="plantdoc", split="train", task="classification", images=("a.jpg",), **more):
    row = {
        "sample_id": f"s{i}", "source_dataset": source, "task_type": task, "split": split, "images": list(images),
        "messages": [{"role": "user", "content": [{"type": "text", "text": "what?", "image": None}]}],
        "target": {"answer_text": "leaf spot", "canonical_label": "leaf spot", "canonical_labels": [], "decision": None, "structured": None, "acceptable_answers": []},
        "metadata": "{}", "verifier": {"mode": "label", "synonyms": {}, "uncertainty_required": False}, "reward_meta": {"weights": {}},
    }
    for key, value in more.items():
        row[key] = {**row[key], **value} if isinstance(value, dict) else value
    return row



def numbered(spark, rows):
    lines = [(i, json.dumps(r)) for i, r in enumerate(rows)]
    return spark.createDataFrame(lines, "ord bigint, value string").select(F.from_json("value", UNIFIED).alias("r"), "ord").select("r.*", "ord")


def test_schema_codes(spark):
    bad = unified(1, split="later", images=[], messages=[{"role": "robot", "content": []}], target={"answer_text": "", "canonical_label": None})
    good = unified(2, sample_id="  s2 ")
    rows = with_violations(numbered(spark, [bad, good])).orderBy("ord").collect()
    assert rows[0].violations == ["split", "images_empty", "role", "content_empty", "target_empty"]
    assert (rows[1].violations, rows[1].sample_id) == ([], "s2")
    assert validate(numbered(spark, [good])).count() == 1
    with pytest.raises(Exception, match="invalid row s1"):
        validate(numbered(spark, [bad])).collect()
    assert {f.name for f in unified_type()} == set(FIELDS)
    extra = spark.createDataFrame([('{"sample_id": 1, "zzz": 2}',), ("broken",)], "j string").select(unknown_keys(F.col("j")).alias("k")).collect()
    assert [r.k for r in extra] == [["zzz"], []]


def test_prefix_is_exact(spark):
    rng = random.Random(3)
    rows = [(g, f"{g}{i}", i, rng.randrange(-(2**63), 2**63)) for g, n in (("a", 700), ("b", 40), (None, 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, key string, i int, h bigint").repartition(5)
    for quota in (0, 1, 39, 40, 200, 5000):
        for buckets in (1, 16, 4096):
            got = prefix(df.withColumn("q", F.lit(quota)), "g", "q", F.col("h"), "key", hash_bucket(F.col("_order"), buckets))
            assert {r.g: r["count"] for r in got.groupBy("g").count().collect()} == {g: min(quota, n) for g, n in ((None, 3), ("b", 40), ("a", 700)) if quota}
    first = prefix(df.withColumn("q", F.lit(25)), "g", "q", F.col("i"), "key", position_bucket(df, "i")).collect()
    assert sorted(r.i for r in first if r.g == "a") == list(range(25)) and len(first) == 53
    nested = [{r.key for r in prefix(df.withColumn("q", F.lit(q)), "g", "q", F.col("h"), "key", hash_bucket(F.col("_order"))).where("g = 'a'").collect()} for q in (10, 50)]
    assert nested[0] < nested[1]
    assert mark_prefix(df.limit(0).withColumn("q", F.lit(1)), "g", "q", F.col("h"), "key", hash_bucket(F.col("_order"))).count() == 0


def test_quotas(spark):
    df = spark.createDataFrame([(g, i) for g, n in (("a", 25), ("b", 3), (None, 10)) for i in range(n)], "g string, ord int")
    counts = {r.g: r["count"] for r in S.prefix_quota(df, "g", 0.1).groupBy("g").count().collect()}
    assert counts == {"a": 2, "b": 1, None: 1}
    assert S.first_n(df, "g", 2).count() == 6 and S.first_n(df, "g", None).count() == 38
    assert [r.ord for r in S.first_rows(df.where("g = 'a'"), 3).collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        S.prefix_quota(df, "g", 0.0)


@pytest.mark.parametrize("seed", range(6))
def test_stratified_sample_equals_the_plain_statement(spark, seed):
    rng = random.Random(seed)
    rows = [{"ord": i, "sample_id": f"r{i}", "a": rng.choice("xyz"), "b": rng.choice("pq")} for i in range(rng.randrange(30, 160))]
    target, floor = rng.randrange(0, 120), rng.randrange(0, 12)
    df = spark.createDataFrame(rows).repartition(3)
    got = [r.sample_id for r in S.stratified_sample(df, target, ["a", "b"], floor, "salt").orderBy("order_key").collect()]
    assert got == plain.stratified(rows, target, ["a", "b"], floor, "salt")


def test_mode_first_seen(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 0), (1, "a", 2), (2, "x", 1), (2, "y", 0), (3, None, 0)], "g int, v string, p int")
    assert {r.g: r.mode for r in S.mode_first_seen(df, ["g"], "v", "p").collect()} == {1: "a", 2: "y"}
    arrays = spark.createDataFrame([(["b", "a", "a"],), (["b", "a"],), ([],)], "v array<string>")
    assert [r.m for r in arrays.select(S.mode_of_array(F.col("v")).alias("m")).collect()] == ["a", "b", None]


def test_merge_and_rewardable(spark):
    a = numbered(spark, [unified(1), unified(2, split="test")])
    b = numbered(spark, [unified(3, source="agbase", split="validation", task="consultation")])
    assert sorted(r.sample_id for r in B.build_sft([a, b]).collect()) == ["s1", "s3"]
    assert B.build_sft([a, b], tasks=(), without=()).count() == 3
    vqa = numbered(spark, [unified(4, task="vqa", verifier={"mode": "exact_match"}), unified(5, images=["a", "b"]), unified(6, target={"answer_text": "w " * 81})])
    assert sorted(r.sample_id for r in B.build_rl([a, vqa]).collect()) == ["s1", "s4"]


def test_tracks_and_holdout(spark):
    bench = numbered(spark, [unified(1, source="mirage", metadata='{"benchmark_track": "MMST"}'), unified(2, source="mirage", task="clarify_or_respond")])
    sources = {"plantdoc": numbered(spark, [unified(3, split="test"), unified(4), unified(5)])}
    out = B.build_eval(bench, sources, "nothing-below-zero", ratio=0.0)
    assert [r.sample_id for r in out["mmst"].collect()] == ["s1"] and [r.sample_id for r in out["mmmt"].collect()] == ["s2"]
    fallback = out["local_holdout"].collect()
    assert [(r.sample_id, r.split) for r in fallback] == [("s4", "holdout")]
    assert B.build_eval(None, sources, "x", ratio=1.0)["local_holdout"].count() == 2


def test_train_and_eval_share_nothing(spark):
    picture = lambda p: json.dumps({"source_image_id": p})
    source = numbered(spark, [
        unified("keep", metadata=picture("k")), unified("dup", metadata=picture("d")), unified("group", metadata=picture("v")), unified("val", split="validation", metadata=picture("v")),
        unified("test", split="test", metadata=picture("t")), unified("many", images=["a", "b"], metadata=picture("m")),
    ])
    held = numbered(spark, [unified("dup", split="holdout", metadata=picture("d"))])
    train, chosen, summary = B.build_train_eval(source, held, "salt")
    assert [r.sample_id for r in train.collect()] == ["skeep"]
    assert sorted(r.sample_id for r in chosen.collect()) == ["sdup", "sval"]
    assert summary["excluded"] == {"max_images": 1, "split": 2, "eval_overlap": 2}
    with pytest.raises(ValueError, match="overlap"):
        M.assert_no_overlap(source, held)
    with pytest.raises(ValueError, match="no training rows"):
        B.build_train_eval(source.where("split = 'test'"), held, "salt")
    assert B.dry_run_summary(train, held)["train_images"] == {"1": 1}


def test_eval_pool_order_and_precedence(spark):
    held = numbered(spark, [unified(1, split="holdout", task="vqa"), unified(1, split="holdout")])
    source = numbered(spark, [unified(1, split="dev"), unified(2, split="dev", task="vqa"), unified(2, split="dev")])
    pool = M.eval_pool(held, source, ("dev",), 1).orderBy("pool_ord").collect()
    assert [(r.sample_id, r.split, r.task_type) for r in pool] == [("s1", "holdout", "classification"), ("s2", "dev", "vqa")]


def test_target_text_order(spark):
    none = {"answer_text": None, "canonical_label": None}
    targets = [
        {}, {"answer_text": ""}, {**none, "canonical_labels": ["a", "b"]}, {**none, "decision": "clarify", "structured": '{"a": 1}'}, {**none, "decision": "clarify"}, {**none, "structured": '{"a": 1}'},
        {**none, "acceptable_answers": ["z"]}, {**none, "structured": "{}"},
    ]
    rows = numbered(spark, [unified(i, target=t) for i, t in enumerate(targets)])
    got = [r.x for r in rows.orderBy("ord").select(M.target_text(F.col("target")).alias("x")).collect()]
    assert got == ["leaf spot", "leaf spot", "a, b", '{"content": {"a": 1}, "decision": "clarify"}', "clarify", '{"a": 1}', "z", None]
    turns = M.training_messages(rows).orderBy("ord").first().messages
    assert (turns[-1].role, turns[-1].content[0].text) == ("assistant", "leaf spot")
    assert M.prompt_messages(M.training_messages(rows)).first().messages[-1].role == "user"


CASES = [
    ("exact_match", "Leaf-Spot!", {"acceptable_answers": ["leaf-spot"]}, {}, 1.0),
    ("exact_match", "other", {}, {}, 0.0),
    ("normalized_label", "tomato early blight", {"canonical_label": "Tomato___Early_Blight"}, {}, 1.0),
    ("synonym_match", "it is blight, surely", {"canonical_label": None}, {"synonyms": {"x": ["blight"]}}, 1.0),
    ("synonym_match", "nothing", {"canonical_label": None}, {"synonyms": {"x": ["??"]}}, 1.0),
    ("synonym_match", "a b", {"canonical_label": "a_b"}, {}, 0.0),
    ("synonym_match", "a b c", {"canonical_label": "a b"}, {}, 1.0),
    ("structured_format", "Diagnosis: x Evidence: y", {}, {"required_sections": ["Diagnosis", "Evidence", "Management", "Follow-up"]}, 0.5),
    ("structured_format", "x", {}, {}, 0.0),
    ("uncertainty_calibration", "with high confidence", {}, {"uncertainty_required": True}, 1.0),
    ("uncertainty_calibration", "with high confidence", {}, {"uncertainty_required": False}, 0.0),
    ("clarify_vs_respond", "which one?", {"decision": "clarify"}, {}, 1.0),
    ("clarify_vs_respond", "this one", {"decision": None}, {"expected_decision": "respond"}, 1.0),
    ("clarify_vs_respond", "this one", {}, {}, 0.0),
    ("management_coverage", "prune and mulch", {}, {"management_keywords": ["mulch", "spray"]}, 0.5),
    ("hallucination_penalty", "definitely a cure", {}, {"forbidden_claims": ["cure"], "uncertainty_required": True}, -1.5),
    ("hallucination_penalty", "certainly", {}, {"uncertainty_required": True}, -0.5),
    ("hallucination_penalty", "certainly", {}, {}, 0.0),
]


def test_rewards(spark):
    rows = numbered(spark, [unified(i, target=t, verifier=v) for i, (_, _, t, v, _) in enumerate(CASES)])
    said = spark.createDataFrame([(i, c[1]) for i, c in enumerate(CASES)], "ord bigint, said string")
    x = R.RewardInput.of(F.col("said"), F.col("target"), F.col("verifier"), F.col("reward_meta"))
    got = {r.ord: r for r in rows.join(said, "ord").select("ord", *[f(x).alias(n) for n, f in R.REWARDS.items()]).collect()}
    assert [(c[0], got[i][c[0]]) for i, c in enumerate(CASES)] == [(c[0], c[4]) for c in CASES]


def test_composite_weights(spark):
    row = unified(1, target={"acceptable_answers": ["leaf spot"]}, reward_meta={"weights": {"exact_match": 0.25}})
    df = numbered(spark, [row]).withColumn("said", F.lit("leaf spot"))
    x = R.RewardInput.of(F.col("said"), F.col("target"), F.col("verifier"), F.col("reward_meta"))
    one = lambda c: df.select(c.alias("c")).first().c
    assert one(R.composite(x, ["exact_match", "normalized_label"])).total == 1.25
    assert one(R.composite(x, ["exact_match", "normalized_label"], {"exact_match": 1.0})).by_module == {"exact_match": 1.0, "normalized_label": 1.0}
    with pytest.raises(KeyError):
        R.composite(x, ["no such"])
    turns = spark.createDataFrame([(None, [("a",), ("b",)]), ("c", None)], "c string, t array<struct<content:string>>")
    assert [r.x for r in turns.select(R.completion_text(F.col("c"), F.col("t")).alias("x")).collect()] == ["b", "c"]


def plain_f1(pairs):
    labels = {x for p in pairs for x in p}
    total = 0.0
    for lab in labels:
        tp = sum(a == b == lab for a, b in pairs)
        fp, fn = sum(b == lab != a for a, b in pairs), sum(a == lab != b for a, b in pairs)
        total += 2 * tp / (2 * tp + fp + fn) if tp else 0.0
    return total / len(labels)


def test_macro_f1_equals_the_loop(spark):
    rng = random.Random(0)
    rows = [(g, rng.choice("abcd"), rng.choice("abcde")) for g in range(25) for _ in range(rng.randrange(1, 30))]
    got = {r.g: r.label_macro_f1 for r in E.macro_f1(spark.createDataFrame(rows, "g int, a string, b string"), "a", "b", ["g"]).collect()}
    for g, value in got.items():
        assert value == pytest.approx(plain_f1([(a, b) for h, a, b in rows if h == g]))


def test_decision_metrics(spark):
    df = spark.createDataFrame([("clarify", "ok?"), ("clarify", "ok"), ("respond", "ok"), ("respond", "ok?")], "d string, p string")
    metrics = E.decision_metrics(F.col("d"), F.col("p"), F.lit(True))
    assert set(df.agg(*[c.alias(n) for n, c in metrics.items()]).first()) == {0.5}
    assert set(df.limit(0).agg(*[c.alias(n) for n, c in metrics.items()]).first()) == {0.0}


def test_oracle_evaluation(spark):
    rows = numbered(spark, [unified(i, task="vqa", target={"answer_text": f"yes {i}", "acceptable_answers": [f"yes {i}"], "canonical_label": None}) for i in range(2)])
    metrics, made = run_task("local_holdout", rows, "oracle", most=1)
    row = metrics.first()
    assert (row.num_examples, row.answer_exact_match, row.label_macro_f1, row.clarify_accuracy) == (1, 1.0, 0.0, None)
    assert len(made.columns) == 12 and made.first().prediction == "yes 0"
    track = run_task("mirage_mmst", rows, "echo")[0]
    assert results_table([metrics, track]).count() == 2 and track.first().answer_exact_match == 0.0
    assert run_task("local_holdout", rows.limit(0), "oracle")[0].count() == 0


def test_reports(spark):
    rows = numbered(spark, [unified(1), unified(2, source="", images=["bad.jpg", "a.jpg"]), unified(3, images=[])])
    checked = spark.createDataFrame([("bad.jpg", "missing file"), ("a.jpg", None)], "image string, error string")
    marked = P.image_errors(rows, checked)
    assert [[e.error for e in r.errors] for r in marked.orderBy("ord").collect()] == [[], ["missing file"], ["row is missing images"]]
    summary = {r.source_dataset: (r.rows, r.invalid_rows, r.images, r.invalid_images) for r in P.validation_summary(marked).collect()}
    assert summary == {"plantdoc": (2, 1, 1, 0), "unknown": (1, 1, 2, 1)}
    assert {(r.field, r.value): r.n for r in P.summarize(rows).collect()}[("split", "train")] == 3
    assert {r.images: r.n for r in P.image_histogram(rows).collect()} == {0: 1, 1: 1, 2: 1}
    heads = [b"\xff\xd8\xff\xe0", b"%PDF-1.7", b"RIFF\x00\x00\x00\x00WEBP", b"GIF89a", None]
    got = spark.createDataFrame([(h,) for h in heads], "h binary").select(P.header_error(F.col("h")).alias("e")).collect()
    assert [r.e for r in got] == [None, "unsupported image signature: PDF document", None, "unsupported image signature: 474946383961", "missing file"]


def test_tables(spark):
    tasks = spark.createDataFrame([("m", {"b": 1.0, "a": 2.0}), ("n", {"a": 3.0})], "model_name string, metrics map<string,double>")
    wide = P.pivot_metrics(tasks, ["model_name"])
    assert P.table_columns(wide.columns) == ["model_name", "metric_a", "metric_b"]
    assert {r.model_name: r.metric_b for r in wide.collect()} == {"m": 1.0, "n": None}
    logs = spark.createDataFrame([('{"global_step": 1, "loss": 0.5, "flag": true}',), ('{"loss": 2, "name": "x"}',)], "j string")
    assert {r.key: r.n for r in P.numeric_keys(logs, "j").collect()} == {"loss": 2}
    assert P.matching_keys(["eval_Loss", "lr"], ["loss"]) == ["eval_Loss"]
    paths = spark.createDataFrame([("a", "implemented", "p", True, True), ("b", "implemented", "q", True, False), ("b", "implemented", "r", False, False), ("c", "planned", "s", True, True)], "name string, implementation_status string, path string, required boolean, exists boolean")
    assert {r.name: (r.readiness_status, r.missing_paths) for r in P.readiness(paths).collect()} == {"a": ("ready", ""), "b": ("missing_data", "q"), "c": ("planned_or_blocked", "")}


def test_results_do_not_depend_on_partitions(spark):
    rows = numbered(spark, [unified(i, split=random.Random(i).choice(["train", "dev", "validation"]), metadata=json.dumps({"source_image_id": f"p{i % 17}"})) for i in range(80)])
    held = rows.where("ord % 9 = 0")
    want = None
    for n in (1, 3, 7):
        train, chosen, _ = B.build_train_eval(rows.repartition(n), held.repartition(n), "s", sample=10, floor=2)
        got = (sorted(r.sample_id for r in train.collect()), [r.sample_id for r in chosen.collect()])
        assert want in (None, got)
        want = got
    assert len(want[1]) == 10


def test_prefixes_by_sizes_equal_brute_force(spark):
    import hashlib
    import random

    from graincart.functions.hashing import stable_hex
    from graincart.operators.selection import hex_bucket, mark_prefix

    rng = random.Random(3)
    quotas = {"a": 0, "b": 50, "c": 7, "d": 10**6, "e": None, "f": 1}
    rows = [(f"{g}{i}", g, rng.choice([0, 1, 3, 9, None, -2]), q) for g, q in quotas.items() for i in range(rng.randrange(1, 60))]
    df = spark.createDataFrame(rows, "id string, g string, size int, q int").repartition(3)
    for sized in (True, False):
        marked = mark_prefix(df, "g", "q", stable_hex(F.col("id"), "s"), "id", hex_bucket(F.col("_order")), "taken", F.col("size") if sized else None)
        got = {r.id for r in marked.collect() if r.taken}
        want = set()
        for g, q in quotas.items():
            total = 0
            for key, size in sorted(((x[0], x[2]) for x in rows if x[1] == g), key=lambda x: hashlib.sha256(f"s::{x[0]}".encode()).hexdigest()):
                total += max(size or 0, 0) if sized else 1
                if q and q >= 1 and total <= q:
                    want.add(key)
                elif q is None or total > q:
                    break
        assert got == want and marked.columns == [*df.columns, "taken"]


def test_released_tables_leave_nothing(spark):
    import os

    from graincart.session import cut_lineage, release

    written = cut_lineage(spark.range(10))
    path = written._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.isdir(path)
    release(written, spark.range(3))
    assert not os.path.exists(path)
