"""What every query makes of empty tables, nulls in any column, repeated rows, long texts and columns with clashing names."""

import pytest

from graincart.llm import queries as Q
from graincart.llm.oracle import ORACLE
from tests.llm.build import SCHEMAS, TARGETS, folder, frame, record, rows
from tests.test_queries import compare, tables  # noqa: F401

#: Queries that only aggregate what another one gives.
DERIVED = ("p1_counts", "p1_pictures", "p3_found", "p3_shares", "p3_token_shares", "p3_checks", "p4_checks", "p5_found", "p6_records", "p7_found", "p7_report", "p7_checks", "p8_round_trip", "p9_fill", "p9_checks", "p10_classes")
MAIN = [n for n in Q.QUERIES if n not in DERIVED]
MANIFEST_QUERIES = [n for n in MAIN if not n.startswith(("p8", "p9", "p10"))]
DOCUMENT_QUERIES = [n for n in MAIN if n.startswith(("p8", "p9", "p10"))]
#: Names that the operators use themselves.
CLASHES = ["_row", "_pos", "word", "ids", "n", "tokens", "container", "part", "skeleton", "skeleton_id", "group_id", "copies", "_bucket", "_canon", "terminal", "term", "weight", "id", "kind", "name", "key", "keys", "node", "root", "records", "given", "label", "task", "question", "answer", "context", "train", "mark", "value", "taken", "_order", "_cell"]


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    """No rows, but for the reports on targets (none here) and those of one row."""
    path = folder(spark, tmp_path, split_targets=TARGETS["split_targets"])
    assert Q.QUERIES[name](spark, path).count() == (1 if name in ("p4_checks", "p9_checks", "p9_fill") else 0)


NULLS = [
    {"ord": 1}, {"ord": None, "sample_id": "s1"}, {"ord": 2, "sample_id": "s2", "split": "train", "images": [None, ""], "messages": [None]},
    {"ord": 3, "sample_id": "s3", "messages": [{"role": None, "content": None}], "target": {"answer_text": ""}, "metadata": "{broken"},
    {"ord": 4, "sample_id": "s4", "split": "dev", "images": [], "messages": [{"role": "user", "content": [None, {"type": "text", "text": None}]}], "metadata": "[1]"},
    {"ord": 5, "sample_id": "s5", "source_dataset": "", "task_type": " ", "split": "", "metadata": '{"contributor_id": null, "plant_id": {"a": 1}}'},
]


@pytest.mark.parametrize("name", MANIFEST_QUERIES)
def test_nulls_everywhere(spark, tmp_path, name):
    targets = {k: [*v, {}] for k, v in TARGETS.items()}
    path = folder(spark, tmp_path, manifest=NULLS, image_index=[{}, {"image_path": "a"}, {"content_sha": "x", "fingerprint": 1}], **targets)
    got = Q.QUERIES[name](spark, path).collect()
    if name == "p2_found":
        assert sorted(tuple(r) for r in got) == [(f"s{i}", "empty") for i in range(1, 6)]
    if name == "p6_found":
        assert sorted(tuple(r) for r in got) == [("s1", "s5"), ("s2", "s3")]
    if name == "p4_splits":
        assert len(got) == 5 and len({r.sample_id for r in got}) == 5


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_null_empty_and_long_documents(spark, tmp_path, name):
    texts = [None, "", "   ", "​", "x" * 30_000, "word " * 20_000, "é" * 5000, "a b", "a b"]
    documents = [{"doc_id": i, "text": t} for i, t in enumerate(texts)]
    path = folder(spark, tmp_path, documents=[*documents, documents[7]])
    got = Q.QUERIES[name](spark, path).collect()
    if name == "p10_found":
        assert [tuple(r) for r in got] == [(7, 8)]
    if name == "p8_ids":
        ids = {r.doc_id: r.ids for r in got}
        assert ids[0] == [] and ids[1] == [] and len(got) == len(texts)
    if name == "p9_found":
        assert sorted(r.doc_id for r in got) == [4, 5, 6]


@pytest.mark.parametrize("name", MAIN)
def test_extra_columns_change_nothing(spark, tmp_path, name):
    manifest = [record(i, source="src" if i % 3 else "other", split=("train", "dev")[i % 2], images=[f"p{i // 2}.jpg"], label="Leaf Rust", meta={"plant_id": f"P-{i // 3}"}, ord=i) for i in range(24)]
    manifest += [manifest[3], {**record(3, ord=99)}]
    index = [{"image_path": f"P{i}.JPG", "content_sha": f"c{i // 2}", "fingerprint": i * 37} for i in range(12)]
    documents = [{"doc_id": i, "text": t} for i, t in enumerate(["one two", "ｏne two", "three", "three", None])]
    given = {"manifest": manifest, "image_index": index, "documents": documents, **TARGETS}
    plain, wide = folder(spark, tmp_path / "a", **given), folder(spark, tmp_path / "b", extra=CLASHES, **given)
    key = lambda df: sorted((str(tuple(r)) for r in df.collect()))
    want = Q.QUERIES[name](spark, plain)
    assert key(want) == key(Q.QUERIES[name](spark, wide).select(*want.columns))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, folder, tables, name):  # noqa: F811
    compare(spark, folder, tables, Q.QUERIES[name], ORACLE[name])


def test_schemas_are_complete(spark):
    assert all(frame(spark, name, []).columns for name in SCHEMAS) and rows(frame(spark, "split_targets", [{"split": "a"}])) == [("a", None)]
