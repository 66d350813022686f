import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graincart.functions import hashing as H
from graincart.functions import text as X
from tests import plain


def frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").orderBy("i")


def column(df, expression):
    return [r.x for r in df.select("i", expression.alias("x")).orderBy("i").collect()]


def test_normal_forms_on_odd_strings(spark):
    df = frame(spark, plain.ODD)
    assert column(df, X.normalize_whitespace("t")) == [plain.whitespace(t) for t in plain.ODD]
    assert column(df, X.normalize_text("t")) == [plain.text(t) for t in plain.ODD]
    assert column(df, X.normalize_label("t")) == [plain.label(t) for t in plain.ODD]
    assert column(df, X.slugify("t")) == [plain.label(t).replace(" ", "-") for t in plain.ODD]
    assert [set(x) for x in column(df, X.token_set("t"))] == [plain.tokens(t) for t in plain.ODD]
    assert column(df, X.word_count("t")) == [len(plain.whitespace(t).split()) for t in plain.ODD]
    assert column(df, X.normalize_edges("t")) == [(t or "").strip() for t in plain.ODD]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x2FFF), max_size=30), min_size=1, max_size=20))
def test_normal_forms_on_random_strings(spark, values):
    df = frame(spark, values)
    assert column(df, X.normalize_text("t")) == [plain.text(t) for t in values]
    assert column(df, X.normalize_whitespace("t")) == [plain.whitespace(t) for t in values]


def test_matches(spark):
    df = frame(spark, plain.ODD)
    terms = ["leaf spot", "", "Early Blight", "a-b", "???"]
    assert column(df, X.overlap_ratio(terms, "t")) == [plain.overlap(terms, t) for t in plain.ODD]
    assert column(df, X.contains_any("t", terms)) == [plain.contains_any(t, terms) for t in plain.ODD]
    assert column(df, X.best_exact_match(terms, "t")) == [float(any(plain.text(r) == plain.text(t) for r in terms)) for t in plain.ODD]
    assert set(column(df, X.best_exact_match([], "t"))) == {0.0}
    assert column(df, X.overlap_ratio([], "t"))[0] == 0.0
    # the words of a prediction keep colons and slashes
    assert column(frame(spark, ["airflow: good"]), X.overlap_ratio(["airflow"], "t")) == [0.0]


def test_sections_splits_labels(spark):
    df = frame(spark, ["Diagnosis: x\nEvidence : y"])
    assert column(df, X.section_headers_present("t", X.SECTIONS)) == [["Diagnosis"]]
    names = frame(spark, ["val", " VALID ", "Train", None, "holdout", "x_y"])
    assert column(names, X.normalize_split_name("t")) == ["validation", "validation", "train", "", "holdout", "x y"]
    assert column(names, X.canonical_split("t")) == ["validation", "validation", "train", "", "holdout", "x_y"]
    paths = frame(spark, ["a/Train/val/x.jpg", "raw/x.jpg", None])
    assert column(paths, X.detect_split_from_path("t")) == ["train", None, None]
    labels = frame(spark, ["Apple___Black_rot", "Corn__Leaf__x", "plain_one", "a____b"])
    got = [(r.crop, r.disease) for r in column(labels, X.parse_plant_label("t"))]
    assert got == [("Apple", "Black rot"), ("Corn", "Leaf x"), (None, "plain one"), ("a", "b")]
    assert column(frame(spark, ["Army-Worm_big"]), X.parse_pest_label("t")) == ["Army Worm big"]


def test_decisions(spark):
    raw = frame(spark, ["<Respond>", "clarify", "needs more info", "task", "maybe", "  ", None, "clarify or respond"])
    assert column(raw, X.normalize_decision("t")) == ["respond", "clarify", "clarify", "clarify", "maybe", None, None, "respond"]
    said = frame(spark, ["really?", "Please upload a picture", "what crop is it", "yes", None])
    assert column(said, X.infer_decision("t")) == ["clarify", "clarify", "clarify", "respond", "respond"]


def test_structured_answer(spark):
    df = spark.createDataFrame([(["  a ", "", "b"],), ([],), (None,)], "s array<string>")
    got = [r.x.split("\n")[3] for r in df.select(X.structured_answer(F.lit("d"), F.col("s"), F.lit("u")).alias("x")).collect()]
    assert got == ["Management: a; b", f"Management: {X.NO_STEPS_LINE}", f"Management: {X.NO_STEPS_LINE}"]


def test_hashes_equal_python(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("v"))
    rows = df.select("v", H.stable_fraction(F.col("v"), "s").alias("f"), H.hash_split(F.col("v"), "s").alias("p"), H.is_holdout(F.col("v"), "s", 0.1).alias("h"), H.stable_hex(F.col("v"), "s").alias("x")).collect()
    for r in rows:
        share = plain.fraction(r.v, "s")
        assert (r.f, r.p, r.h, r.x) == (share, "train" if share < 0.8 else "validation" if share < 0.9 else "test", share < 0.1, plain.hexed(r.v, "s"))
    assert len({r.p for r in rows}) == 3


@pytest.mark.parametrize(("image", "images", "key"), [("s", ["p"], "d::s"), ("", ["p"], "d::p"), (None, None, "d::"), (None, [], "d::")])
def test_group_key(spark, image, images, key):
    df = spark.createDataFrame([("d", image, images)], "d string, i string, p array<string>")
    assert df.select(H.group_key(F.col("d"), F.col("i"), F.col("p"))).first()[0] == key
