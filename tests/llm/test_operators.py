"""The operators against brute force on small fixtures."""

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graincart.llm import budget, dedup, frequency, grouping, mixing, overlap, packing, pairs, quota, skeleton, tokens
from graincart.llm.queries import tokenizer_path
from tests.llm.build import TARGETS, frame, record

# ---------------------------------------------------------------- 1


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9])
def test_cosine_join_equals_brute_force(spark, threshold):
    rng = random.Random(int(threshold * 10))

    def vectors(start):
        out = {}
        for i in range(60):
            terms = {int(rng.paretovariate(0.6)) % 40: rng.random() * rng.choice([1, 1, -0.3]) for _ in range(rng.randrange(1, 7))}
            norm = math.sqrt(sum(w * w for w in terms.values()))
            out[start + i] = {t: w / norm for t, w in terms.items()}
        return out

    a, b = vectors(0), vectors(1000)
    as_rows = lambda v: spark.createDataFrame([(i, t, w) for i, x in v.items() for t, w in x.items()] + [(None, 1, 1.0), (1, None, 1.0)], "id bigint, term bigint, weight double")
    got = {(r.id_a, r.id_b): r.cosine for r in overlap.weighted_cosine_join(as_rows(a), as_rows(b), threshold).collect()}
    want = {(i, j): c for i, x in a.items() for j, y in b.items() if (c := sum(w * y.get(t, 0.0) for t, w in x.items())) >= threshold - 1e-9}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())


@pytest.mark.parametrize("blocks", [6, 7, 8])
def test_near_fingerprints(spark, monkeypatch, blocks):
    rng = random.Random(blocks)
    base = [rng.getrandbits(64) for _ in range(40)]

    def near(x, most):
        for bit in rng.sample(range(64), rng.randrange(most + 1)):
            x ^= 1 << bit
        return x - (1 << 64) if x >> 63 else x

    a, b = {near(x, 3) for x in base} | {0, -1}, {near(x, 6) for x in base} | {-(2**63), 15, 31}
    monkeypatch.setattr(overlap, "blocks_for", lambda n: blocks)
    ids = lambda v: spark.createDataFrame([("f", x) for x in v], "kind string, id bigint")
    got = {tuple(r) for r in overlap.alike_pictures(ids(a), ids(b)).collect()}
    assert got == {(x, y) for x in a for y in b if bin((x ^ y) & (2**64 - 1)).count("1") <= 4} and len(got) >= 10


def test_cross_split_pairs(spark):
    rows = [record("a", images=["raw/X 1.jpg"]), record("b", images=["RAW\\x1.JPG"], split="Test"), record("c", images=["y.jpg"], split="val"), record("d", images=["z.jpg"]), record("e", images=["w.jpg"], split="dev"), record("f", images=["v.jpg"], split="")]
    index = [("Y.jpg", "h", None), ("z.jpg", "h", 7), ("w.jpg", None, 7 ^ 0b1111), ("v.jpg", "h", 7), ("z.jpg", "h", 7)]
    images = [{"image_path": p, "content_sha": s, "fingerprint": f} for p, s, f in index]
    got = overlap.cross_split_pairs(frame(spark, "manifest", rows), frame(spark, "image_index", images))
    assert {(r.train_id, r.other_id, r.other_split) for r in got.collect()} == {("sa", "sb", "test"), ("sd", "sc", "validation"), ("sd", "se", "dev")}


def test_every_kind_of_value_goes_through_the_cosine_join(spark, monkeypatch):
    rows = [record("a", images=["x.jpg"]), record("b", images=["x.jpg"], split="test"), record("c", images=["y.jpg"], split="dev"), record("d", images=["z.jpg"], split="dev")]
    index = [{"image_path": p, "content_sha": s, "fingerprint": f} for p, s, f in (("x.jpg", "h", 7), ("y.jpg", None, 3), ("z.jpg", "h", None))]
    joined, join = [], overlap.weighted_cosine_join

    def spy(*args):
        found = join(*args)
        joined.extend((r.id_a, r.id_b, round(r.cosine, 6)) for r in found.collect())
        return found

    monkeypatch.setattr(overlap, "weighted_cosine_join", spy)
    tables = frame(spark, "manifest", rows), frame(spark, "image_index", index)
    got = overlap.cross_split_pairs(*tables)
    assert {(r.train_id, r.other_id) for r in got.collect()} == {("sa", "sb"), ("sa", "sc"), ("sa", "sd")}
    # the path, the digest and the fingerprint itself, and one that differs by a bit: ten of fifteen choices are untouched
    assert len(joined) == 4 and sorted(c for _, _, c in joined)[1:] == [1, 1, 1] and 0.6 < min(c for _, _, c in joined) < 0.7
    classes = {tuple(r) for r in overlap.shared_pictures(*tables).collect()}
    assert classes == {("p", "xjpg", "xjpg", 1, 1), ("s", "h", "h", 1, 2), ("f", "7", "7", 1, 1), ("f", "7", "3", 1, 1)}


def test_vectors_are_pruned(spark):
    """Terms that the other side lacks, and those that cannot reach the threshold, are not looked up."""
    left = spark.createDataFrame([(1, t, math.sqrt(w)) for t, w in ((10, 0.5), (11, 0.3), (12, 0.1), (13, 0.1))], "id bigint, term bigint, weight double")
    right = spark.createDataFrame([(i, t, math.sqrt(w)) for i in range(5) for t, w in ((12, 0.1), (13, 0.1), (20 + i, 0.8))] + [(9, 10, math.sqrt(0.5)), (9, 11, math.sqrt(0.5))], "id bigint, term bigint, weight double")
    (row,) = overlap.pruned_vectors(left, right, 0.8).collect()
    assert [x.term for x in row.kept] == [11] and sorted(x.term for x in row.rest) == [10, 12, 13]
    (row,) = overlap.pruned_vectors(left, right.where("term < 11 OR term > 11"), 0.5).collect()
    assert 11 not in [x.term for x in row.kept + row.rest]
    got = overlap.weighted_cosine_join(left, right, 0.8).collect()
    assert [(r.id_a, r.id_b) for r in got] == [(1, 9)] and got[0].cosine == pytest.approx(math.sqrt(0.25) + math.sqrt(0.15))


def test_a_hot_picture_is_one_row(spark):
    rows = [record(i, images=["hot.jpg"], split="train" if i % 2 else "test") for i in range(60)]
    (row,) = overlap.shared_pictures(frame(spark, "manifest", rows), frame(spark, "image_index", [])).collect()
    assert (row.name_a, row.train_records, row.other_records) == ("hotjpg", 30, 30)


# ---------------------------------------------------------------- 2

Q = "Why do the leaves of my tomato look like this?"
ALONE = [
    (Q, None, "empty"), (Q, " \n​", "empty"), (Q, "...", "empty"), (Q, "N/A", "empty"), (Q, "<answer></answer>", "empty"), (Q, "Answer:", "empty"), (Q, "Diagnosis:\nEvidence:\n**Follow-up**:", "empty"),
    ("How many?", "0", None), ("Is it ill?", "No.", None), ("How many?", "none visible", None), ("Is it ill?", "nein", None),
    (Q, "I'm sorry, but I can't help with that request.", "refusal"), (Q, "Hello. This topic falls outside what I am allowed to discuss.", "refusal"), (Q, "**Notice:** I must decline to answer questions about plants.", "refusal"),
    (Q, "Désolé, je ne peux pas répondre à cette demande.", "refusal"), (Q, "Lo siento, no puedo ayudar con esa consulta.", "refusal"), (Q, "Leider kann ich dazu keine Auskunft geben.", "refusal"), (Q, "Desculpe, não posso ajudar com esse pedido.", "refusal"),
    (Q, "I cannot name the pathogen from one photo, but the spots make early blight the likeliest cause.", None), (Q, "Unfortunately the roots are already lost, yet the tomato will recover if you mulch.", None), (Q, "Please add a photo of the stems; the view hides them.", None),
    (Q, Q, "copies_question"), (Q, "Q: " + Q.upper(), "copies_question"), (Q, f"{Q} {Q}", "copies_question"), (Q, f"{Q} The damage is recent and limited to the leaves, which suggests thrips.", None), ("Is it rust or scab?", "rust", None),
    (Q, "Es handelt sich wohl um Schorf an Mais, begünstigt durch Nässe, also Gelbtafeln aufhängen.", "other_language"), (Q, "水稻叶片上的褐色轮纹说明已经发病，建议改善通风。", "other_language"), ("¿Qué cultivo aparece en la foto?", "yuca", None),
    ("Was hilft gegen Thripse?", "Es sind nur wenige zu sehen, daher reicht es, wenn Sie weniger gießen.", None), (Q, "The café-style notice is for the visitors of the garden.", None),
    (Q, "The spots point to stem (see", "truncated"), (Q, "He said «the leaves are", "truncated"), (Q, "```\nspray: weekly\n", "truncated"), (Q, "Steps:\n- prune\n- ", "truncated"), (Q, "It is early blight, which", "truncated"), (Q, "Why do the leaves of my tom", "truncated"),
    (Q, "1) prune\n2) mulch", None), (Q, "It's fine (I think).", None), (Q, 'The "spots" are fine', None), (Q, "about 38", None),
]


@pytest.mark.parametrize(("question", "answer", "defect"), ALONE)
def test_pairs_on_their_own(question, answer, defect):
    assert pairs.inspect(question, answer)[0] == defect


@pytest.mark.parametrize("answer", ["Sorry, I cant help with that.", "We wont discuss this.", "Leider kann ich dazu nichts sagen.", "Leider kann ich dazu keinerlei Auskunft geben.", "Las politicas impiden responder.", "Me niego.", "Recuso.", "抱歉"])
def test_refusals_of_any_length_and_spelling(answer):
    assert pairs.inspect(Q, answer)[0] == "refusal"


LEFT_OPEN = ["He said **stop here", "Use `code ", "(a {b) done.", "[1] see (fig. 2", "<b>Spray early", "- prune\n- ", "```\nspray", "Er sagte „ja“ und «nein", '"It is rust, he said', "<ul><li>prune</li>"]
CLOSED = ["Spray early.<br>Repeat weekly.", "<p>Paragraph one. All is fine.", 'Use a 5" pot and water daily.', "He said **stop** here.", "Use `code` here.", "1) prune 2) mulch", "(a {b}) done.", "<ul><li>prune<li>mulch</ul>", "<img src='a.png'/> fine", 'The "5" is fine.', "It`s fine", "```\n(a\n``` done", "2 ** 3 is 8"]


@pytest.mark.parametrize(("answer", "is_open"), [(x, True) for x in LEFT_OPEN] + [(x, False) for x in CLOSED])
def test_pushdown_parser(answer, is_open):
    assert pairs.left_open(answer) == is_open


@pytest.mark.parametrize(
    ("question", "answer", "defect"),
    [
        ("How many aphids are on this leaf?", "None.", None), ("How many aphids are on this leaf?", "Nil.", None), ("Are there any aphids?", "none", None), ("¿Cuántas plagas hay?", "None", None), ("What is this?", "None.", "empty"), ("What is this?", "none given", "empty"),
        ("O que é isso?", "Não posso afirmar com certeza, parece ferrugem.", None), ("O que é isso?", "Não posso responder a isso.", "refusal"), (Q, "We do not discuss this.", "refusal"), (Q, "That falls outside what I can do here.", "refusal"),
        (Q, "I cannot say for certain, it looks like rust.", None), (Q, "We do not see any spots on this leaf.", None),
    ],
)
def test_numbers_doubt_and_denials(question, answer, defect):
    assert pairs.inspect(question, answer)[0] == defect


def test_a_table_delivered_under_other_ids_changes_nothing(spark):
    whole = "The spots on the lower leaves point to early blight, so remove the worst leaves and check again after {} days."
    rows = [record(i, answer=whole.format(i)) for i in range(40)] + [record(100, answer="The spots on the lower leaves point to early blight, so rem"), record(101, answer="The spots on the lower leaves point"), record(102, answer="early blight")]
    twice = rows + [{**r, "sample_id": "t" + r["sample_id"]} for r in rows]
    got = {(r.sample_id, r.defect) for r in pairs.defective_pairs(frame(spark, "manifest", twice)).collect()}
    assert got == {(p + s, "truncated") for p in ("", "t") for s in ("s100", "s101")}


@pytest.mark.parametrize("answer", ["N/A" + " " * 80, "None" + "." * 80, " " * 80 + "n/a"])
def test_padded_words_for_nothing(answer):
    assert pairs.inspect(Q, answer)[0] == "empty"


def test_tiling():
    a, b = "x a b c y a b c".split(), "a b c d".split()
    in_a, in_b = pairs.tiles(a, b, 3)
    assert in_a == [False, True, True, True, False, True, True, True] and in_b == [True, True, True, False]


def test_truncation_by_the_corpus(spark):
    whole = "The spots on the lower leaves point to early blight, so remove the worst leaves and check again after {} days."
    rows = [record(i, answer=whole.format(i)) for i in range(40)]
    rows += [record(100, answer="The spots on the lower leaves point to early blight, so rem"), record(101, answer="The spots on the lower leaves point"), record(102, answer=whole.format(7)[:-1]), record(103, answer="early blight"), record(104, answer="oversight"), record(105, answer=whole.format(3)[:60], task=" Classification ")]
    got = {(r.sample_id, r.defect) for r in pairs.defective_pairs(frame(spark, "manifest", rows)).collect()}
    assert got == {("s100", "truncated"), ("s101", "truncated")}


def test_copies_of_a_truncated_answer_are_no_evidence(spark):
    whole = "The spots on the lower leaves point to early blight, so remove the worst leaves and check again after {} days."
    rows = [record(i, answer=whole.format(i)) for i in range(40)]
    cut = ["The spots on the lower leaves point to early blight, so rem", "The spots on the lower leaves point"]
    rows += [record(100 + i, answer=cut[i % 2] if i % 4 < 2 else f" {cut[i % 2].upper()} ") for i in range(40)]
    got = {(r.sample_id, r.defect) for r in pairs.defective_pairs(frame(spark, "manifest", rows)).collect()}
    assert got == {(f"s{100 + i}", "truncated") for i in range(40)}


# ---------------------------------------------------------------- 3 and 7


def test_portions_and_pouring():
    assert budget.portions(10, [1, 1, 1]) == [4, 3, 3] and budget.portions(5, [0, 0]) == [0, 0] and sum(budget.portions(997, [3, 5, 11, 2])) == 997
    leaves = [budget.Leaf(("f", "a"), 500, 10), budget.Leaf(("f", "b"), 250, 1000), budget.Leaf(("g", "c"), 250, 1000)]
    assert budget.allocate(leaves, 100) == 0
    # what a lacks goes to its sibling b, not to c
    assert [x.given for x in leaves] == [10, 65, 25]
    leaves = [budget.Leaf(("f", "a"), 500, 10), budget.Leaf(("f", "b"), 250, 30), budget.Leaf(("g", "c"), 250, 40)]
    assert budget.allocate(leaves, 100) == 20 and [x.given for x in leaves] == [10, 30, 40]
    leaves = [budget.Leaf(("a",), 900, 100), budget.Leaf(("b",), 100, 100, floor=30)]
    assert budget.allocate(leaves, 100) == 0 and [x.given for x in leaves] == [70, 30]


@pytest.mark.parametrize("seed", range(20))
def test_allocation_invariants(seed):
    rng = random.Random(seed)
    leaves = [budget.Leaf((rng.choice("fgh"), rng.choice("xy"), str(i)), rng.randrange(0, 50), rng.randrange(0, 80), rng.randrange(0, 5)) for i in range(rng.randrange(1, 12))]
    total = rng.randrange(0, 300)
    left = budget.allocate(leaves, total)
    given = sum(x.given for x in leaves)
    assert all(0 <= x.given <= x.capacity for x in leaves) and left >= 0
    floors = sum(min(x.floor, x.capacity) for x in leaves)
    assert given + left == total or given == floors > total
    if left and sum(x.weight for x in leaves):
        assert all(x.given == x.capacity for x in leaves)


def cells(spark, counts):
    rows = [(f"{s}-{t}-{p}-{i}", s, t, p) for (s, t, p), n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "sample_id string, source_dataset string, task_type string, split string").repartition(3)


def test_mix(spark):
    records = cells(spark, {("src", "vqa", "train"): 30, ("other", "vqa", "train"): 50, ("spare", "vqa", "train"): 20})
    report = mixing.budgets(records, frame(spark, "mix_targets", TARGETS["mix_targets"] + [{"source_dataset": "gone", "target_permille": 10, "max_repeats": 3}]), frame(spark, "dataset_registry", TARGETS["dataset_registry"]))
    made = {r.source_dataset: r for r in report.collect()}
    assert {k for k, r in made.items() if r.falls_short} == {"gone"} and made["src"].capacity == 60
    mixed = mixing.mix(records, report).collect()
    uses = Counter()
    for r in mixed:
        uses[r.source_dataset] += r.copies
        assert r.copies <= (2 if r.source_dataset == "src" else 1)
    assert uses == {"src": made["src"].given, "other": made["other"].given} and sum(uses.values()) == 100
    again = {r.sample_id: r.copies for r in mixing.mix(records.repartition(7), report).collect()}
    assert again == {r.sample_id: r.copies for r in mixed}
    shares = {(r.source_dataset, r.task_type): r.actual_permille for r in mixing.shares(mixing.mix(records, report), report).collect()}
    assert shares[("src", None)] == pytest.approx(made["src"].given * 10) and ("src", "vqa") in shares


def test_mix_by_languages_and_tokens(spark):
    """Languages are leaves of their own: what one lacks comes from the other source in that language first. Sizes are those of the records."""
    rows = [(f"{s}-{lang}-{i}", s, "vqa", lang, size) for s, lang, n, size in (("src", "en", 10, 3), ("src", "de", 10, 3), ("other", "en", 40, 7), ("other", "de", 10, 5)) for i in range(n)]
    records = spark.createDataFrame(rows, "sample_id string, source_dataset string, task_type string, language string, tokens int").repartition(3)
    targets, registry = frame(spark, "mix_targets", TARGETS["mix_targets"]), frame(spark, "dataset_registry", TARGETS["dataset_registry"])
    report = {(r.source_dataset, r.language): r for r in mixing.budgets(records, targets, registry, size="tokens").collect()}
    total = 60 + 280 + 50
    assert report["src", "en"].capacity == 60 == report["src", "en"].given and report["src", "de"].falls_short and not report["other", "en"].falls_short
    assert sum(r.given for r in report.values()) == total and report["other", "de"].given == 50
    table = mixing.budgets(records, targets, registry, size="tokens")
    mixed = mixing.mix(records, table, size="tokens").collect()
    used = Counter()
    for r in mixed:
        used[r.source_dataset, r.language] += r.copies * r.tokens
    # a prefix leaves less room than its next record takes
    assert all(0 <= report[k].given - n < 7 for k, n in used.items()) and used["src", "en"] == 60
    assert {r.sample_id: r.copies for r in mixing.mix(records.repartition(5), table, size="tokens").collect()} == {r.sample_id: r.copies for r in mixed}


def test_languages_of_records(spark):
    rows = [record(1), record(2, question="Was hilft gegen Thripse?", answer="Es sind nur wenige zu sehen."), record(3, question="水稻叶片上的褐色", answer=None), {"ord": 9, "sample_id": "s9"}]
    got = {r.sample_id: r.language for r in mixing.mixable(frame(spark, "manifest", rows)).collect()}
    assert got == {"s1": "en", "s2": "de", "s3": "zh", "s9": ""}


def test_sample(spark):
    records = cells(spark, {("src", "vqa", "train"): 200, ("src", "vqa", "test"): 60, ("other", "vqa", "dev"): 1, ("none", "x", "train"): 39})
    report = quota.plan_sample(records, frame(spark, "sample_targets", TARGETS["sample_targets"]))
    made = {r.source_dataset: r for r in report.collect()}
    assert made["other"].unmet and not made["src"].unmet and (made["src"].given, made["other"].given) == (29, 1)
    drawn = quota.draw(records, report).collect()
    assert Counter(r.source_dataset for r in drawn) == {"src": 29, "other": 1} and len({r.sample_id for r in drawn}) == 30
    assert {r.sample_id for r in quota.draw(records.repartition(9), report).collect()} == {r.sample_id for r in drawn}


# ---------------------------------------------------------------- 4


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    n = 150
    keys = {f"r{i:03}": {f"k{rng.randrange(n)}" for _ in range(rng.randrange(0, 3))} | ({"hot"} if rng.random() < 0.3 else set()) for i in range(n)}
    if seed == 2:  # a long chain
        keys = {f"r{i:03}": {f"c{i}", f"c{i + 1}"} for i in rng.sample(range(n), n)}
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for r, ks in keys.items():
        for k in ks:
            holders.setdefault(k, []).append(r)
    for members in holders.values():
        for m in members[1:]:
            a, b = sorted((find(members[0]), find(m)))
            parent[b] = a
    df = spark.createDataFrame([(r, sorted(ks)) for r, ks in keys.items()], "sample_id string, keys array<string>").repartition(4)
    got = {r.sample_id: r.group_id for r in grouping.components(df).collect()}
    shared = {m for members in holders.values() if len(members) > 1 for m in members}
    assert got == {r: find(r) for r in shared}


def test_related_records_and_divided_groups(spark):
    rows = [
        record(1, meta={"contributor_id": "AA-01"}), record(2, meta={"submitted_by": "aa 01"}, split="test"), record(3, meta={"plant_id": "AA-01"}), record(4, meta={"source_image_id": "p1"}), record(5, meta={"source_image_id": "P-1"}, source="SRC ", split="dev"),
        record(6, meta={"source_image_id": "p1"}, source="other", split="dev"), record(7, meta={"contributor_id": "Unknown "}), record(8, meta={"contributor_id": "unknown"}, split="test"), record(9, meta={"plant_id": "x", "contributor_id": "AA01"}), record(10, meta={"plant_id": "X"}),
    ]
    records = grouping.related_by(frame(spark, "manifest", rows))
    groups = grouping.components(records)
    got = {(r.group_id, r.sample_id) for r in grouping.divided_groups(records, groups).collect()}
    assert got == {("s1", "s1"), ("s1", "s2"), ("s1", "s9"), ("s1", "s10"), ("s4", "s4"), ("s4", "s5")}


def test_splits_keep_groups_and_shares(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(f"r{i}", rng.choice(["a", "a", "b"]), rng.choice(["x", "x", "x", "y"]), f"g{rng.randrange(900)}" if i % 5 else f"h{i % 3}") for i in range(4000)]
    records = spark.createDataFrame([(r, s, t) for r, s, t, _ in rows], "sample_id string, source_dataset string, task_type string")
    first = {}
    for r, _, _, g in sorted(rows):
        first.setdefault(g, r)
    groups = spark.createDataFrame([(r, first[g]) for r, _, _, g in rows if g != "g0"], "sample_id string, group_id string")
    targets = frame(spark, "split_targets", TARGETS["split_targets"])
    for most in (50_000, 0):
        monkeypatch.setattr(grouping, "MOST_SETS", most)
        got = grouping.assign_splits(records, groups, targets).collect()
        assert len(got) == 4000 and len({(r.group_id, r.split) for r in got}) == len({r.group_id for r in got})
        share = Counter(r.split for r in got)
        assert abs(share["train"] / 4000 - 0.8) < 0.02 and abs(share["test"] / 4000 - 0.1) < 0.02
        label = {r: (s, t) for r, s, t, _ in rows}
        for cell in {label[r.sample_id] for r in got}:
            inside = Counter(r.split for r in got if label[r.sample_id] == cell)
            assert abs(inside["train"] / sum(inside.values()) - 0.8) < 0.05
    with pytest.raises(ValueError):
        grouping.assign_splits(records, groups, targets.limit(0))


@pytest.mark.parametrize("seed", range(5))
def test_a_block_is_placed_like_its_groups_one_by_one(seed):
    rng = random.Random(seed)
    for _ in range(200):
        need, size, groups = [rng.randrange(-50, 100) for _ in range(rng.randrange(1, 5))], rng.randrange(1, 9), rng.randrange(0, 40)
        left, want = list(need), [0] * len(need)
        for _ in range(groups):
            i = max(range(len(left)), key=lambda s: (left[s], -s))
            want[i] += 1
            left[i] -= size
        assert grouping.pour(groups, size, need) == want


def test_turns_take_the_rarest_outstanding_label(spark):
    sets = [(("a",), {"a": 9}), (("a", "b"), {"a": 1, "b": 3}), (("b", "c"), {"b": 7, "c": 2}), (("c", "d"), {"c": 5, "d": 5})]
    # d 5, c 7, b 10, a 10; with d goes c's 5, with c (2 left) b's 7, then b (3 left), then a
    assert sorted(grouping.turns(sets), key=grouping.turns(sets).get) == ["d", "c", "b", "a"]
    table = spark.createDataFrame([(list(x), c) for x, c in sets], "labels array<string>, counts map<string,bigint>")
    assert grouping._turns_by_passes(table) == grouping.turns(sets)


@pytest.mark.parametrize("copies", [1, 100, 10_000])
def test_rare_labels_keep_their_proportions(copies):
    """A label of 100 groups among any number of others, alone or beside a frequent one."""
    blocks = [("rare", ["rare"], [1], 100, 0), ("scarce", ["often", "scarce"], [3, 1], 10, 1), ("often", ["often"], [2], copies, 2), ("often", ["often"], [1], 100 * copies, 3)]
    totals = {"rare": 100, "scarce": 10, "often": 30 + 102 * copies}
    need = [{label: n * part for label, n in totals.items()} for part in (800, 100, 100)]
    got = dict(grouping.place(blocks, need, 1000))
    assert got[0] == [80, 10, 10] and got[1] == [8, 1, 1]
    often = [3 * got[1][s] + 2 * got[2][s] + got[3][s] for s in range(3)]
    assert all(abs(n - totals["often"] * part / 1000) <= 2 for n, part in zip(often, (800, 100, 100)))


# ---------------------------------------------------------------- 5


def test_frequencies(spark):
    df = spark.createDataFrame([("Leaf_Rust", "vqa")] * 2 + [("rust, rust", "vqa"), (None, "vqa"), ("---", None), ("??", "x/y")] + [("scab", "vqa")] * 50, "label string, task string")
    got = {(r.field_name, r.value): (r.occurrences, r.records, r.mark) for r in frequency.term_frequencies(df, {"l": F.col("label"), "t": F.col("task")}, {"w": F.col("label")}).collect()}
    assert got[("l", "leaf rust")] == (2, 2, "rare") and got[("w", "rust")] == (4, 3, "common") and got[("t", "x y")] == (1, 1, "rare") and got[("l", "scab")] == (50, 50, "common")
    assert ("l", "") not in got and got[("l", "---")] == (1, 1, "rare")


# ---------------------------------------------------------------- 6


def test_trie():
    rng = random.Random(5)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 40))) for _ in range(3000)] + [b"", b"a" * 100, b"a" * 100, b"a" * 101]
    trie = dedup.Trie()
    for i, k in enumerate(keys):
        trie.add(k, str(i))
    got = {k: len(v) for k, v in trie.terminals()}
    assert got == Counter(keys)


@pytest.mark.parametrize("fits", [3, 50, 20_000])
def test_copies_equal_brute_force(spark, fits):
    rng = random.Random(fits)
    texts = ["Yes", " yes. ", "«YES!»", "no", "No ,", "it is\trust", "It is rust...", "", None, "y-e s"]
    rows = [record(f"{i:03}", answer=rng.choice(texts), question=rng.choice(["A b?", "a B", "c"]), images=rng.sample(["raw/P 1.jpg", "RAW/p1.JPG", "q.png"], rng.randrange(1, 3))) for i in range(300)]
    for r in rows:
        if rng.random() < 0.3:
            r["messages"][1]["content"].reverse()

    def fold(t):
        return "".join(ch for ch in (t or "").lower() if ch.isalnum())

    groups = {}
    for r in rows:
        key = (frozenset(fold(p) for p in r["images"]), fold(r["target"]["answer_text"]), tuple(sorted(fold(p["text"]) for p in r["messages"][1]["content"] if p["type"] == "text")))
        groups.setdefault(key, []).append(r["sample_id"])
    want = {(min(v), x, len(v)) for v in groups.values() if len(v) > 1 for x in v}
    got = {(r.group_id, r.sample_id, r.copies) for r in dedup.copies(frame(spark, "manifest", rows).repartition(3), fits).collect()}
    assert got == want


def test_long_common_prefixes_and_large_records(spark):
    """One level splits a bucket wherever its records differ first, and buckets are bounded by their bytes too."""
    rows = [(f"r{i:03}", b"x" * 5000 + f"{i % 90:03}".encode()) for i in range(180)] + [(f"s{i}", b"same" * 1000) for i in range(40)]
    df = spark.createDataFrame(rows, "sample_id string, _canon binary")
    got = dedup.radix_buckets(df, 1000, 30_000).collect()
    assert len(got) == 220 and {r.sample_id: bytes(r._canon) for r in got} == dict(rows)
    size = Counter()
    for r in got:
        size[bytes(r._bucket)] += len(r._canon) / r._pieces
        assert bytes(r._canon).startswith(bytes(r._bucket))
    assert max(size.values()) <= 30_000 and {r._pieces for r in got if r.sample_id < "s"} == {1}


# ---------------------------------------------------------------- 8

TEXTS = [
    "Hello  world, it's 2024!\n\n\tx", "naïve café — “quotes” … 10°C", "水稻叶片上的褐色轮纹，建议58天后。", "टमाटर की पत्तियों पर", "👩🏽‍🌾🌾 <|endoftext|> x", "a" * 700, " lead and trail  ", "\r\n\x1c\x0b 　z", "I'LL we'll 'ſ K", "x" * 199 + " " + "é" * 101, "ﬁ Ⅷ ½ ² ٣", "\u0000�", "can't   stop", "   ",
]


def test_encoding_equals_two_reference_tokenizers(spark):
    import tiktoken
    from tokenizers import Tokenizer

    path = tokenizer_path()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (101, "")], "doc_id bigint, text string")
    got = {r.doc_id: r.ids for r in tokens.encode(docs, path).collect()}
    import public_tokenizers

    other = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens.ranks(path), special_tokens={})
    third = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    third.encode_special_tokens = True
    for i, t in enumerate(TEXTS):
        assert got[i] == other.encode_ordinary(t) == third.encode(t, add_special_tokens=False).ids, t
    assert got[100] == [] and got[101] == []
    back = {r.doc_id: r.text for r in tokens.decode(tokens.encode(docs, path), path).collect()}
    assert back == {**dict(enumerate(TEXTS)), 100: "", 101: ""}
    counts = {r.doc_id: r.tokens for r in tokens.token_counts(docs, path).collect()}
    assert counts == {i: len(v) for i, v in got.items()}


@pytest.mark.parametrize("most", [0, 3, 40])
def test_encoding_with_a_large_vocabulary(spark, monkeypatch, most):
    """Nothing, the most used words, or nearly all of them are broadcast; ids and counts stay the same."""
    docs = spark.createDataFrame([*enumerate(TEXTS), (50, "a b a b, it's a b"), (51, None), (52, "")], "doc_id bigint, text string")
    want = {r.doc_id: r.ids for r in tokens.encode(docs, tokenizer_path()).collect()}
    monkeypatch.setattr(tokens, "BROADCAST_WORDS", most)
    assert {r.doc_id: r.ids for r in tokens.encode(docs, tokenizer_path()).collect()} == want
    assert {r.doc_id: r.tokens for r in tokens.token_counts(docs, tokenizer_path()).collect()} == {k: len(v) for k, v in want.items()}


def test_long_words_merge_like_short_ones():
    table, rng = tokens.ranks(tokenizer_path()), random.Random(2)
    for _ in range(200):
        word = "".join(rng.choice(rng.choice(["ab", "theing", "é水", "x"])) for _ in range(rng.randrange(1, 60))).encode()
        pieces = [word[i : i + 1] for i in range(len(word))]
        while len(pieces) > 1 and word not in table:
            rank, at = min((table.get(a + b, 2**31), i) for i, (a, b) in enumerate(zip(pieces, pieces[1:])))
            if rank == 2**31:
                break
            pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        want = [table[word]] if word in table else [table[p] for p in pieces]
        assert tokens.merge_long(word, table) == want


# ---------------------------------------------------------------- 9


def containers(sizes, capacity):
    """The container of each item, by the fillings."""
    stock, out, number = {}, [None] * len(sizes), 0
    for i, size in enumerate(sizes):
        if size:
            stock.setdefault(size, []).append(i)
    for times, held in packing.fillings({s: len(v) for s, v in stock.items()}, capacity):
        for _ in range(times):
            for size in held:
                out[stock[size].pop()] = number
            number += 1
    assert not any(stock.values())
    return out


def one_by_one(sizes, capacity):
    """Best-two-fit with a list of items: the sizes in each container."""
    left, out = sorted(x for x in sizes if x), []
    while left:
        held = []
        while fitting := [x for x in left if x <= capacity - sum(held)]:
            held.append(max(fitting))
            left.remove(max(fitting))
        while sum(held) < capacity:
            low = min(held)
            room = capacity - sum(held) + low
            pairs_ = [(a + b, -min(a, b)) for i, a in enumerate(left) for b in left[i + 1 :] if a + b <= room and a + b > low]
            if not pairs_:
                break
            both, small = max(pairs_)
            held.remove(low)
            for x in (-small, both + small):
                left.remove(x)
                held.append(x)
            left = sorted([*left, low])
        out.append(tuple(sorted(held)))
    return Counter(out)


@pytest.mark.parametrize("seed", range(8))
def test_packing_is_valid_and_tight(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 100, 2048])
    sizes = [rng.randrange(0, capacity + 1) if seed % 2 else max(1, int(rng.gauss(capacity / 5, capacity / 9))) % (capacity + 1) for _ in range(rng.randrange(1, 600))]
    where = containers(sizes, capacity)
    fill = Counter()
    for size, c in zip(sizes, where):
        fill[c] += size
    assert max(fill.values(), default=0) <= capacity
    used, least = len({c for s, c in zip(sizes, where) if s}), -(-sum(sizes) // capacity)
    assert used <= max(least + 1, 1.25 * least) and containers([], capacity) == []


@pytest.mark.parametrize("seed", range(30))
def test_repeated_fillings_are_those_of_items_one_by_one(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([rng.randrange(1, 21), 7, 3]) for _ in range(rng.randrange(1, 120))]
    got = Counter()
    for times, held in packing.fillings(Counter(sizes), 20):
        got[tuple(sorted(held))] += times
    assert got == one_by_one(sizes, 20)


def test_the_work_does_not_grow_with_the_items():
    made = list(packing.fillings({s: 10**9 // s for s in range(1, 2049)}, 2048))
    assert len(made) < 20_000 and sum(t for t, _ in made) - sum(s * (10**9 // s) for s in range(1, 2049)) / 2048 < 2


def test_two_fit_replaces_the_smallest():
    # greedy takes 6 and 3 and leaves 1; 2 + 2 fill the gap that the 3 leaves
    assert len(set(containers([6, 3, 2, 2], 10))) == 2
    where = containers([6, 3, 2, 2], 10)
    assert where[0] == where[2] == where[3] != where[1]


def test_pack_divides_only_what_is_too_large(spark):
    items = spark.createDataFrame([(1, 25), (2, 10), (3, 0), (4, None), (5, 9), (6, 20)], "doc_id bigint, tokens bigint")
    got = packing.pack(items, capacity=10).collect()
    parts = {}
    for r in got:
        parts.setdefault(r.doc_id, []).append((r.part, r.parts, r.tokens, r.container is None))
    assert {k: sorted(v) for k, v in parts.items()} == {1: [(1, 3, 10, False), (2, 3, 10, False), (3, 3, 5, False)], 2: [(1, 1, 10, False)], 3: [(1, 1, 0, True)], 4: [(1, 1, 0, True)], 5: [(1, 1, 9, False)], 6: [(1, 2, 10, False), (2, 2, 10, False)]}
    fill = Counter()
    for r in got:
        fill[r.container] += r.tokens
    assert max(fill.values()) <= 10
    assert sorted(r.doc_id for r in packing.divided(packing.pack(items, capacity=10)).collect()) == [1, 6]


# ---------------------------------------------------------------- 10

SAME = [
    ("café", "café"), ("ＡＢＣ １２", "ABC 12"), ("a b", "a b"), ("a　b", "a b"), ("zero​width﻿", "zerowidth"), ("so­ft", "soft"), ("сорт", "copт"), ("ΑΒΟ", "ABO"), ("ﾊﾟ", "パ"), ("Ａ̊", "Å"),
]
OTHER = [("A", "a"), ("cafe", "café"), ("cafë", "café"), ("m2", "m²"), ("O", "0"), ("l", "1"), ("a  b", "a b"), ("ab", "a b"), ("½", "1/2"), ("ı", "i")]


def test_skeletons():
    for a, b in SAME:
        assert skeleton.skeleton(a) == skeleton.skeleton(b), (a, b)
    for a, b in OTHER:
        assert skeleton.skeleton(a) != skeleton.skeleton(b), (a, b)
    for a, b in SAME + OTHER:
        assert skeleton.skeleton(skeleton.skeleton(a)) == skeleton.skeleton(a) and skeleton.skeleton(skeleton.skeleton(b)) == skeleton.skeleton(b)


def test_public_confusables(spark):
    """Letters of other alphabets and planes, fonts and selectors look like what they are; case, digits, dots and accents still tell apart."""
    table = skeleton.confusables(spark)
    same = [("ɑ", "a"), ("ɡ", "g"), ("ⅼ", "l"), ("Ⅰ", "I"), ("ѵ", "v"), ("Ꭱ", "R"), ("ᎠᎡᏞᏙ", "DRLV"), ("Ӏ", "I"), ("Ϲ", "C"), ("Ϳ", "J"), ("ց", "g"), ("𝐈𝑙𝓂", "Ilm"), ("𝚨", "A"), ("ꓲꓮ", "IA"), ("x\U000e0100", "x"), ("a\ufff9b", "ab"), ("Ԛ", "Q")]
    for a, b in same:
        assert skeleton.skeleton(a, table) == skeleton.skeleton(b, table), (a, b)
    for a, b in OTHER + [("I", "l"), ("m", "rn"), ("0", "O"), ("𝟏", "1"), ("〇", "O"), ("ø", "o")]:
        assert skeleton.skeleton(a, table) != skeleton.skeleton(b, table), (a, b)
    for a, b in SAME + OTHER + same:
        assert skeleton.skeleton(skeleton.skeleton(a, table), table) == skeleton.skeleton(a, table), a
    assert len(table) > 1000 and all(skeleton.skeleton(chr(c), table) == chr(c) for c in range(128))


@pytest.mark.parametrize("copies", [3, 20_000])
def test_classes_of_looks_are_linear(spark, copies):
    docs = spark.range(copies).selectExpr("id AS doc_id", "'cafe' AS text").unionByName(spark.createDataFrame([(-1, "c\u0430fe"), (-1, "c\u0430fe"), (-2, "other"), (-3, None)], "doc_id bigint, text string"))
    got = {(r.class_id, r.links): r.n for r in skeleton.look_alike_members(docs).groupBy("class_id", "links").agg(F.count("doc_id").alias("n")).collect()}
    assert got == {(-1, 1): copies, (-1, copies): 1}


def test_look_alike_pairs(spark):
    texts = ["café", "café", "café", "cafe", "​", "  ", None, "", "ｃafé"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {tuple(r) for r in skeleton.look_alike_pairs(docs).collect()}
    assert got == {(0, 1), (1, 2), (0, 8), (1, 8), (2, 8)}


def test_looks_are_joined_by_their_strings_alone(spark):
    """A string held by many documents is paired once with another of its look, not document by document."""
    docs = spark.createDataFrame(list(enumerate(["cafe"] * 50 + ["c\u0430fe"])), "doc_id bigint, text string")
    pairs_ = skeleton.look_alike_pairs(docs)
    joins = [x for x in pairs_._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x and "skeleton_id" in x]
    assert joins and not any("doc_id" in x for x in joins)
    assert {tuple(r) for r in pairs_.collect()} == {(i, 50) for i in range(50)}


def test_metadata_of_any_shape(spark):
    shapes = ["null", "[]", '"x"', "{}", '{"plant_id": 5}', '{"plant_id": [1]}', None, ""]
    rows = [{**record(i), "metadata": m} for i, m in enumerate(shapes)]
    got = {r.sample_id: r["keys"] for r in grouping.related_by(frame(spark, "manifest", rows)).collect()}
    assert got["s4"] == ["plant\x1f5"] and got["s0"] == [] and got["s6"] == [] and json.loads(shapes[4])
