"""Same or near-same records across splits.

A weighted cosine join over inverted lists: a vector is a set of (term, weight) rows of norm 1, and pairs of a left
and a right vector with a dot product of at least the threshold are found without comparing all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graincart.functions.text import name_key, normalize_split_name
from graincart.llm.common import first_deliveries, letters
from graincart.session import cut_lineage, hinted

#: Fingerprints of 64 bits that differ in at most DIFFER are the same picture.
BITS, DIFFER = 64, 4
TOLERANCE = 1e-9


def _entries(rows: DataFrame) -> DataFrame:
    return rows.where("id IS NOT NULL AND term IS NOT NULL AND weight IS NOT NULL").select("term", "id", "weight")


Weight = Callable[[Column], Column]


def _entries(rows: DataFrame, weight: Weight | None) -> DataFrame:
    """(term, id), and weight unless the term tells it."""
    if weight is None:
        return rows.where("id IS NOT NULL AND term IS NOT NULL AND weight IS NOT NULL").select("term", "id", "weight")
    return rows.where("id IS NOT NULL AND term IS NOT NULL").select("term", "id")


def pruned_vectors(left: DataFrame, right: DataFrame, threshold: float, weight: Weight | None = None) -> DataFrame:
    """id, kept, rest of each left vector: the (term, weight) that must be looked up in the inverted lists of `right`, and those that need not.

    Maximum-weight pruning: a term's weight is bounded by the largest one on the other side, which is 0 for terms
    that the other side lacks; these are in neither. Residual-norm pruning: the terms left of a vector are taken from the
    longest inverted list to the shortest, and as long as neither the sum of the weight bounds nor the norm of the terms so far
    reaches the threshold, a pair cannot reach it by them alone, so they go to `rest`. A pair is thus met in the lists of rare terms.
    """
    of = weight(F.col("term")) if weight else F.col("weight")
    lists = _entries(right, weight).groupBy("term").agg(F.max(F.abs(of)).alias("most"), F.count(F.lit(1)).alias("length"))
    bounded = _entries(left, weight).join(lists, "term").select("id", "term", of.alias("weight"), "most", "length")
    vector = F.sort_array(F.collect_list(F.struct((-F.col("length")).alias("rank"), "term", "weight", "most")))
    none = F.array().cast("array<struct<term:bigint,weight:double>>")
    start = F.struct(F.lit(0.0).alias("dot"), F.lit(0.0).alias("square"), none.alias("kept"), none.alias("rest"))

    def walk(state: Column, x: Column) -> Column:
        dot, square = state["dot"] + F.abs(x["weight"]) * x["most"], state["square"] + x["weight"] * x["weight"]
        enough = F.least(dot, F.sqrt(square)) >= threshold - TOLERANCE
        one = F.array(F.struct(x["term"].alias("term"), x["weight"].alias("weight")))
        kept, rest = F.when(enough, F.concat(state["kept"], one)).otherwise(state["kept"]), F.when(enough, state["rest"]).otherwise(F.concat(state["rest"], one))
        return F.struct(dot.alias("dot"), square.alias("square"), kept.alias("kept"), rest.alias("rest"))

    return bounded.groupBy("id").agg(vector.alias("v")).select("id", F.aggregate("v", start, walk).alias("s")).select("id", "s.kept", "s.rest").where(F.size("kept") > 0)


def weighted_cosine_join(left: DataFrame, right: DataFrame, threshold: float, weight: Weight | None = None, verify: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(id_a, id_b, cosine) of the pairs of `left` and `right` (id, term bigint, weight; norm 1 at most) with a dot product of at least `threshold`.

    The terms that pruned_vectors keeps meet the inverted lists, and the products of their weights are summed up by pair; what the
    pruned terms add is looked up for these pairs alone. `weight`, where given, tells a weight from its term, and the column isn't needed.
    `verify` is a condition on the two ids that pairs must meet besides; it is checked where they are met. Null ids, terms and
    weights are left out. Weights may be negative.
    """
    lists = _entries(right, weight)
    of = weight(F.col("term")) if weight else F.col("weight")
    lists = lists.select("term", F.col("id").alias("id_b"), of.alias("_wb"))
    vectors = cut_lineage(pruned_vectors(left, right, threshold, weight))
    kept = vectors.select(F.col("id").alias("id_a"), F.explode("kept").alias("x")).select("id_a", "x.term", F.col("x.weight").alias("_wa"))
    met = kept.join(lists, "term")
    if verify is not None:
        met = met.where(verify(F.col("id_a"), F.col("id_b")))
    pairs = met.groupBy("id_a", "id_b").agg(F.sum(F.col("_wa") * F.col("_wb")).alias("cosine"))
    rest = vectors.where(F.size("rest") > 0)
    if not rest.isEmpty():
        more = pairs.join(rest.select(F.col("id").alias("id_a"), "rest"), "id_a").select("id_a", "id_b", F.explode("rest").alias("x")).select("id_a", "id_b", "x.term", F.col("x.weight").alias("_wa"))
        more = more.join(lists, ["id_b", "term"]).groupBy("id_a", "id_b").agg(F.sum(F.col("_wa") * F.col("_wb")).alias("cosine"))
        pairs = pairs.unionByName(more).groupBy("id_a", "id_b").agg(F.sum("cosine").alias("cosine"))
    return pairs.where(F.col("cosine") >= threshold - TOLERANCE)


def blocks_for(fingerprints: int) -> int:
    """Blocks whose choices have more bits than the fingerprints' number: 6 choose 2 have 21, 7 choose 3 have 27, 8 choose 4 have 32."""
    return 6 if fingerprints < 1 << 22 else 7 if fingerprints < 1 << 27 else 8


def choices(blocks: int, differ: int = DIFFER) -> list[tuple[tuple[int, int], ...]]:
    """The choices of blocks, each as (first bit, bits), that at most `differ` changed bits must leave one of untouched.

    With b blocks, d changed bits leave at least b - d blocks as they are, so two fingerprints share a choice of b - d blocks.
    """
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    return [tuple((edges[b], edges[b + 1] - edges[b]) for b in choice) for choice in combinations(range(blocks), blocks - differ)]


#: Room for the number of a choice in its term.
CHOICE = 128


def picture_terms(kind: Column, id: Column, chosen: list[tuple[tuple[int, int], ...]]) -> Column:
    """Array of the terms of a picture's value: of a fingerprint, the bits of every choice with its number; of a path or digest, its hash, below 0."""
    terms = []
    for number, blocks in enumerate(chosen):
        value = F.lit(0).cast("bigint")
        for first, bits in blocks:
            value = F.shiftleft(value, bits).bitwiseOR(F.shiftrightunsigned(id, first).bitwiseAND(F.lit((1 << bits) - 1)))
        terms.append(value * CHOICE + number)
    return F.when(kind == "f", F.array(*terms)).otherwise(F.array(id.bitwiseOR(F.lit(-(2**63)))))


def term_weight(chosen: list[tuple[tuple[int, int], ...]]) -> tuple[Weight, float]:
    """The weight of a term, and the smallest product of two equal ones. The square of a choice's weight is its part of all choices' bits, so that the norm is 1."""
    bits = [sum(n for _, n in blocks) for blocks in chosen]
    weights = F.array(*[F.lit(math.sqrt(n / sum(bits))) for n in bits])
    return lambda term: F.when(term < 0, F.lit(1.0)).otherwise(F.get(weights, (term % CHOICE).cast("int"))), min(bits) / sum(bits)


def alike_pictures(train: DataFrame, other: DataFrame, differ: int = DIFFER) -> DataFrame:
    """(id_a, id_b) of a train and another picture value (kind, id; distinct) that are the same: equal ids, or fingerprints differing in at most `differ` bits.

    Any term that two values share may carry them, so the threshold is the smallest product of two weights, and the pairs met are checked exactly.
    """
    chosen = choices(blocks_for(train.count() + other.count()), differ)
    weight, threshold = term_weight(chosen)

    def vectors(side: DataFrame) -> DataFrame:
        return side.select("id", F.explode(picture_terms(F.col("kind"), F.col("id"), chosen)).alias("term"))

    return weighted_cosine_join(vectors(train), vectors(other), threshold, weight, lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= differ).select("id_a", "id_b")


def shown_pictures(manifest: DataFrame, image_index: DataFrame) -> DataFrame:
    """Record and picture: (sample_id, split, source_dataset, train, path, content_sha, fingerprint), one row for each different entry of the path in the index.

    Null and empty paths are no pictures; a path that the index lacks has neither digest nor fingerprint. Records without a split are left out.
    """
    paths = F.array_distinct(F.filter(F.transform("images", letters), lambda p: p != ""))
    rows = first_deliveries(manifest, split=normalize_split_name("split"), source_dataset=name_key("source_dataset"), paths=paths).where("split <> ''")
    shown = rows.select("sample_id", "split", "source_dataset", (F.col("split") == "train").alias("train"), F.explode("paths").alias("path"))
    index = image_index.select(letters(F.col("image_path")).alias("path"), F.nullif("content_sha", F.lit("")).alias("content_sha"), "fingerprint").distinct()
    return shown.join(index, "path", "left")


def picture_values(shown: DataFrame, *columns: str) -> DataFrame:
    """The given columns with kind, id and name of each value of a picture: path (`p`), digest (`s`) and fingerprint (`f`).

    The id of a fingerprint is itself, that of a path or digest its hash; `name` (null for fingerprints) tells apart what a hash doesn't.
    """
    none = F.lit(None).cast("string")

    def value(kind: str, id: Column, name: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), id.alias("id"), name.alias("name"))

    values = [value(k, F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(k), c)), F.col(c)) for k, c in (("p", "path"), ("s", "content_sha"))]
    return shown.select(*columns, F.explode(F.array(*values, value("f", F.col("fingerprint"), none))).alias("v")).select(*columns, "v.kind", "v.id", "v.name").where("id IS NOT NULL")


def same_pictures(shown: DataFrame, differ: int = DIFFER) -> DataFrame:
    """(id_a, id_b) of the values that shown_pictures shows on the two sides; broadcast if they are few."""
    values = cut_lineage(picture_values(shown, "train").select("train", "kind", "id").distinct())
    return hinted(alike_pictures(values.where("train").drop("train"), values.where("NOT train").drop("train"), differ))


def _sides(shown: DataFrame, same: DataFrame) -> DataFrame:
    """Rows of both sides that show the same picture; those of the train side with `_a` in front of their names."""
    columns = ("sample_id", "split", "source_dataset")
    train = picture_values(shown.where("train"), *columns).select(*[F.col(c).alias(f"_a{c}") for c in (*columns, "kind", "id", "name")])
    other = picture_values(shown.where("NOT train"), *columns)
    met = train.join(same, F.col("_aid") == F.col("id_a")).join(other, (F.col("id_b") == F.col("id")) & (F.col("kind") == F.col("_akind")))
    return met.where(F.col("name").eqNullSafe(F.col("_aname")))


def cross_split_pairs(manifest: DataFrame, image_index: DataFrame, differ: int = DIFFER) -> DataFrame:
    """train_id, other_id, other_split, other_source of each train record and record of another split that share a picture.

    Records without a split are on neither side. An empty table on either side gives no pairs.
    """
    shown = cut_lineage(shown_pictures(manifest, image_index))
    met = _sides(shown, same_pictures(shown, differ))
    return met.select(F.col("_asample_id").alias("train_id"), F.col("sample_id").alias("other_id"), F.col("split").alias("other_split"), F.col("source_dataset").alias("other_source")).distinct()


def shared_pictures(manifest: DataFrame, image_index: DataFrame, differ: int = DIFFER) -> DataFrame:
    """kind, name_a, name_b, train_records, other_records: the values of pictures that are the same on both sides, with the records that show each.

    This is the join without its pairs of records: the classes are those who show a value, so that a picture shown by a third of all records is a
    row for each value like it. Names are paths, digests, or fingerprints as numbers.
    """
    shown = cut_lineage(shown_pictures(manifest, image_index))
    same = same_pictures(shown, differ)
    counts = picture_values(shown, "sample_id", "train").groupBy("train", "kind", "id", "name").agg(F.countDistinct("sample_id").alias("n"))
    counts = counts.withColumn("name", F.coalesce("name", F.col("id").cast("string")))
    a = counts.where("train").select(F.col("kind").alias("_k"), F.col("id").alias("_i"), F.col("name").alias("name_a"), F.col("n").alias("train_records"))
    b = counts.where("NOT train").select("kind", "id", F.col("name").alias("name_b"), F.col("n").alias("other_records"))
    met = a.join(same, F.col("_i") == F.col("id_a")).join(b, (F.col("id_b") == F.col("id")) & (F.col("kind") == F.col("_k")))
    return met.where("kind = 'f' OR name_a = name_b").select("kind", "name_a", "name_b", "train_records", "other_records")
