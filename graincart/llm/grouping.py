"""Splits that keep related records together.

Records and the keys they share (author, plant, source picture) are a graph; its components are found by
contraction, and then placed by grouped iterative stratification: the component with the rarest label that is still
outstanding goes first, into the split that needs that label most. Components with equal label vectors are placed
together, so that the work grows with the number of different vectors.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graincart.functions.text import name_key, normalize_split_name
from graincart.llm.common import first_deliveries, letters
from graincart.operators.selection import hex_bucket
from graincart.session import cut_lineage, hinted, release

#: Ids that say nothing, compared as letters and digits in lower case.
PLACEHOLDERS = ("", "na", "nan", "none", "null", "nil", "unknown", "anonymous", "anon", "undefined", "unspecified", "notavailable", "missing", "tbd", "0")
#: Label sets up to this many are walked on the driver; beyond, the order of the labels takes a pass over them for each label.
MOST_SETS = 50_000


def related_by(manifest: DataFrame) -> DataFrame:
    """sample_id, split, source_dataset, task_type and keys (array) of each record.

    Broken or null metadata gives no keys. The author stands in `contributor_id` or in `submitted_by`; where both
    say something, both relate. Values that aren't strings compare as JSON writes them.
    """
    rows = manifest.withColumn("_meta", F.from_json("metadata", "map<string,string>", {"mode": "PERMISSIVE"}))
    meta, source = F.col("_meta"), name_key("source_dataset")
    given = [("author", "contributor_id", None), ("author", "submitted_by", None), ("plant", "plant_id", None), ("picture", "source_image_id", source)]
    named = F.array(*[F.struct(F.concat_ws("\x1f", F.lit(kind), *([] if scope is None else [scope]), F.lit("")).alias("kind"), letters(meta[field]).alias("ident")) for kind, field, scope in given])
    keys = F.transform(F.filter(named, lambda k: ~k["ident"].isin(*PLACEHOLDERS)), lambda k: F.concat(k["kind"], k["ident"]))
    return first_deliveries(rows, split=normalize_split_name("split"), source_dataset=source, task_type=name_key("task_type"), keys=F.array_distinct(keys))


def components(records: DataFrame) -> DataFrame:
    """(sample_id, group_id) of each record that shares a key with another one; group_id is the smallest id it is related to.

    Each round points every node to the smallest node among those that share a key with it, follows these pointers
    to their ends, doubling the step, and replaces nodes by those ends; keys left with one node are done with. Nodes halve at least in every
    round, so there are about log2 of the longest chain of them. A key held by a third of all records is combined
    before its shuffle, and its pointers all lead to one node, so it is one edge after the first round. The edges and pointers of a round
    are written to the checkpoint folder and deleted when the next ones are there. Only row counts reach the driver.
    """
    edges = records.select(F.col("sample_id").alias("node"), F.explode("keys").alias("key"))
    steps: list[DataFrame] = []
    live: DataFrame | None = None
    while True:
        lowest = edges.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key", "low")
        before, live = live, cut_lineage(edges.join(lowest, "key"))
        if before is not None:
            release(before)
        if live.isEmpty():
            break
        parents, last = live.groupBy("node").agg(F.min("low").alias("root")), None
        while True:
            up = parents.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            jumped = cut_lineage(parents.join(up, "root").select("node", F.col("_next").alias("root"), (F.col("_next") < F.col("root")).alias("moved")))
            if last is not None:
                release(last)
            parents, last = jumped.select("node", "root"), jumped
            if jumped.where("moved").isEmpty():
                break
        steps.append(parents)
        edges = live.join(parents, "node").select(F.col("root").alias("node"), "key").distinct()
    if not steps:
        return records.select("sample_id", F.col("sample_id").alias("group_id")).limit(0)
    # each step maps what the one before it led to; the last ones are the smallest
    whole = steps.pop()
    while steps:
        after = whole.select(F.col("node").alias("root"), F.col("root").alias("_end"))
        whole = steps.pop().join(after, "root", "left").select("node", F.coalesce("_end", "root").alias("root"))
    return whole.select(F.col("node").alias("sample_id"), F.col("root").alias("group_id"))


def divided_groups(records: DataFrame, groups: DataFrame) -> DataFrame:
    """group_id, sample_id, split of the records of groups with more than one split; records without a split don't count towards that."""
    rows = groups.join(records.select("sample_id", "split"), "sample_id")
    mixed = rows.where("split <> ''").groupBy("group_id").agg(F.min("split").alias("_a"), F.max("split").alias("_b")).where("_a <> _b").select("group_id")
    return rows.join(mixed, "group_id").select("group_id", "sample_id", "split")


def turns(sets: list[tuple[tuple[str, ...], dict[str, int]]]) -> dict[str, int]:
    """The turn of each label: rarest outstanding first. `sets` are (labels of a group, records by label), summed over the groups.

    Which groups are placed in a label's turn doesn't depend on where they go, so the order is known before any is placed.
    """
    left: dict[str, int] = {}
    holders: dict[str, list[int]] = {}
    for i, (labels, counts) in enumerate(sets):
        for label in labels:
            left[label] = left.get(label, 0) + counts[label]
            holders.setdefault(label, []).append(i)
    out: dict[str, int] = {}
    done = [False] * len(sets)
    while left:
        rarest = min(left, key=lambda x: (left[x], x))
        out[rarest] = len(out)
        for i in holders[rarest]:
            if not done[i]:
                done[i] = True
                for label in sets[i][0]:
                    if label in left:
                        left[label] -= sets[i][1][label]
        del left[rarest]
    return out


def _turns_by_passes(sets: DataFrame) -> dict[str, int]:
    """The same over a table of sets (labels, counts), with one pass for each label."""
    out: dict[str, int] = {}
    while True:
        open_ = sets.where(~F.arrays_overlap("labels", F.array(*[F.lit(x) for x in out]).cast("array<string>"))) if out else sets
        rows = open_.select(F.explode("counts").alias("label", "n")).groupBy("label").agg(F.sum("n").alias("n")).orderBy("n", "label").limit(1).collect()
        if not rows:
            # labels that only occur beside rarer ones have nothing left and come last
            rest = sets.select(F.explode("labels").alias("label")).distinct().collect()
            return out | {x: len(out) + i for i, x in enumerate(sorted(r.label for r in rest if r.label not in out))}
        out[rows[0].label] = len(out)


def pour(groups: int, size: int, need: list[int]) -> list[int]:
    """How many of `groups` equal groups each split gets, if one after the other goes to the split that needs most; on ties to the first.

    Placing lowers a split's need by `size`, so the groups go to the `groups` largest of the numbers need, need - size, need - 2 size ...
    """
    if groups <= 0:
        return [0] * len(need)

    def over(level: int) -> int:
        return sum(max(0, (x - level) // size + 1) for x in need)

    low, high = min(need) - size * (groups + 1), max(need) + 1
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if over(middle) >= groups else (low, middle)
    # low is the level of the last group placed: all numbers above it, and some of those equal to it
    got = [max(0, (x - low - 1) // size + 1) for x in need]
    rest = groups - sum(got)
    for i, x in enumerate(need):
        if rest and (x - low) % size == 0 and x >= low:
            got[i] += 1
            rest -= 1
    return got


def place(blocks: Iterable[tuple[str, list[str], list[int], int, int]], need: list[dict[str, int]], whole: int) -> Iterator[tuple[int, list[int]]]:
    """(block, groups for each split) of blocks in the order of their turns: (label of the turn, labels, records of a group by label, groups, block).

    A block is all groups with the same label vector. `need`, by split and label in parts of `whole`, is lowered in place; the split that needs
    the turn's label most comes first, then the one that needs most in all, then the earlier one.
    """
    lacking = [sum(x.values()) for x in need]
    for turn, labels, counts, groups, block in blocks:
        order = sorted(range(len(need)), key=lambda s: (-lacking[s], s))
        size = counts[labels.index(turn)] * whole
        got = pour(groups, size, [need[s].get(turn, 0) for s in order])
        parts = [0] * len(need)
        for s, n in zip(order, got):
            parts[s] = n
            for label, count in zip(labels, counts):
                need[s][label] = need[s].get(label, 0) - n * count * whole
                lacking[s] -= n * count * whole
        yield block, parts


def assign_splits(records: DataFrame, groups: DataFrame, targets: DataFrame) -> DataFrame:
    """(sample_id, group_id, split): a split of `targets` for each record, the same within a group, in the targets' proportions.

    Labels are source and task type. A record related to none is its own group. Groups with the same label vector are
    alike, so they are placed as one block, at any number of them exactly as if one by one: in the turn of their rarest outstanding
    label, large ones first, each to the split that needs that label most. Blocks are sorted and run through one task, which holds
    no more than the needs by split and label; which groups of a block go where is decided by a hash. Without a positive target it is an error.
    """
    spark = records.sparkSession
    wanted = [(r.split, r.target_permille) for r in targets.groupBy(normalize_split_name("split").alias("split")).agg(F.max("target_permille").alias("target_permille")).where("target_permille > 0").orderBy("split").collect()]
    whole = sum(n for _, n in wanted)
    if not whole:
        raise ValueError("no split has a positive target")
    rows = records.select("sample_id", F.concat_ws("|", "source_dataset", "task_type").alias("label")).join(groups, "sample_id", "left").withColumn("group_id", F.coalesce("group_id", "sample_id"))
    rows = cut_lineage(rows)
    cells = rows.groupBy("group_id", "label").agg(F.count(F.lit(1)).alias("n"))
    vectors = cut_lineage(cells.groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("label", "n"))).alias("labels")))
    alike = vectors.groupBy("labels").agg(F.count(F.lit(1)).alias("groups"))
    alike = cut_lineage(alike.withColumn("block", F.monotonically_increasing_id()))
    names, counts = F.transform("labels", lambda x: x["label"]), F.transform("labels", lambda x: x["n"])
    each = alike.select(names.alias("labels"), F.posexplode("labels").alias("_i", "x"), "groups").groupBy("labels", F.col("x.label").alias("label")).agg(F.sum(F.col("x.n") * F.col("groups")).alias("n"))
    sets = cut_lineage(each.groupBy("labels").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("counts")))
    few = sets.limit(MOST_SETS + 1).collect()
    turn = turns([(tuple(r.labels), r.counts) for r in few]) if len(few) <= MOST_SETS else _turns_by_passes(sets)
    totals = {r.label: r.n for r in sets.select(F.explode("counts").alias("label", "n")).groupBy("label").agg(F.sum("n").alias("n")).collect()}
    need = [{label: n * part for label, n in totals.items()} for _, part in wanted]

    if not turn:
        return rows.select("sample_id", "group_id", F.lit(None).cast("string").alias("split"))
    order = F.create_map(*[F.lit(x) for pair in turn.items() for x in pair])
    first = F.array_min(F.transform(names, lambda x: order[x]))
    size = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
    sorted_ = alike.select(first.alias("turn"), size.alias("size"), names.alias("names"), counts.alias("counts"), "groups", "block").repartition(1).sortWithinPartitions("turn", F.desc("size"), "names", "counts")
    at = {i: label for label, i in turn.items()}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = [dict(x) for x in need]

        def stream() -> Iterator[tuple[str, list[str], list[int], int, int]]:
            for part in parts:
                yield from ((at[t], list(n), [int(x) for x in c], int(g), int(b)) for t, n, c, g, b in zip(part["turn"], part["names"], part["counts"], part["groups"], part["block"]))

        batch = []
        for made in place(stream(), left, whole):
            batch.append(made)
            if len(batch) == 10_000:
                yield pd.DataFrame(batch, columns=["block", "parts"])
                batch = []
        yield pd.DataFrame(batch, columns=["block", "parts"])

    plan = sorted_.mapInPandas(run, "block bigint, parts array<bigint>")
    ends = F.transform(F.sequence(F.lit(1), F.lit(len(wanted))), lambda i: F.aggregate(F.slice("parts", F.lit(1), i), F.lit(0).cast("bigint"), lambda a, x: a + x))
    plan = hinted(plan.join(alike, "block").select("labels", "block", ends.alias("ends")))
    bucketed = vectors.join(plan, "labels").select("group_id", "block", "ends", F.sha2("group_id", 256).alias("_h")).withColumn("_b", hex_bucket(F.col("_h")))
    sizes = bucketed.groupBy("block", "_b").agg(F.count(F.lit(1)).alias("_n"))
    ahead = hinted(sizes.select(F.col("block").alias("_block"), F.col("_b").alias("_bb"), F.coalesce(F.sum("_n").over(Window.partitionBy("block").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead")))
    ranked = bucketed.withColumn("_rank", F.row_number().over(Window.partitionBy("block", "_b").orderBy("_h"))).join(ahead, (F.col("block") == F.col("_block")) & (F.col("_b") == F.col("_bb")))
    place_of = F.size(F.filter("ends", lambda e: e < F.col("_rank") + F.col("_ahead")))
    split = F.get(F.array(*[F.lit(s) for s, _ in wanted]), place_of)
    return rows.join(ranked.select("group_id", split.alias("split")), "group_id").select("sample_id", "group_id", "split")
