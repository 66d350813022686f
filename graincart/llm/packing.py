"""Filling fixed-capacity containers with items.

Best-two-fit: a container is filled greedily with the largest item that still fits; then its smallest item is
replaced by two unpacked items that fit the gap it leaves more tightly, as long as that helps. Items of one size are
alike, so the packing is worked out on the number of items of each size: a filling is repeated as often as the stock
stays the same to it, and a few thousand fillings pack any number of items exactly as if one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graincart.operators.selection import hex_bucket
from graincart.session import cut_lineage

CAPACITY = 2048


def fillings(stock: dict[int, int], capacity: int) -> Iterator[tuple[int, list[int]]]:
    """(times, sizes): how often a container is filled with items of these sizes, until the stock (size -> items) is used up.

    Sizes are from 1 to `capacity`. A filling only depends on which sizes there are, and of which there are two; so it is the next one
    again as long as two of each of its sizes are left over.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in stock.items():
        left[size] = n
    while left.any():
        held: list[int] = []
        gap = capacity
        there = np.flatnonzero(left)
        before = left.copy()
        while gap > 0:
            at = int(np.searchsorted(there, gap, side="right")) - 1
            while at >= 0 and not left[there[at]]:
                at -= 1
            if at < 0:
                break
            size = int(there[at])
            held.append(size)
            left[size] -= 1
            gap -= size
        while gap > 0 and held:
            smallest = min(held)
            room = gap + smallest
            there = np.flatnonzero(left[1:room]) + 1
            if not len(there):
                break
            # the best partner of each size is the largest one that fits beside it; the same size twice needs two items
            at = np.searchsorted(there, room - there, side="right") - 1
            partner = np.where(at >= 0, there[np.maximum(at, 0)], 0)
            alone = (partner == there) & (left[there] < 2)
            partner = np.where(alone, np.where(at >= 1, there[np.maximum(at - 1, 0)], 0), partner)
            sums = np.where(partner > 0, there + partner, 0)
            best = int(np.argmax(sums))
            if sums[best] <= smallest:
                break
            held.remove(smallest)
            left[smallest] += 1
            for size in (int(there[best]), int(partner[best])):
                held.append(size)
                left[size] -= 1
            gap = capacity - sum(held)
        sizes, uses = np.unique(held, return_counts=True)
        times = max(1, int(((before[sizes] - 2) // uses).min()))
        left[sizes] = before[sizes] - uses * times
        yield times, held


def pack(items: DataFrame, key: str = "doc_id", size: str = "tokens", capacity: int = CAPACITY) -> DataFrame:
    """key, part, parts, tokens, container: where each piece of each item goes.

    An item larger than the capacity is divided: all but its last piece fill a container each, the last is packed
    like an item (`parts` > 1 marks it); no other item is divided. Items of size 0, and those with a null size, take no
    room and stand in container null. Repeated keys are packed once for each row. The driver gets the number of pieces of each size, at most
    `capacity` rows, and works out the fillings; which pieces of a size go where is decided by a hash, and ranks are counted by
    bucket, so that a size that a third of all items have is no task of its own.
    """
    rows = items.select(key, F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("_size")).withColumn("parts", F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("_size") / capacity)))
    pieces = rows.select(key, "parts", "_size", F.explode(F.sequence(F.lit(1).cast("bigint"), "parts")).alias("part"))
    tokens = F.when(F.col("part") < F.col("parts"), F.lit(capacity)).otherwise(F.col("_size") - capacity * (F.col("parts") - 1))
    pieces = pieces.select(key, "part", "parts", tokens.cast("int").alias("tokens"))
    full = pieces.where((F.col("part") < F.col("parts")) | (F.col("tokens") == 0))
    hashed = F.sha2(F.concat_ws("#", F.col(key).cast("string"), F.col("part").cast("string")), 256)
    # equal hashes (repeated rows) are ranked once, since the ranks are written out
    open_ = cut_lineage(pieces.where((F.col("part") == F.col("parts")) & (F.col("tokens") > 0)).withColumn("_h", hashed).withColumn("_b", hex_bucket(F.col("_h"))))
    sizes = cut_lineage(open_.groupBy("tokens", "_b").agg(F.count(F.lit(1)).alias("_n")))
    stock = {r.tokens: r.n for r in sizes.groupBy("tokens").agg(F.sum("_n").alias("n")).collect()}
    ahead = sizes.select(F.col("tokens").alias("_t"), F.col("_b").alias("_bb"), F.coalesce(F.sum("_n").over(Window.partitionBy("tokens").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    ranked = open_.withColumn("_rank", F.row_number().over(Window.partitionBy("tokens", "_b").orderBy("_h", key)) - 1)
    ranked = ranked.join(ahead, (F.col("tokens") == F.col("_t")) & (F.col("_b") == F.col("_bb"))).select(key, "part", "parts", "tokens", (F.col("_rank") + F.col("_ahead")).alias("_place"))

    # by size: from which place on its items go to which filling, how many of them into each container
    spans: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    for number, (times, held) in enumerate(fillings(stock, capacity)):
        for s in set(held):
            uses = held.count(s)
            spans.setdefault(s, []).append((used.get(s, 0), number, uses))
            used[s] = used.get(s, 0) + times * uses
    arrays = {s: tuple(np.array(x, dtype=np.int64) for x in zip(*v)) for s, v in spans.items()}
    shared = items.sparkSession.sparkContext.broadcast(arrays)

    def name(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            place, tokens = part["_place"].to_numpy(), part["tokens"].to_numpy()
            number, which = np.zeros(len(part), dtype=np.int64), np.zeros(len(part), dtype=np.int64)
            for s in np.unique(tokens):
                rows = np.flatnonzero(tokens == s)
                starts, numbers, uses = shared.value[int(s)]
                at = np.searchsorted(starts, place[rows], side="right") - 1
                number[rows], which[rows] = numbers[at], (place[rows] - starts[at]) // uses[at]
            yield part.drop(columns="_place").assign(container=[f"{n}-{w}" for n, w in zip(number, which)])

    kind = items.schema[key].dataType.simpleString()
    packed = ranked.mapInPandas(name, f"`{key}` {kind}, part bigint, parts bigint, tokens int, container string")
    whole = F.when(F.col("tokens") > 0, F.concat(F.col(key).cast("string"), F.lit("#"), F.col("part").cast("string")))
    return packed.unionByName(full.withColumn("container", whole))


def divided(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The keys of the items that were put into more than one container."""
    return packed.groupBy(key).agg(F.min("container").alias("_low"), F.max("container").alias("_high")).where("_low <> _high").select(key)
