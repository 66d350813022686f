"""Duplicates hidden by formatting differences.

A record's canonical bytes are its pictures, answer and messages without white space, letter case and punctuation,
orders that don't matter sorted. Recursive radix partitioning: records are bucketed by the first bytes; buckets with
more than FITS records or BYTES bytes are split by the bytes behind what all of a bucket have in common, until each fits. A
bucket that no bytes can split (copies of one record) is cut by a hash of the id instead. Each piece is counted in a trie
with terminal counters, and the counters of cut buckets are added up.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graincart.llm.common import first_deliveries, letters
from graincart.session import cut_lineage, hinted, release

#: Records and bytes that one trie takes; a single longer record is a trie of its own.
FITS, BYTES = 20_000, 64 << 20
#: Length of the first prefix, and how many bytes each further level looks on.
FIRST, FURTHER = 4, 4
#: Bytes in a trie's node.
CHUNK = 8


def fold(text: Column) -> Column:
    """Text without white space, punctuation and letter case; null as empty."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f\p{P}]+", ""))


def canonical(messages: Column, answer: Column, images: Column) -> Column:
    """The canonical bytes of a record, in UTF-8; null parts count as empty.

    The pictures come first and backwards, since the ends of paths differ most: the earlier the bytes of two
    records differ, the sooner the partitioning ends.
    """

    def texts(content: Column) -> Column:
        return F.array_join(F.array_sort(F.transform(F.filter(content, lambda p: p["text"].isNotNull()), lambda p: fold(p["text"]))), "\x1e")

    none = F.array().cast("array<string>")
    shown = F.flatten(F.transform(messages, lambda m: F.transform(F.filter(m["content"], lambda p: p["image"].isNotNull()), lambda p: p["image"])))
    paths = F.array_sort(F.array_distinct(F.transform(F.concat(F.coalesce(images, none), F.coalesce(shown, none)), lambda p: F.reverse(letters(F.coalesce(p, F.lit("")))))))
    said = F.array_join(F.transform(messages, lambda m: F.concat(fold(m["role"]), F.lit("\x1d"), F.coalesce(texts(m["content"]), F.lit("")))), "\x1f")
    return F.encode(F.concat_ws("\x1f", F.array_join(paths, "\x1e"), fold(answer), F.coalesce(said, F.lit(""))), "UTF-8")


class Trie:
    """Keys with the ids that have them. A node maps CHUNK bytes to a node, or to a leaf (rest of the key, ids) as long as it is the only one below."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, key: bytes, row: str) -> None:
        node = self.root
        while True:
            head, key = key[:CHUNK], key[CHUNK:]
            below = node.get(head)
            if below is None:
                node[head] = (key, [row])
                return
            if isinstance(below, tuple):
                rest, rows = below
                if rest == key:
                    rows.append(row)
                    return
                node[head] = below = {rest[:CHUNK]: (rest[CHUNK:], rows)}
            node = below

    def terminals(self):
        """(key, ids) of each distinct key."""
        stack = [(b"", self.root)]
        while stack:
            prefix, node = stack.pop()
            for head, below in node.items():
                if isinstance(below, tuple):
                    yield prefix + head + below[0], below[1]
                else:
                    stack.append((prefix + head, below))


def _count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """terminal, sample_id of each record that its piece has copies of, or whose bucket was cut. Rows come sorted by piece."""
    trie, at, cut = Trie(), None, False

    def out() -> list[tuple[bytes, str]]:
        return [(hashlib.sha256(key).digest(), row) for key, rows in trie.terminals() if cut or len(rows) > 1 for row in rows]

    for part in parts:
        found: list[tuple[bytes, str]] = []
        for bucket, piece, pieces, key, row in zip(part["_bucket"], part["_piece"], part["_pieces"], part["_canon"], part["sample_id"]):
            if (bucket, piece) != at:
                found += out()
                trie, at, cut = Trie(), (bucket, piece), pieces > 1
            trie.add(bytes(key), row)
        yield pd.DataFrame(found, columns=["terminal", "sample_id"])
    yield pd.DataFrame(out(), columns=["terminal", "sample_id"])


def _common(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        common = [len(os.path.commonprefix([bytes(a), bytes(b)])) for a, b in zip(part["_low"], part["_high"])]
        yield part[["_big", "_n", "_size"]].assign(_same=[bytes(a) == bytes(b) for a, b in zip(part["_low"], part["_high"])], _common=common)


def radix_buckets(rows: DataFrame, fits: int = FITS, most: int = BYTES) -> DataFrame:
    """`rows` (sample_id, _canon) with the bucket `_bucket` of each, and in `_pieces` the number of pieces it must be cut into.

    Only buckets that are still too large are looked at again, each split where its smallest and its largest record differ, so
    that every level splits every one of them. Oversized buckets are written out, and broadcast if they are few.
    """
    none = F.lit(1).cast("bigint")
    open_ = rows.select("sample_id", "_canon", F.substring("_canon", 1, FIRST).alias("_bucket"))
    done: DataFrame | None = None
    while True:
        counts = open_.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.octet_length("_canon")).alias("_size"))
        big = hinted(counts.where((F.col("_n") > fits) | ((F.col("_size") > most) & (F.col("_n") > 1))).select(F.col("_bucket").alias("_big"), "_n", "_size"))
        ready = open_.join(big, F.col("_bucket") == F.col("_big"), "left_anti").select("sample_id", "_canon", "_bucket", none.alias("_pieces"))
        done = ready if done is None else done.unionByName(ready)
        if big.isEmpty():
            return done
        held = open_.join(big, F.col("_bucket") == F.col("_big"))
        spread = held.groupBy("_big", "_n", "_size").agg(F.min("_canon").alias("_low"), F.max("_canon").alias("_high")).mapInPandas(_common, "_big binary, _n bigint, _size bigint, _same boolean, _common int")
        plan = hinted(spread.select(F.col("_big").alias("_of"), "_same", "_common", F.greatest(F.ceil(F.col("_n") / fits), F.ceil(F.col("_size") / most)).alias("_cut")))
        tagged = cut_lineage(open_.join(plan, F.col("_bucket") == F.col("_of")).select("sample_id", "_canon", "_bucket", "_same", "_common", "_cut"))
        # a bucket of equal records is cut; any other is split behind what its records have in common
        done = done.unionByName(tagged.where("_same").select("sample_id", "_canon", "_bucket", F.col("_cut").cast("bigint").alias("_pieces")))
        open_ = tagged.where("NOT _same").select("sample_id", "_canon", F.substring("_canon", F.lit(1), F.col("_common") + FURTHER).alias("_bucket"))


def copies(manifest: DataFrame, fits: int = FITS) -> DataFrame:
    """group_id, sample_id, copies of the records that are not alone in their group; group_id is the smallest id.

    One row for each record, its first delivery. Records with neither pictures, answer nor messages are copies of
    each other. An empty table gives no rows.
    """
    rows = cut_lineage(first_deliveries(manifest, _canon=canonical(F.col("messages"), F.col("target.answer_text"), F.col("images"))))
    pieces = radix_buckets(rows, fits).withColumn("_piece", F.pmod(F.xxhash64("sample_id"), F.col("_pieces")))
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.repartition(tasks, "_bucket", "_piece").sortWithinPartitions("_bucket", "_piece")
    members = cut_lineage(pieces.select("sample_id", "_canon", "_bucket", "_piece", "_pieces").mapInPandas(_count, "terminal binary, sample_id string"))
    release(rows)
    groups = members.groupBy("terminal").agg(F.min("sample_id").alias("group_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return members.join(groups, "terminal").select("group_id", "sample_id", "copies")
