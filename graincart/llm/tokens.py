"""Encoding of the whole corpus with a public byte-level BPE tokenizer, and back.

The distinct words of the corpus are encoded once each: higher-order functions fold the merges of lowest rank over the
array of a word's bytes, with the ranks as a literal map. The words of a text are then looked up as one array.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graincart.session import cut_lineage, hinted

#: How text is cut into words before the merges: the public tokenizers' pattern, with Unicode classes switched on.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The rank map is a literal array of small maps, since Spark searches a map from its start.
SLOTS = 1 << 14
NO_RANK = 2**31 - 1
#: Words of more bytes are merged with a heap: a fold copies its arrays at each step, so its cost grows with their square.
LONG_WORD = 200
#: As many of the most used words as this many rows and characters hold are broadcast; the others are joined by a shuffle.
BROADCAST_WORDS, BROADCAST_CHARS = 400_000, 8_000_000


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def _slots(path: str) -> str:
    """The rank map as JSON: slot (CRC-32 of the piece's hex digits) -> {hex digits: rank}."""
    table: list[dict[str, int]] = [{} for _ in range(SLOTS)]
    for piece, rank in ranks(path).items():
        digits = piece.hex().upper()
        table[zlib.crc32(digits.encode()) % SLOTS][digits] = rank
    return json.dumps(table, separators=(",", ":"))


def _let(value: Column, use) -> Column:
    """`use(value)` with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def word_ids(word: Column, path: str) -> Column:
    """The ids of one word of PATTERN, as array<int>.

    A state holds the pieces (hex digits of their bytes) and the ranks of the pairs of neighbours. Each step
    merges the leftmost pair of lowest rank and looks up the two pairs that this makes; there are at most as many
    steps as bytes. A word that is a piece itself needs none.
    """
    literal = F.from_json(F.lit(_slots(path)), "array<map<string,int>>")
    return _let(literal, lambda table: _fold(word, table))


def _fold(word: Column, table: Column) -> Column:
    """word_ids with the rank map as a lambda's variable, so that the plan holds the literal once."""

    def rank(piece: Column) -> Column:
        return F.coalesce(F.try_element_at(F.get(table, F.pmod(F.crc32(F.encode(piece, "UTF-8")), F.lit(SLOTS)).cast("int")), piece), F.lit(NO_RANK))

    digits = F.hex(F.encode(word, "UTF-8"))
    n = (F.length(digits) / 2).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(digits, i * 2 + 1, F.lit(2)))
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: rank(F.substring(digits, i * 2 + 1, F.lit(4))))).otherwise(F.array().cast("array<int>"))

    def state(p: Column, r: Column) -> Column:
        return F.struct(p.alias("p"), r.alias("r"))

    def merge(s: Column, _: Column) -> Column:
        def at(best: Column) -> Column:
            def put(k: Column) -> Column:
                def made(piece: Column) -> Column:
                    p, r = s["p"], s["r"]
                    size = F.size(p)
                    kept = F.concat(F.slice(p, F.lit(1), k - 1), F.array(piece), F.slice(p, k + 2, size))
                    none = F.array().cast("array<int>")
                    before = F.when(k > 1, F.concat(F.slice(r, F.lit(1), k - 2), F.array(rank(F.concat(F.element_at(p, k - 1), piece))))).otherwise(none)
                    after = F.when(k + 2 <= size, F.concat(F.array(rank(F.concat(piece, F.element_at(p, k + 2)))), F.slice(r, k + 2, size))).otherwise(none)
                    return state(kept, F.concat(before, after))

                return _let(F.concat(F.element_at(s["p"], k), F.element_at(s["p"], k + 1)), made)

            return F.when(best < NO_RANK, _let(F.array_position(s["r"], best).cast("int"), put)).otherwise(s)

        return F.when(F.size(s["r"]) > 0, _let(F.array_min(s["r"]), at)).otherwise(s)

    folded = F.aggregate(F.sequence(F.lit(1), n), state(pieces, pairs), merge, lambda s: F.transform(s["p"], rank))
    return F.when(rank(digits) < NO_RANK, F.array(rank(digits))).otherwise(folded)


def merge_long(word: bytes, table: dict[bytes, int]) -> list[int]:
    """The ids of a word by the same merges, with a heap of pairs (rank, place) in place of a scan for the lowest."""
    if word in table:
        return [table[word]]
    end = len(word)
    after, before = list(range(1, end + 1)), list(range(-1, end - 1))
    piece = [word[i : i + 1] for i in range(end)]
    heap = [(table[word[i : i + 2]], i, 2) for i in range(end - 1) if word[i : i + 2] in table]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i] if piece[i] else end
        if j >= end or len(piece[i]) + len(piece[j]) != size:
            continue  # one of the two has been merged since
        piece[i] += piece[j]
        piece[j] = b""
        after[i] = after[j]
        if after[i] < end:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < end and (rank := table.get(piece[a] + piece[b])) is not None:
                heapq.heappush(heap, (rank, a, len(piece[a]) + len(piece[b])))
    return [table[x] for x in piece if x]


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null and empty texts."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>"))


def vocabulary(documents: DataFrame, path: str, text: str = "text") -> DataFrame:
    """word, uses, ids, n (their number) of each distinct word of the texts, written to the checkpoint folder."""
    words = documents.select(F.explode(words_of(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
    spread = words.repartition(_tasks(documents))
    short = spread.where(F.octet_length("word") <= LONG_WORD).select("word", "uses", word_ids(F.col("word"), path).alias("ids"))
    table = documents.sparkSession.sparkContext.broadcast(ranks(path))

    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(ids=[merge_long(w.encode(), table.value) for w in part["word"]])

    long = spread.where(F.octet_length("word") > LONG_WORD).withColumn("ids", F.array().cast("array<int>")).mapInPandas(merge, "word string, uses bigint, ids array<int>")
    return cut_lineage(short.unionByName(long).withColumn("n", F.size("ids")))


def _tasks(df: DataFrame) -> int:
    """Tasks for work that is heavy for its bytes, which adaptive execution would put into too few."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _common(vocab: DataFrame) -> DataFrame | None:
    """The words to broadcast: all if they are few, else the most used ones, as many as fit the bounds; None if that is all of them.

    Words are counted by the power of two of their uses, which gives at most 64 rows to the driver.
    """
    power = F.floor(F.log2("uses")).cast("int")
    sizes = vocab.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("words"), F.sum(F.length("word") + 4 * F.col("n")).alias("chars")).collect()
    words = chars = 0
    for row in sorted(sizes, key=lambda r: -r.p):
        words, chars = words + row.words, chars + row.chars
        if words > BROADCAST_WORDS or chars > BROADCAST_CHARS:
            return vocab.where(power > row.p)
    return None


def _rows(documents: DataFrame, key: str, text: str) -> DataFrame:
    """key and text of each different row. Keys alone are counted, so that only texts of repeated keys are shuffled."""
    rows = documents.select(key, text)
    repeats = hinted(rows.select(key).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(key).alias("_key")))
    same = F.col(key).eqNullSafe(F.col("_key"))
    return rows.join(repeats, same, "left_anti").unionByName(rows.join(repeats, same, "left_semi").dropDuplicates([key, text]))


class _Vocabulary:
    """Words with their ids as Arrow arrays, made once a Python worker from what was broadcast."""

    def __init__(self, sent) -> None:
        table = pa.ipc.open_stream(sent.value).read_all().combine_chunks()
        self.words = table["word"].combine_chunks() if table.num_rows else pa.array([], pa.string())
        self.ids = table["ids"].combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
        self.sizes = np.diff(self.ids.offsets.to_numpy())

    def look_up(self, words: pa.ListArray, counts_only: bool) -> tuple[pa.Array, pa.Array]:
        """(ids or their number, gaps) of each text. A gap is a word that isn't here, with how many ids of the text come before it."""
        flat, ends = words.flatten(), words.offsets.to_numpy() - words.offsets[0].as_py()
        place = pc.index_in(flat, value_set=self.words)
        known = place.is_valid().to_numpy(zero_copy_only=False)
        sizes = np.zeros(len(flat), dtype=np.int64)
        at = place.fill_null(0).to_numpy()
        if len(self.sizes):
            sizes = np.where(known, self.sizes[at], 0)
        before = np.concatenate(([0], np.cumsum(sizes)))
        of_texts = before[ends]
        missing = np.flatnonzero(~known)
        text_of = np.searchsorted(ends, missing, side="right") - 1
        gaps = pa.StructArray.from_arrays([pa.array((before[missing] - of_texts[text_of]).astype(np.int32)), flat.take(pa.array(missing))], ["at", "word"])
        gaps = pa.ListArray.from_arrays(pa.array(np.searchsorted(missing, ends).astype(np.int32)), gaps)
        if counts_only:
            return pa.array(np.diff(of_texts)), gaps
        ids = self.ids.take(place.drop_null()).flatten().cast(pa.int32())
        return pa.ListArray.from_arrays(pa.array(of_texts.astype(np.int32)), ids), gaps


def _looked_up(documents: DataFrame, path: str, key: str, text: str, counts_only: bool) -> tuple[DataFrame, DataFrame | None]:
    """(key, _row, out, gaps) of each text, and the vocabulary that gaps are looked up in; None if there are no gaps.

    The words of a text go to Python as one array, and come back as ids in the same row: nothing is shuffled. Of a large vocabulary
    only the most used words are broadcast, and gaps are the others.
    """
    vocab = vocabulary(documents, path, text)
    common = _common(vocab)
    sent = (vocab if common is None else common).select("word", "ids").toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("word", pa.string()), ("ids", pa.list_(pa.int32()))])) as out:
        out.write_table(sent.cast(pa.schema([("word", pa.string()), ("ids", pa.list_(pa.int32()))])))
    shared = documents.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
    schema = f"`{key}` {documents.schema[key].dataType.simpleString()}, _row bigint, out {'bigint' if counts_only else 'array<int>'}, gaps array<struct<at:int,word:string>>"

    def look_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Vocabulary(shared)
        for part in parts:
            made, gaps = table.look_up(part.column(2), counts_only)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), made, gaps], [key, "_row", "out", "gaps"])

    rows = _rows(documents, key, text).select(key, F.xxhash64(text).alias("_row"), words_of(F.col(text)).alias("_words"))
    found = rows.mapInArrow(look_up, schema)
    return (found, None) if common is None else (found, vocab)


def _fill(found: DataFrame, vocab: DataFrame | None, key: str, column: str) -> DataFrame:
    """`found` with `filled`: (place of the gap, ids or their number) of each gap of a text, in order; no column if there are no gaps.

    Gaps are nearly all words but few of a text. Their words are no key that a third of the texts share, since those are broadcast.
    """
    if vocab is None:
        return found
    found = cut_lineage(found)
    far = found.select(key, "_row", F.posexplode("gaps").alias("_pos", "g")).select(key, "_row", "_pos", "g.at", "g.word").join(vocab.select("word", F.col(column).alias("more")), "word")
    far = far.groupBy(key, "_row").agg(F.sort_array(F.collect_list(F.struct("_pos", "at", "more"))).alias("filled")).select(F.col(key).alias("_key"), F.col("_row").alias("_text"), "filled")
    return found.join(far, F.col(key).eqNullSafe(F.col("_key")) & F.col("_row").eqNullSafe(F.col("_text")), "left").drop("_key", "_text")


def encode(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array<int>): the ids of each text, without special tokens; an empty array for empty and null texts.

    One row for each different (key, text); further columns are not carried, so their names cannot clash.
    """
    found, vocab = _looked_up(documents, path, key, text, False)
    rows = _fill(found, vocab, key, "ids")
    if vocab is None:
        return rows.select(key, F.col("out").alias("ids"))
    # before each gap, the ids from the last one on; after the last gap, the rest
    start, size = F.lit(0), F.size("filled")
    before = F.transform("filled", lambda x, i: F.concat(F.slice("out", F.when(i > 0, F.get(F.col("filled"), i - 1)["at"]).otherwise(start) + 1, x["at"] - F.when(i > 0, F.get(F.col("filled"), i - 1)["at"]).otherwise(start)), x["more"]))
    last = F.get(F.col("filled"), size - 1)["at"]
    rest = F.slice("out", last + 1, F.size("out") - last)
    return rows.select(key, F.when(F.col("filled").isNull(), F.col("out")).otherwise(F.concat(F.flatten(before), rest)).alias("ids"))


def token_counts(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, tokens: the number of ids of each text; 0 for empty and null texts."""
    found, vocab = _looked_up(documents, path, key, text, True)
    rows = _fill(found, vocab, key, "n")
    if vocab is None:
        return rows.select(key, F.col("out").alias("tokens"))
    return rows.select(key, (F.col("out") + F.coalesce(F.aggregate("filled", F.lit(0).cast("bigint"), lambda a, x: a + x["more"]), F.lit(0))).alias("tokens"))


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, text: the ids turned back into text by joining the pieces' bytes. Ids outside the vocabulary make the text null."""
    pieces = {rank: piece.hex().upper() for piece, rank in ranks(path).items()}
    table = F.from_json(F.lit(json.dumps([pieces.get(i) for i in range(max(pieces) + 1)])), "array<string>")
    digits = F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")
    known = F.forall(ids, lambda i: F.get(table, i).isNotNull())
    return encoded.select(key, F.when(known, F.decode(F.unhex(digits), "UTF-8")).alias("text"))
