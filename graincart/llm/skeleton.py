"""Visually identical text with different characters.

The skeleton of a text: decompose it (NFD), replace every character by the prototype of its look, decompose again.
Texts with equal skeletons look the same. Letter case, accents and digits are part of the look; NFKC is not used,
because it would make a raised digit a plain one.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graincart.session import cut_lineage

#: A character that is neither white space nor a control or format character.
_VISIBLE = re.compile(r"[^\s\x00-\x1f\x7f-\x9f\u00ad\u0600-\u0605\u061c\u06dd\u070f\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff\ufff9-\ufffb\U000e0000-\U000e0fff]")

#: Letters of other alphabets and the Latin letters that they look like, in the order of their alphabets. They go before those of confusables().
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορυϲϳ", "ABEZHIKMNOPTYXavopucj")
CYRILLIC = ("АВЕЅІЈКМНОРСТУҮХԌԚԜаеорсуүхѕіјһԁԛԝӏ", "ABESIJKMHOPCTYYXGQWaeopcyyxsijhdqwl")
ARMENIAN = ("ՍՏՕհոսօզ", "USOhnuoq")
CHEROKEE = ("ᎪᎫᎬᎳᎷᎻᎢᏀᏃᏚᏟᏢᏦᏴ", "AJEWMHTGZSCPKB")
COPTIC = ("ⲞⲟⲢⲣⲤⲥⲔⲘⲚⲎⲦⲬ", "OoPpCcKMNHTX")
#: Characters without a width of their own (joiners, direction marks, soft hyphen, selectors, annotation and shorthand marks, tags), in all planes.
WIDTHLESS = [
    0x00AD, 0x034F, 0x061C, 0x17B4, 0x17B5, *range(0x180B, 0x1810), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF, *range(0xFFF9, 0xFFFC),
    *range(0x1BCA0, 0x1BCA4), *range(0x1D173, 0x1D17B), *range(0xE0000, 0xE1000),
]

Table = dict[int, str | None]


def _letters() -> list[str]:
    """The letters of all planes beyond ASCII that have no decomposition into a letter and marks."""
    every = (chr(code) for code in range(0x80, 0x110000))
    return [c for c in every if unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lo", "Nl") and unicodedata.normalize("NFD", c) == c]


@cache
def prototypes() -> Table:
    """Character -> what is shown in its place; None for nothing.

    Widths, fonts and kinds of space come from the character database: a character whose decomposition is <wide> or
    <narrow> looks like that decomposition, a letter in another <font> like the letter, every space separator like a space.
    """
    table: Table = {}
    for code in range(0x110000):
        char = chr(code)
        how = unicodedata.decomposition(char)
        if how.startswith(("<wide>", "<narrow>")) or (how.startswith("<font>") and char.isalpha()):
            table[code] = "".join(chr(int(x, 16)) for x in how.split()[1:])
        elif unicodedata.category(char) == "Zs":
            table[code] = " "
    for source, target in (GREEK, CYRILLIC, ARMENIAN, CHEROKEE, COPTIC):
        table.update((ord(a), b) for a, b in zip(source, target))
    table.update(dict.fromkeys(WIDTHLESS))
    return table


_PUBLIC: dict[str, Table] = {}


def confusables(spark: SparkSession) -> Table:
    """prototypes() with every other letter that the Unicode table of confusables (in the ICU library that Spark ships) gives the look of an ASCII letter.

    About 800 letters more. That table makes no difference between I, l, 1 and |, nor between m and rn: a letter that looks like several
    ASCII letters gets that of its own case. Latin letters with a mark, and those without their dot, are letters with another accent;
    the ideographic zero is a digit: these stay as they are.
    """
    if "table" not in _PUBLIC:
        checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()

        def looks(chars: list[str]) -> list[str]:
            return checker.getSkeleton(0, "\n".join(chars)).split("\n")

        ascii_ = [chr(code) for code in range(0x41, 0x7B) if chr(code).isalpha()]
        named: dict[str, list[str]] = {}
        for char, look in zip(ascii_, looks(ascii_)):
            named.setdefault(look, []).append(char)
        found = _letters()
        table: Table = {}
        for char, look in zip(found, looks(found)):
            name = unicodedata.name(char, "")
            if look not in named or name.startswith("IDEOGRAPHIC") or (name.startswith("LATIN") and (" WITH " in name or "DOTLESS" in name)):
                continue
            small = unicodedata.category(char) == "Ll" or name.startswith("SMALL ")
            table[ord(char)] = min(named[look], key=lambda x: x.islower() != small)
        merged = {**table, **prototypes()}
        # what a prototype looks like itself counts, as that of a Greek letter in another font
        _PUBLIC["table"] = {code: look if look is None else look.translate(merged) for code, look in merged.items()}
    return _PUBLIC["table"]


def skeleton(text: str, table: Table | None = None) -> str:
    if text.isascii():
        return text
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(prototypes() if table is None else table))


def _skeleton_of(text: Column, table: Table) -> Column:
    @F.pandas_udf(T.StringType())
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(lambda t: skeleton(t, table), na_action="ignore")

    return run(text)


def _look_of(text: Column, table: Table) -> Column:
    def look(one: str) -> bytes | None:
        form = skeleton(one, table)
        return hashlib.sha256(form.encode("utf-8", "surrogatepass")).digest() if _VISIBLE.search(form) else None

    @F.pandas_udf(T.BinaryType())
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(look, na_action="ignore")

    return run(text)


def look_id(text: str, table: Table) -> Column:
    """SHA-256 of a text's skeleton; null without a visible character. Plain ASCII texts, which are their own skeletons, skip Python."""
    plain = F.col(text).rlike(r"\A[\x00-\x7F]*\z")
    own = F.when(F.col(text).rlike(r"[\x21-\x7E]"), F.unhex(F.sha2(text, 256)))
    return F.when(plain, own).otherwise(_look_of(F.when(~plain, F.col(text)), table))


def with_skeleton(documents: DataFrame, text: str = "text", name: str = "skeleton") -> DataFrame:
    """`documents` with the one form of each text; null for a null text, empty for one of widthless marks only.

    Python sees each distinct need once: plain ASCII texts are their own skeleton and skip it.
    """
    plain = F.col(text).rlike(r"\A[\x00-\x7F]*\z")
    other = F.when(~plain, F.col(text))
    return documents.withColumn(name, F.when(plain, F.col(text)).otherwise(_skeleton_of(other, confusables(documents.sparkSession))))


def look_alike_classes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """skeleton_id, text_id, key of each document whose look more than one string has.

    The texts are read once, and only digests (SHA-256) of them go on. Copies of one string are combined before a look is
    counted, so a string held by a third of all documents is one row for each task. Texts without a visible character are
    left out.
    """
    shaped = documents.select(key, text).select(F.col(key), F.unhex(F.sha2(text, 256)).alias("text_id"), look_id(text, confusables(documents.sparkSession)).alias("skeleton_id"))
    ids = cut_lineage(shaped).where("skeleton_id IS NOT NULL")
    several = ids.select("skeleton_id", "text_id").distinct().groupBy("skeleton_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("skeleton_id")
    return cut_lineage(ids.join(several, "skeleton_id", "left_semi"))


def look_alike_pairs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(`key`_a, `key`_b), smaller first: documents with equal skeletons and different strings.

    Pairs of copies of one string are none, so that the pairs of a look are those between its different strings: these are
    paired first, and only then joined with the documents that hold them.
    """
    rows = look_alike_classes(documents, key, text)
    texts = rows.select("skeleton_id", "text_id").distinct()
    other = texts.select("skeleton_id", F.col("text_id").alias("_tb"))
    pairs = texts.select("skeleton_id", F.col("text_id").alias("_ta")).join(other, "skeleton_id").where("_ta < _tb").select("_ta", "_tb")
    a, b = (rows.select(F.col("text_id").alias(t), F.col(key).alias(k)) for t, k in (("_ta", "_ka"), ("_tb", "_kb")))
    met = pairs.join(a, "_ta").join(b, "_tb").where("_ka <> _kb")
    return met.select(F.least("_ka", "_kb").alias(f"{key}_a"), F.greatest("_ka", "_kb").alias(f"{key}_b")).distinct()


def look_alike_members(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, class_id, links of each document with a look-alike: the smallest key of its look, and how many documents with other strings have that look.

    Strings are counted before anything is joined, so the work is linear however many documents hold one. A document delivered again counts once.
    """
    rows = look_alike_classes(documents, key, text).distinct()
    texts = rows.groupBy("skeleton_id", "text_id").agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_low"))
    looks = texts.groupBy("skeleton_id").agg(F.sum("_n").alias("_all"), F.min("_low").alias("class_id"))
    per_text = texts.join(looks, "skeleton_id").select("text_id", "class_id", (F.col("_all") - F.col("_n")).alias("links"))
    return rows.select(key, "text_id").join(per_text, "text_id").select(key, "class_id", "links")
