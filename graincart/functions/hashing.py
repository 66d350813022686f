"""Deterministic hashes: the same value always goes to the same split, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = float(16**12)


def stable_hex(value: Column, salt: Column | str) -> Column:
    """SHA-256 of `salt::value` in hex."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    return F.sha2(F.concat(salt, F.lit("::"), value.cast("string")), 256)


def stable_fraction(value: Column, salt: Column | str) -> Column:
    """The first 48 bits of stable_hex as a share in [0, 1); exact in a double."""
    return F.conv(F.substring(stable_hex(value, salt), 1, 12), 16, 10).cast("bigint").cast("double") / F.lit(SPAN)


def hash_split(value: Column, salt: Column | str, train: float = 0.8, validation: float = 0.1) -> Column:
    share = stable_fraction(value, salt)
    return F.when(share < F.lit(train), "train").when(share < F.lit(train + validation), "validation").otherwise("test")


def is_holdout(value: Column, salt: Column | str, ratio: float) -> Column:
    return stable_fraction(value, salt) < F.lit(ratio)


def group_key(source_dataset: Column, source_image_id: Column, images: Column) -> Column:
    """`source::picture`: the id of the source picture, else the first path, else nothing."""
    picture = F.coalesce(F.nullif(source_image_id, F.lit("")), F.get(images, F.lit(0)), F.lit(""))
    return F.concat(F.coalesce(source_dataset, F.lit("None")), F.lit("::"), picture)
