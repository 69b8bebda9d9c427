"""Stable hashes: every random decision is a function of (seed, salt, id), so it is
the same on any partitioning and in any engine with md5."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rank_key(seed: int, salt: str, *ids: str | Column) -> Column:
    """A 32-digit hex key whose order is a seeded shuffle."""
    parts = [F.col(i) if isinstance(i, str) else i for i in ids]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *[p.cast("string") for p in parts]))


def hash_long(key: Column, digits: int = 13) -> Column:
    """The first hex digits of a key as a non-negative long."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("long")


def u01(seed: int, salt: str, *ids: str | Column) -> Column:
    """A uniform number in [0, 1) with 52 bits."""
    return hash_long(rank_key(seed, salt, *ids)) / F.lit(float(1 << 52))


def shard_of(key: str | Column, shards: int) -> Column:
    """Partition number of a key: 60 bits of its md5 modulo the number of shards."""
    c = F.col(key) if isinstance(key, str) else key
    return (hash_long(F.md5(c.cast("string")), 15) % shards).cast("int")


def blake2_hex(value: str, size: int = 16) -> str:
    return hashlib.blake2b(value.encode("utf-8"), digest_size=size).hexdigest()


def request_seed(seed: int, game: int, ply: int) -> int:
    """31-bit seed of one request, from a 64-bit blake2b of ``seed|game|ply``."""
    raw = hashlib.blake2b(f"{seed}|{game}|{ply}".encode(), digest_size=8).digest()
    return int.from_bytes(raw, "big") % ((1 << 31) - 1)


def with_blake2(df: DataFrame, column: str, name: str = "digest", size: int = 16) -> DataFrame:
    """``df`` with the blake2b hex digest of a column (Spark has no such function); null stays null."""
    @F.pandas_udf("string")
    def digest(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else blake2_hex(v, size))

    return df.withColumn(name, digest(F.col(column).cast("string")))
