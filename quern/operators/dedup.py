"""Exact dedup and identity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class IdentityError(ValueError):
    """Rows that share an identity disagree, or one that is needed is missing."""


def keep_first(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """Of each key the first row in ``order``.  An aggregate, so copies combine before the shuffle."""
    cols = df.columns
    place = F.struct(*[F.col(o) for o in order])
    best = df.groupBy(key.alias("__key")).agg(F.min_by(F.struct(*cols), place).alias("__row"))
    return best.select("__row.*")


def keep_best(df: DataFrame, key: list[str], rank: list[str | Column]) -> DataFrame:
    """Of each key the row with the greatest rank tuple."""
    place = F.struct(*[F.col(r) if isinstance(r, str) else r for r in rank])
    keys = [F.col(k).alias(f"__k{n}") for n, k in enumerate(key)]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), place).alias("__row")).select("__row.*")


def conflicts(df: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """Keys that occur more than once: rows, distinct contents, and whether they conflict."""
    digest = F.sha2(F.to_json(F.struct(*content)), 256)
    out = df.groupBy(*key).agg(F.count("*").alias("n_rows"), F.count_distinct(digest).alias("n_contents")).filter("n_rows > 1")
    return out.withColumn("conflict", F.col("n_contents") > 1)


def require_unique(df: DataFrame, key: list[str]) -> DataFrame:
    """``df``, or an error that names a repeated key."""
    bad = df.groupBy(*key).count().filter("count > 1").limit(1).collect()
    if bad:
        raise IdentityError(f"repeated key {bad[0].asDict()}")
    return df
