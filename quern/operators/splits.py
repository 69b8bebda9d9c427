"""Splits without leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import global_row_number


class Leak(ValueError):
    """Two splits share a key."""


def ordinal_split(df: DataFrame, order: str, test: int, val: int) -> DataFrame:
    """The lowest ``test`` rows in order, the next ``val``, the rest for training."""
    at = global_row_number(df, [order], "__rn")
    split = F.when(F.col("__rn") <= test, "test").when(F.col("__rn") <= test + val, "val").otherwise("train")
    return at.withColumn("split", split).drop("__rn")


def follow_first(df: DataFrame, key: list[str], order: str, split: str = "split") -> DataFrame:
    """Every row takes the split of its key's first row."""
    first = df.groupBy(*key).agg(F.min_by(split, order).alias("__s"))
    return df.join(first, key).withColumn(split, F.col("__s")).drop("__s")


def assign_by_priority(df: DataFrame, key: str, split: str, priority: list[str]) -> DataFrame:
    """One row per key, in the first split of the priority list that claims it: the chain of
    anti-joins in one aggregate."""
    place = F.coalesce(*[F.when(F.col(split) == s, F.lit(k)) for k, s in enumerate(priority)], F.lit(len(priority)))
    return df.groupBy(key).agg(F.min_by(split, place).alias(split), F.count("*").alias("claims"))


def overlaps(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that stand in several splits."""
    return df.groupBy(key).agg(F.count_distinct(split).alias("n_splits")).filter("n_splits > 1")


def require_disjoint(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    bad = overlaps(df, key, split).limit(1).collect()
    if bad:
        raise Leak(f"{key} {bad[0][0]} stands in {bad[0][1]} splits")
    return df


def pairwise_overlap(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """split_a, split_b, shared: common keys of every two splits, zero included (splits are few)."""
    keys = df.select(key, split).distinct()
    names = keys.select(split).distinct()
    pairs = names.select(F.col(split).alias("split_a")).join(names.select(F.col(split).alias("split_b")), F.col("split_a") < F.col("split_b"))
    sets = keys.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("s")).filter(F.size("s") > 1)
    both = sets.select(key, F.explode("s").alias("split_a"), "s").select(key, "split_a", F.explode("s").alias("split_b")).filter("split_a < split_b")
    found = both.groupBy("split_a", "split_b").agg(F.count("*").alias("shared"))
    return pairs.join(found, ["split_a", "split_b"], "left").fillna(0, ["shared"])


def membership(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is listed, the others)."""
    listed = ids.select(key).distinct()
    return df.join(listed, key, "left_semi"), df.join(listed, key, "left_anti")


def length_groups(df: DataFrame, length: str, pool: int, group: int, shuffle, order_name: str = "position") -> DataFrame:
    """Pool-wise length sort: shuffle all, sort by length inside pools of ``pool`` rows, cut into
    groups of ``group``, shuffle the groups.  ``shuffle(salt, *columns)`` gives hex keys."""
    from .ranking import global_hash_rank

    at = global_hash_rank(df, shuffle("rows"), "__rn").withColumn("pool", F.floor((F.col("__rn") - 1) / pool))
    at = at.withColumn("__in", F.row_number().over(Window.partitionBy("pool").orderBy(length, "__rn")))
    at = at.withColumn("group_id", F.floor((F.col("__in") - 1) / group))
    return at.withColumn("group_key", shuffle("groups", F.col("pool"), F.col("group_id"))).withColumnRenamed("__in", order_name).drop("__rn")
