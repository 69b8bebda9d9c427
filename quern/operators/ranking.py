"""Row numbers over a whole table without one big task.

A plain ``row_number() over (order by ...)`` sends every row to one partition.
Here rows go to buckets of the leading sort column, are numbered inside their
bucket, and get the bucket's offset from a prefix sum over one row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256


def _bucket(df: DataFrame, lead: Column, buckets: int) -> Column:
    """Number of approximate quantiles below the value: at most ``buckets`` values reach the driver."""
    cuts = df.agg(F.percentile_approx(lead, [k / buckets for k in range(1, buckets)], 1000).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    if not cuts:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= lead)), F.lit(0))


def global_row_number(df: DataFrame, order: list[Column | str], name: str = "rn", buckets: int = BUCKETS) -> DataFrame:
    """``df`` with dense row numbers from 1 in ascending ``order``; the first entry is numeric."""
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    at = df.withColumn("__bucket", _bucket(df, cols[0], buckets))
    counts = at.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__bucket", F.coalesce(before, F.lit(0)).alias("__before"))  # a row per bucket
    inner = Window.partitionBy("__bucket").orderBy(*cols)
    out = at.withColumn("__grn", F.row_number().over(inner)).join(F.broadcast(offsets), "__bucket")
    return out.withColumn(name, F.col("__grn") + F.col("__before")).drop("__bucket", "__grn", "__before")


def global_hash_rank(df: DataFrame, key: Column, name: str = "rn") -> DataFrame:
    """Row numbers in the order of a hex key (a seeded shuffle); buckets are the key's first digits."""
    at = df.withColumn("__key", key).withColumn("__bucket", F.substring("__key", 1, 2))
    counts = at.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__bucket", F.coalesce(before, F.lit(0)).alias("__before"))  # 256 rows
    out = at.withColumn("__grn", F.row_number().over(Window.partitionBy("__bucket").orderBy("__key"))).join(F.broadcast(offsets), "__bucket")
    return out.withColumn(name, F.col("__grn") + F.col("__before")).drop("__bucket", "__grn", "__before", "__key")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, name: str | None = None) -> DataFrame:
    """At most ``k`` first rows of each group (Spark trims groups before the shuffle)."""
    w = Window.partitionBy(*group).orderBy(*order)
    out = df.withColumn("__grn", F.row_number().over(w)).filter(F.col("__grn") <= k)
    return out.withColumnRenamed("__grn", name) if name else out.drop("__grn")


def top_rows(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of the whole table; each task keeps at most ``k``."""
    return df.orderBy(*order).limit(k)
