"""Checked joins, request joins, theta joins on narrow rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dedup import IdentityError, require_unique


def checked_join(left: DataFrame, build: DataFrame, key: list[str]) -> DataFrame:
    """Inner join whose build side must be unique by key and must hold every key of the left."""
    require_unique(build, key)
    missing = left.join(build.select(*key), key, "left_anti").limit(1).collect()
    if missing:
        raise IdentityError(f"no row for {[missing[0][k] for k in key]}")
    return left.join(build, key)


def one_to_one(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Join that must pair every row of both sides exactly once."""
    require_unique(left, key)
    require_unique(right, key)
    tags = left.select(*key, F.lit(1).alias("__l")).join(right.select(*key, F.lit(1).alias("__r")), key, "full")
    bad = tags.filter("__l is null or __r is null").limit(1).collect()
    if bad:
        raise IdentityError(f"unpaired {[bad[0][k] for k in key]}")
    return left.join(right, key)


def compute_once(requests: DataFrame, keys: list[str], compute) -> DataFrame:
    """Distinct requests, computed once, joined back: ``compute`` maps a frame of distinct keys to keys and results."""
    return requests.join(compute(requests.select(*keys).distinct()), keys, "left")


def best_versus_played(rows: DataFrame, group: str, item: str, score: str, played: str) -> DataFrame:
    """Per group the best item (greatest score, then least item), the played one and the loss, never negative."""
    own = F.when(F.col(item) == F.col(played), F.col(score))
    out = rows.groupBy(group).agg(
        F.max_by(item, F.struct(F.col(score), -F.col(item))).alias("best"),
        F.max(score).alias("best_score"),
        F.max(F.when(F.col(item) == F.col(played), F.col(item))).alias("played_item"),
        F.max(own).alias("played_score"),
    )
    loss = F.when(F.col("best") == F.col("played_item"), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.col("best_score") - F.col("played_score")))
    return out.withColumn("loss", loss)


def cheapest_answer(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Answer each request (fen, need_nodes, need_lines) by the cached result with at least its
    budget and lines and the most nodes; null where none subsumes it."""
    hit = requests.join(cache, "fen", "left").withColumn("ok", (F.col("nodes") >= F.col("need_nodes")) & (F.col("lines") >= F.col("need_lines")))
    best = F.max_by(F.when(F.col("ok"), F.struct("nodes", "lines", "value")), F.when(F.col("ok"), F.struct("nodes", "lines", "value")))
    out = hit.groupBy("fen", "need_nodes", "need_lines").agg(best.alias("b"))
    return out.select("fen", "need_nodes", "need_lines", F.col("b.nodes").alias("nodes"), F.col("b.value").alias("value"))


def drop_dominated(rows: DataFrame, group: list[str], path: str) -> DataFrame:
    """Rows whose path is not a proper sub-list of another path of the same group (groups are small: plans of one position)."""
    text = lambda c: F.concat(F.lit(","), F.array_join(c, ","), F.lit(","))
    a = rows.withColumn("__t", text(F.col(path)))
    b = a.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__t").alias("__u"))
    same = [F.col(g) == F.col(f"__{g}") for g in group]
    cond = F.contains(F.col("__u"), F.col("__t")) & (F.col("__u") != F.col("__t"))
    for s in same:
        cond = s & cond
    return a.join(b, cond, "left_anti").drop("__t")


def drop_prefixes(rows: DataFrame, group: list[str], path: str) -> DataFrame:
    """Rows whose path is no proper prefix of another of the same group: every proper prefix is listed
    once, then an anti-join on equality."""
    n = F.size(path)
    heads = rows.select(*group, F.explode(F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.slice(path, 1, k))).otherwise(F.array().cast(dict(rows.dtypes)[path].replace("array<", "array<array<") + ">"))).alias(path)).distinct()
    return rows.join(heads, [*group, path], "left_anti")


def first_difference(a: Column, b: Column) -> Column:
    """0-based place of the first difference of two arrays; null if they are equal."""
    n = F.greatest(F.size(a), F.size(b))
    differ = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: ~z["a"].eqNullSafe(z["b"]))
    at = F.array_position(differ, True)
    return F.when((n == 0) | (at == 0), F.lit(None).cast("int")).otherwise((at - 1).cast("int"))


def solution_match(line: Column, solution: Column) -> Column:
    """Whether a line equals the solution's first or last moves of the same number."""
    n = F.size(line)
    fits = (n > 0) & (n <= F.size(solution))
    return fits & ((F.slice(solution, 1, n) == line) | (F.slice(solution, F.greatest(F.size(solution) - n + 1, F.lit(1)), n) == line))


def aligned(left: DataFrame, right: DataFrame, ordinal: str, ident: str) -> DataFrame:
    """Positional join; rows at the same place must carry the same id, and the right is a prefix of the left."""
    r = right.withColumnRenamed(ident, "__id")
    bad = left.join(r, ordinal, "right").filter(F.col(ident).isNull() | (F.col(ident) != F.col("__id"))).limit(1).collect()
    if bad:
        raise IdentityError(f"place {bad[0][ordinal]} does not match")
    return left.join(r.drop("__id"), ordinal)


def pairings(names: DataFrame, name: str, kind: str, hub: str | None = None) -> DataFrame:
    """a, b of a schedule over a short list of players: chain, round_robin or star."""
    if kind == "chain":
        return names.select(F.col(name).alias("a"), F.lead(name).over(Window.orderBy(name)).alias("b")).filter("b is not null")
    if kind == "round_robin":
        return names.select(F.col(name).alias("a")).join(names.select(F.col(name).alias("b")), F.col("a") < F.col("b"))
    if kind == "star":
        return names.filter(F.col(name) != hub).select(F.lit(hub).alias("a"), F.col(name).alias("b"))
    raise ValueError(f"unknown schedule {kind}")
