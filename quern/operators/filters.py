"""Gates, buckets, reason chains and ledgers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import u01


class SpecError(ValueError):
    """A specification that contradicts itself."""


def all_gates(gates: dict[str, Column], names: list[str]) -> Column:
    """Named boolean gates, all of which must hold."""
    unknown = [n for n in names if n not in gates]
    if unknown:
        raise SpecError(f"unknown gates {unknown}")
    return reduce(lambda a, b: a & b, [gates[n] for n in names], F.lit(True))


def bucket(value: Column, spec: list[tuple[str, float, float]]) -> Column:
    """Name of the half-open bucket (low, high] that holds the value; null outside."""
    out = F.lit(None).cast("string")
    for name, low, high in spec:
        out = F.when((value > low) & (value <= high), F.lit(name)).otherwise(out)
    return out


def check_buckets(spec: list[tuple[str, float, float, int]]) -> None:
    """Unique names, positive counts, sane and disjoint bounds."""
    names = [s[0] for s in spec]
    if len(set(names)) != len(names):
        raise SpecError("bucket names repeat")
    if any(c <= 0 for *_, c in spec):
        raise SpecError("bucket counts must be positive")
    if any(low >= high for _, low, high, _ in spec):
        raise SpecError("a bucket is empty")
    by_low = sorted(spec, key=lambda s: s[1])
    for a, b in zip(by_low, by_low[1:], strict=False):
        if a[2] > b[1]:
            raise SpecError(f"buckets {a[0]} and {b[0]} overlap")


def overlapping(spec: DataFrame) -> DataFrame:
    """Rows (name, low, high) whose upper bound passes the next lower one."""
    w = Window.orderBy("low")  # a row per bucket
    return spec.withColumn("next_low", F.lead("low").over(w)).withColumn("overlaps", F.coalesce(F.col("high") > F.col("next_low"), F.lit(False)))


def bands(value: Column, cuts: list[tuple[float, str]], rest: str) -> Column:
    """Label of the first cut above the absolute value."""
    out = F.lit(rest)
    for cut, name in reversed(cuts):
        out = F.when(F.abs(value) < cut, F.lit(name)).otherwise(out)
    return out


def first_reason(reasons: list[tuple[str, Column]]) -> Column:
    """The first reason whose condition holds; null for rows to keep."""
    return F.coalesce(*[F.when(c, F.lit(n)) for n, c in reasons], F.lit(None).cast("string"))


def all_reasons(reasons: list[tuple[str, Column]]) -> Column:
    """Every reason that holds, in order, without repeats."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in reasons])))


def category(reason: Column, prefixes: list[tuple[str, str]], rest: str = "other") -> Column:
    """A stable category by a reason's prefix."""
    out = F.lit(rest)
    for prefix, name in reversed(prefixes):
        out = F.when(reason.startswith(prefix), F.lit(name)).otherwise(out)
    return out


def split_ledger(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(kept rows, held rows with their reason)."""
    tagged = df.withColumn("reason", reason)
    return tagged.filter("reason is null").drop("reason"), tagged.filter("reason is not null")


def ledger(df: DataFrame, by: str, reason: str = "reason") -> DataFrame:
    """Counts by source and reason, per source, per reason and in all (grouping sets)."""
    status = F.coalesce(F.col(reason), F.lit("kept"))
    out = df.withColumn("status", status).cube(by, "status").agg(F.count("*").alias("n"))
    return out.select(F.coalesce(by, F.lit("*")).alias(by), F.coalesce("status", F.lit("*")).alias("status"), "n")


def thin(df: DataFrame, share: Column, seed: int, salt: str, *ids: str) -> DataFrame:
    """Keep each row with its probability ``share``, by the row's hash."""
    return df.filter(u01(seed, salt, *ids) < share)


def thin_large(df: DataFrame, value: Column, limit: float, keep: float, seed: int, salt: str, *ids: str) -> DataFrame:
    """Keep rows up to the limit, and larger ones with probability ``keep``."""
    return df.filter((F.abs(value) <= limit) | (u01(seed, salt, *ids) < keep))


def thin_classes(df: DataFrame, cls: str, rates: DataFrame, cap: float, factor: float, seed: int, salt: str, *ids: str) -> DataFrame:
    """Flatten a class distribution: probability least(1, factor * cap / rate) from a rate table (class, rate)."""
    at = df.join(rates, cls)  # broadcast by its size alone
    return thin(at, F.least(F.lit(1.0), F.lit(factor * cap) / F.col("rate")), seed, salt, *ids).drop("rate")


def running_cap(df: DataFrame, cls: str, seq: str, per: float, cap: float) -> DataFrame:
    """Rows whose rank in their class stays within ``ceil(cap * seq / per)``; rejected rows use up rank (the stateless form)."""
    w = Window.partitionBy(cls).orderBy(seq)
    return df.withColumn("class_rank", F.row_number().over(w)).filter(F.col("class_rank") <= F.ceil(F.lit(cap) * F.col(seq) / F.lit(per)))


def running_cap_exact(df: DataFrame, cls: str, seq: str, per: float, cap: float) -> DataFrame:
    """Rows accepted by a running cap in which only accepted rows count.  Classes are
    independent; within one, rows stream in order through a fold over (class, seq)."""
    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(seq, kind="stable")
        kept, keep = 0, []
        for s in pdf[seq]:
            ok = kept < -(-cap * s // per)
            kept += ok
            keep.append(bool(ok))
        return pdf[keep]

    narrow = df.select(cls, seq)
    return narrow.groupBy(cls).applyInPandas(fold, narrow.schema)


def near_mate(df: DataFrame, game: str, ply: str, mates: Column, near: int) -> DataFrame:
    """Rows among the last ``near`` plies of games whose last row satisfies ``mates``."""
    last = df.groupBy(game).agg(F.max(ply).alias("__last"), F.max_by(mates, ply).alias("__mates"))
    at = df.join(last.filter("__mates"), game)
    return at.filter(F.col(ply) > F.col("__last") - near).drop("__last", "__mates")


def leftover_marks(text: Column, tokens: str = r"<[A-Za-z0-9_]+>", around: int = 24, most: int = 8) -> Column:
    """The contexts of every ``<>{}`` character that remains once known tokens are taken out:
    distinct, in order, line breaks as ``\\n``, the first ``most``."""
    bare = F.regexp_replace(text, tokens, "")
    parts = F.split(bare, "[<>{}]", -1)
    numbers = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda k: k < F.size(parts))
    places = F.transform(numbers, lambda k: F.length(F.array_join(F.slice(parts, 1, k), " ")) + 1)
    begin = lambda i: F.greatest(i - around, F.lit(1))
    near = F.transform(places, lambda i: F.replace(F.substring(bare, begin(i), i + around + 1 - begin(i)), F.lit("\n"), F.lit("\\n")))
    return F.slice(F.array_sort(F.array_distinct(near)), 1, most)


def unknown_tokens(text: Column, known: list[str], pattern: str = r"<[A-Za-z0-9_]+>") -> Column:
    """Tokens outside the vocabulary, each once."""
    return F.array_except(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array(*[F.lit(k) for k in known]))


def eligible(df: DataFrame, moves: str, kind: str, least: int = 15, motifs: str | None = None) -> DataFrame:
    """Rows with enough context, or of kind puzzle; with ``motifs`` also a non-empty motif list."""
    ok = (F.size(moves) >= least) | (F.col(kind) == "puzzle")
    if motifs:
        ok = ok & F.exists(motifs, lambda m: m.isNotNull())
    return df.filter(ok)


def unseen(df: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not among the seen ones."""
    return df.join(seen.select(*key).distinct(), key, "left_anti")
