"""Ordered-prefix and window operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_prefix(df: DataFrame, line: list[str], ply: str, bad: Column) -> DataFrame:
    """Rows before each line's first bad one."""
    cut = F.min(F.when(bad, F.col(ply))).over(Window.partitionBy(*line))
    return df.withColumn("__cut", cut).filter(F.col("__cut").isNull() | (F.col(ply) < F.col("__cut"))).drop("__cut")


def first_blocks(df: DataFrame, line: list[str], ply: str, one: Column, other: Column) -> DataFrame:
    """Per line the earlier of two blocking rows: its ply and which condition held (the first on ties)."""
    at = df.groupBy(*line).agg(F.min(F.when(one, F.col(ply))).alias("__a"), F.min(F.when(other, F.col(ply))).alias("__b"))
    kind = F.when(F.col("__a").isNull() & F.col("__b").isNull(), F.lit(None)).when(F.col("__b").isNull() | (F.col("__a") <= F.col("__b")), "one").otherwise("other")
    return at.withColumn("block_at", F.least("__a", "__b")).withColumn("block_by", kind).drop("__a", "__b")


def label_candidates(df: DataFrame, item: list[str], score: str, tie: str, labels: str = "xyz") -> DataFrame:
    """The best rows of each item, labelled in order."""
    w = Window.partitionBy(*item).orderBy(F.desc(score), tie)
    names = F.array(*[F.lit(c) for c in labels])
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= len(labels)).withColumn("label", F.element_at(names, F.col("place")))


def inject_best(candidates: DataFrame, best: DataFrame, item: list[str], score: str, tie: str, gap: float = 0.05, labels: str = "xyz") -> DataFrame:
    """Candidates, with the item's best move put in where every candidate trails it by ``gap`` or more, ranked and labelled anew."""
    top = candidates.groupBy(*item).agg(F.max(score).alias("__top"))
    extra = best.join(top, item).filter(F.col(score) - F.col("__top") >= gap).drop("__top")
    both = candidates.select(*item, tie, score, F.lit(False).alias("injected")).unionByName(extra.select(*item, tie, score, F.lit(True).alias("injected")))
    return label_candidates(both, item, score, tie, labels)


def fill_to_k(preferred: DataFrame, fillers: DataFrame, item: list[str], move: str, order: str, k: int) -> DataFrame:
    """k distinct moves of each item: preferred ones in order, then ranked fill-ins."""
    both = preferred.withColumn("__tier", F.lit(0)).unionByName(fillers.withColumn("__tier", F.lit(1)))
    once = both.groupBy(*item, move).agg(F.min(F.struct("__tier", order)).alias("__at"))
    w = Window.partitionBy(*item).orderBy("__at", move)
    return once.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select(*item, move, "place")


def coverage(df: DataFrame, group: list[str], share: str, mass: float, tie: str) -> DataFrame:
    """Rows by falling share until the mass before a row reaches ``mass``; ``before`` is that mass."""
    w = Window.partitionBy(*group).orderBy(F.desc(share), tie).rowsBetween(Window.unboundedPreceding, -1)
    at = df.withColumn("before", F.coalesce(F.sum(share).over(w), F.lit(0.0)))
    return at.filter(F.col("before") < mass)


def relative_breadth(df: DataFrame, group: list[str], share: str, followed: Column, cap: int, tie: str) -> DataFrame:
    """Siblings at least as likely as the followed row, at most ``cap``."""
    level = F.max(F.when(followed, F.col(share))).over(Window.partitionBy(*group))
    w = Window.partitionBy(*group).orderBy(F.desc(share), tie)
    return df.withColumn("__level", level).withColumn("place", F.row_number().over(w)).filter((F.col(share) >= F.col("__level")) & (F.col("place") <= cap)).drop("__level")


def previous(df: DataFrame, line: list[str], ply: str, value: str, name: str = "previous") -> DataFrame:
    return df.withColumn(name, F.lag(value).over(Window.partitionBy(*line).orderBy(ply)))


def history(df: DataFrame, line: list[str], ply: str, value: str, size: int = 7, name: str = "history") -> DataFrame:
    """The values of up to ``size`` rows before each row, oldest first."""
    w = Window.partitionBy(*line).orderBy(ply).rowsBetween(-size, -1)
    return df.withColumn(name, F.collect_list(value).over(w))


def repetitions(df: DataFrame, line: list[str], key: list[str], ply: str, name: str = "repetition") -> DataFrame:
    """How often a key stood earlier in the line."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*line, *key).orderBy(ply)) - 1)


def streaks(df: DataFrame, line: list[str], ply: str, flag: Column) -> DataFrame:
    """Maximal runs of consecutive flagged rows: first, last, length."""
    w = Window.partitionBy(*line).orderBy(ply)
    at = df.withColumn("__rn", F.row_number().over(w)).filter(flag)
    at = at.withColumn("__run", F.col("__rn") - F.row_number().over(w))
    return at.groupBy(*line, "__run").agg(F.min(ply).alias("first"), F.max(ply).alias("last"), F.count("*").alias("length")).drop("__run")


def sliding(df: DataFrame, value: str, low: int, high: int) -> DataFrame:
    """Windows of low..high consecutive entries of an array column without a repeated entry: start, size, window."""
    sizes = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("size")
    at = df.select("*", sizes).filter(F.size(value) >= F.col("size"))
    at = at.withColumn("start", F.explode(F.sequence(F.lit(1), F.size(value) - F.col("size") + 1)))
    at = at.withColumn("window", F.slice(value, F.col("start"), F.col("size")))
    return at.filter(F.size(F.array_distinct("window")) == F.col("size"))


def best_leaf(nodes: DataFrame, levels: int) -> DataFrame:
    """Minimax over an edge table (tree, node, parent, ply, value, maximise): each level's values go
    to the parents, deepest first; returns tree, node, value, best (the child that was chosen)."""
    kind = dict(nodes.dtypes)["node"]
    level = lambda ply: nodes.filter(F.col("ply") == ply).select("tree", "node", "parent", "ply", "maximise", "value", F.lit(None).cast(kind).alias("best"))
    below = level(levels)
    out = below
    for ply in range(levels - 1, -1, -1):  # only the new values go up
        child = F.struct("value", "node")
        kids = below.groupBy("tree", F.col("parent").alias("node")).agg(F.max_by("node", F.struct(F.col("value"), -F.col("node"))).alias("__hi"), F.max("value").alias("__hv"), F.min(child).alias("__low"))
        at = level(ply).join(kids, ["tree", "node"], "left")
        best = F.when(F.col("maximise"), F.col("__hi")).otherwise(F.col("__low.node"))
        value = F.coalesce(F.when(F.col("maximise"), F.col("__hv")).otherwise(F.col("__low.value")), F.col("value"))
        below = at.select("tree", "node", "parent", "ply", "maximise", value.alias("value"), best.alias("best"))
        out = out.unionByName(below)
    return out


def root_paths(nodes: DataFrame, depth: int) -> DataFrame:
    """tree, node, path, depth of all nodes (tree, node, parent) that hang on a node 1, one join a level."""
    level = nodes.filter("node = 1").select("tree", "node", F.col("node").cast("string").alias("path"), F.lit(0).alias("depth"))
    out = level
    for k in range(1, depth + 1):
        above = level.select("tree", F.col("node").alias("parent"), F.col("path").alias("__above"))
        level = nodes.join(above, ["tree", "parent"]).select("tree", "node", F.concat_ws("/", "__above", F.col("node").cast("string")).alias("path"), F.lit(k).alias("depth"))
        out = out.unionByName(level)
    return out


def prefixes(df: DataFrame, chain: str) -> DataFrame:
    """A trie as rows: every prefix of the chains, its length and how many chains pass."""
    at = df.filter(F.size(chain) > 0).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(chain)), lambda k: F.slice(chain, 1, k))).alias("prefix"))
    return at.groupBy("prefix").agg(F.count("*").alias("n")).withColumn("depth", F.size("prefix"))


def top_terms(df: DataFrame, group: list[str], delta: str, tie: str, k: int = 3, least: float = 8.0) -> DataFrame:
    """The k largest absolute changes of each group that reach ``least``, or the single largest."""
    w = Window.partitionBy(*group).orderBy(F.desc(F.abs(delta)), tie)
    return df.withColumn("place", F.row_number().over(w)).filter((F.col("place") <= k) & ((F.abs(delta) >= least) | (F.col("place") == 1)))


def alternate(a: DataFrame, b: DataFrame, group: list[str], place: str, pattern: str = "aababb") -> DataFrame:
    """Merge two ranked lists by a pattern of turns; what the pattern leaves follows list a, then b."""
    def slot(which: str) -> Column:
        spots = [k for k, c in enumerate(pattern) if c == which]
        out = F.col(place) + len(pattern) + (0 if which == "a" else 1_000_000)
        for n, k in reversed(list(enumerate(spots, 1))):
            out = F.when(F.col(place) == n, F.lit(k)).otherwise(out)
        return out

    both = a.withColumn("source", F.lit("a")).withColumn("__slot", slot("a")).unionByName(b.withColumn("source", F.lit("b")).withColumn("__slot", slot("b")))
    return both.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy("__slot"))).drop("__slot")


def dominant(df: DataFrame, group: list[str], name: str, value: str, threshold: str) -> DataFrame:
    """Per group the feature whose absolute value is largest in units of its threshold, if it reaches one."""
    size = F.abs(value) / F.col(threshold)
    out = df.groupBy(*group).agg(F.max_by(name, F.struct(size, name)).alias("dominant"), F.max(size).alias("size"))
    return out.filter("size >= 1")
