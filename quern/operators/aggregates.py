"""Aggregations of the evaluation side: roll-ups, rates, ratings, association."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(df: DataFrame, task: str, correct: Column) -> DataFrame:
    """Accuracy per task and over all rows (task null)."""
    return df.rollup(task).agg(F.count("*").alias("n"), F.avg(correct.cast("double")).alias("accuracy"))


def rates(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Several rates over one denominator."""
    return df.agg(F.count("*").alias("n"), *[F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(k) for k, c in flags.items()])


def guarded(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0))


def match_scores(games: DataFrame, opponent: str, score: Column) -> DataFrame:
    """games, points and rate per opponent; the rate is null without a finished game."""
    return games.groupBy(opponent).agg(F.count("*").alias("games"), F.sum(score).alias("points")).withColumn("rate", guarded(F.col("points"), F.col("games").cast("double")))


def expected_score(a: Column, b: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (b - a) / 400))


def elo_grid(matches: DataFrame, target: str, opponent_elo: Column, points: Column, games: Column, low: int = -200, high: int = 3600, step: int = 1, drop: float = 1.92) -> DataFrame:
    """Maximum-likelihood rating on an integer grid per target, first of ties, with the interval of
    grid points within ``drop`` of the maximum.  Likelihood terms are summed per target and grid point."""
    grid = F.explode(F.sequence(F.lit(low), F.lit(high), F.lit(step))).alias("elo")
    rows = matches.groupBy(target, opponent_elo.cast("double").alias("opp")).agg(F.sum(points).alias("p"), F.sum(games).alias("g"))
    at = rows.select(target, "opp", "p", "g", grid).withColumn("e", expected_score(F.col("elo").cast("double"), F.col("opp")))
    ll = at.groupBy(target, "elo").agg(F.round(F.sum(F.col("p") * F.log("e") + (F.col("g") - F.col("p")) * F.log(1 - F.col("e"))), 9).alias("ll"))
    best = ll.groupBy(target).agg(F.max("ll").alias("top"), F.max_by("elo", F.struct(F.col("ll"), -F.col("elo"))).alias("rating"))
    within = ll.join(best, target).filter(F.col("ll") >= F.col("top") - drop)
    return within.groupBy(target).agg(F.first("rating").alias("rating"), F.min("elo").alias("ci_low"), F.max("elo").alias("ci_high"))


def joint_ratings(matches: DataFrame, anchors: dict[str, float], start: float = 1500.0, sweeps: int = 60, low: int = -200, high: int = 3600) -> DataFrame:
    """Joint maximum-likelihood ratings of a match table (a, b, score_a, games): player, rating, ci_low, ci_high.

    All free players move together: each sweep sums, per player and in one aggregation, the points
    beyond expectation and their slope, and takes a damped Newton step, until no rating moves by a
    tenth.  Then the grid gives each one's integer rating and interval against the others' fixed
    ratings.  Anchored players keep theirs.  The driver holds one number a player.
    """
    other = matches.select(F.col("b").alias("player"), F.col("a").alias("foe"), (F.col("games") - F.col("score_a")).alias("points"), "games")
    both = matches.select(F.col("a").alias("player"), F.col("b").alias("foe"), F.col("score_a").alias("points"), "games").unionByName(other)
    pairs = both.groupBy("player", "foe").agg(F.sum("points").alias("points"), F.sum("games").alias("games")).persist()
    spark = matches.sparkSession
    elo = {r[0]: float(anchors.get(r[0], start)) for r in pairs.select("player").distinct().collect()}

    def rated() -> DataFrame:
        return spark.createDataFrame(sorted(elo.items()) or [("", 0.0)], "name string, elo double")

    def opposed() -> DataFrame:
        foes = rated().select(F.col("name").alias("foe"), F.col("elo").alias("foe_elo"))
        return pairs.join(foes, "foe").join(rated().select(F.col("name").alias("player"), "elo"), "player")

    for _ in range(sweeps):
        e = expected_score(F.col("elo"), F.col("foe_elo"))
        sums = opposed().groupBy("player").agg(F.sum(F.col("points") - F.col("games") * e).alias("beyond"), F.sum(F.col("games") * e * (1 - e)).alias("slope"))
        moved = 0.0
        for name, beyond, slope in sums.collect():
            if name not in anchors:
                step = 0.7 * beyond / max(slope * 2.302585092994046 / 400, 1e-9)
                new = min(max(elo[name] + min(max(step, -200.0), 200.0), float(low)), float(high))
                moved, elo[name] = max(moved, abs(new - elo[name])), new
        if moved < 0.1:
            break
    grid = elo_grid(opposed(), "player", F.col("foe_elo"), F.col("points"), F.col("games"), low, high)
    fixed = F.create_map(*[F.lit(x) for kv in anchors.items() for x in kv]) if anchors else F.create_map().cast("map<string,double>")
    known = F.element_at(fixed, F.col("player"))
    out = grid.select("player", *[F.coalesce(known, F.col(c).cast("double")).alias(c) for c in ("rating", "ci_low", "ci_high")])
    return out


def association(df: DataFrame, row: list[str], feature: str, target: Column, support: int = 5) -> DataFrame:
    """Smoothed ratio of a feature's share among target rows to its share among the others,
    each row counting a feature once; features of at least ``support`` target rows."""
    base = df.select(*row, feature, target.alias("__t")).distinct()
    totals = base.select(*row, "__t").distinct().agg(F.sum(F.col("__t").cast("long")).alias("T"), F.sum((~F.col("__t")).cast("long")).alias("N"))
    t, n = totals.first()  # two numbers
    t, n = t or 0, n or 0
    counts = base.groupBy(feature).agg(F.sum(F.col("__t").cast("long")).alias("in_target"), F.sum((~F.col("__t")).cast("long")).alias("in_rest"))
    ratio = ((F.col("in_target") + 0.5) / (t + 1)) / ((F.col("in_rest") + 0.5) / (n + 1))
    return counts.filter(F.col("in_target") >= support).withColumn("ratio", ratio)


def widened_target(df: DataFrame, win: Column, draw: Column, least: float = 0.15) -> tuple[Column, float]:
    """The win flag, or win-or-draw where wins are rarer than ``least``; and the win rate."""
    rate = df.agg(F.avg(win.cast("double"))).first()[0] or 0.0
    return (win if rate >= least else (win | draw)), rate


def top_classes(df: DataFrame, cls: Column, k: int = 40) -> DataFrame:
    """The k most frequent classes, ties by name; each task sends partial counts."""
    return df.groupBy(cls.alias("class")).agg(F.count("*").alias("n")).filter("class is not null").orderBy(F.desc("n"), "class").limit(k)


def label_counts(df: DataFrame, labels: Column) -> DataFrame:
    """Rows per label; a row counts once for each of its labels."""
    return df.select(F.explode(F.array_distinct(labels)).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def nested_counts(df: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Counts over grouping sets; columns outside a set are null, ``grouped`` names the set."""
    parts = []
    names = list(dict.fromkeys(c for s in sets for c in s))
    for s in sets:
        g = df.groupBy(*s).agg(F.count("*").alias("n"))
        parts.append(g.select(*[F.col(c) if c in s else F.lit(None).cast(dict(df.dtypes)[c]).alias(c) for c in names], F.lit("+".join(s)).alias("grouped"), "n"))
    return reduce(DataFrame.unionByName, parts)


def percentiles(df: DataFrame, group: list[str], value: str, points: list[float]) -> DataFrame:
    """n, mean, deviation and exact percentiles."""
    quant = [F.percentile(value, p).alias(f"p{round(100 * p)}") for p in points]
    return df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev(value).alias("sd"), *quant)


def in_every_group(df: DataFrame, group: str, item: str) -> DataFrame:
    """Items that stand in all groups."""
    n = df.select(group).distinct().count()
    return df.groupBy(item).agg(F.count_distinct(group).alias("n_groups")).filter(F.col("n_groups") == n).select(item)


def ordered_in_every_group(df: DataFrame, group: str, item: str, place: str) -> DataFrame:
    """Pairs (first, second) of common items whose order (by last place) is the same in every group."""
    common = df.join(in_every_group(df, group, item), item, "left_semi").groupBy(group, item).agg(F.max(place).alias("at"))
    a = common.select(group, F.col(item).alias("first"), F.col("at").alias("fa"))
    b = common.select(group, F.col(item).alias("second"), F.col("at").alias("sa"))
    both = a.join(b, group).filter("first <> second")
    return both.groupBy("first", "second").agg(F.min(F.col("fa") < F.col("sa")).alias("always")).filter("always").select("first", "second")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` where ``value`` is computed once, even if inner functions read it for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sum_digits(numbers: Column) -> Column:
    """The exact sum, in digits, of numbers given as digit strings of any length."""
    limbs = F.ceil(F.array_max(F.transform(numbers, F.length)) / 9).cast("int")

    def limb(k: Column) -> Column:
        part = lambda c: F.substring(F.lpad(c, 9 * limbs, F.lit("0")), 9 * (limbs - k) - 8, F.lit(9)).cast("long")
        return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, c: a + part(c))

    start = F.struct(F.lit(0).cast("long").alias("carry"), F.lit("").alias("low"))
    total = lambda a, k: limb(k) + a["carry"]
    step = lambda a, k: F.struct(F.floor(total(a, k) / 10**9).alias("carry"), F.concat(F.lpad((total(a, k) % 10**9).cast("string"), 9, "0"), a["low"]).alias("low"))
    return F.aggregate(F.sequence(F.lit(0), limbs - 1), start, step, lambda a: F.regexp_replace(F.concat(a["carry"].cast("string"), a["low"]), "^0+(?=.)", ""))


def multiset(text: Column, token: str = r"<([a-z_0-9]+)>(\d*)") -> Column:
    """Sorted (token, n, beyond) of a text with optional count suffixes; a total beyond a long
    has no ``n`` and stands in ``beyond`` by its digits, which is null otherwise."""
    names = F.regexp_extract_all(text, F.lit(token), F.lit(1)).alias("n")
    found = F.arrays_zip(names, F.regexp_extract_all(text, F.lit(token), F.lit(2)).alias("c"))

    def total(name: Column, mine: Column) -> Column:
        """The entry of a name whose counts are ``mine``."""
        few = F.aggregate(mine, F.lit(0).cast("long"), lambda a, c: a + c.try_cast("long"))
        digits = F.when(F.exists(mine, lambda c: F.length(c) > 9), _sum_digits(mine))
        n = F.when(digits.isNull(), few).otherwise(digits.try_cast("long"))
        return F.struct(name.alias("token"), n.alias("n"), F.when(n.isNull(), digits).alias("beyond"))

    def counted(pairs: Column) -> Column:
        mine = lambda name: F.transform(F.filter(pairs, lambda z: z["n"] == name), lambda z: F.when(z["c"] == "", "1").otherwise(z["c"]))
        return F.transform(F.array_distinct(pairs["n"]), lambda name: _once(mine(name), lambda m: total(name, m)))

    return F.array_sort(_once(found, counted))


def throughput(df: DataFrame, group: list[str], tokens: str, seconds: str, truncated: Column) -> DataFrame:
    """Tokens a second and share of truncated rows, 0 where nothing was timed."""
    out = df.groupBy(*group).agg(F.sum(tokens).alias("tokens"), F.sum(seconds).alias("seconds"), F.count("*").alias("n"), F.sum(truncated.cast("long")).alias("cut"))
    return out.select(*group, "n", F.coalesce(guarded(F.col("tokens"), F.col("seconds")), F.lit(0.0)).alias("per_second"), F.coalesce(guarded(F.col("cut"), F.col("n")), F.lit(0.0)).alias("cut_share"))
