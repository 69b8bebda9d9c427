"""Samplers, mixers and splitters.  Ranks come from md5 keys, so every pick is
reproducible on any partitioning; counts that reach the driver are one per group."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_long, rank_key, u01
from .filters import SpecError
from .ranking import global_hash_rank, top_per_group


class Shortfall(ValueError):
    """A stratum holds fewer rows than were asked for."""


def group_sample(df: DataFrame, group: list[str], k: int, seed: int, salt: str, *ids: str) -> DataFrame:
    """``min(available, k)`` rows of each group without replacement."""
    return top_per_group(df, group, [rank_key(seed, salt, *ids)], k)


def stratified(df: DataFrame, stratum: str, quotas: dict[str, int], seed: int, salt: str, *ids: str) -> DataFrame:
    """A fixed-size reservoir for each stratum of the quota table."""
    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    w = Window.partitionBy(stratum).orderBy(rank_key(seed, salt, *ids))
    some = df.filter(F.col(stratum).isin(list(quotas))).withColumn("__rn", F.row_number().over(w))
    return some.filter(F.col("__rn") <= F.element_at(quota, F.col(stratum))).drop("__rn")


def shortfalls(df: DataFrame, stratum: str, quotas: DataFrame) -> DataFrame:
    """stratum, wanted, available, short of every stratum of the quota table (stratum, wanted)."""
    have = df.groupBy(stratum).agg(F.count("*").alias("available"))
    at = quotas.join(have, stratum, "left").withColumn("available", F.coalesce("available", F.lit(0)))
    return at.select(stratum, "wanted", "available", F.greatest(F.col("wanted") - F.col("available"), F.lit(0)).alias("short"))


def require_quotas(df: DataFrame, stratum: str, quotas: dict[str, int]) -> None:
    table = df.sparkSession.createDataFrame(list(quotas.items()), f"{stratum} string, wanted long")
    bad = shortfalls(df, stratum, table).filter("short > 0").collect()  # a row per stratum
    if bad:
        raise Shortfall("; ".join(f"{r[stratum]}: {r['available']} of {r['wanted']}" for r in bad))


def class_priority(df: DataFrame, group: str, forced: Column, rare: Column, coin: float, k: int, seed: int, *ids: str) -> DataFrame:
    """Forced rows all, rare rows by a coin, at most ``k`` common ones of each group; ``picked`` says why."""
    label = F.when(forced, "forced").when(rare, "rare").otherwise("common")
    at = df.withColumn("picked", label)
    rest = group_sample(at.filter("picked = 'common'"), [group], k, seed, "common", *ids)
    some = at.filter("picked = 'rare'").filter(u01(seed, "coin", *ids) < coin)
    return reduce(DataFrame.unionByName, [at.filter("picked = 'forced'"), some, rest])


def quota_of_plies(df: DataFrame, group: str, ply: str, share: int = 10) -> DataFrame:
    """group, quota: a tenth of the distinct plies, rounded up."""
    return df.groupBy(group).agg(F.ceil(F.count_distinct(ply) / share).cast("long").alias("quota"))


def mistakes_and_quota(df: DataFrame, group: str, ply: str, mistake: Column, large: Column, part: int, seed: int, *ids: str) -> DataFrame:
    """All mistakes; a ``part``-th (rounded up) of the large rows of each group; others up to the group's quota."""
    quotas = quota_of_plies(df, group, ply)
    at = df.withColumn("stratum", F.when(mistake, "mistake").when(large, "large").otherwise("common"))
    w = Window.partitionBy(group, "stratum")
    at = at.withColumn("__n", F.count("*").over(w)).withColumn("__rn", F.row_number().over(w.orderBy(rank_key(seed, "pick", *ids))))
    at = at.join(quotas, group)
    keep = (F.col("stratum") == "mistake") | ((F.col("stratum") == "large") & (F.col("__rn") <= F.ceil(F.col("__n") / part))) | ((F.col("stratum") == "common") & (F.col("__rn") <= F.col("quota")))
    return at.filter(keep).drop("__n", "__rn", "quota")


def fill_groups(df: DataFrame, key: str, groups: list[tuple[str, Column, int]], seed: int, *ids: str) -> DataFrame:
    """Quota groups filled in order; a key that several groups could take goes to the first of them."""
    name = F.coalesce(*[F.when(c, F.lit(n)) for n, c, _ in groups])
    place = F.coalesce(*[F.when(c, F.lit(k)) for k, (_, c, _) in enumerate(groups)])
    at = df.withColumn("group_name", name).withColumn("__place", place).filter("group_name is not null")
    first = at.groupBy(key).agg(F.min_by(F.struct(*at.columns), F.struct(F.col("__place"), rank_key(seed, "fill", *ids))).alias("__r")).select("__r.*")
    return stratified(first.drop("__place"), "group_name", {n: q for n, _, q in groups}, seed, "fill", *ids)


def greedy_labels(df: DataFrame, key: str, labels: str, each: int, seed: int) -> DataFrame:
    """Greedy multi-label cover: again and again the least covered label takes the candidate whose
    labels are least covered in sum, then the one with more labels, then the least key, until each
    label has ``each`` rows or none is left.

    All rows compete.  Rows with the same labels differ by key only, and once ``each`` of them are
    taken all their labels have enough, so the fold gets the least ``each`` keys of each distinct set
    of labels and gives what it would give over the whole table.  Nothing is drawn, so ``seed`` has
    no effect.  Returns key, ``pick`` order.
    """
    import pandas as pd

    sets = df.select(key, F.array_sort(F.array_distinct(labels)).alias("__labels")).filter(F.size("__labels") > 0).distinct()
    # in buckets first, so a set that most rows share is trimmed by many tasks
    some = top_per_group(sets.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(16))), ["__labels", "__bucket"], [F.col(key)], each)
    pool = top_per_group(some, ["__labels"], [F.col(key)], each).select(key, "__labels")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        queues: dict[tuple, list] = {}
        for k, v in sorted(zip(pdf[key], pdf["__labels"], strict=True), key=lambda r: r[0], reverse=True):
            queues.setdefault(tuple(v), []).append(k)
        cover = {x: 0 for v in queues for x in v}
        out = []
        while queues:
            needy = [x for x in sorted(cover, key=lambda x: (cover[x], x)) if cover[x] < each]
            pick = None
            for x in needy:
                able = [v for v in queues if x in v]
                if able:
                    pick = min(able, key=lambda v: (sum(cover[y] for y in v), -len(v), queues[v][-1]))
                    break
            if pick is None:
                break
            out.append(queues[pick].pop())
            if not queues[pick]:
                del queues[pick]
            for y in pick:
                cover[y] += 1
        return pd.DataFrame({key: pd.Series(out, dtype=pdf[key].dtype), "pick": range(1, len(out) + 1)})

    kind = dict(df.dtypes)[key]
    return pool.withColumn("__one", F.lit(0)).groupBy("__one").applyInPandas(fold, f"{key} {kind}, pick long")


def interleave(df: DataFrame, stream: str, order: str, weights: dict[str, float]) -> DataFrame:
    """Deadline form of weighted interleaving: the k-th row of a stream is due at (k - 0.5) / weight."""
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    k = F.row_number().over(Window.partitionBy(stream).orderBy(order))
    at = df.filter(F.col(stream).isin(list(weights))).withColumn("ordinal", k)
    return at.withColumn("due", (F.col("ordinal") - 0.5) / F.element_at(weight, F.col(stream)))


def smooth_round_robin(streams: dict[str, list], weights: dict[str, float]) -> list[tuple[str, int]]:
    """Smooth weighted round-robin with dedup: (stream, ordinal from 1) in order.

    After n turns a stream is owed n times its share of the weights less what it gave; the one
    that is owed most after the next turn gives next, the first of ties.  ``None`` rows are always
    new, others must not have come from any stream; a stream without a new row leaves, and what the
    others are owed stays as it is.
    """
    import numpy as np

    taken: set = set()

    def new_rows(rows: list) -> Iterator[int]:
        for ordinal, row in enumerate(rows, 1):
            if row is None or row not in taken:
                if row is not None:
                    taken.add(row)
                yield ordinal

    names = np.array(list(weights), object)
    share = np.array([float(weights[s]) for s in names])
    supply = [new_rows(streams.get(s, [])) for s in names]
    owed, active, out = np.zeros(len(names)), np.ones(len(names), bool), []
    while active.any():
        owed += np.where(active, share, 0.0)
        turn = int(np.argmax(np.where(active, owed, -np.inf)))
        owed[turn] -= share[active].sum()
        ordinal = next(supply[turn], None)
        if ordinal is None:
            active[turn] = False
        else:
            out.append((str(names[turn]), ordinal))
    return out


def interleave_exact(df: DataFrame, stream: str, order: str, weights: dict[str, float], key: Column | None = None) -> DataFrame:
    """Rows with their ``position`` under smooth weighted round-robin, each key once over all
    streams: the fold runs over (stream, ordinal, key digest) only, one task, then joins back."""
    import pandas as pd

    k = F.row_number().over(Window.partitionBy(stream).orderBy(order))
    at = df.filter(F.col(stream).isin(list(weights))).withColumn("ordinal", k.cast("long"))
    digest = F.lit(None).cast("string") if key is None else F.md5(key.cast("string"))
    narrow = at.select(F.col(stream).alias("s"), "ordinal", digest.alias("k"), F.lit(0).alias("one"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = {s: [None if pd.isna(x) else x for x in g.sort_values("ordinal")["k"]] for s, g in pdf.groupby("s")}
        seq = smooth_round_robin(rows, weights)
        return pd.DataFrame({stream: [s for s, _ in seq], "ordinal": [o for _, o in seq], "position": range(1, len(seq) + 1)})

    slots = narrow.groupBy("one").applyInPandas(fold, f"{stream} string, ordinal long, position long")
    return at.join(slots, [stream, "ordinal"])


def anchor_mix(df: DataFrame, source: str, shares: dict[str, float], seed: int, *ids: str) -> DataFrame:
    """Proportional mix: the source with the greatest share (first of ties) whole, of each other
    ``bround(n_anchor * share / share_anchor)`` hash-ranked rows; an error if one is too small."""
    anchor = max(shares, key=lambda s: shares[s])
    have = {r[0]: r[1] for r in df.filter(F.col(source).isin(list(shares))).groupBy(source).count().collect()}  # a row per source
    base = have.get(anchor, 0)
    targets = {s: base if s == anchor else round(base * p / shares[anchor]) for s, p in shares.items()}
    for s, n in targets.items():
        if have.get(s, 0) < n:
            raise Shortfall(f"{s}: {have.get(s, 0)} of {n}")
    return stratified(df, source, targets, seed, "mix", *ids)


def random_interleave(a: DataFrame, b: DataFrame, order: str, seed: int) -> DataFrame:
    """Two streams merged at random, each in its own order: slots are labelled by a shuffled
    label list and rows join on (label, ordinal)."""
    both = a.withColumn("stream", F.lit("a")).unionByName(b.withColumn("stream", F.lit("b")))
    own = both.withColumn("ordinal", F.row_number().over(Window.partitionBy("stream").orderBy(order)))
    slots = own.select(F.col("stream").alias("slot_stream"), F.col("ordinal").alias("slot_ordinal"))
    ranked = global_hash_rank(slots, rank_key(seed, "slots", "slot_stream", "slot_ordinal"), "position")
    again = ranked.withColumn("k", F.row_number().over(Window.partitionBy("slot_stream").orderBy("position"))).select(F.col("slot_stream").alias("stream"), F.col("k").alias("ordinal"), "position")
    return own.join(again, ["stream", "ordinal"])


def holdout(df: DataFrame, n: int, seed: int, salt: str, *ids: str) -> DataFrame:
    """A hold-out of exactly ``n`` rows (all, if fewer)."""
    return df.withColumn("__k", rank_key(seed, salt, *ids)).orderBy("__k").limit(n).drop("__k")


def shuffled_slices(df: DataFrame, cuts: list[tuple[str, int]], rest: str, seed: int, salt: str, *ids: str) -> DataFrame:
    """One shuffle, cut into named slices of the given sizes; ``slice`` names each row's."""
    at = global_hash_rank(df, rank_key(seed, salt, *ids), "__rn")
    out, upto = F.lit(rest), sum(n for _, n in cuts)
    for name, n in reversed(cuts):
        out = F.when(F.col("__rn") <= upto, F.lit(name)).otherwise(out)
        upto -= n
    return at.withColumn("slice", out).drop("__rn")


def log_uniform(low: float, high: float, u: Column) -> Column:
    """An integer whose logarithm is uniform between the bounds."""
    return F.round(F.exp(F.log(F.lit(float(low))) + u * (F.log(F.lit(float(high))) - F.log(F.lit(float(low)))))).cast("long")


def uniform_upto(low: int, high: int, room: Column, u: Column) -> Column:
    """A uniform integer in [low, least(high, room)]; null where there is no room."""
    top = F.least(F.lit(high), room)
    return F.when(top >= low, F.floor(u * (top - low + 1)) + low)


def exponential_key(weight: Column, u: Column) -> Column:
    """The least key of a group is a draw with probability proportional to the weight."""
    return -F.log(F.greatest(u, F.lit(1e-300))) / weight


def weighted_choice(df: DataFrame, group: list[str], weight: Column, seed: int, salt: str, *ids: str) -> DataFrame:
    """One row of each group, drawn in proportion to its weight."""
    at = df.withColumn("__key", exponential_key(weight, u01(seed, salt, *ids)))
    return top_per_group(at, group, [F.col("__key"), *[F.col(i) for i in ids]], 1).drop("__key")


def inverse_frequency_choice(df: DataFrame, group: list[str], cls: str, seed: int, salt: str, *ids: str) -> DataFrame:
    """One row of each group with weights 1 / (class frequency * class multiplicity in the group)."""
    freq = df.groupBy(cls).agg(F.count("*").alias("__f"))
    at = df.join(freq, cls).withColumn("__m", F.count("*").over(Window.partitionBy(*group, cls)))
    return weighted_choice(at, group, 1 / (F.col("__f") * F.col("__m")), seed, salt, *ids).drop("__f", "__m")


def pick_template(key: str | Column, n: int) -> Column:
    """Index of a template by the first byte of the key's md5."""
    c = F.col(key) if isinstance(key, str) else key
    return (hash_long(F.md5(c.cast("string")), 2) % n).cast("int")


def cumulative_cut(df: DataFrame, group: list[str], p: str, mass: float, *ties: str) -> DataFrame:
    """Rows by falling probability until the mass before a row reaches ``mass``."""
    w = Window.partitionBy(*group).orderBy(F.desc(p), *ties).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__c", F.sum(p).over(w) - F.col(p)).filter(F.col("__c") < mass).drop("__c")


def hash_split(df: DataFrame, shares: list[tuple[str, float]], seed: int, salt: str, *ids: str) -> DataFrame:
    """``split`` of each row by its hash; shares sum to one, the last takes the rest."""
    total = sum(s for _, s in shares)
    if abs(total - 1) > 1e-9:
        raise SpecError("shares must sum to one")
    u, out, upto = u01(seed, salt, *ids), F.lit(shares[-1][0]), total
    for name, share in reversed(shares[:-1]):
        upto = sum(s for n, s in shares[: [x for x, _ in shares].index(name) + 1])
        out = F.when(u < upto, F.lit(name)).otherwise(out)
    return df.withColumn("split", out)
