"""Operators on mined lineages and trees: attempts, chosen children, first mistakes, orders and draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import u01
from .ranking import top_per_group
from .sampling import exponential_key


def usable_attempts(attempts: Column, evaluation: str = "evaluation", valid: str = "valid") -> Column:
    """The attempts whose evaluation was read and whose checked prefix is valid, in their order."""
    return F.filter(attempts, lambda a: a[evaluation].isNotNull() & F.coalesce(a[valid], F.lit(False)))


def last_step(trajectory: Column) -> Column:
    """The trajectory's last step; null for none."""
    return F.when(F.size(trajectory) > 0, F.element_at(trajectory, -1))


def chosen_child(children: Column, label: Column, name: str = "label") -> Column:
    """The first child with the label; null if there is none."""
    return F.get(F.filter(children, lambda c: c[name] == label), F.lit(0))


def history_of(own: Column, source: Column, earlier: Column, most: int = 7) -> Column:
    """A step's own history, or else the last ``most`` of the source's history and the earlier positions."""
    joined = F.concat(F.coalesce(source, F.array().cast("array<string>")), earlier)
    tail = F.when(F.size(joined) > most, F.slice(joined, -most, most)).otherwise(joined)
    return F.coalesce(own, tail)


def without_helpers(step: Column, *names: str) -> Column:
    """A struct without its helper fields."""
    return step.dropFields(*names)


def first_mistake(paths: DataFrame, path: list[str], ply: str, before: Column, after: Column, drop: float) -> DataFrame:
    """The shallowest row of each path whose value falls by ``drop`` or more; paths without one give no row."""
    bad = paths.filter(before - after >= drop)
    return top_per_group(bad, path, [F.col(ply)], 1)


def capture_order(victim: Column, attacker: Column) -> Column:
    """Sort key of moves: captures first, dear victims and cheap attackers before others; a capture
    without a victim on its square (in passing) takes a pawn."""
    return F.struct(F.when(attacker.isNull(), 1).otherwise(0).alias("quiet"), F.when(attacker.isNull(), 0).otherwise(attacker - 10 * F.coalesce(victim, F.lit(1))).alias("worth"))


def canonical_order(names: list[str], name: Column, own: Column) -> Column:
    """Sort key of findings: by the place of the name in a fixed order, the mover's before the other side's;
    an unknown name raises."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), name)
    known = F.when(place > 0, place).otherwise(F.raise_error(F.concat(F.lit("unknown name: "), F.coalesce(name, F.lit("null")))).cast("long"))
    return F.struct(known.alias("place"), F.when(own, 0).otherwise(1).alias("side"))


def explored(*turns: DataFrame) -> DataFrame:
    """Union of the paths that several iterations explored, each once."""
    out = turns[0]
    for t in turns[1:]:
        out = out.unionByName(t)
    return out.distinct()


def draw_token(logits: DataFrame, group: list[str], token: str, logit: str, temperature: float, top_k: int, top_p: float, seed: int) -> DataFrame:
    """One token of each group: temperature, then the ``top_k`` largest (ties with the last stay), then the
    nucleus of mass ``top_p``, then a draw in proportion to what is left.  Temperature 0 takes the largest,
    the first token of ties."""
    if temperature == 0:
        return top_per_group(logits, group, [F.desc(logit), F.col(token)], 1).select(*group, token)
    at = logits.withColumn("__s", F.col(logit) / temperature)
    if top_k > 0:
        at = at.withColumn("__k", F.rank().over(Window.partitionBy(*group).orderBy(F.desc("__s")))).filter(F.col("__k") <= top_k).drop("__k")
    whole = Window.partitionBy(*group)
    at = at.withColumn("__e", F.exp(F.col("__s") - F.max("__s").over(whole)))
    if top_p < 1:
        rising = whole.orderBy("__e", F.desc(token)).rowsBetween(Window.unboundedPreceding, 0)
        place = F.row_number().over(whole.orderBy(F.desc("__e"), token))
        at = at.withColumn("__low", F.sum("__e").over(rising) / F.sum("__e").over(whole)).withColumn("__first", place)
        at = at.filter((F.col("__low") > 1 - top_p) | (F.col("__first") == 1))
    at = at.withColumn("__key", exponential_key(F.col("__e"), u01(seed, "draw", *group, token)))
    return top_per_group(at, group, [F.col("__key"), F.col(token)], 1).select(*group, token)


def two_level_choice(rows: DataFrame, group: list[str], changed: str, cls: str, seed: int, ident: str) -> DataFrame:
    """One row of each group: a fair coin takes changed or unchanged rows (what there is, if one kind is
    missing), then a draw inside the bucket gives each class the same weight."""
    first = Window.partitionBy(*group)
    both = rows.withColumn("__some", F.count_if(changed).over(first)).withColumn("__all", F.count("*").over(first))
    heads = u01(seed, "coin", *group) < 0.5
    want = F.when(F.col("__some") == 0, False).when(F.col("__some") == F.col("__all"), True).otherwise(heads)
    kept = both.filter(F.col(changed) == want)
    kept = kept.withColumn("__m", F.count("*").over(Window.partitionBy(*group, cls)))
    kept = kept.withColumn("__key", exponential_key(1.0 / F.col("__m"), u01(seed, "class", ident)))
    return top_per_group(kept, group, [F.col("__key"), F.col(ident)], 1).select(*rows.columns)
