"""Packing training rows: the ordered rejection chain, its ledger, a seeded hold-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import rank_key
from .filters import first_reason

# The reasons in the order in which they are tried.
REASONS = ["duplicate record", "terminal", "validation overlap", "malformed", "unparseable evaluation", "evaluation error", "duplicate position"]


def audited(rows: DataFrame, order: str, record: str, position: Column, terminal: Column, validation: DataFrame | None, malformed: Column, error: Column, limit: float) -> DataFrame:
    """``rows`` with ``reason`` (null to keep).

    A record id counts as seen by its first row even if that is rejected; a position only
    by the first row that is kept.  ``validation`` lists position keys (``key``); ``error``
    is null where the evaluation cannot be read, and rejects at the limit and above.
    """
    at = rows.withColumn("__key", position)
    first = F.row_number().over(Window.partitionBy(record).orderBy(order)) > 1
    at = at.withColumn("__again", F.when(F.col(record).isNotNull(), first).otherwise(False))
    if validation is not None:
        listed = validation.select(F.col("key").alias("__key")).distinct().withColumn("__held", F.lit(True))
        at = at.join(listed, "__key", "left")
    else:
        at = at.withColumn("__held", F.lit(None).cast("boolean"))
    early = first_reason(
        [
            (REASONS[0], F.col("__again")),
            (REASONS[1], terminal),
            (REASONS[2], F.coalesce(F.col("__held"), F.lit(False))),
            (REASONS[3], malformed),
            (REASONS[4], error.isNull()),
            (REASONS[5], error >= limit),
        ]
    )
    at = at.withColumn("reason", early)
    good = F.col("reason").isNull()
    place = F.row_number().over(Window.partitionBy("__key", good).orderBy(order))
    at = at.withColumn("reason", F.when(good & (place > 1), REASONS[6]).otherwise(F.col("reason")))
    return at.select(*rows.columns, "reason")


def ledger(audit: DataFrame, by: str) -> DataFrame:
    """Rows per source and status, kept ones included."""
    return audit.groupBy(by, F.coalesce("reason", F.lit("kept")).alias("status")).agg(F.count("*").alias("n"))


def with_holdout(kept: DataFrame, n: int, seed: int, ident: str) -> DataFrame:
    """``kept`` with ``split``: exactly ``n`` hash-ranked rows for validation, or all of fewer."""
    picked = kept.select(ident).withColumn("__k", rank_key(seed, "holdout", ident)).orderBy("__k").limit(n).select(ident, F.lit("val").alias("split"))
    return kept.join(picked, ident, "left").withColumn("split", F.coalesce("split", F.lit("train")))


# The labels in their order, the reasons to go on.
LABELS = "xyz"
MALFORMED, MISORDERED, OUTSIDE, EXHAUSTED = (
    "child evaluation remained malformed",
    "incorrect inaccurate child ordering",
    "inferred evaluation outside truth limit",
    "child exhausted clean-prefix attempts",
)


def decide(rows: DataFrame, children: str, truth: Column, inferred: Column, sampled: Column, accept: Column, divergence: Column, drop: float, limit: float) -> DataFrame:
    """``rows`` with ``decision``: struct(action, reason, next, selected, new_error, old_error).

    ``children``: array of struct(label, fen, predicted, order, truth, valid); ``order`` compares
    predictions, ``truth`` and ``inferred`` are the root's values, ``sampled`` says whether all children
    were sampled validly, ``accept`` and ``divergence`` judge the proposed line.  In this order: a child
    without a prediction, a chosen child that is truly worse than x by ``drop``, a prediction off the
    truth by ``limit`` and invalid sampling go on from the child at fault (``next``: its fen); else the
    divergence accepts, or the chosen child is gone on from.
    """
    by_label = lambda c: F.struct(F.instr(F.lit(LABELS), c["label"]).alias("place"), c.alias("c"))
    kids = F.transform(F.array_sort(F.transform(children, lambda c: by_label(c))), lambda x: x["c"])
    at = rows.withColumn("__kids", kids)
    first = lambda test: F.get(F.filter("__kids", test), F.lit(0))
    most = lambda key: F.aggregate("__kids", F.get("__kids", F.lit(0)), lambda a, c: F.when(key(c) > key(a), c).otherwise(a))
    at = at.withColumn("__none", first(lambda c: c["predicted"].isNull())).withColumn("__best", F.get("__kids", F.lit(0))).withColumn("__chosen", most(lambda c: c["order"]))
    at = at.withColumn("__off", most(lambda c: F.abs(c["predicted"] - c["truth"]))).withColumn("__invalid", first(lambda c: ~c["valid"]))
    new, old = F.abs(F.col("__chosen.predicted") - truth), F.abs(inferred - truth)
    misordered = (F.col("__chosen.label") != LABELS[0]) & (F.col("__best.truth") - F.col("__chosen.truth") >= drop)

    def go(action: str, reason: Column | str, fen: str | None, told: bool = True) -> Column:
        said = F.lit(reason) if isinstance(reason, str) else reason
        known = lambda c: c if told else F.lit(None)
        following = F.col(fen) if fen else F.lit(None).cast("string")
        return F.struct(F.lit(action).alias("action"), said.alias("reason"), following.alias("next"), known(F.col("__chosen.label")).cast("string").alias("selected"), known(new).cast("double").alias("new_error"), known(old).cast("double").alias("old_error"))

    decision = (
        F.when(F.col("__none").isNotNull(), go("recurse", MALFORMED, "__none.fen", told=False))
        .when(misordered, go("recurse", MISORDERED, "__off.fen"))
        .when(new >= limit, go("recurse", OUTSIDE, "__best.fen"))
        .when(~sampled, go("recurse", EXHAUSTED, "__invalid.fen"))
        .when(accept, go("accept", divergence, None))
        .otherwise(go("recurse", divergence, "__chosen.fen"))
    )
    return at.withColumn("decision", decision).drop("__kids", "__none", "__best", "__chosen", "__off", "__invalid")
