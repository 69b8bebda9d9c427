"""Win rates, verdict bands and evaluation strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Slope of the logistic win rate per centipawn, mate threshold.
SLOPE = 0.00368208
MATE = 99000


def win_rate(cp: Column) -> Column:
    """0 to 1, exponent clamped to +-60."""
    return 1 / (1 + F.exp(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), -F.lit(SLOPE) * cp))))


def win_percent(cp: Column) -> Column:
    """0 to 100, centipawns clamped to +-1500."""
    c = F.greatest(F.lit(-1500.0), F.least(F.lit(1500.0), cp.cast("double")))
    return 50 + 50 * (2 / (1 + F.exp(-F.lit(SLOPE) * c)) - 1)


# The verdict phrases and the least pawns of each.
VERDICTS = {
    "winning": 4.0,
    "much better-to-winning": 2.5,
    "much better": 1.5,
    "better-to-much better": 1.0,
    "better": 0.6,
    "slightly better-to-better": 0.3,
    "slightly better": 0.1,
}


def verdict(pawns: Column, mate: Column | bool = False) -> Column:
    """``side is phrase`` of an evaluation in pawns for white; a mate is winning; null below the least band."""
    phrase = F.when(F.lit(mate) if isinstance(mate, bool) else mate, "winning")
    for name, least in VERDICTS.items():
        phrase = phrase.when(F.abs(pawns) >= least, name)
    return F.concat(F.when(pawns >= 0, "white").otherwise("black"), F.lit(" is "), phrase)


def verdict_value(text: Column) -> Column:
    """Pawns for white that a verdict text stands for: the middle of the band of the longest phrase it
    holds, 5 for ``winning``; 0 without a phrase or without a side in front."""
    tops = dict(zip(list(VERDICTS)[1:], VERDICTS.values(), strict=False))
    t = F.lower(text)
    size = F.lit(0.0)
    for name in sorted(VERDICTS, key=len):  # the longest is asked for first
        size = F.when(t.contains(name), (VERDICTS[name] + tops[name]) / 2 if name in tops else 5.0).otherwise(size)
    return F.when(t.rlike(r"^\s*white"), size).when(t.rlike(r"^\s*black"), -size).otherwise(0.0)


def show_evaluation(cp: Column) -> Column:
    """``mate`` beyond the threshold, else pawns with sign and two digits."""
    return F.when(F.abs(cp) >= MATE, F.concat(F.when(cp > 0, "+").otherwise("-"), F.lit("mate"))).otherwise(F.format_string("%+.2f", cp / 100.0))


def parse_evaluation(text: Column) -> Column:
    """struct(kind, pawns for white, method) of an evaluation line: a mate or its first number.

    The perspective is the side that is named as better off, else the side a number is given
    for, else white's.
    """
    t = F.lower(text)
    number = F.regexp_extract(t, r"([+-]?\d+(?:\.\d+)?)", 1)
    is_mate = t.contains("mate")
    black = t.rlike(r"black (?:is |has |stands )?(?:slightly |much |clearly )?(?:better|winning|ahead|mates|an? (?:edge|advantage))|favou?rs black|for black")
    white = t.rlike(r"white (?:is |has |stands )?(?:slightly |much |clearly )?(?:better|winning|ahead|mates|an? (?:edge|advantage))|favou?rs white|for white")
    signed = number.startswith("+") | number.startswith("-")
    value = F.when(number != "", number.cast("double"))
    pawns = F.when(is_mate, F.when(black, -100.0).otherwise(100.0)).when(signed, F.when(black & ~white & number.startswith("+") & t.contains("for black"), -value).otherwise(value)).when(black & ~white, -value).otherwise(value)
    method = F.when(black & ~white, "black").when(white & ~black, "white").otherwise("default")
    return F.struct(F.when(is_mate, "mate").when(number != "", "number").otherwise(F.lit(None)).alias("kind"), pawns.alias("pawns"), method.alias("method"))


def lookahead_order(root_sign: Column, distance: Column) -> Column:
    """Mates compare by side, then nearer first for the winner."""
    return F.struct(root_sign.alias("sign"), (-root_sign * distance).alias("near"))


def truncating_div(a: Column, b: Column) -> Column:
    """Integer division toward zero."""
    return F.when(b != 0, F.floor(F.abs(a) / F.abs(b)) * F.signum(a * b)).cast("long")


def phase_value(mg: Column, eg: Column, phase: Column, whole: int = 128) -> Column:
    """Interpolation between middle and end game, truncating."""
    return truncating_div(mg * phase + eg * (whole - phase), F.lit(whole))


def mirror(square: Column) -> Column:
    """The square seen from the other side."""
    return square.bitwiseXOR(F.lit(56))


def distance(a: Column, b: Column) -> Column:
    """King moves between two squares."""
    df = F.abs(a.bitwiseAND(F.lit(7)) - b.bitwiseAND(F.lit(7)))
    dr = F.abs(F.shiftright(a, 3) - F.shiftright(b, 3))
    return F.greatest(df, dr)
