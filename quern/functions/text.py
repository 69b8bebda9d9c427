"""String functions: sections, answers, tokens, prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Section names of an analysis text.
SECTIONS = ["ANALYSIS", "BEST_MOVE", "CRITICAL_LINE", "PROMISING_MOVES", "EVALUATION"]


def section_map(text: Column, names: list[str] = SECTIONS) -> Column:
    """Section name to its trimmed body; the last of repeated sections wins."""
    head = "|".join(names)
    pattern = F.lit(rf"(?ms)^({head}):[ \t]*(.*?)(?=^(?:{head}):|\z)")
    keys = F.regexp_extract_all(text, pattern, F.lit(1))
    bodies = F.transform(F.regexp_extract_all(text, pattern, F.lit(2)), lambda b: F.regexp_replace(b, r"^\s+|\s+$", ""))
    entries = F.arrays_zip(keys.alias("k"), bodies.alias("v"))
    last = F.filter(F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("k"), F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"].alias("v"))), lambda e: e["k"].isNotNull())
    return F.map_from_entries(last)


def replace_section(text: Column, name: str, body: Column, names: list[str] = SECTIONS) -> Column:
    """The text with one section's body replaced."""
    head = "|".join(names)
    safe = F.replace(F.replace(body, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return F.regexp_replace(text, F.lit(rf"(?ms)^{name}:.*?(?=^(?:{head}):|\z)"), F.concat(F.lit(f"{name}: "), safe, F.lit("\n")))


def final_answer(text: Column) -> Column:
    """What follows the last blank line, trimmed."""
    return F.trim(F.element_at(F.split(text, "\n\n"), -1))


def after_tag(text: Column, tag: str = "</think>") -> Column:
    """What follows the first closing tag, or the text itself."""
    at = F.instr(text, tag)
    return F.trim(F.when(at > 0, F.substring(text, at + F.lit(len(tag)), F.length(text))).otherwise(text))


def oxford(items: Column, word: str = "and") -> Column:
    """a; a and b; a, b, and c."""
    n = F.size(items)
    most = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", ")
    last = F.element_at(items, -1)
    return F.when(n <= 0, "").when(n == 1, F.get(items, F.lit(0))).when(n == 2, F.concat(F.get(items, F.lit(0)), F.lit(f" {word} "), last)).otherwise(F.concat(most, F.lit(f", {word} "), last))


def with_count(token: Column, n: Column) -> Column:
    """Token with a count suffix where the count exceeds one."""
    return F.concat(token, F.when(n > 1, n.cast("string")).otherwise(""))


def pad_right(ids: Column, size: int, pad: int) -> Column:
    """An id list cut or padded to a constant length."""
    cut = F.slice(ids, 1, size)
    return F.concat(cut, F.array_repeat(F.lit(pad), F.greatest(F.lit(size) - F.size(cut), F.lit(0))))


def mask(ids: Column, size: int) -> Column:
    """Attention mask of ``pad_right``."""
    n = F.least(F.size(ids), F.lit(size))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.greatest(F.lit(size) - n, F.lit(0))))


def label_mask(ids: Column, prompt: Column, ignore: int = -100) -> Column:
    """Labels with the prompt's span masked."""
    return F.concat(F.array_repeat(F.lit(ignore), F.least(prompt, F.size(ids))), F.slice(ids, F.least(prompt, F.size(ids)) + 1, F.size(ids)))


def bytes_of(*columns: str) -> Column:
    """Sum of the byte lengths, nulls as none."""
    out = F.lit(0)
    for c in columns:
        out = out + F.coalesce(F.octet_length(F.col(c)), F.lit(0))
    return out


def first_of(*names: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(n.cast("string")) != "", n.cast("string")) for n in names])


def as_list(text: Column) -> Column:
    """Words of a scalar as a list; empty for null and blank."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"\s+"))


_SIDED = r"<SQUARE_[0-9]+>|<PIECE_[MO][PNBRQK]>|\bplayer\b|\bopponent\b"


def reanchor(text: Column) -> Column:
    """The same statement seen from the other side: squares mirrored, mine and opponent's swapped."""
    tokens = F.regexp_extract_all(text, F.lit(f"({_SIDED})"), F.lit(1))
    gaps = F.split(text, _SIDED, -1)

    def turn(t: Column) -> Column:
        n = F.regexp_extract(t, r"(\d+)", 1).cast("int")
        mirrored = F.concat(F.lit("<SQUARE_"), ((n - 1).bitwiseXOR(F.lit(56)) + 1).cast("string"), F.lit(">"))
        piece = F.concat(F.lit("<PIECE_"), F.when(F.substring(t, 8, 1) == "M", "O").otherwise("M"), F.substring(t, 9, 2))
        word = F.when(t == "player", "opponent").otherwise("player")
        return F.when(t.startswith("<SQUARE_"), mirrored).when(t.startswith("<PIECE_"), piece).otherwise(word)

    turned = F.transform(tokens, turn)
    pieces = F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(turned, i), F.lit(""))))
    return F.array_join(pieces, "")
