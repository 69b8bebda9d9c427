"""Rewrites between side-relative tokens, absolute tokens and human prose.

Side-relative: ``<SQUARE_1>`` to ``<SQUARE_64>`` counted from the mover's first rank, ``<PIECE_MN>``
for the mover's, ``<PIECE_ON>`` for the other side's, ``<PLAYER>`` and ``<OPPONENT>``.  Absolute:
``<SQUARE_E4>``, ``<WHITE_KNIGHT>``, ``<WHITE>``, ``<FILE_E>``, ``<RANK_4>``, ``<DIAGONAL_A1_H8>``.
``white`` tells whether white is the mover.  All are expressions: a text is cut at a pattern's matches,
each match is rewritten, and the pieces are put together again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the piece letters, of the ranks.
PIECES = {"P": "PAWN", "N": "KNIGHT", "B": "BISHOP", "R": "ROOK", "Q": "QUEEN", "K": "KING"}
RANKS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth"]

_SQ, _PC = r"<SQUARE_(\d+)>", r"<PIECE_([MO])([PNBRQK])>"
_ABS = r"<SQUARE_([A-H][1-8])>"


def rewritten(text: Column, pattern: str, fn: Callable[[Column], Column]) -> Column:
    """``text`` with each match of ``pattern`` replaced by ``fn`` of it."""

    def whole(t: Column) -> Column:
        gaps = F.split(t, pattern, -1)
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        return F.concat(F.get(gaps, F.lit(0)), F.array_join(F.transform(found, lambda m, i: F.concat(fn(m), F.get(gaps, i + 1))), ""))

    return F.get(F.transform(F.array(text), whole), F.lit(0))  # the text is evaluated once


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def square_name(number: Column, white: Column) -> Column:
    """``e4`` for a side-relative number from 1."""
    at = number.cast("int") - 1
    at = F.when(white, at).otherwise(at.bitwiseXOR(F.lit(56)))
    return F.concat(F.substring(F.lit("abcdefgh"), at % 8 + 1, F.lit(1)), (F.floor(at / 8) + 1).cast("string"))


def square_number(name: Column, white: Column) -> Column:
    """The side-relative number from 1 of a square's name."""
    at = (F.ascii(F.upper(name)) - 65) + 8 * (F.substring(name, 2, 1).cast("int") - 1)
    return F.when(white, at).otherwise(at.bitwiseXOR(F.lit(56))) + 1


def _colour(mark: Column, white: Column, names: tuple[str, str]) -> Column:
    return F.when((mark == "M") == white, names[0]).otherwise(names[1])


def to_human(text: Column, white: Column) -> Column:
    """Side-relative tokens as prose: captures, moves, lines, squares, pieces."""
    group = lambda m, p, k: F.regexp_extract(m, p, k)
    square = lambda m, p, k: square_name(group(m, p, k), white)

    def piece(m: Column, p: str, k: int) -> Column:
        return F.concat(_colour(group(m, p, k), white, ("white", "black")), F.lit(" "), F.lower(_lookup(group(m, p, k + 1), PIECES)))

    take = _PC + _SQ + _PC + _SQ
    move = _PC + _SQ + _SQ
    line = _SQ + _SQ + r"\s*[-–—]?\s*(file|rank|diagonal)"

    def said_line(m: Column) -> Column:
        a, b, kind = square(m, line, 1), square(m, line, 2), group(m, line, 3)
        rank = F.get(F.array(*map(F.lit, RANKS)), F.substring(a, 2, 1).cast("int") - 1)
        plain = F.concat(a, F.lit("-"), b, F.lit(" "), kind)
        on_file, on_rank = (kind == "file") & (F.left(a, F.lit(1)) == F.left(b, F.lit(1))), (kind == "rank") & (F.right(a, F.lit(1)) == F.right(b, F.lit(1)))
        return F.when(on_file, F.concat(F.left(a, F.lit(1)), F.lit("-file"))).when(on_rank, F.concat(rank, F.lit(" rank"))).otherwise(plain)

    out = rewritten(text, take, lambda m: F.concat(piece(m, take, 1), F.lit(" "), square(m, take, 3), F.lit(" takes "), piece(m, take, 4), F.lit(" "), square(m, take, 6)))
    out = rewritten(out, move, lambda m: F.concat(piece(m, move, 1), F.lit(" "), square(m, move, 3), F.lit("-"), square(m, move, 4)))
    out = rewritten(out, line, said_line)
    out = F.regexp_replace(out, "(?<=>)(?=<)", " ")
    out = rewritten(out, _SQ, lambda m: square(m, _SQ, 1))
    out = rewritten(out, _PC, lambda m: piece(m, _PC, 1))
    return F.replace(out, F.lit("<EMPTY>"), F.lit("empty"))


def to_human_sides(text: Column, white: Column) -> Column:
    """As ``to_human``, with the two sides' tokens as White and Black."""
    out = to_human(text, white)
    for token, mark in (("<PLAYER>", "M"), ("<OPPONENT>", "O")):
        out = F.replace(out, F.lit(token), _colour(F.lit(mark), white, ("White", "Black")))
    return out


def _line_token(m: Column, pattern: str) -> Column:
    """The file, rank or diagonal whose end squares a pair names; the pair itself otherwise."""
    a, b = F.regexp_extract(m, pattern, 1), F.regexp_extract(m, pattern, 2)
    file = lambda s: F.ascii(s) - 65
    rank = lambda s: F.substring(s, 2, 1).cast("int") - 1
    across, up = file(b) - file(a), rank(b) - rank(a)
    edge = lambda at, step: F.when(step > 0, at == 7).otherwise(at == 0)
    ends = (F.abs(across) == F.abs(up)) & (across != 0) & (edge(file(b), across) | edge(rank(b), up))
    return (
        F.when((across == 0) & (F.abs(up) == 7), F.concat(F.lit("<FILE_"), F.left(a, F.lit(1)), F.lit(">")))
        .when((up == 0) & (F.abs(across) == 7), F.concat(F.lit("<RANK_"), F.right(a, F.lit(1)), F.lit(">")))
        .when(ends, F.concat(F.lit("<DIAGONAL_"), F.least(a, b), F.lit("_"), F.greatest(a, b), F.lit(">")))
        .otherwise(m)
    )


def to_absolute(text: Column, white: Column) -> Column:
    """Side-relative tokens and the words player and opponent as absolute tokens; end squares as lines."""
    out = rewritten(text, _SQ, lambda m: F.concat(F.lit("<SQUARE_"), F.upper(square_name(F.regexp_extract(m, _SQ, 1), white)), F.lit(">")))
    out = rewritten(out, _PC, lambda m: F.concat(F.lit("<"), _colour(F.regexp_extract(m, _PC, 1), white, ("WHITE", "BLACK")), F.lit("_"), _lookup(F.regexp_extract(m, _PC, 2), PIECES), F.lit(">")))
    for token, word, mark in (("<PLAYER>", "player", "M"), ("<OPPONENT>", "opponent", "O")):
        side = _colour(F.lit(mark), white, ("<WHITE>", "<BLACK>"))
        out = F.regexp_replace(F.replace(out, F.lit(token), side), F.lit(rf"(?i)\b(?:the\s+)?{word}\b"), side)
    pair = _ABS + r"\s*[-–—]\s*" + _ABS
    return rewritten(out, pair, lambda m: _line_token(m, pair))


def to_relative(text: Column, white: Column) -> Column:
    """Absolute tokens as side-relative ones; sides become words, with a capital where a sentence begins."""
    out = F.regexp_replace(text, r"<DIAGONAL_([A-H][1-8])_([A-H][1-8])>", "<SQUARE_$1>-<SQUARE_$2>")
    out = rewritten(out, r"<FILE_([A-H])>", lambda m: _ends(F.substring(m, 7, 1), True))
    out = rewritten(out, r"<RANK_([1-8])>", lambda m: _ends(F.substring(m, 7, 1), False))
    out = rewritten(out, _ABS, lambda m: F.concat(F.lit("<SQUARE_"), square_number(F.regexp_extract(m, _ABS, 1), white).cast("string"), F.lit(">")))
    letters = {v: k for k, v in PIECES.items()}
    piece = r"<(WHITE|BLACK)_(PAWN|KNIGHT|BISHOP|ROOK|QUEEN|KING)>"
    own = lambda m, p: (F.regexp_extract(m, p, 1) == "WHITE") == white
    out = rewritten(out, piece, lambda m: F.concat(F.lit("<PIECE_"), F.when(own(m, piece), "M").otherwise("O"), _lookup(F.regexp_extract(m, piece, 2), letters), F.lit(">")))
    side = r"<(WHITE|BLACK)>"
    out = rewritten(out, side, lambda m: F.when(own(m, side), "the player").otherwise("the opponent"))
    return F.regexp_replace(out, r"(^|[.!?]\s+|\n+)the (player|opponent)\b", "$1The $2")


def _ends(mark: Column, file: bool) -> Column:
    a, b = (F.concat(mark, F.lit("1")), F.concat(mark, F.lit("8"))) if file else (F.concat(F.lit("A"), mark), F.concat(F.lit("H"), mark))
    return F.concat(F.lit("<SQUARE_"), a, F.lit(">-<SQUARE_"), b, F.lit(">"))


def leftovers(text: Column) -> Column:
    """Distinct tokens of a side-relative text that are none of its vocabulary, in order."""
    tags = F.regexp_extract_all(text, F.lit(r"<[^<>\s]+>"), F.lit(0))
    known = r"^<(?:SQUARE_(?:[1-9]|[1-5]\d|6[0-4])|PIECE_[MO][PNBRQK]|PLAYER|OPPONENT|EMPTY)>$"
    return F.array_sort(F.array_distinct(F.filter(tags, lambda t: ~t.rlike(known))))


def kept_moves(text: Column, keep: Column, section: str = "CRITICAL_LINE", move: str = r"(?:<[A-Z]+_[A-Z0-9]+>)+") -> Column:
    """The text with the section's moves cut after the first ``keep``; unchanged if it has no more."""
    body = F.regexp_extract(text, rf"(?ms)^{section}:(.*?)(?=^[A-Z_]+:|\z)", 1)
    moves = F.regexp_extract_all(body, F.lit(move), F.lit(0))
    some = F.concat(F.array_join(F.slice(moves, 1, F.greatest(keep, F.lit(0))), " "), F.lit("\n"))
    at = F.locate(section + ":", text) + len(section)  # the colon
    cut = F.concat(F.substring(text, F.lit(1), at), some, F.substring(text, at + 1 + F.length(body), F.length(text)))
    return F.when(keep < F.size(moves), cut).otherwise(text)
