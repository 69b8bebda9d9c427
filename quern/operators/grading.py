"""Graders of generated answers: multisets of tokens, sections, move lists, attacked squares."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import final_answer
from .aggregates import multiset

# The tokens that graders read, each with an optional count, and a piece bound to its square.
TOKEN = r"(<(?:SQUARE|PIECE)_[A-Z0-9]+>|<EMPTY>)(\d*)"
PLACED = r"(<PIECE_[A-Z]+><SQUARE_[A-Z0-9]+>)"


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _sorted_matches(c: Column, pattern: str) -> Column:
    return F.array_sort(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)))


def _head_and_rest(c: Column) -> tuple[Column, Column]:
    """A trimmed text up to its first blank, and what follows it."""
    at = F.instr(c, " ")
    return F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c), F.when(at > 0, F.substring(c, at + 1, F.length(c))).otherwise("")


def _agree(pred: Column, gold: Column, *parts: Callable[[Column], Column]) -> Column:
    """Whether every part of the two final answers is the same; a missing answer is wrong."""
    a, b = _trimmed(final_answer(pred)), _trimmed(final_answer(gold))
    out = F.lit(True)
    for part in parts:
        out = out & part(a).eqNullSafe(part(b))
    return F.coalesce(out & a.isNotNull() & b.isNotNull(), F.lit(False))


def multiset_equal(pred: Column, gold: Column) -> Column:
    """Same tokens with the same counts."""
    return _agree(pred, gold, lambda c: multiset(c, TOKEN))


def anchored_equal(pred: Column, gold: Column) -> Column:
    """The first token must agree, and all tokens as a multiset."""
    return _agree(pred, gold, lambda c: F.regexp_extract(c, TOKEN, 1), lambda c: multiset(c, TOKEN))


def exact_equal(pred: Column, gold: Column) -> Column:
    return _agree(pred, gold, lambda c: c)


def sectioned_equal(pred: Column, gold: Column) -> Column:
    """Four lines, label, pieces, label, pieces: labels agree, each side's pieces as a multiset."""
    lines = lambda c: F.filter(F.transform(F.split(c, "\n"), _trimmed), lambda x: x != "")
    four = lambda c: F.size(lines(c)) == 4
    label = lambda k: lambda c: F.get(lines(c), F.lit(k))
    pieces = lambda k: lambda c: multiset(F.get(lines(c), F.lit(k)), TOKEN)
    whole = four(_trimmed(final_answer(pred))) & four(_trimmed(final_answer(gold)))
    return F.coalesce(whole, F.lit(False)) & _agree(pred, gold, label(0), pieces(1), label(2), pieces(3))


def move_list_equal(pred: Column, gold: Column) -> Column:
    """The queried part before the first blank agrees, and the moves between commas as a multiset."""
    moves = lambda c: F.array_sort(F.filter(F.split(_head_and_rest(c)[1], ","), lambda m: m != ""))
    return _agree(pred, gold, lambda c: _head_and_rest(c)[0], moves)


def sides_equal(pred: Column, gold: Column) -> Column:
    """The queried part agrees; then attackers, a blank and defenders, each as a multiset of placed pieces."""
    rest = lambda c: _head_and_rest(c)[1]
    part = lambda k: lambda c: _sorted_matches(_head_and_rest(rest(c))[k], PLACED)
    return _agree(pred, gold, lambda c: _head_and_rest(c)[0], part(0), part(1))


GRADERS = {"multiset": multiset_equal, "anchored": anchored_equal, "exact": exact_equal, "sectioned": sectioned_equal, "moves": move_list_equal, "sides": sides_equal}
# Which grader each task uses.
TASK_GRADER = {
    "piece_on_square": "anchored",
    "square_of_piece": "anchored",
    "piece_on_file": "multiset",
    "piece_on_rank": "multiset",
    "piece_on_diagonal": "multiset",
    "piece_count": "sectioned",
    "material_count": "exact",
    "piece_moves": "moves",
    "square_attackers": "sides",
    "checking_moves": "moves",
    "capture_moves": "moves",
    "check_parries": "moves",
    "is_checkmate": "exact",
}


def grade(task: Column, pred: Column, gold: Column) -> Column:
    """Correctness by the task's grader; the multiset of tokens for unknown tasks."""
    out = multiset_equal(pred, gold)
    for name, kind in TASK_GRADER.items():
        if kind != "multiset":
            out = F.when(task == name, GRADERS[kind](pred, gold)).otherwise(out)
    return out
