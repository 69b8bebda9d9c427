"""Chess on DataFrames.  Static facts are SQL over exploded boards; what needs the
rules runs in Arrow-batched maps, a position a row, with no state between rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import decode as dec
from . import rules, tasks

# Points of a piece letter.
POINTS = {"p": 1, "n": 3, "b": 3, "r": 5, "q": 9, "k": 0}


def expanded(fen: Column) -> Column:
    """The 64 letters of a position's board from a8 to h1, dots for empty squares."""
    out = F.replace(F.substring_index(fen, " ", 1), F.lit("/"), F.lit(""))
    for n in range(8, 0, -1):
        out = F.replace(out, F.lit(str(n)), F.lit("." * n))
    return out


def position_key(fen: Column) -> Column:
    """The first four fields, as text."""
    return F.substring_index(fen, " ", 4)


def side_to_move(fen: Column) -> Column:
    return F.split_part(fen, F.lit(" "), F.lit(2))


def board_rows(df: DataFrame, fen: str = "fen") -> DataFrame:
    """``df`` with a row for each square: square (a1 = 0), file, rank, piece ('.' if empty)."""
    at = df.select("*", F.posexplode(F.split(expanded(F.col(fen)), "")).alias("__i", "piece")).filter("__i < 64")
    at = at.withColumn("file", F.col("__i") % 8).withColumn("rank", 7 - F.floor(F.col("__i") / 8).cast("int"))
    return at.withColumn("square", F.col("rank") * 8 + F.col("file")).drop("__i")


def letters(fen: Column, letter: str) -> Column:
    """How often a piece letter stands on the board."""
    b = F.substring_index(fen, " ", 1)
    return F.length(b) - F.length(F.replace(b, F.lit(letter), F.lit("")))


def material(fen: Column, side: str) -> Column:
    """Points of a side ('w' or 'b')."""
    out = F.lit(0)
    for p, v in POINTS.items():
        if v:
            out = out + v * letters(fen, p.upper() if side == "w" else p)
    return out


def _map(df: DataFrame, columns: list[str], schema: str, rows) -> DataFrame:
    """A row-to-rows function over narrow columns, batch by batch."""
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [r for t in pdf[columns].itertuples(index=False, name=None) for r in rows(*t)]
            yield pd.DataFrame(out, columns=names)

    return df.select(*columns).mapInPandas(run, schema)


def flags(df: DataFrame, fen: str = "fen") -> DataFrame:
    """fen, in_check, checkmate, stalemate, has_check."""

    def rows(f):
        b = rules.Board.of(f)
        status = b.status()
        yield f, status in ("check", "checkmate"), status == "checkmate", status == "stalemate", any(b.push(m).in_check() for m in b.legal())

    return _map(df, [fen], "fen string, in_check boolean, checkmate boolean, stalemate boolean, has_check boolean", rows)


def legal_moves(df: DataFrame, fen: str = "fen") -> DataFrame:
    """fen, uci, tag, class of every legal move, in the order of move lists."""

    def rows(f):
        view = tasks.View(rules.Board.of(f), False)
        for k, m in enumerate(sorted(tasks.all_facts(view), key=tasks.move_order)):
            yield f, k, m["move"].uci(), tasks.move_tag(m), tasks.move_class(m)

    return _map(df, [fen], "fen string, place long, uci string, tag string, class long", rows)


def attacks(df: DataFrame, fen: str = "fen") -> DataFrame:
    """fen, square, attackers, defenders (counts) of every square."""

    def rows(f):
        b = rules.Board.of(f)
        for s in range(64):
            a, d = tasks.attackers_defenders(b, s)
            yield f, s, len(a), len(d)

    return _map(df, [fen], "fen string, square long, attackers long, defenders long", rows)


def replayed(df: DataFrame, game: str = "game", start: str = "start_fen", moves: str = "moves") -> DataFrame:
    """game, ply, uci, fen, key of every position of a game; an illegal move ends it with ``fen`` null."""

    def rows(g, f, ms):
        board = rules.Board.of(f)
        yield g, 0, None, board.fen(), board.key()
        for k, m in enumerate(ms, 1):
            try:
                board = board.play(m)
            except (rules.IllegalMove, ValueError):
                yield g, k, m, None, None
                return
            yield g, k, m, board.fen(), board.key()

    kind = dict(df.dtypes)[game]
    return _map(df, [game, start, moves], f"game {kind}, ply long, uci string, fen string, key string", rows)


def terminations(df: DataFrame, game: str = "game", start: str = "start_fen", moves: str = "moves") -> DataFrame:
    """game, result, reason of a finished or stopped game."""

    def rows(g, f, ms):
        done, _ = rules.legal_prefix(f, list(ms))
        result, reason = rules.termination(rules.replay(f, done))
        yield g, result, reason

    return _map(df, [game, start, moves], f"game {dict(df.dtypes)[game]}, result string, reason string", rows)


def questions(df: DataFrame, task: str, n: int, seed: int, pov: bool = True, fen: str = "fen") -> DataFrame:
    """fen, task, question, answer, answer_class: at most ``n`` rows of each position."""

    def rows(f):
        for r in tasks.sample(task, f, pov, n, f"{seed}|{f}"):
            yield f, r["task"], r["question"], r["answer"], r["answer_class"]

    return _map(df, [fen], "fen string, task string, question string, answer string, answer_class array<string>", rows)


def instances(rows: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """The five-key training instance: fen, history, prompt, response, extra."""
    at = rows if history is None else rows.join(history, "fen", "left")
    past = F.coalesce(F.col("history"), F.array().cast("array<string>")) if history is not None else F.array().cast("array<string>")
    extra = F.struct("task", F.coalesce("answer_class", F.array().cast("array<string>")).alias("answer_class"))
    return at.select("fen", past.alias("history"), F.col("question").alias("prompt"), F.col("answer").alias("response"), extra.alias("extra"))


def decoded(df: DataFrame, fen: str = "fen", raw: str = "raw", pov: bool = True, strict: bool = True) -> DataFrame:
    """fen, raw, uci, error of each token move."""

    def rows(f, r):
        uci, error = dec.decode(rules.Board.of(f), r, pov, strict)
        yield f, r, uci, error

    return _map(df, [fen, raw], "fen string, raw string, uci string, error string", rows)


def planes(df: DataFrame, history: str = "history") -> DataFrame:
    """fen, planes: 112 planes of 64 (eight boards of 13, newest first, seen by the side to move; then castling
    rights, side, half-move clock, zeros and ones) from a position and its earlier ones (oldest first).

    Boards before the oldest given one repeat it, with a double-stepped pawn that can be taken in
    passing put back to its first square; before the start position they stay empty."""

    def one(fens: list[str]) -> list[float]:
        boards = [rules.Board.of(f) for f in reversed(fens)]
        own = boards[0].turn
        flip = 56 * own
        seen = [b.key() for b in boards]
        out: list[float] = []
        for k in range(8):
            b = boards[min(k, len(boards) - 1)]
            before = k >= len(boards)
            if before and b.fen().split()[:4] == rules.START.split()[:4]:
                out += [0.0] * (13 * 64)
                continue
            at = list(b.squares)
            if before and b.ep is not None:
                pawn = b.ep + (8 if b.turn else -8)
                at[pawn], at[2 * b.ep - pawn] = "", at[pawn]  # back over the square passed
            for side in (own, 1 - own):
                for kind in "PNBRQK":
                    letter = kind if side == 0 else kind.lower()
                    out += [1.0 if at[s ^ flip] == letter else 0.0 for s in range(64)]
            k = min(k, len(boards) - 1)
            out += [1.0 if seen[k] in seen[k + 1 :] else 0.0] * 64
        now = boards[0]
        mine, theirs = ("QK", "qk") if own == 0 else ("qk", "QK")
        for c in mine + theirs:
            out += [float(c in now.castling)] * 64
        return out + [float(own)] * 64 + [float(now.half)] * 64 + [0.0] * 64 + [1.0] * 64

    def rows(f, h):
        yield f, one([*list(h if h is not None else [])[-7:], f])

    return _map(df, ["fen", history], "fen string, planes array<float>", rows)
