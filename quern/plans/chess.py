"""Positions: boards as rows, tasks, replay, decoding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..chess import frames, rules

# Public test positions of move generators and their node counts.
POSITIONS = [
    ("start", rules.START),
    ("kiwipete", "r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1"),
    ("endgame", "8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1"),
    ("promotions", "r3k2r/Pppp1ppp/1b3nbN/nP6/BBP1P3/q4N2/Pp1P2PP/R2Q1RK1 w kq - 0 1"),
    ("mirrored", "r2q1rk1/pP1p2pp/Q4n2/bbp1p3/Np6/1B3NBn/pPPP1PPP/R3K2R b KQ - 0 1"),
    ("talkchess", "rnbq1k1r/pp1Pbppp/2p5/8/2B5/8/PPP1NnPP/RNBQK2R w KQ - 1 8"),
    ("foolsmate", "rnb1kbnr/pppp1ppp/8/4p3/6Pq/5P2/PPPPP2P/RNBQKBNR w KQkq - 1 3"),
    ("stalemate", "7k/5Q2/6K1/8/8/8/8/8 b - - 0 1"),
]
NODES = [("start", 1, 20), ("start", 2, 400), ("start", 3, 8902), ("kiwipete", 1, 48), ("kiwipete", 2, 2039), ("endgame", 1, 14), ("endgame", 2, 191), ("endgame", 3, 2812), ("promotions", 1, 6), ("promotions", 2, 264), ("mirrored", 1, 6), ("mirrored", 2, 264), ("talkchess", 1, 44), ("talkchess", 2, 1486), ("foolsmate", 1, 0), ("stalemate", 1, 0)]
GAMES = [
    ("sicilian", ["e2e4", "c7c5", "g1f3"], "rnbqkbnr/pp1ppppp/8/2p5/4P3/5N2/PPPP1PPP/RNBQKB1R b KQkq - 1 2", "*", "unfinished"),
    ("fool", ["f2f3", "e7e5", "g2g4", "d8h4"], "rnb1kbnr/pppp1ppp/8/4p3/6Pq/5P2/PPPPP2P/RNBQKBNR w KQkq - 1 3", "0-1", "checkmate"),
    ("shuffle", ["g1f3", "g8f6", "f3g1", "f6g8", "g1f3", "g8f6", "f3g1", "f6g8"], "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 8 5", "1/2-1/2", "threefold"),
]


def _positions(spark):
    return spark.createDataFrame(POSITIONS, "name string, fen string")


def _games(spark):
    return spark.createDataFrame([(g, rules.START, m) for g, m, *_ in GAMES], "game string, start_fen string, moves array<string>")


def fen_board(spark, d):
    """CHS1: every square of every position."""
    return frames.board_rows(_positions(spark)).select("name", "square", "file", "rank", "piece")


def piece_inventory(spark, d):
    """AGG18: pieces by letter, from exploded boards."""
    return frames.board_rows(_positions(spark)).filter("piece <> '.'").groupBy("name", "piece").agg(F.count("*").alias("n"))


def material_points(spark, d):
    """Task material_count: points of both sides."""
    return _positions(spark).select("name", frames.material(F.col("fen"), "w").alias("white"), frames.material(F.col("fen"), "b").alias("black"))


def line_counts(spark, d):
    """Tasks piece_on_file, piece_on_rank, piece_on_diagonal: pieces on every line."""
    b = frames.board_rows(_positions(spark)).filter("piece <> '.'")
    lines = F.explode(F.array(F.struct(F.lit("file").alias("kind"), F.col("file").alias("line")), F.struct(F.lit("rank").alias("kind"), F.col("rank").alias("line")), F.struct(F.lit("rising").alias("kind"), (F.col("rank") - F.col("file")).alias("line")), F.struct(F.lit("falling").alias("kind"), (F.col("rank") + F.col("file")).alias("line"))))
    at = b.select("name", "piece", lines.alias("l")).select("name", "piece", "l.kind", "l.line")
    keep = F.expr("(kind = 'rising' and abs(line) <= 6) or (kind = 'falling' and line between 1 and 13) or kind in ('file', 'rank')")
    return at.filter(keep).groupBy("name", "kind", "line", "piece").agg(F.count("*").alias("n"))


def position_keys(spark, d):
    """D2: key and side to move."""
    return _positions(spark).select("name", frames.position_key(F.col("fen")).alias("key"), frames.side_to_move(F.col("fen")).alias("side"))


def legal_move_counts(spark, d):
    """CHS4: numbers of legal moves."""
    p = _positions(spark)
    n = frames.legal_moves(p).groupBy("fen").agg(F.count("*").alias("moves"))
    return p.join(n, "fen", "left").select("name", F.coalesce("moves", F.lit(0)).alias("moves"))


def node_counts(spark, d):
    """CHS4, CHS5: leaves of the move tree to a stated depth."""
    p = spark.createDataFrame([(n, dict(POSITIONS)[n], depth) for n, depth, _ in NODES], "name string, fen string, depth int")

    def rows(name, fen, depth):
        yield name, depth, rules.perft(rules.Board.of(fen), depth)

    return frames._map(p.repartition(4), ["name", "fen", "depth"], "name string, depth int, nodes long", rows)


def position_flags(spark, d):
    """CHS2: check, mate, stalemate, whether a check can be given."""
    p = _positions(spark)
    return p.join(frames.flags(p), "fen").select("name", "in_check", "checkmate", "stalemate", "has_check")


def strict_decoding(spark, d):
    """CHS6: every legal move of every position as tokens, decoded again; and one token short, which decodes to nothing."""
    p = _positions(spark)
    told = frames.legal_moves(p).select("fen", "uci", F.col("tag").alias("raw"))
    cut = told.withColumn("raw", F.regexp_replace("raw", "<[^<]*>$", "")).withColumn("uci", F.lit(None).cast("string"))
    whole = told.join(frames.decoded(told.select("fen", "raw").distinct(), pov=False).select("fen", "raw", F.col("uci").alias("got")), ["fen", "raw"])
    short = cut.join(frames.decoded(cut.select("fen", "raw").distinct(), pov=False).select("fen", "raw", F.col("uci").alias("got")), ["fen", "raw"])
    right = whole.filter("uci = got").groupBy("fen").agg(F.count("*").alias("decoded"))
    wrong = short.groupBy("fen").agg(F.count("got").alias("from_part"))
    return p.join(right, "fen", "left").join(wrong, "fen", "left").select("name", F.coalesce("decoded", F.lit(0)).alias("decoded"), F.coalesce("from_part", F.lit(0)).alias("from_part"))


def game_replay(spark, d):
    """PRJ2, CHS5: final positions of games."""
    r = frames.replayed(_games(spark))
    return r.groupBy("game").agg(F.max_by("fen", "ply").alias("fen"), F.max("ply").alias("plies"))


def game_histories(spark, d):
    """PRJ5, AGG16: earlier positions and repetitions along games."""
    r = frames.replayed(_games(spark))
    w = Window.partitionBy("game").orderBy("ply")
    rep = F.row_number().over(Window.partitionBy("game", "key").orderBy("ply")) - 1
    return r.select("game", "ply", rep.alias("repetition"), F.size(F.collect_list("fen").over(w.rowsBetween(-7, -1))).alias("history"))


def game_terminations(spark, d):
    """CHS25, CHS26: result and reason."""
    return frames.terminations(_games(spark))


def move_windows(spark, d):
    """PRJ1: up to seven moves before each ply."""
    g = _games(spark).select("game", "moves", F.explode(F.sequence(F.lit(0), F.size("moves"))).alias("ply"))
    return g.select("game", "ply", F.array_join(F.slice("moves", F.greatest(F.col("ply") - 7, F.lit(0)) + 1, F.least(F.lit(7), F.col("ply"))), " ").alias("window"))


def task_rows(spark, d):
    """All thirteen tasks on every position, at most four rows each."""
    from functools import reduce

    from pyspark.sql import DataFrame

    from ..chess import tasks

    p = _positions(spark)
    out = reduce(DataFrame.unionByName, [frames.questions(p, t, 4, 1) for t in tasks.TASKS])
    return out.select("fen", "task", "question", "answer", "answer_class")


def task_instances(spark, d):
    """PRJ6: five-key instances of one task."""
    return frames.instances(frames.questions(_positions(spark), "piece_on_file", 8, 2))


def move_tags(spark, d):
    """SRT1: move lists in canonical order."""
    m = frames.legal_moves(_positions(spark))
    return m.groupBy("fen").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "tag"))), lambda x: x["tag"]), ",").alias("tags"))


def control_counts(spark, d):
    """CHS3: attackers and defenders of every square."""
    return frames.attacks(_positions(spark))


def board_planes(spark, d):
    """CHS23: sums of the 112 planes."""
    p = _positions(spark).withColumn("history", F.array().cast("array<string>"))
    return frames.planes(p).select("fen", F.size("planes").alias("n"), F.aggregate("planes", F.lit(0.0), lambda a, x: a + x).alias("total"))


QUERIES = {f.__name__: f for f in (fen_board, piece_inventory, material_points, line_counts, position_keys, legal_move_counts, node_counts, position_flags, strict_decoding, game_replay, game_histories, game_terminations, move_windows, task_rows, task_instances, move_tags, control_counts, board_planes)}

_P = "p(name, fen) AS (VALUES " + ", ".join(f"('{n}', '{f}')" for n, f in POSITIONS) + ")"
_X = "replace(split_part(fen, ' ', 1), '/', '')"
for _n in range(8, 0, -1):
    _X = f"replace({_X}, '{_n}', '{'.' * _n}')"
_B = f"{_P}, b AS (SELECT name, i % 8 AS file, 7 - i // 8 AS rank, substr({_X}, i + 1, 1) AS piece FROM p, (SELECT unnest(range(64))::INT AS i))"
ORACLES = {
    "fen_board": f"WITH {_B} SELECT name, rank * 8 + file AS square, file, rank, piece FROM b",
    "piece_inventory": f"WITH {_B} SELECT name, piece, count(*) AS n FROM b WHERE piece <> '.' GROUP BY 1, 2",
    "material_points": f"WITH {_B}, v(l, v) AS (VALUES ('p', 1), ('n', 3), ('b', 3), ('r', 5), ('q', 9)) SELECT name, coalesce(sum(v) FILTER (piece = upper(l)), 0)::INT AS white, coalesce(sum(v) FILTER (piece = l), 0)::INT AS black FROM b LEFT JOIN v ON lower(piece) = l GROUP BY 1",
    "line_counts": f"WITH {_B}, l AS (SELECT name, piece, 'file' AS kind, file AS line FROM b UNION ALL SELECT name, piece, 'rank', rank FROM b UNION ALL SELECT name, piece, 'rising', rank - file FROM b WHERE abs(rank - file) <= 6 UNION ALL SELECT name, piece, 'falling', rank + file FROM b WHERE rank + file BETWEEN 1 AND 13) SELECT name, kind, line, piece, count(*) AS n FROM l WHERE piece <> '.' GROUP BY 1, 2, 3, 4",
    "position_keys": f"WITH {_P} SELECT name, array_to_string(string_split(fen, ' ')[1:4], ' ') AS key, split_part(fen, ' ', 2) AS side FROM p",
    "legal_move_counts": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {c})" for n, depth, c in NODES if depth == 1) + ") t(name, moves)",
    "node_counts": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {depth}, {c})" for n, depth, c in NODES) + ") t(name, depth, nodes)",
    "position_flags": "SELECT * FROM (VALUES ('start', false, false, false, false), ('kiwipete', false, false, false, false), ('endgame', false, false, false, true), ('promotions', true, false, false, false), ('mirrored', true, false, false, false), ('talkchess', false, false, false, false), ('foolsmate', true, true, false, false), ('stalemate', false, false, true, false)) t(name, in_check, checkmate, stalemate, has_check)",
    "strict_decoding": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {c}, 0)" for n, depth, c in NODES if depth == 1) + ") t(name, decoded, from_part)",
    "game_replay": "SELECT * FROM (VALUES " + ", ".join(f"('{g}', '{f}', {len(m)})" for g, m, f, *_ in GAMES) + ") t(game, fen, plies)",
    "game_terminations": "SELECT * FROM (VALUES " + ", ".join(f"('{g}', '{r}', '{w}')" for g, _, _, r, w in GAMES) + ") t(game, result, reason)",
    "move_windows": "WITH g(game, moves) AS (VALUES " + ", ".join(f"('{g}', {m!r})" for g, m, *_ in GAMES) + ") SELECT game, ply, array_to_string(moves[greatest(ply - 7, 0) + 1:ply], ' ') AS window FROM g, (SELECT unnest(range(20))::INT AS ply) WHERE ply <= len(moves)",
}
