"""Rules, tokens, tasks and decoding: public node counts, examples, symmetry."""

import pytest
from pyspark.sql import functions as F

from quern.chess import decode, frames, rules, tasks
from quern.functions.hashing import blake2_hex, request_seed
from quern.plans.chess import GAMES, NODES, POSITIONS

FEN = dict(POSITIONS)


@pytest.mark.parametrize("name,depth,nodes", NODES)
def test_node_counts(name, depth, nodes):
    board = rules.Board.of(FEN[name])
    assert rules.perft(board, depth) == nodes


@pytest.mark.parametrize("fen", [f for _, f in POSITIONS])
def test_fen_round_trip(fen):
    assert rules.Board.of(fen).fen() == fen


@pytest.mark.parametrize("fen", ["", "8/8/8 w - - 0 1", "9/8/8/8/8/8/8/8 w - - 0 1"])
def test_broken_fen(fen):
    with pytest.raises((ValueError, IndexError)):
        rules.Board.of(fen)


def test_games():
    for _, moves, fen, result, why in GAMES:
        line = rules.replay(rules.START, moves)
        assert line[-1].fen(True) == fen and rules.termination(line) == (result, why)
    assert rules.legal_prefix(rules.START, ["e2e4", "e2e4"]) == (["e2e4"], "e2e4")


def test_en_passant_key_only_where_it_can_be_played():
    idle = rules.replay(rules.START, ["e2e4"])[-1]
    assert idle.fen().split()[3] == "e3" and idle.key().split()[3] == "-"
    live = rules.replay(rules.START, ["e2e4", "a7a6", "e4e5", "d7d5"])[-1]
    assert live.key().split()[3] == "d6"


@pytest.mark.parametrize("raw", [None, "", "e2e4", "<PIECE_MP><SQUARE_13>", "<PIECE_MP><SQUARE_13><SQUARE_29> then", "<PIECE_OP><SQUARE_13><SQUARE_29>", "<PIECE_MP><SQUARE_0><SQUARE_29>", "<PIECE_MP><SQUARE_13><SQUARE_65>", "<PIECE_MN><SQUARE_13><SQUARE_29>", "<PIECE_MP><SQUARE_13><PIECE_OP><SQUARE_29>"])
def test_malformed_moves_decode_to_nothing(raw):
    uci, error = decode.decode(rules.Board.of(rules.START), raw)
    assert uci is None and error


def test_a_missing_promotion_does_not_default_when_strict():
    board = rules.Board.of("8/P6k/8/8/8/8/8/K7 w - - 0 1")
    raw = "<PIECE_MP><SQUARE_49><SQUARE_57>"
    assert decode.decode(board, raw)[0] is None and decode.decode(board, raw, strict=False)[0] == "a7a8q"


@pytest.mark.parametrize("fen", [f for _, f in POSITIONS])
@pytest.mark.parametrize("pov", [True, False])
def test_every_legal_move_decodes_back(fen, pov):
    board = rules.Board.of(fen)
    for f in tasks.all_facts(tasks.View(board, pov)):
        assert decode.decode(board, tasks.move_tag(f), pov) == (f["move"].uci(), None)


def mirrored(fen):
    b = rules.Board.of(fen)
    squares = tuple(b.squares[s ^ 56].swapcase() for s in range(64))
    castling = "".join(sorted(b.castling.swapcase()))
    return rules.Board(squares, 1 - b.turn, castling, None if b.ep is None else b.ep ^ 56, b.half, b.full)


@pytest.mark.parametrize("fen", [f for _, f in POSITIONS])
def test_point_of_view_answers_do_not_see_colours(fen):
    a, b = tasks.View(rules.Board.of(fen), True), tasks.View(mirrored(fen), True)
    for name, rows in tasks.TASKS.items():
        one, two = [sorted(r["answer"].split("\n\n", 1)[1] for r in rows(v, 0)) for v in (a, b)]
        assert one == two, name


def test_task_tags_by_hand():
    view = tasks.View(rules.Board.of(FEN["foolsmate"]), False)
    tag = lambda t: [r["answer"].split("\n\n", 1)[1] for r in tasks.TASKS[t](view, 0)]
    assert tag("is_checkmate") == ["<PIECE_WK><SQUARE_E1> yes"]
    assert tag("check_parries") == ["<PIECE_WK><SQUARE_E1>"]
    assert tag("material_count") == ["white\n39\nblack\n39"]
    assert tag("piece_on_file")[4] == "<PIECE_WP><PIECE_WK><PIECE_BP><PIECE_BK>"
    assert "<SQUARE_H4><PIECE_BQ>" in tag("piece_on_square")
    assert len(tag("piece_on_diagonal")) == 26 and len(tag("square_attackers")) == 64
    start = tasks.View(rules.Board.of(rules.START), True)
    assert [r["answer"].split("\n\n", 1)[1] for r in tasks.TASKS["capture_moves"](start, 0)] == ["<PIECE_MK>"]


def test_sampling_is_bounded_distinct_and_stable():
    a = tasks.sample("piece_on_square", rules.START, True, 10, 1)
    assert len({r["question"] for r in a}) == len(a) == 10
    assert a == tasks.sample("piece_on_square", rules.START, True, 10, 1)
    assert len(tasks.sample("piece_count", rules.START, True, 10, 1)) == 1


def test_origins_choices_audits():
    board = rules.Board.of("r3k2r/8/8/8/8/8/8/R3K2R w KQkq - 0 1")
    assert decode.origins(board, ["e1g1"])[5] == 7 and decode.origins(board, ["e1g1"])[6] == 4
    start = rules.Board.of(rules.START)
    assert decode.choose(start, "e2e5", ["d2d4"], [], 0) == ("d2d4", "critical")
    assert decode.choose(start, None, [], [], 3)[1] == "random"
    assert decode.candidates(start, [["e2e4", "e2e5"], ["e2e4", "d2d4", "c2c4", "b2b4"]]) == ["e2e4", "d2d4", "c2c4"]
    assert decode.audit(start, "e2e4", ["e2e4", "e7e5"], []) == []
    assert decode.audit(start, None, [], []) == ["structure: no best move", "structure: no line"]
    assert decode.audit(start, "e2e4", ["d2d4", "d2d4"], ["d2d4"]) == ["candidate: e2e4 was not supplied", "structure: the line starts elsewhere", "line: illegal move 2"]


def test_seeds_and_digests():
    assert request_seed(20260823, 0, 0) == 917225541
    assert len(blake2_hex("x")) == 32


def test_planes(spark):
    df = spark.createDataFrame([(rules.START, [])], "fen string, history array<string>")
    p = frames.planes(df).first().planes
    assert len(p) == 112 * 64 and sum(p[: 12 * 64]) == 32 and sum(p[104 * 64 : 108 * 64]) == 256


def test_illegal_games_end_with_a_null_position(spark):
    df = spark.createDataFrame([(1, rules.START, ["e2e4", "e2e4", "d2d4"]), (2, rules.START, [])], "game int, start_fen string, moves array<string>")
    rows = frames.replayed(df).orderBy("game", "ply").collect()
    assert [(r.game, r.ply, r.fen is None) for r in rows] == [(1, 0, False), (1, 1, False), (1, 2, True), (2, 0, False)]


def test_graders_tell_every_tasks_answers_apart(spark):
    """Each answer equals itself; another answer of the task, with another tag, is wrong."""
    from quern.chess import tasks
    from quern.operators import grading

    rows = []
    for _, fen in POSITIONS:
        for pov in (True, False):
            for name, make in tasks.TASKS.items():
                rows += [(name, r["answer"]) for r in make(tasks.View(rules.Board.of(fen), pov), 1)]
    by = {}
    for name, answer in rows:
        by.setdefault(name, {}).setdefault(answer.split("\n\n")[-1].strip(), answer)
    pairs = []
    for name, tags in by.items():
        listed = sorted(tags.items())
        pairs += [(name, a, a, True) for _, a in listed[:40]]
        pairs += [(name, a, b, False) for (ta, a), (tb, b) in zip(listed, listed[1:], strict=False) if sorted(ta) != sorted(tb)]
        pairs += [(name, "I do not know.", a, False) for _, a in listed[:5]]
    df = spark.createDataFrame(pairs, "task string, pred string, gold string, want boolean")
    got = df.withColumn("got", grading.grade(F.col("task"), F.col("pred"), F.col("gold")))
    assert got.filter("got is null or got <> want").limit(5).collect() == []
    assert got.filter("not want").select("task").distinct().count() == len(tasks.TASKS)


def test_planes_before_the_history(spark):
    """Without history a board is repeated, its double step taken back; the start position has nothing before it."""
    fens = [rules.START, "4k3/8/8/3pP3/8/8/8/4K3 w - d6 0 2", "4k3/8/8/8/3Pp3/8/8/4K3 b - d3 0 2"]
    df = spark.createDataFrame([(f, None) for f in fens], "fen string, history array<string>")
    got = {r.fen: r.planes for r in frames.planes(df).collect()}
    ones = lambda f, slot, plane: [s for s in range(64) if got[f][(slot * 13 + plane) * 64 + s]]
    assert sum(got[fens[0]][13 * 64 : 13 * 8 * 64]) == 0
    assert ones(fens[1], 0, 6) == [35] and all(ones(fens[1], k, 6) == [51] for k in range(1, 8))  # d5, then d7
    assert ones(fens[2], 0, 6) == [35] and ones(fens[2], 1, 6) == [51]  # the same seen from the other side
    assert all(ones(f, k, 12) == [] for f in fens for k in range(8))
