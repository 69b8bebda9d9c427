"""Sources, sinks, levels and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from quern.chess.rules import START
from quern.operators.dedup import IdentityError
from quern.operators.filters import SpecError
from quern.sources import config, files, pgn, sinks
from quern.streaming import flows

PGN = """[White "A"]
[Black "B"]
[Result "1-0"]

1. e4 e5 2. Nf3 {a comment} Nc6 (2... d6 3. d4) 3. Bb5 a6 4. O-O $1 1-0

[White "bad"]

1. e4 Ke5 *

[White "empty"]
[Result "*"]

*

[White "C\xff"]
[FEN "8/P6k/8/8/8/8/8/K7 w - - 0 1"]

1. a8=N+ Kg6 1/2-1/2
"""


def test_pgn_plain_and_compressed(spark, tmp_path):
    import zstandard

    raw = PGN.encode("latin-1")
    (tmp_path / "a.pgn").write_bytes(raw)
    (tmp_path / "b.pgn.zst").write_bytes(zstandard.ZstdCompressor().compress(raw))
    pgn.register(spark)
    for df in (spark.read.format("pgn").load(str(tmp_path / "*.pgn*")), pgn.from_bytes(spark, str(tmp_path / "*.pgn*"))):
        rows = df.orderBy("file", "game_no").collect()
        assert [r.game_no for r in rows] == [0, 3, 0, 3]
        assert rows[0].moves == ["e2e4", "e7e5", "g1f3", "b8c6", "f1b5", "a7a6", "e1g1"] and rows[0].result == "1-0"
        assert rows[1].moves == ["a7a8n", "h7g6"] and "�" in rows[1].headers["White"]
    assert pgn.chained(pgn.game_ids(df), 1).first().file.endswith("a.pgn")
    assert spark.read.format("pgn").option("max_games", 1).load(str(tmp_path / "a.pgn")).count() == 1


def test_globs_and_torn_lines(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n{"a": 2}\n{"a": ')
    (tmp_path / "a.jsonl").write_text('{"a": 3}\n')
    paths = files.resolve(spark, [str(tmp_path / "b*"), str(tmp_path / "*.jsonl")])
    assert [p.rsplit("/", 1)[1] for p in paths] == ["b.jsonl", "a.jsonl"]
    with pytest.raises(files.SourceError):
        files.resolve(spark, [str(tmp_path / "none*")])
    assert sorted(r.a for r in files.read_jsonl(spark, paths, "a int").collect()) == [1, 2, 3]
    assert files.read_jsonl(spark, paths, "a int", torn="keep").filter("_torn is not null").select("a", "_torn").collect()[0].a is None
    with pytest.raises(Exception):
        files.read_jsonl(spark, paths, "a int", torn="fail").collect()
    pool = files.pool(spark, paths, keep=lambda v: v.endswith("}")).orderBy("idx").collect()
    assert [(r.idx, json.loads(r.value)["a"]) for r in pool] == [(0, 3), (1, 1), (2, 2)]


def test_polymorphic_rows(spark):
    games = {"games": [{"white": "a", "black": "b", "result": "*", "moves": ["e2e4"]}]}
    lines = [json.dumps(x) for x in (["s", ["m"], "e"], ["s", ["m"], "e", ["x", "y"], "f"], ["s", [], "e", [["x"], "f"]], ["s", [], "e", games], {"start_fen": "s", "moves": ["m"], "fen": "e"})]
    df = spark.createDataFrame([(x,) for x in [*lines, "torn ["]], "value string")
    got = files.decode_rows(df).collect()
    assert [(r.start_fen, r.fen, r.ahead_moves, r.ahead_fen, bool(r.games)) for r in got] == [("s", "e", None, None, False), ("s", "e", ["x", "y"], "f", False), ("s", "e", ["x"], "f", False), ("s", "e", None, None, True), ("s", "e", None, None, False)]
    seeds = [json.dumps(["s", [], "e f g h 1 2"]), json.dumps({"record_id": "r", "fen": "z", "history": list("abcdefghi"), "extra": {"k": "v"}})]
    got = files.seeds(spark.createDataFrame([(x,) for x in seeds], "value string")).collect()
    assert got[0].history == ["s"] and len(got[0].record_id) == 32 and got[1].history == list("cdefghi") and got[1].extra == {"k": "v"}


def test_snapshot(spark, tmp_path):
    (tmp_path / "x.txt").write_text("one")
    at = [str(tmp_path / "x.txt")]
    frozen = spark.createDataFrame(files.inventory(spark, at).collect(), files.inventory(spark, at).schema)
    files.verify_unchanged(frozen, spark, at)
    (tmp_path / "x.txt").write_text("other")
    with pytest.raises(files.SourceError):
        files.verify_unchanged(frozen, spark, at)


def test_mixed_rows_puzzles_and_samples(spark, tmp_path):
    df = spark.createDataFrame([("game", 1), ("position", 2)], "kind string, v int")
    assert files.tagged_views(df, "kind", ["game", "position"])["game"].count() == 1
    with pytest.raises(files.SourceError):
        files.tagged_views(df, "kind", ["game"])
    p = spark.createDataFrame([("a", START, ["e2e4", "e7e5", "g1f3"], 1234, ["x"]), ("b", START, ["e2e4"], 900, [])], "id string, fen string, moves array<string>, rating int, themes array<string>")
    r = files.puzzle_rows(p).collect()
    assert len(r) == 1 and (r[0].rating_bin, r[0].setup_move_uci, r[0].correct_move_uci, r[0].solution_uci) == (1200, "e2e4", "e7e5", ["e7e5", "g1f3"])
    (tmp_path / "s.json").write_text(json.dumps([{"sample_id": "1"}, {"sample_id": "1"}]))
    with pytest.raises(files.SourceError):
        files.benchmark_samples(spark, str(tmp_path / "s.json"), "sample_id string")


def test_config():
    base = {"a": {"b": 1}, "c": 2}
    assert config.override(base, "a.b=0.5") == {"a": {"b": 0.5}, "c": 2} and base["a"]["b"] == 1
    assert [config.coerce(x) for x in ("3", "3.5", "True", "null", "x")] == [3, 3.5, True, None, "x"]
    for bad in ("novalue", "=1", "c.d=1"):
        with pytest.raises(SpecError):
            config.override(base, bad)
    good = {"sources": [{"name": "a", "frac": 0.5}, {"name": "b", "frac": 0.5}], "splits": {"train": 3}}
    config.check_mix(good)
    for bad in ({}, {"sources": [{"name": "a", "frac": 0.5}]}, {"sources": good["sources"] + [{"name": "a", "frac": 0.1}]}, good | {"splits": {"dev": 1}}, good | {"splits": {"val": -1}}):
        with pytest.raises(SpecError):
            config.check_mix(bad)
    assert config.task_range(["x", "y", "z"], 1, 3) == [(1, "y"), (2, "z")]
    with pytest.raises(SpecError):
        config.task_range(["x"], 0, 2)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    first = sinks.write_jsonl(df, str(tmp_path / "j"))
    assert first == sinks.table_digest(df.repartition(5).orderBy(F.desc("k"))) and first[0] == 2
    with pytest.raises(Exception):
        sinks.write_jsonl(df, str(tmp_path / "j"))
    assert sinks.publish(df, str(tmp_path / "p")) == sinks.publish(df, str(tmp_path / "p"))
    with pytest.raises(sinks.SinkError):
        sinks.publish(df.limit(1), str(tmp_path / "p"))
    for name, flag in (("one", True), ("two", True), ("odd", False)):
        sinks.write_dataset(df if name != "two" else df.limit(0), str(tmp_path / name), {"pov": flag})
    assert sinks.concatenate(spark, [str(tmp_path / "two"), str(tmp_path / "one")]).count() == 2
    with pytest.raises(sinks.SinkError):
        sinks.concatenate(spark, [str(tmp_path / "one"), str(tmp_path / "odd")])
    shards = sinks.write_shards(df.union(df), str(tmp_path / "s"), "k", "v", 3)
    assert shards.agg(F.sum("rows")).first()[0] == 2
    with pytest.raises(IdentityError):
        sinks.write_shards(df.union(spark.createDataFrame([(1, "z")], df.schema)), str(tmp_path / "s2"), "k", "v", 3)
    order = spark.createDataFrame([(2, 0), (1, 1)], "k int, place int")
    assert [r.k for r in sinks.assemble(df, order, "k", "place").collect()] == [2, 1]
    with pytest.raises(sinks.SinkError):
        sinks.assemble(df.limit(1), order, "k", "place")
    with sinks.single_writer(str(tmp_path / "w")):
        with pytest.raises(sinks.SinkError):
            with sinks.single_writer(str(tmp_path / "w")):
                pass
    assert sinks.markdown(df).splitlines()[0] == "| k | v |"
    g = spark.createDataFrame([(1, "a", "b", "*", ["e2e4", "e7e5", "d2d4"]), (2, "a", "b", "*", [])], "game_id int, white string, black string, result string, moves array<string>")
    texts = {r.game_id: r.pgn for r in sinks.pgn_text(g).collect()}
    assert texts[1].endswith("1. e2e4 e7e5 2. d2d4 *\n") and texts[2].endswith("\n\n*\n")


def test_levels_resume_and_refuse(spark, tmp_path):
    calls = []

    def act(rows, depth):
        calls.append(depth)
        return rows.withColumn("decision", F.when(F.col("n") <= depth, "accept").otherwise("recurse")).withColumn("reason", F.lit("small"))

    start = spark.createDataFrame([(k,) for k in range(8)], "n int")
    at = str(tmp_path / "run")
    got = {r.n: (r.decision, r.reason, r.depth) for r in flows.levels(spark, start, act, at, 3, {"x": 1}).collect()}
    assert got[0] == ("accept", "small", 0) and got[2] == ("accept", "small", 2) and got[7] == ("discard", "depth limit", 2)
    assert calls == [0, 1, 2]
    flows.levels(spark, start, act, at, 3, {"x": 1})
    assert calls == [0, 1, 2]
    with pytest.raises(sinks.SinkError):
        flows.levels(spark, start, act, at, 3, {"x": 2})


def test_retry(spark, tmp_path):
    got = flows.retry(spark, spark.createDataFrame([(k,) for k in range(5)], "n int"), lambda r, k: r.withColumn("ok", F.col("n") <= k), 3, str(tmp_path / "r"))
    assert sorted((r.n, r.ok) for r in got.collect()) == [(0, True), (1, True), (2, True), (3, False), (4, False)]


def test_streams(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    spark.createDataFrame([(1, "a"), (2, "b"), (1, "a")], "k int, v string").write.parquet(str(src))
    read = lambda: spark.readStream.schema("k int, v string").parquet(str(src))
    flows.stream_new(read(), str(out), str(tmp_path / "cp"), "k").awaitTermination()
    spark.createDataFrame([(2, "b"), (3, "c")], "k int, v string").write.mode("append").parquet(str(src))
    flows.stream_new(read(), str(out), str(tmp_path / "cp"), "k").awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(str(out)).collect()) == [1, 2, 3]
    flows.stream_chunks(read(), str(tmp_path / "chunks"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == 5
    assert flows.append_new(spark, spark.read.parquet(str(src)), str(tmp_path / "app"), "k") == 3
    assert flows.append_new(spark, spark.read.parquet(str(src)), str(tmp_path / "app"), "k") == 0


def test_event_windows(spark):
    e = spark.createDataFrame([("2024-01-01 00:00:00", "u"), ("2024-01-01 00:20:00", "u"), ("2024-01-01 02:00:00", "u")], "ts string, u string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert sorted(r.n for r in flows.windowed_counts(e, "ts", ["u"], "1 hour", "1 hour").collect()) == [1, 2]
    assert sorted(r.n for r in flows.sessions(e, "ts", ["u"], "30 minutes").collect()) == [1, 2]


def test_game_states(spark):
    log = [("g", 0, 0, "move", "e2e4"), ("g", 1, 0, "move", "d2d4"), ("g", 2, 1, "move", "e2e4"), ("g", 3, 1, "move", "e7e5"), ("g", 4, 2, "back", None), ("g", 5, 3, "back", None), ("g", 6, 3, "claim", None), ("g", 7, 3, "resign", None), ("g", 8, 4, "move", "e2e4")]
    df = spark.createDataFrame(log, "game_id string, seq int, version int, action string, uci string")
    got = [(r.applied, r.reason) for r in flows.game_states(df).collect()]
    assert got == [(True, None), (False, "stale version"), (False, "illegal move"), (True, None), (True, None), (False, "nothing to take back"), (False, "no draw to claim"), (True, None), (False, "the game is over")]
