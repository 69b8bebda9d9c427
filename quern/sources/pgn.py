"""Game archives: a Spark data source for PGN files, plain or zstd.

``spark.read.format("pgn").load(glob)`` after ``register(spark)``: one partition a
file (a compressed stream cannot be split); bad bytes are replaced, games that do
not parse or have no move are skipped, ``max_games`` caps each file.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..chess.rules import START, Board, Move, square

SCHEMA = "file string, game_no long, headers map<string,string>, start_fen string, moves array<string>, result string"
_HEADER = re.compile(r'^\[(\w+)\s+"((?:[^"\\]|\\.)*)"\]\s*$')
_SKIP = re.compile(r"\{[^}]*\}|;[^\n]*|\$\d+|\d+\.(?:\.\.)?|[!?]+")
_SAN = re.compile(r"^([NBRQK]?)([a-h]?)([1-8]?)x?([a-h][1-8])(?:=?([NBRQ]))?[+#]?$")
_ENDS = ("1-0", "0-1", "1/2-1/2", "*")


def san_move(board: Board, san: str) -> Move:
    """The legal move that a short algebraic text names."""
    text = san.rstrip("+#")
    if text.replace("0", "O") in ("O-O", "O-O-O"):
        stop = (6 if len(text) == 3 else 2) + 56 * board.turn
        found = [m for m in board.legal() if board.is_castle(m) and m.stop == stop]
    else:
        m = _SAN.match(san)
        if not m:
            raise ValueError(f"not a move: {san}")
        kind, file, rank, to, promotion = m.groups()
        found = [
            x
            for x in board.legal()
            if x.stop == square(to)
            and board.squares[x.start].upper() == (kind or "P")
            and (not file or "abcdefgh"[x.start & 7] == file)
            and (not rank or str((x.start >> 3) + 1) == rank)
            and x.promotion == (promotion or "").lower()
            and not board.is_castle(x)
        ]
    if len(found) != 1:
        raise ValueError(f"{san} names {len(found)} moves")
    return found[0]


def _without_variations(text: str) -> str:
    out, depth = [], 0
    for part in re.split(r"([()])", text):
        if part == "(":
            depth += 1
        elif part == ")":
            depth = max(depth - 1, 0)
        elif not depth:
            out.append(part)
    return "".join(out)


def parse_game(headers: dict[str, str], body: str) -> tuple[str, list[str], str] | None:
    """(start position, mainline, result), or nothing for a broken or empty game."""
    start = headers.get("FEN", START)
    moves: list[str] = []
    result = headers.get("Result", "*")
    try:
        board = Board.of(start)
        for word in _without_variations(_SKIP.sub(" ", body)).split():
            if word in _ENDS:
                result = word
                break
            m = san_move(board, word)
            moves.append(m.uci())
            board = board.push(m)
    except (ValueError, IndexError):
        return None
    return (start, moves, result) if moves else None


def games(lines: Iterator[str]) -> Iterator[tuple[dict[str, str], str]]:
    """(headers, move text) of every game of a stream of lines."""
    headers: dict[str, str] = {}
    body: list[str] = []
    for line in lines:
        m = _HEADER.match(line.strip())
        if m:
            if body:
                yield headers, "\n".join(body)
                headers, body = {}, []
            headers[m[1]] = m[2].replace('\\"', '"')
        elif line.strip():
            body.append(line)
    if body:
        yield headers, "\n".join(body)


def open_text(raw: io.BufferedIOBase, name: str) -> io.TextIOBase:
    if name.endswith(".zst"):
        import zstandard

        raw = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
    return io.TextIOWrapper(raw, encoding="utf-8", errors="replace")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], most: int | None):
        self.paths, self.most = paths, most

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File):
        with open(partition.path.removeprefix("file:"), "rb") as raw:
            kept = 0
            for n, (headers, body) in enumerate(games(open_text(raw, partition.path))):
                game = parse_game(headers, body)
                if game is not None:
                    yield partition.path, n, headers, game[0], game[1], game[2]
                    kept += 1
                    if self.most is not None and kept >= self.most:
                        return


class PgnSource(DataSource):
    """Reads paths that every executor mounts; ``from_bytes`` reads any store through Spark."""

    @classmethod
    def name(cls) -> str:
        return "pgn"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        import glob

        most = self.options.get("max_games")
        found = sorted(glob.glob(self.options["path"].removeprefix("file:")))
        if not found:
            raise FileNotFoundError(self.options["path"])
        return _Reader(found, int(most) if most else None)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PgnSource)


def from_bytes(spark: SparkSession, paths: list[str] | str, max_games: int | None = None) -> DataFrame:
    """Games of files in any store that Spark reads, a file a row and task slot."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = []
                for n, (headers, body) in enumerate(games(open_text(io.BytesIO(content), path))):
                    game = parse_game(headers, body)
                    if game is not None:
                        rows.append((path, n, headers, *game))
                        if max_games is not None and len(rows) >= max_games:
                            break
                yield pd.DataFrame(rows, columns=["file", "game_no", "headers", "start_fen", "moves", "result"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, SCHEMA)


def chained(df: DataFrame, most: int) -> DataFrame:
    """The first ``most`` games in file order."""
    return df.orderBy("file", "game_no").limit(most)


def game_ids(df: DataFrame) -> DataFrame:
    """``df`` with game_id: twenty hex digits of SHA-256 over the start position and the moves."""
    return df.withColumn("game_id", F.substring(F.sha2(F.concat(F.col("start_fen"), F.lit("\0"), F.array_join("moves", " ")), 256), 1, 20))
