"""Levels with checkpoints, resumable appends, streaming dedup and state."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import SinkError, identity


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def claim_run(spark: SparkSession, path: str, settings: dict) -> None:
    """Record a run's identity, or refuse to resume under other settings."""
    mine = identity(settings)
    at = f"{path.rstrip('/')}/run"
    if _exists(spark, at):
        there = json.loads(spark.read.text(at).first()[0])["identity"]
        if there != mine:
            raise SinkError("inputs or settings changed since the run began")
        return
    spark.createDataFrame([(json.dumps({"identity": mine, "settings": settings}, sort_keys=True),)], "value string").coalesce(1).write.text(at)


def levels(spark: SparkSession, start: DataFrame, act: Callable[[DataFrame, int], DataFrame], path: str, most: int = 5, settings: dict | None = None) -> DataFrame:
    """Bounded recursion over tables: ``act(level rows, depth)`` returns the rows with ``decision``
    (accept, discard or recurse) and ``reason``; recursing rows go to the next level, those of the
    last one are discarded.  Each level is a written table, so a run resumes after the last whole
    level; returns all decided rows with their ``depth``."""
    claim_run(spark, path, settings or {})
    done: list[DataFrame] = []
    now = start
    for depth in range(most):
        at = f"{path.rstrip('/')}/level-{depth}"
        if not _exists(spark, f"{at}/_SUCCESS"):
            out = act(now, depth)
            last = F.lit(depth + 1 >= most) & (F.col("decision") == "recurse")
            out = out.withColumn("reason", F.when(last, "depth limit").otherwise(F.col("reason"))).withColumn("decision", F.when(last, "discard").otherwise(F.col("decision")))
            out.withColumn("depth", F.lit(depth)).write.mode("overwrite").parquet(at)
        rows = spark.read.parquet(at)
        done.append(rows.filter("decision <> 'recurse'"))
        now = rows.filter("decision = 'recurse'").drop("decision", "reason", "depth")
        if now.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def retry(spark: SparkSession, rows: DataFrame, act: Callable[[DataFrame, int], DataFrame], times: int, path: str) -> DataFrame:
    """Run ``act`` on all rows, then again on those whose ``ok`` is false, at most ``times`` in all."""
    parts, now = [], rows
    for k in range(times):
        at = f"{path.rstrip('/')}/try-{k}"
        act(now, k).write.mode("overwrite").parquet(at)
        got = spark.read.parquet(at)
        again = got.filter("not ok")
        last = k + 1 == times or again.isEmpty()
        parts.append(got if last else got.filter("ok"))
        if last:
            break
        now = again.select(*rows.columns)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def append_new(spark: SparkSession, rows: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the table does not hold yet; returns how many."""
    fresh = rows.dropDuplicates([key])
    if _exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    before = spark.read.parquet(path).count() if _exists(spark, path) else 0
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def stream_new(stream: DataFrame, path: str, checkpoint: str, key: str, once: bool = True):
    """Stream rows into a Parquet table, a key once; offsets and seen keys live in the checkpoint, so a
    stopped query goes on where its last whole batch ended."""
    writer = stream.dropDuplicates([key]).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_chunks(stream: DataFrame, path: str, checkpoint: str):
    """Write each micro-batch as an immutable chunk named by its id; a repeated batch rewrites its own chunk."""

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/chunk={batch:09d}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, keys: list[str], window: str, late: str) -> DataFrame:
    """Counts per event-time window with a watermark; works on streams and tables."""
    at = stream.withColumn(time, F.col(time).cast("timestamp"))
    at = at.withWatermark(time, late) if at.isStreaming else at
    return at.groupBy(F.window(time, window).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str) -> DataFrame:
    """Sessions of events that follow within a gap."""
    at = events.withColumn(time, F.col(time).cast("timestamp"))
    return at.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


GAME_SCHEMA = "game_id string, version int, action string, uci string, applied boolean, reason string, fen string"


def game_states(log: DataFrame) -> DataFrame:
    """Fold an event log (game_id, seq, version, action, uci) into accepted and rejected steps.

    A step applies to the version it names: others are stale.  ``move`` plays a legal move,
    ``back`` takes the last two plies back, ``resign`` ends the game, ``claim`` ends it if a
    draw can be claimed; every accepted step raises the version.  Games are independent, a
    game's log is read in order.
    """
    import pandas as pd

    from ..chess import rules

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        boards, version, over, rows = [rules.Board.of(rules.START)], 0, False, []
        for g, v, action, uci in pdf.sort_values("seq")[["game_id", "version", "action", "uci"]].itertuples(index=False, name=None):
            reason = None
            if over:
                reason = "the game is over"
            elif v != version:
                reason = "stale version"
            elif action == "move":
                try:
                    boards = [*boards, boards[-1].play(uci or "")]
                    over = not boards[-1].legal()
                except (rules.IllegalMove, ValueError, IndexError):
                    reason = "illegal move"
            elif action == "back":
                if len(boards) > 2:
                    boards = boards[:-2]
                else:
                    reason = "nothing to take back"
            elif action == "resign":
                over = True
            elif action == "claim":
                over = rules.can_claim_draw(boards) is not None
                reason = None if over else "no draw to claim"
            else:
                reason = "unknown action"
            if reason is None:
                version += 1
            rows.append((g, version, action, uci, reason is None, reason, boards[-1].fen()))
        return pd.DataFrame(rows, columns=["game_id", "version", "action", "uci", "applied", "reason", "fen"])

    return log.groupBy("game_id").applyInPandas(fold, GAME_SCHEMA)
