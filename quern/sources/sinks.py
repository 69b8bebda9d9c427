"""Sinks: checked writes with manifests, shards, ordered assembly, PGN, markdown."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import shard_of
from ..operators.dedup import IdentityError


class SinkError(ValueError):
    """Output that exists already, is locked, or does not match."""


def identity(settings: dict) -> str:
    """Digest of canonical JSON: sorted keys, no spaces."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def write_json_atomic(path: str, value: dict) -> None:
    """Write a small JSON file through a rename."""
    tmp = f"{path}.tmp-{os.getpid()}"
    with open(tmp, "w", encoding="utf-8") as f:
        json.dump(value, f, sort_keys=True, indent=1)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, path)


def table_digest(df: DataFrame) -> tuple[int, str]:
    """(rows, digest) of a table, whatever its order: a sum of row hashes, aggregated partially."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda k: F.sum(F.conv(F.substring(row, 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{k}")
    r = df.agg(F.count("*").alias("n"), *[part(k) for k in range(4)]).first()
    return r["n"], hashlib.sha256("|".join(str(r[f"p{k}"]) for k in range(4)).encode()).hexdigest()


def write_jsonl(df: DataFrame, path: str) -> tuple[int, str]:
    """JSON lines; refuses to overwrite (the commit protocol renames whole tasks); returns rows and digest of what was written."""
    df.write.mode("errorifexists").json(path)
    return table_digest(df.sparkSession.read.schema(df.schema).json(path))


def publish(df: DataFrame, path: str, accept_identical: bool = True) -> tuple[int, str]:
    """Write a Parquet table once; an existing one is accepted only if its content is the same."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        there = table_digest(spark.read.parquet(path))
        if accept_identical and there == table_digest(df):
            return there
        raise SinkError(f"{path} exists with other content")
    df.write.parquet(path)
    return table_digest(spark.read.parquet(path))


def write_dataset(df: DataFrame, path: str, config: dict) -> None:
    """A Parquet dataset (its schema stays even without rows) and its sidecar configuration."""
    df.write.mode("errorifexists").parquet(path)
    rows = [(json.dumps(config, sort_keys=True),)]
    df.sparkSession.createDataFrame(rows, "value string").coalesce(1).write.text(f"{path.rstrip('/')}.config")


def read_sidecar(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path.rstrip('/')}.config").first()[0])


def concatenate(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Datasets in sorted order of their names; their ``pov`` flags and columns must agree, which is checked before anything is read."""
    flags = {p: read_sidecar(spark, p).get("pov") for p in sorted(paths)}
    if len(set(flags.values())) > 1:
        raise SinkError(f"point-of-view flags differ: {flags}")
    parts = [spark.read.parquet(p) for p in sorted(paths)]
    if len({tuple(sorted(p.columns)) for p in parts}) > 1:
        raise SinkError("columns differ")
    return reduce(DataFrame.unionByName, parts)


def write_shards(df: DataFrame, path: str, key: str, line: str, shards: int) -> DataFrame:
    """Original lines in hash shards of their key; equal keys must have equal lines, which then count
    once.  Returns shard, rows and digest of what was written."""
    clash = df.groupBy(key).agg(F.count_distinct(F.sha2(line, 256)).alias("n")).filter("n > 1").limit(1).collect()
    if clash:
        raise IdentityError(f"{clash[0][key]} has several contents")
    once = df.groupBy(key).agg(F.min(line).alias(line))
    out = once.withColumn("shard", shard_of(key, shards))
    out.select("shard", key, line).repartition(shards, "shard").sortWithinPartitions("shard", key).write.partitionBy("shard").mode("errorifexists").parquet(path)
    part = F.conv(F.substring(F.sha2(line, 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.sparkSession.read.parquet(path).groupBy("shard").agg(F.count("*").alias("rows"), F.sum(part).cast("string").alias("digest"))


def assemble(chunks: DataFrame, order: DataFrame, key: str, place: str) -> DataFrame:
    """Chunks in the required order; a required key that is missing is an error."""
    missing = order.join(chunks.select(key), key, "left_anti").limit(1).collect()
    if missing:
        raise SinkError(f"{missing[0][key]} is missing")
    return order.select(key, place).join(chunks, key).orderBy(place)


def chunk_name(first: int, last: int, ids: list[str]) -> str:
    """Name of an immutable chunk: its line range and the digest of its ids."""
    return f"{first:09d}-{last:09d}-{hashlib.sha256(chr(0).join(ids).encode()).hexdigest()[:16]}"


def held_and_kept(df: DataFrame, reason: str, path: str) -> None:
    """Two tables of one audited frame: kept rows and held rows with their reason."""
    df.filter(F.col(reason).isNull()).drop(reason).write.mode("errorifexists").parquet(f"{path}/kept")
    df.filter(F.col(reason).isNotNull()).write.mode("errorifexists").parquet(f"{path}/held")


@contextlib.contextmanager
def single_writer(path: str) -> Iterator[None]:
    """A lock file on an output, held by one driver."""
    import fcntl

    with open(f"{path}.lock", "a", encoding="utf-8") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            raise SinkError(f"{path} is being written") from e
        yield


def pgn_text(games: DataFrame, moves: str = "moves") -> DataFrame:
    """game_id, pgn: headers and numbered moves (UCI) of each game."""
    n = F.size(moves)
    numbered = F.transform(F.col(moves), lambda m, i: F.when(i % 2 == 0, F.concat(((i / 2).cast("int") + 1).cast("string"), F.lit(". "), m)).otherwise(m))
    head = F.concat(F.lit('[White "'), "white", F.lit('"]\n[Black "'), "black", F.lit('"]\n[Result "'), "result", F.lit('"]\n\n'))
    return games.select("game_id", F.concat(head, F.when(n > 0, F.concat(F.array_join(numbered, " "), F.lit(" "))).otherwise(""), "result", F.lit("\n")).alias("pgn"))


def markdown(df: DataFrame, most: int = 100) -> str:
    """A small result table as markdown; raises beyond ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise SinkError(f"more than {most} rows")
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *["| " + " | ".join("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows]]) + "\n"


def in_order(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """One text a group, its values in order (groups are files of bounded size)."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(value).cast("string").alias("v"))))
    return df.groupBy(group).agg(F.array_join(F.transform(rows, lambda r: r["v"]), "\n").alias("text"))
