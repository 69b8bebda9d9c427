"""File sources: globs, JSON lines, polymorphic rows, snapshots, numbered scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SourceError(ValueError):
    """A source that is missing, changed or malformed."""


def resolve(spark: SparkSession, patterns: list[str]) -> list[str]:
    """Paths of the patterns, each once in first-seen order, sorted within a pattern; an error where
    one matches nothing.  Uses the cluster's file systems."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out: list[str] = []
    for p in patterns:
        path = jvm.org.apache.hadoop.fs.Path(p)
        found = path.getFileSystem(conf).globStatus(path)
        names = sorted(s.getPath().toString() for s in found) if found else []
        if not names:
            raise SourceError(f"nothing matches {p}")
        out += [n for n in names if n not in out]
    return out


def read_jsonl(spark: SparkSession, paths: list[str] | str, schema: str | T.StructType, torn: str = "skip") -> DataFrame:
    """JSON lines (plain or compressed) under a declared schema.

    ``torn``: ``skip`` drops lines that do not parse, ``fail`` raises, ``keep`` adds them as ``_torn``.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if torn == "fail":
        return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)
    wide = T.StructType([*schema.fields, T.StructField("_torn", T.StringType())])
    df = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_torn").json(paths)
    return df if torn == "keep" else df.filter("_torn is null").drop("_torn")


def numbered_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """file, line (from 0), value of text files, in file order: a file's blocks are numbered by their start."""
    df = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    w = Window.partitionBy("file").orderBy("block", "at")
    return df.withColumn("line", F.row_number().over(w) - 1).select("file", "line", "value")


def pool(spark: SparkSession, paths: list[str] | str, keep=None) -> DataFrame:
    """idx, file, line, value: a dense global row number in (file, line) order; lines for which
    ``keep(value)`` is false use no number up.  Files get offsets from a sum over one row each."""
    df = numbered_lines(spark, paths)
    if keep is not None:
        df = df.filter(keep(F.col("value")))
    sizes = df.groupBy("file").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = df.withColumn("own", F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1)
    return at.join(sizes.select("file", before.alias("before")), "file").select((F.col("before") + F.col("own")).alias("idx"), "file", "line", "value")


def decode_rows(lines: DataFrame, value: str = "value") -> DataFrame:
    """start_fen, moves, fen, ahead_moves, ahead_fen, games from polymorphic JSON rows, told apart by
    their form: an array of 3 (triple), 5 (with lookahead) or 4 (with games), or a motif object."""
    v = F.col(value)
    at = lambda k: F.get_json_object(v, f"$[{k}]")
    n = F.coalesce(F.json_array_length(v), F.lit(-1))
    moves = lambda c: F.from_json(c, "array<string>")
    is_object = F.ltrim(v).startswith("{")
    tail = at(3)
    games = F.when((n == 4) & F.ltrim(tail).startswith("{"), F.from_json(F.get_json_object(tail, "$.games"), "array<struct<white:string,black:string,result:string,moves:array<string>>>"))
    flat = (n == 4) & F.ltrim(tail).startswith("[")
    return lines.select(
        F.when(is_object, F.get_json_object(v, "$.start_fen")).otherwise(at(0)).alias("start_fen"),
        F.when(is_object, moves(F.get_json_object(v, "$.moves"))).otherwise(moves(at(1))).alias("moves"),
        F.when(is_object, F.get_json_object(v, "$.fen")).otherwise(at(2)).alias("fen"),
        F.when(n == 5, moves(tail)).when(flat, moves(F.get_json_object(tail, "$[0]"))).alias("ahead_moves"),
        F.when(n == 5, at(4)).when(flat, F.get_json_object(tail, "$[1]")).alias("ahead_fen"),
        games.alias("games"),
    ).filter("fen is not null")


def seeds(lines: DataFrame, value: str = "value") -> DataFrame:
    """record_id, fen, history (at most the last seven), extra of list or object seeds; a missing id is the position key's digest."""
    v = F.col(value)
    is_object = F.ltrim(v).startswith("{")
    fen = F.when(is_object, F.get_json_object(v, "$.fen")).otherwise(F.get_json_object(v, "$[2]"))
    past = F.when(is_object, F.from_json(F.get_json_object(v, "$.history"), "array<string>")).otherwise(F.array(F.get_json_object(v, "$[0]")))
    past = F.coalesce(past, F.array().cast("array<string>"))
    ident = F.when(is_object, F.get_json_object(v, "$.record_id"))
    extra = F.when(is_object, F.from_json(F.get_json_object(v, "$.extra"), "map<string,string>"))
    out = lines.select(F.coalesce(ident, F.md5(F.substring_index(fen, " ", 4))).alias("record_id"), fen.alias("fen"), F.slice(past, F.greatest(F.size(past) - 6, F.lit(1)), 7).alias("history"), extra.alias("extra"))
    return out.filter("fen is not null")


def inventory(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, size, modified of the files that a scan would read."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def verify_unchanged(frozen: DataFrame, spark: SparkSession, paths: list[str]) -> None:
    """Raise if a file came, went or changed since ``frozen`` was taken."""
    now = inventory(spark, paths)
    rows = frozen.exceptAll(now).unionByName(now.exceptAll(frozen)).limit(1).collect()
    if rows:
        raise SourceError(f"{rows[0]['path']} changed")


def tagged_views(df: DataFrame, tag: str, kinds: list[str]) -> dict[str, DataFrame]:
    """One read of mixed rows as a frame for each tag."""
    unknown = df.filter(~F.col(tag).isin(kinds) | F.col(tag).isNull()).limit(1).collect()
    if unknown:
        raise SourceError(f"unknown row kind {unknown[0][tag]}")
    return {k: df.filter(F.col(tag) == k) for k in kinds}


def benchmark_samples(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Samples of one JSON document; ids must be non-empty and unique."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    bad = df.filter("sample_id is null or sample_id = ''").limit(1).collect() or df.groupBy("sample_id").count().filter("count > 1").limit(1).collect()
    if bad:
        raise SourceError("sample ids must be unique and not empty")
    return df


def puzzle_rows(df: DataFrame) -> DataFrame:
    """Puzzle records (id, fen, moves, rating, themes) with the setup move split from the solution and a rating bin."""
    size = F.size("moves")
    return df.filter(size >= 2).select(F.col("id").alias("puzzle_id"), "fen", "rating", (F.floor(F.col("rating") / 200) * 200).cast("int").alias("rating_bin"), "themes", F.get("moves", F.lit(0)).alias("setup_move_uci"), F.get("moves", F.lit(1)).alias("correct_move_uci"), F.slice("moves", 2, F.greatest(size - 1, F.lit(1))).alias("solution_uci"))
