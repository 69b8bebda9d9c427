"""Helpers that every operator of this subpackage shares: shared-folder tables,
size-checked broadcasts and column-name hygiene."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its rows times a row width stay below this.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it.  Where the setting is absent on a local master (tests)
    a temporary folder is made once and recorded; on a cluster that is an error, since executors
    would not see it.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.conf.get("spark.quern.scratch", None)
        if not at:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            at = tempfile.mkdtemp(prefix="quern-")
            spark.conf.set("spark.quern.scratch", at)
    return at.rstrip("/")


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage with replicated-by-storage files, so a lost executor costs
    no recomputation of what lies before.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and nothing reads any more."""
    for df in tables:
        path = getattr(df, "_quern_path", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


#: What the operator that used this worker process last keeps over its tasks, by operator.
_kept: dict[str, dict] = {}


def kept(operator: str) -> dict:
    """What ``operator`` keeps in this process from task to task.

    A worker process serves every stage of a session.  What another operator kept goes, so a
    process never holds the tokenizers and caches of several.
    """
    if operator not in _kept:
        _kept.clear()
        _kept[operator] = {}
    return _kept[operator]


def give_back() -> None:
    """Return freed memory to the system, which neither Arrow's pool nor the C library does on its own."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, operator: str = "") -> DataFrame:
    """``df.mapInArrow(run, schema)`` by workers that hold only what ``operator`` keeps; between tasks the rest is the system's."""

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(operator)
        give_back()
        try:
            yield from run(rows)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def maybe_broadcast(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """Hint a broadcast when the counted size is below ``BROADCAST_BYTES``;
    beyond it the frame comes back unchanged and the join shuffles."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes <= BROADCAST_BYTES else df


def id_text(docs: DataFrame, *extra: str) -> DataFrame:
    """Only the columns that an operator reads, so clashing extra columns of the
    input never meet the operator's own names."""
    return docs.select("doc_id", "text", *extra)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of one key that stay in one task, whatever the size; beyond, a key may hold a DEALT-th of all rows.
KEY_ROWS, DEALT = 64, 2000


def dealt_join(rows: DataFrame, side: DataFrame, key: str, by: str, how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """``rows`` join ``side`` on ``key``, where ``side`` has a key once and ``rows`` may have it very often.

    The rows of a hot key are dealt over several tasks by the column ``by``, and the side's row
    goes to each of them.  A key is hot beyond ``KEY_ROWS`` rows and a ``DEALT``-th of all, so
    there are at most ``DEALT`` of them.  ``counted`` stands for ``rows`` where that is cheaper to
    count.  Null keys meet nothing and are dealt as well.
    """
    seen = rows if counted is None else counted
    spark = rows.sparkSession
    limit = max(KEY_ROWS, seen.count() // DEALT)
    hot = seen.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > limit).collect()
    if not hot and how != "left":
        return rows.join(side, key, how)
    parts, deal = fresh(rows, "__parts"), fresh(rows, "__deal")
    sizes = pa.table({key: pa.array([r[0] for r in hot], pa.int64()), parts: pa.array([-(-r[1] // limit) for r in hot], pa.int64())})
    sizes = F.broadcast(spark.createDataFrame(sizes))
    spread = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(by), F.lit(1 << 20))).otherwise(F.coalesce(F.pmod(F.xxhash64(by), F.col(parts)), F.lit(0)))
    left = rows.join(sizes, key, "left").withColumn(deal, spread).drop(parts)
    right = side.join(sizes, key, "left").withColumn(deal, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(parts), F.lit(1)) - 1))).drop(parts)
    return left.join(right, [key, deal], how).drop(deal)
