"""Token tables: ids as Parquet list columns.

A table holds one row per document: doc_id, shard, local_start, n_tokens and
``ids array<int>``.  Rows are range-partitioned and sorted by doc_id, so files
and row groups cover ranges; ids are dictionary-encoded (or delta-encoded on
demand), row groups and pages have bounded sizes, and column and offset indexes
let a reader skip pages of ids when it wants metadata or a few documents.

A document's start among all ids is its shard's base plus its place in the
shard; bases are prefix sums over one row per shard.

Defined cases: a null text counts as empty and keeps only the end id; documents
with a null doc_id come first; rows that repeat a doc_id each give a row, in an
unstated order among themselves (so are ties); an empty input writes a table without
rows; very long texts are encoded whole, a row each; further columns are not read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, scan
from .shared import id_text, kept, mapped, shared_dir

#: Bytes of a row group and of a page, rows of a page.
ROW_GROUP, PAGE, PAGE_ROWS = 16 << 20, 256 << 10, 1000
#: Distinct chunks that a worker process remembers, about 200 bytes each.
MEMORY = 800_000
#: Text bytes whose chunks are looked up together.
TOGETHER = 8 << 20


class Library:
    """The tokenizers library with a memory of chunks, which are runs between white space.

    The tokenizer merges inside words only and no word spans white space, so a text's ids
    are its chunks' ids one after another, and a chunk's are its words'; the library's model
    sees each new word once.  Texts with special tokens or characters beyond the fast split
    go through the library whole.  The memory has two generations of ``MEMORY`` / 2 entries:
    what is still in use moves from the old one to the young one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.alphabet = bpe.byte_alphabet()
        self.plain, self.split = bpe.fast_split()
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<i4").tobytes()

    def _word(self, word: str) -> bytes:
        symbols = word if word.isascii() else "".join(map(self.alphabet.__getitem__, word.encode("utf-8")))
        return np.array([t.id for t in self.model.tokenize(symbols)], "<i4").tobytes()

    def _learn(self, need: list[str]) -> None:
        if len(self.known) > MEMORY // 2:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        for chunk in [c for c in need if c not in known]:
            raw = old.get(chunk)
            if raw is None:
                parts = []
                for w in self.split.findall(chunk):
                    ids = known.get(w) or old.get(w) or self._word(w)
                    if len(w) <= bpe.CACHE_CHARS:
                        known[w] = ids
                    parts.append(ids)
                raw = parts[0] if len(parts) == 1 else b"".join(parts)
            known[chunk] = raw

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, dict[int, bytes]]:
        """Ids of the texts one after another, where each text's begin (with the total at the
        end), and apart from them the ids of texts that the library reads whole.

        Chunks are cut, told apart and laid out as arrays; only distinct ones reach the memory.
        """
        apart = {k: self.whole(t) for k, t in enumerate(texts) if "<|" in t or self.plain.search(t)}
        # the fast alphabet's only white space is what this splits at; an empty piece has no ids
        cut = pc.ascii_split_whitespace(pa.array(["" if k in apart else t.lower() for k, t in enumerate(texts)], pa.large_string()))
        coded = cut.values.dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn(chunks)
        raw = list(map(self.known.__getitem__, chunks))
        size = np.fromiter(map(len, raw), np.int32, len(raw)) // 4
        store, begin = np.frombuffer(b"".join(raw), "<i4"), np.cumsum(size, dtype=np.int32) - size
        at = coded.indices.to_numpy()
        n = size[at]
        ends = np.zeros(len(n) + 1, np.int32)
        np.cumsum(n, out=ends[1:])
        ids = store[np.repeat(begin[at] - ends[:-1], n) + np.arange(ends[-1], dtype=np.int32)]
        for w in chunks:
            if len(w) > bpe.CACHE_CHARS:
                del self.known[w]
        return ids, ends[cut.offsets.to_numpy()], apart

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as little-endian 32-bit integers."""
        ids, first, apart = self.flat(texts)
        return [np.frombuffer(apart[k], "<i4") if k in apart else ids[first[k] : first[k + 1]] for k in range(len(texts))]


def library(path: str) -> Library:
    """One library, with its memory, for each worker process and file."""
    libraries = kept("tokens")
    if path not in libraries:
        libraries[path] = Library(path)
    return libraries[path]


def encoded(docs: DataFrame, path: str, end_id: int | None = 1) -> DataFrame:
    """shard, doc_id, local_start, n_tokens, ids of every row, in the order of each partition."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = library(path)
        shard, at = TaskContext.get().partitionId(), 0
        tail = np.array([] if end_id is None else [end_id], "<i4")
        for batch in rows:
            for part in scan.batches(batch, "text", TOGETHER):
                coded = known.encode([t or "" for t in part.column("text").to_pylist()])
                counts = np.array([len(ids) + len(tail) for ids in coded], np.int64)
                ends = np.cumsum(counts)
                flat = np.concatenate([x for ids in coded for x in (ids, tail)]) if coded else tail[:0]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(coded), shard, np.int32)), part.column("doc_id"), pa.array(at + ends - counts), pa.array(counts), lists], ["shard", "doc_id", "local_start", "n_tokens", "ids"])
                at += int(ends[-1]) if len(ends) else 0

    kind = dict(docs.dtypes)["doc_id"]
    return mapped(docs.select("doc_id", "text"), run, f"shard int, doc_id {kind}, local_start long, n_tokens long, ids array<int>", "tokens")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, partitions: int | None = None, encoding: str = "dictionary") -> None:
    """Write the token table of ``docs`` to ``path``.

    ``encoding``: ``dictionary`` or ``delta`` (delta binary packed ids).
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is 'dictionary' or 'delta'")
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = id_text(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    options = {
        "parquet.block.size": str(ROW_GROUP),
        "parquet.page.size": str(PAGE),
        "parquet.page.row.count.limit": str(PAGE_ROWS),
        "parquet.dictionary.page.size": str(1 << 20),
        "parquet.enable.dictionary": "true" if encoding == "dictionary" else "false",
        "parquet.writer.version": "PARQUET_1_0" if encoding == "dictionary" else "PARQUET_2_0",
        "compression": "zstd",
    }
    encoded(ordered, tokenizer, end_id).write.options(**options).parquet(path)


def schema(doc_id: T.DataType | None = None) -> T.StructType:
    fields = [("shard", T.IntegerType()), ("doc_id", doc_id or T.LongType()), ("local_start", T.LongType()), ("n_tokens", T.LongType()), ("ids", T.ArrayType(T.IntegerType()))]
    return T.StructType([T.StructField(*f) for f in fields])


def metadata(spark: SparkSession, path: str, doc_id: T.DataType | None = None) -> DataFrame:
    """doc_id, start, n_tokens; the ids column is not read."""
    table = spark.read.schema(schema(doc_id)).parquet(path)
    return _started(table.drop("ids"), table).drop("shard", "local_start")


def read(spark: SparkSession, path: str, low: int | None = None, high: int | None = None, doc_id: T.DataType | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids of the documents with low <= doc_id < high; the bounds reach the scan and prune row groups and pages."""
    table = spark.read.schema(schema(doc_id)).parquet(path)
    some = table
    if low is not None:
        some = some.filter(F.col("doc_id") >= low)
    if high is not None:
        some = some.filter(F.col("doc_id") < high)
    return _started(some, table).drop("shard", "local_start")


def _started(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with ``start``; one row per shard, so as many as files, is summed and broadcast."""
    sums = table.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sums.select("shard", before.alias("base"))
    names = [c for c in rows.columns if c not in ("shard", "local_start")]
    return rows.join(F.broadcast(bases), "shard").select("shard", "local_start", *[c for c in names if c == "doc_id"], (F.col("base") + F.col("local_start")).alias("start"), *[c for c in names if c != "doc_id"])


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of rows that hold ids."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ids = batch.column("ids")
            flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))
            raw = memoryview(flat).cast("B")
            at = (4 * ids.offsets.to_numpy().astype(np.int64)).tolist()
            sums = [zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = dict(tokens.dtypes)["doc_id"]
    return mapped(tokens.select("doc_id", "start", "n_tokens", "ids"), run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long", "tokens")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the token table into the shared folder, read the files back and sum them up."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer, end_id)
    return checksums(read(spark, path, doc_id=docs.schema["doc_id"].dataType))
