"""Media columns: texts or bytes stored as progressive JPEG, read back as RGB tensors.

``store_tensors`` keeps the decoded tensors; ``round_trip`` decodes them for its features
without storing them, since they take three bytes a sample.

Defined cases: a null text is stored like an empty one, as 64 zero bytes; equal
payloads give equal media and features; a media value that cannot be read whole
gives null tensors (``error`` says why) instead of failing the job.  Rows that
repeat a doc_id each give a row, an empty table none; very long texts make one tall
picture; there are no ties; further columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import jpeg
from .shared import id_text, materialize

#: Media bytes that one Arrow batch gathers before it is sent on.
BATCH = 8 << 20


def pad(raw: bytes, to: int = 64) -> bytes:
    """``raw`` and bytes 0 up to a positive multiple of ``to``."""
    return raw + bytes(-len(raw) % to if raw else to)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every whole text as one progressive JPEG."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ids, sizes, media, held = [], [], [], 0
            for i, t in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                raw = (t.as_py() or "").encode("utf-8")
                ids.append(i)
                sizes.append(len(raw))
                media.append(jpeg.encode_payload(pad(raw)))
                held += len(media[-1])
                if held >= BATCH:
                    yield _stored(batch, ids, sizes, media)
                    ids, sizes, media, held = [], [], [], 0
            yield _stored(batch, ids, sizes, media)

    kind = dict(docs.dtypes)["doc_id"]
    return id_text(docs).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def _stored(batch, ids, sizes, media) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i.as_py() for i in ids], batch.schema.field("doc_id").type), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def tensors(media: DataFrame, column: str = "media") -> DataFrame:
    """All columns and height, width, rgb (row-major 8-bit samples), error."""
    from pyspark.sql import types as T

    schema = T.StructType([*media.schema.fields, T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("rgb", T.BinaryType()), T.StructField("error", T.StringType())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for k in range(batch.num_rows):
                data = batch.column(column)[k].as_py()
                h = w = rgb = error = None
                try:
                    x = jpeg.tensor(jpeg.decode(data)) if data is not None else None
                    if x is not None:
                        (h, w, _), rgb = x.shape, x.tobytes()
                except jpeg.BadMedia as e:
                    error = str(e)
                one = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([h], pa.int32()), pa.array([w], pa.int32()), pa.array([rgb], pa.binary()), pa.array([error], pa.string())], [f.name for f in schema.fields])

    return media.mapInArrow(run, schema)


def store_tensors(media: DataFrame, path: str, column: str = "media") -> None:
    """Write the full-resolution tensors of ``media`` to ``path``: its other columns, height, width, rgb, error.

    Row groups are bounded and rgb stands apart from the small columns, so a reader of sizes or
    errors alone skips the samples.
    """
    options = {"parquet.block.size": str(16 << 20), "parquet.page.size": str(1 << 20), "compression": "zstd", "parquet.enable.dictionary": "false"}
    tensors(media, column).drop(column).write.options(**options).parquet(path)


def digests(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what the stored bytes say: payload and media digests and the tensor's feature."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for m in batch.column("media"):
                data = m.as_buffer().to_pybytes()
                image = jpeg.decode(data)
                payload = jpeg.payload_of(image)
                out["payload_bytes"].append(len(payload))
                out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                out["tail_crc32"].append(zlib.crc32(payload[-64:]))
                out["media_bytes"].append(len(data))
                out["media_sha256"].append(hashlib.sha256(data).hexdigest())
                out["feature"].append(jpeg.feature(jpeg.tensor(image)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), **{k: pa.array(v, pa.string() if k in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for k, v in out.items()}})

    kind = dict(stored.dtypes)["doc_id"]
    return stored.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def round_trip(docs: DataFrame) -> DataFrame:
    """Store every text, read the stored files back, and digest them."""
    options = {"parquet.block.size": str(16 << 20), "compression": "zstd", "parquet.enable.dictionary": "false"}
    return digests(materialize(store(docs), "media", **options))
