"""Quality by compression: a text resembles the side whose dictionary packs it better.

Two zstandard dictionaries are built, one from texts labelled 1 and one from
texts labelled 0.  A text is cut into pieces of ``SPAN`` bytes, small enough that a
dictionary and not the text itself explains them, and each piece is packed with
both.  With a and b the two sizes, a piece's normalised difference is
(b - a) / (a + b).  The score is a logistic curve over nothing but such differences:
that of the summed sizes, the pieces' mean, their lower decile and their least, so
that a text with some bad stretches is told from one without.  The curve is fitted on
further labelled rows and gives a probability of label 1.

The fit uses a bounded sample: at most ``ROWS`` rows of each label for the
dictionaries and as many for the curve, taken in the order of a hash of doc_id
from all labelled rows that are not held out, and of each row at most ``PIECES``
pieces of ``PIECE`` characters, spread evenly over its text.  Scoring covers every row
and every byte.

Defined cases: null and empty texts get the share of label 1 in the labelled
rows; without both labels no dictionary can be built and every row gets that
share (0.5 without any label); repeated label rows count once, contradicting
ones not at all; rows that repeat a doc_id each give a row, and the fit takes the
least of their texts; a null doc_id is not held out and never fitted on; very long
texts are packed piece by piece; equal texts have equal scores, and ties of the
hash go by doc_id; an empty table gives no row; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_text

#: Labelled rows of each label for the dictionaries, and again for the curve.
ROWS = 1000
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: Characters of a dictionary sample, and how many of them a fitted row gives at most.
PIECE, PIECES = 2048, 16
#: Bytes of a scored piece; a shorter end goes with the piece before it.
SPAN = 128


@dataclass
class Model:
    good: bytes
    bad: bytes
    prior: float
    #: Means and deviations of the differences, then the weights of a constant and the differences.
    means: tuple[float, ...] = ()
    deviations: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()

    def differences(self, texts: list[str | None]) -> np.ndarray:
        """Normalised size difference of each text's sums, and its pieces' mean, lower decile and least."""
        import zstandard as zstd

        if not hasattr(self, "_packers"):
            self._packers = []
            for d in (self.good, self.bad):
                loaded = zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_FULLDICT)
                loaded.precompute_compress(level=LEVEL)
                self._packers.append(zstd.ZstdCompressor(level=LEVEL, dict_data=loaded, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        good, bad = self._packers
        out = np.zeros((len(texts), 4))
        for k, t in enumerate(texts):
            raw = (t or "").encode("utf-8")
            if raw:
                cuts = [*range(0, max(len(raw) - SPAN // 2, 1), SPAN), len(raw)]
                sizes = np.array([(len(good(raw[i:j])), len(bad(raw[i:j]))) for i, j in zip(cuts, cuts[1:], strict=False)])
                a, b = sizes.sum(0)
                d = np.sort((sizes[:, 1] - sizes[:, 0]) / sizes.sum(1))
                out[k] = (b - a) / (a + b), d.mean(), d[len(d) // 10], d[0]
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.good:
            return np.full(len(texts), self.prior)
        x = (self.differences(texts) - np.array(self.means)) / np.array(self.deviations)
        z = self.weights[0] + x @ np.array(self.weights[1:])
        out = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return np.where(np.array([bool(t) for t in texts], bool), out, self.prior)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_packers"}


def _dictionary(texts: list[str]) -> bytes:
    import zstandard as zstd

    samples = [raw[k : k + PIECE] for t in texts if (raw := t.encode("utf-8")) for k in range(0, len(raw), PIECE)]
    samples = [s for s in samples if len(s) >= 8]
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 10))
    try:
        return zstd.train_dictionary(size, samples).as_bytes()
    except zstd.ZstdError:  # too few samples to train on
        return b""


def _fit_curve(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression with a small ridge, by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (w * (y - p)) - 1e-2 * beta
        hess = (a * (w * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(a.shape[1])
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def learn(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    """Fit on rows of ``labels`` (doc_id, quality) that are not held out."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most")
    share = known.agg(F.avg("quality")).first()[0]
    if share is None:
        return Model(b"", b"", 0.5)
    order = F.xxhash64(F.col("doc_id").cast("string"))
    picked = None
    for label in (0, 1):  # a bounded top of each label
        some = known.filter(F.col("quality") == label).select("doc_id", "quality").orderBy(order, "doc_id").limit(2 * rows)
        picked = some if picked is None else picked.unionByName(some)
    long = F.length("text")
    some = F.least(F.lit(PIECES), F.ceil(long / PIECE))
    pieces = F.transform(F.sequence(F.lit(0).cast("long"), some - 1), lambda i: F.col("text").substr((F.floor(i * long / some) + 1).cast("int"), F.lit(PIECE)))
    sample = F.when(long <= PIECE * PIECES, F.col("text")).otherwise(F.array_join(pieces, ""))
    rows_of = id_text(docs).filter("text is not null").join(F.broadcast(picked), "doc_id").select("quality", "doc_id", sample.alias("text"), order.alias("place"))
    got = rows_of.groupBy("quality", "doc_id", "place").agg(F.min("text").alias("text")).collect()  # at most 4 * rows ids of bounded texts
    got.sort(key=lambda r: (r.place, r.doc_id, r.text))
    train: dict[int, list[str]] = {0: [], 1: []}
    curve: list[tuple[int, str]] = []
    for k, r in enumerate(got):
        if k % 2 == 0:
            train[r.quality].append(r.text)
        elif r.text:
            curve.append((r.quality, r.text))
    model = Model(_dictionary(train[1]), _dictionary(train[0]), float(share))
    y = np.array([q for q, _ in curve], float)
    if not model.good or not model.bad or len(set(y.tolist())) < 2:
        return Model(b"", b"", float(share))
    x = model.differences([t for _, t in curve])
    mean, dev = x.mean(0), np.maximum(x.std(0), 1e-9)
    # the sample is drawn by label; weights bring back the labels' shares
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    beta = _fit_curve((x - mean) / dev, y, weight)
    model.means, model.deviations, model.weights = tuple(mean.tolist()), tuple(dev.tolist()), tuple(beta.tolist())
    return model


def score(docs: DataFrame, labels: DataFrame, at: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= ``at``) of every row."""
    model = learn(docs, labels)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(batch.column("text").to_pylist()))], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    scored = id_text(docs).mapInArrow(run, f"doc_id {kind}, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, "score", F.when(F.col("score") >= at, 1).otherwise(0).cast("int").alias("predicted"))
