"""Language identification by rank-order profiles.

A profile is the ranking of the most frequent character n-grams (1 to 3
letters, words padded with a space on each side).  A document's own most
frequent n-grams are compared with each language's profile by the out-of-place
distance: the difference of ranks, or the profile's length for an n-gram that
the profile lacks.  The nearest language wins.

Learning counts n-grams of all training rows in one scan with partial sums per
task; only the top of each language reaches the driver.  Prediction is a map
over the documents.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
ties go to the language first in order; equal counts are ranked by n-gram code;
without any training row everything is ``und``; a null doc_id is not held out.  Rows
that repeat a doc_id each give a row, an empty table none; very long texts are counted
block by block; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import id_text, mapped

#: N-grams of a profile and of a document that are ranked.
PROFILE, OWN = 400, 300
#: Steps in which distances are counted, rows from which a bound is learnt.
STEPS, FEW = 1000, 100
#: N-grams that a task holds before it counts them and sends the counts on.
_HELD = 6_000_000
_letters: list[np.ndarray] = []


def held_out(doc_id: str | Column) -> Column:
    """The fifth of the documents that learning never sees; a null doc_id is not among them."""
    named = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(named.cast("string")) % 5 == 0, F.lit(False))


def letter_table() -> np.ndarray:
    """Per code point the lower-cased letter, or 0 for anything else."""
    if not _letters:
        out = np.zeros(0x110000, np.uint32)
        for c in range(0x30000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                out[c] = ord(low[0])
        _letters.append(out)
    return _letters[0]


def grams(text: str) -> np.ndarray:
    """Codes of all 1- to 3-grams of a text (21 bits a letter); empty without a letter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = letter_table()[points]
    is_letter = low != 0
    if not is_letter.any():
        return np.zeros(0, np.uint64)
    # one zero between words and at both ends
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    x = np.concatenate([[0], low[keep], [0]]).astype(np.uint64)
    two = (x[:-1] << np.uint64(21)) | x[1:]
    three = (two[:-1] << np.uint64(21)) | x[2:]
    one = x[x != 0]
    two = two[two != 0] | np.uint64(1 << 62)
    middle = x[1:-1] != 0
    return np.concatenate([one, two, three[middle] | np.uint64(1 << 63)])


def ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` most frequent codes, ties by code."""
    if len(codes) > 4 * top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))[:top]]


@dataclass
class Profiles:
    """Languages and, over the union of their n-grams, each language's rank."""

    languages: list[str]
    codes: np.ndarray
    ranks: np.ndarray

    def nearest(self, text: str | None) -> tuple[str, float]:
        return self.measured(text)[:2]

    def measured(self, text: str | None) -> tuple[str, float, float]:
        """Nearest language, score, and the out-of-place distance (0 to 1) to that language."""
        found = grams(text) if text else np.zeros(0, np.uint64)
        if not len(found) or not self.languages:
            return "und", 0.0, 1.0
        codes, counts = np.unique(found, return_counts=True)
        own = ranked(codes, counts, OWN)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        known = self.codes[at] == own
        place = np.arange(len(own))
        gap = np.where(known[:, None], np.minimum(np.abs(self.ranks[at] - place[:, None]), PROFILE), PROFILE)
        distance = gap.sum(0) / (PROFILE * len(own))
        order = np.argsort(distance, kind="stable")
        best = float(distance[order[0]])
        rest = float(distance[order[1]]) if len(order) > 1 else 1.0
        return self.languages[order[0]], (0.5 + 0.5 * (rest - best) / rest) * (1.0 - best / 2) if rest > 0 else 1.0, best


def learn(docs: DataFrame) -> Profiles:
    """Profiles of all non-null ``lang`` values of ``docs`` (text, lang)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0
        for batch in rows:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                g = grams(text)
                if len(g):
                    held.setdefault(lang, []).append(g)
                    size += len(g)
                if size > _HELD:
                    for k in list(held):
                        yield _counts(k, held.pop(k))
                    size = 0
        for k, v in held.items():
            yield _counts(k, v)

    sums = mapped(docs.select("text", "lang").filter("lang is not null and text is not null"), run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # ranked in the JVM; PROFILE rows a language reach the driver
    best = sums.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).filter(F.col("place") <= PROFILE)
    rows = best.select("lang", "code", "place").collect()
    languages = sorted({r[0] for r in rows})
    codes = np.unique(np.array([r[1] for r in rows], np.int64).view(np.uint64)) if rows else np.zeros(0, np.uint64)
    ranks = np.full((len(codes), len(languages)), 10 * PROFILE, np.int64)
    for lang, code, place in rows:
        ranks[np.searchsorted(codes, np.uint64(code & 0xFFFFFFFFFFFFFFFF)), languages.index(lang)] = place - 1
    return Profiles(languages, codes, ranks)


def _counts(lang: str, parts: list[np.ndarray]) -> pa.RecordBatch:
    codes, n = np.unique(np.concatenate(parts), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "code", "n"])


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score of every row."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            got = [profiles.nearest(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return mapped(id_text(docs), run, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the rows that are not held out."""
    profiles = learn(docs.filter(~held_out("doc_id")))
    return predict(docs, profiles).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def farthest(docs: DataFrame, profiles: Profiles) -> float:
    """The distance beyond which a text is in none of the languages, from all rows of ``docs`` with a language.

    As far above the 99th percentile of their distances as that lies above the median: a few
    foreign or junk rows among them do not move it.  A hundredth needs ``FEW`` rows to be seen; with
    fewer only texts go that share no n-gram with any profile.  Counts by step of ``1 / STEPS`` reach
    the driver.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            got = [profiles.measured(t) for t in batch.column("text").to_pylist()]
            steps, n = np.unique(np.array([int(np.ceil(g[2] * STEPS)) for g in got if g[0] != "und"], np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(steps), pa.array(n.astype(np.int64))], ["step", "n"])

    counts = mapped(docs.filter("lang is not null and text is not null").select("text"), run, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect()
    if sum(r[1] for r in counts) < FEW:
        return (STEPS - 1) / STEPS
    steps, n = np.array(sorted(tuple(r) for r in counts)).T
    half, most = (int(steps[np.searchsorted(n.cumsum(), share * n.sum())]) for share in (0.5, 0.99))
    return (2 * most - half) / STEPS


def keep_known(docs: DataFrame, least: float = 0.05) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known: not ``und``, no farther from its
    profile than the learnt bound (``farthest``), and scored ``least`` or more.

    The verdict is computed beside the row in one map, so nothing is shuffled.
    """
    train = docs.filter(~held_out("doc_id"))
    profiles = learn(train)
    bound = farthest(train, profiles)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            at = batch.schema.get_field_index("text")
            got = [profiles.measured(t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([g[0] != "und" and g[1] >= least and g[2] <= bound for g in got], pa.bool_()))

    return mapped(docs, run, docs.schema)
