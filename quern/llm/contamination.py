"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item is cut into windows of ``size`` consecutive words (an item of
fewer words is one window).  A window is a set of short shingles; all of them
must stand in a document that contains the window, so one necessary token is
enough as its prefix: the window's rarest shingle by the corpus counts.  The
join meets documents at those prefix tokens only, length and positional bounds
drop candidates that would overhang the text, and what is left is verified
exactly, word by word and byte by byte.

Counts come from a first scan over all documents.  Items are taken in blocks of
at most ``BLOCK_BYTES`` of text, so what each task holds is bounded whatever the
benchmark's size; with one block, nothing of the documents is shuffled.

Defined cases: null or wordless documents have n_words 0, no hit, and are not
contaminated; null or wordless items have no window; items with equal texts are
all reported; an empty benchmark leaves every document clean.  Rows that repeat
a doc_id each give a row, an empty table none; very long texts are read in blocks and
searched whole; of equally rare prefix tokens the least hash is taken; further columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .shared import id_text, mapped, materialize

#: Text bytes of the benchmark items that one pass over the documents looks for.
BLOCK_BYTES = 8 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Index:
    """Windows of a block of items, keyed by one shingle each."""

    def __init__(self, items: list[tuple], size: int, width: int):
        self.size, self.width = size, width
        raw, offsets = scan.text_buffer(pa.array([t for _, t in items], pa.string()))
        words = scan.words_of(raw, offsets, scan.ALNUM, scan.ALNUM_FLAG)
        low = raw.tobytes().translate(_LOWER)
        spans = zip(words.start.tolist(), words.end.tolist(), strict=True)
        self.bytes_of: dict[int, bytes] = {}
        spelled = [low[a:b] for a, b in spans]
        clash = {h for h, w in zip(words.hash.tolist(), spelled, strict=True) if self.bytes_of.setdefault(h, w) != w}
        for h in clash:  # two words of the items share a hash: windows with it are told apart by their bytes
            del self.bytes_of[h]
        self.names = [str(i) for i, _ in items]
        found: dict[tuple, list[int]] = {}
        for k in range(len(items)):
            own = words.hash[words.first[k] : words.first[k + 1]].tolist()
            step = min(size, len(own))
            for at in range(len(own) - step + 1 if step else 0):
                seen = tuple(own[at : at + step])
                first = int(words.first[k]) + at
                holders = found.setdefault((seen, tuple(spelled[first : first + step]) if clash.intersection(seen) else None), [])
                if not holders or holders[-1] != k:
                    holders.append(k)
        self.windows = [w for w, _ in found]
        self.spelled = {k: s for k, (_, s) in enumerate(found) if s is not None}
        self.holders = list(found.values())
        self.tokens = [scan.shingle_hashes(np.array(w, np.uint64), min(width, len(w))) for w in self.windows]

    def token_sets(self) -> dict[int, np.ndarray]:
        """Distinct tokens by their width."""
        by: dict[int, list[np.ndarray]] = {}
        for w, t in zip(self.windows, self.tokens, strict=True):
            by.setdefault(min(self.width, len(w)), []).append(t)
        return {k: np.unique(np.concatenate(v)) for k, v in by.items()}

    def order(self, counts: dict[tuple[int, int], int]) -> None:
        """Choose each window's rarest token and lay the windows out by it."""
        self.prefix: dict[int, tuple] = {}
        by: dict[int, list[tuple[int, int, int]]] = {}
        for k, (w, t) in enumerate(zip(self.windows, self.tokens, strict=True)):
            width = min(self.width, len(w))
            listed = t.tolist()
            at = min(range(len(listed)), key=lambda j: (counts.get((width, listed[j]), 0), listed[j], j))
            by.setdefault(width, []).append((listed[at], at, k))
        for width, rows in by.items():
            rows.sort()
            keys = np.array([r[0] for r in rows], np.uint64)
            distinct, first = np.unique(keys, return_index=True)
            gate = np.zeros(1 << 16, bool)
            gate[distinct >> np.uint64(48)] = True
            self.prefix[width] = (distinct, np.append(first, len(keys)), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), gate)
        self.length = np.array([len(w) for w in self.windows], np.int64)
        self.matrix = np.zeros((len(self.windows), self.size), np.uint64)
        for k, w in enumerate(self.windows):
            self.matrix[k, : len(w)] = w

    def hits(self, words: scan.Words, low: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every verified occurrence."""
        places, windows = [], []
        total = len(words.hash)
        for width, (distinct, first, offset, window, gate) in self.prefix.items():
            tokens = scan.shingle_hashes(words.hash, width)
            at = np.flatnonzero(gate[tokens >> np.uint64(48)])
            k = np.minimum(np.searchsorted(distinct, tokens[at]), len(distinct) - 1)
            same = distinct[k] == tokens[at]
            at, k = at[same], k[same]
            if not len(at):
                continue
            n = first[k + 1] - first[k]
            rows = np.repeat(first[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            start = np.repeat(at, n) - offset[rows]
            which = window[rows]
            stop = start + self.length[which]
            ok = (start >= 0) & (stop <= total)  # positional bound, then both ends in one text
            start, which, stop = start[ok], which[ok], stop[ok]
            doc_of = np.searchsorted(words.first, start, "right")
            ok = stop <= words.first[np.minimum(doc_of, len(words.first) - 1)]
            start, which = start[ok], which[ok]
            for j in range(0, len(start), 100_000):
                s, w = start[j : j + 100_000], which[j : j + 100_000]
                cols = np.arange(self.size)
                seen = words.hash[np.minimum(s[:, None] + cols, total - 1)]
                good = ((seen == self.matrix[w]) | (cols >= self.length[w][:, None])).all(1)
                places.append(s[good])
                windows.append(w[good])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start, which = np.concatenate(places), np.concatenate(windows)
        if not len(start):
            return start, which
        covered = self._cover(start, which, total)
        word = lambda p: low[words.start[p] : words.end[p]]
        if self.spelled:
            same = [w not in self.spelled or all(word(s + j) == x for j, x in enumerate(self.spelled[w])) for s, w in zip(start.tolist(), which.tolist(), strict=True)]
            start, which = start[same], which[same]
            covered = self._cover(start, which, total)
        wrong = [p for p in np.flatnonzero(covered).tolist() if word(p) != self.bytes_of.get(int(words.hash[p]), word(p))]
        if wrong:  # an equal hash of another word: drop the windows over it
            marks = np.zeros(total + 1, np.int64)
            marks[np.array(wrong) + 1] = 1
            marks = np.cumsum(marks)
            keep = marks[start + self.length[which]] == marks[start]
            start, which = start[keep], which[keep]
        return start, which

    def _cover(self, start: np.ndarray, which: np.ndarray, total: int) -> np.ndarray:
        change = np.zeros(total + 1, np.int64)
        np.add.at(change, start, 1)
        np.add.at(change, start + self.length[which], -1)
        return np.cumsum(change[:-1]) > 0


def _blocks(items: DataFrame, size: int, width: int) -> Iterator[Index]:
    """Indexes over blocks of items of bounded size."""
    items = items.select("item_id", "text").filter("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = int(total // BLOCK_BYTES) + 1
    for k in range(n):
        block = items if n == 1 else items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        rows = sorted(((r[0], r[1]) for r in block.collect()), key=lambda r: (str(r[0]), r[1]))
        if rows:
            index = Index(rows, size, width)
            if index.windows:
                yield index


def count_tokens(docs: DataFrame, wanted: dict[int, np.ndarray]) -> dict[tuple[int, int], int]:
    """How often each wanted token (by width) stands in all documents."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {w: np.zeros(len(t), np.int64) for w, t in wanted.items()}
        gates = {}
        for w, t in wanted.items():
            gates[w] = np.zeros(1 << 16, bool)
            gates[w][t >> np.uint64(48)] = True
        for batch in rows:
            for part in scan.batches(batch, "text", 4 << 20):
                raw, offsets = scan.text_buffer(part.column("text"))
                words = scan.words_of(raw, offsets, scan.ALNUM, scan.ALNUM_FLAG)
                for w, t in wanted.items():
                    seen = scan.shingle_hashes(words.hash, w)
                    seen = seen[gates[w][seen >> np.uint64(48)]]
                    at = np.minimum(np.searchsorted(t, seen), len(t) - 1)
                    sums[w] += np.bincount(at[t[at] == seen], minlength=len(t))
        for w, s in sums.items():
            hit = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), w, np.int32)), pa.array(wanted[w][hit].view(np.int64)), pa.array(s[hit])], ["width", "token", "n"])

    counted = mapped(docs.select("text"), run, "width int, token long, n long").groupBy("width", "token").agg(F.sum("n").alias("n"))
    return {(r[0], r[1] & 0xFFFFFFFFFFFFFFFF): r[2] for r in counted.collect()}  # at most one row per token of a block


def _find(docs: DataFrame, index: Index | None, spans: bool) -> DataFrame:
    """Per document its words, hits and items; with ``spans`` the hit words and items as lists."""
    none = hashlib.sha256(b"").hexdigest()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in scan.batches(batch, "text", 4 << 20):
                raw, offsets = scan.text_buffer(part.column("text"))
                words = scan.words_of(raw, offsets, scan.ALNUM, scan.ALNUM_FLAG)
                n_words = np.diff(words.first)
                n_hit = np.zeros(part.num_rows, np.int64)
                items: list[set] = [None] * part.num_rows
                places: list = [None] * part.num_rows
                if index is not None and len(words.hash):
                    start, which = index.hits(words, _Lowered(raw))
                    if len(start):
                        covered = index._cover(start, which, len(words.hash))
                        where = np.flatnonzero(covered)
                        n_hit = np.diff(np.searchsorted(where, words.first))
                        doc = np.searchsorted(words.first, start, "right") - 1
                        for d, w in set(zip(doc.tolist(), which.tolist(), strict=True)):
                            items[d] = (items[d] or set()) | {index.names[k] for k in index.holders[w]}
                        if spans:
                            for d in np.flatnonzero(n_hit):
                                a, b = np.searchsorted(where, words.first[[d, d + 1]])
                                places[d] = where[a:b] - words.first[d]
                out = [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64())]
                if spans:
                    out += [pa.array([p if p is not None else [] for p in places], pa.list_(pa.int64())), pa.array([sorted(s) if s else [] for s in items], pa.list_(pa.string()))]
                    names = ["doc_id", "n_words", "n_hit", "hit_words", "items"]
                else:
                    out += [pa.array([len(s) if s else 0 for s in items], pa.int64()), pa.array([hashlib.sha256(",".join(sorted(s)).encode()).hexdigest() if s else none for s in items])]
                    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"]
                yield pa.RecordBatch.from_arrays(out, names)

    tail = "hit_words array<long>, items array<string>" if spans else "n_items long, items_sha256 string"
    kind = dict(docs.dtypes)["doc_id"]
    return mapped(id_text(docs), run, f"doc_id {kind}, n_words long, n_hit long, {tail}")


class _Lowered:
    """Lower-cased slices of a byte buffer."""

    def __init__(self, raw: np.ndarray):
        self.raw = raw

    def __getitem__(self, at: slice) -> bytes:
        return self.raw[at].tobytes().translate(_LOWER)


def contaminated(docs: DataFrame, items: DataFrame, size: int = 13, share: int = 20, width: int = 3, spans: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; with ``spans`` also
    hit_words (positions) and items (ids as strings).

    A document is contaminated if it has a hit and ``share * n_hit >= n_words``.
    """
    indexes = []
    for index in _blocks(items, size, width):
        index.order(count_tokens(docs, index.token_sets()))
        indexes.append(index)
    verdict = ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated")
    if len(indexes) <= 1 and not spans:
        return _find(docs, indexes[0] if indexes else None, False).select("*", verdict)
    if len(indexes) <= 1:
        found = _find(docs, indexes[0] if indexes else None, True)
    else:  # every block sees every document; a document's hits are united
        tagged = materialize(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "documents")
        keyed = tagged.select(F.struct("row", "doc_id").alias("doc_id"), "text")
        found = None
        for index in indexes:
            one = _find(keyed, index, True)
            found = one if found is None else found.unionByName(one)
        found = found.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("hit_words"))).alias("hit_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        found = found.select("doc_id.doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.array_sort("hit_words").alias("hit_words"), "items")
    digest = F.sha2(F.array_join("items", ","), 256)
    out = found.withColumn("n_items", F.size("items").cast("long")).withColumn("items_sha256", digest).withColumn("contaminated", verdict)
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return out.select(*names, *(["hit_words", "items"] if spans else []))


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = 13, share: int = 20) -> DataFrame:
    """The documents that are not contaminated, with all their columns; one scan more, no shuffle of texts when the verdicts are few."""
    from .shared import maybe_broadcast

    bad = contaminated(docs, items, size, share).filter("contaminated").select("doc_id").distinct()
    bad = materialize(bad, "contaminated")
    return docs.join(maybe_broadcast(bad, 16), "doc_id", "left_anti")


ORACLE = r"""
WITH low AS (SELECT doc_id AS id, true AS is_doc, text FROM documents UNION ALL SELECT item_id, false, text FROM benchmark),
w AS (SELECT id, is_doc, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
items AS (SELECT id, w, least(13, len(w)) AS n FROM w WHERE NOT is_doc AND len(w) > 0),
windows AS (SELECT DISTINCT id, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM items)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT id, n, k, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM w, sizes WHERE is_doc AND len(w) >= n)),
hits AS (SELECT p.id, p.n, p.k, x.id AS item FROM places p JOIN windows x USING (n, win)),
hit_words AS (SELECT id, count(DISTINCT j) AS n_hit FROM (SELECT id, unnest(range(k, k + n)) AS j FROM hits) GROUP BY id),
hit_items AS (SELECT id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item::VARCHAR, ',' ORDER BY item::VARCHAR) AS listed FROM hits GROUP BY id)
SELECT w.id AS doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM w LEFT JOIN hit_words USING (id) LEFT JOIN hit_items USING (id) WHERE is_doc
"""
