"""Vectorised scans of Arrow text columns: words, word hashes and shingles.

Texts stay in the Arrow buffer; nothing is decoded to Python strings.  A word
hash starts from the word's length and takes in its bytes eight at a time, each
step through a non-linear mixer, so no two words collide by their structure;
words beyond ``LONG_WORD`` bytes take a cryptographic hash.  Shingle hashes
combine word hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that one vectorised step looks at; its temporaries take about 20 times as much.
BLOCK = 1 << 16
#: Longer words are hashed one by one.
LONG_WORD = 256
#: The first n bytes of a little-endian 64-bit integer.
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64's constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])


def word_table(keep) -> np.ndarray:
    """256 entries: the byte with A-Z lower-cased where ``keep(lowered byte)``, else 0."""
    low = [b + 32 if 65 <= b <= 90 else b for b in range(256)]
    return np.array([b if b and keep(b) else 0 for b in low], np.uint8)


#: Words are runs of anything but space and the controls 9 to 13 (byte 0 is a word byte).
SPACED = word_table(lambda b: b != 32 and not 9 <= b <= 13)
SPACED_FLAG = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
#: Words are runs of 0-9, a-z and bytes above 127.
ALNUM = word_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
ALNUM_FLAG = ALNUM != 0


def word_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words ``low[start:end]`` of lower-cased bytes."""
    padded = np.zeros(len(low) + 8, np.uint8)
    padded[: len(low)] = low
    eight = np.ndarray((len(low) + 1,), "<u8", padded, strides=(1,))
    size = end - start
    out = mix(size.astype(np.uint64) * _STEP + np.uint64(1))
    todo = np.flatnonzero(size <= LONG_WORD)
    at, left = start[todo], size[todo]
    while len(todo):
        part = eight[at] & _FIRST_BYTES[np.minimum(left, 8)]
        out[todo] = mix((out[todo] ^ part) + _STEP)
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(low[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not wide and not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column, wide = column.cast(pa.large_string()), True
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, off, data = column.buffers()
    if len(column) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a run of texts: byte spans, hashes, and the first word of each text."""

    __slots__ = ("start", "end", "hash", "first")

    def __init__(self, start, end, hash_, first):
        self.start, self.end, self.hash, self.first = start, end, hash_, first


def words_of(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, flag: np.ndarray) -> Words:
    """All words of the texts in ``raw``, found block by block."""
    n = len(raw)
    starts, ends, hashes = [], [], []
    text_starts = offsets[:-1]
    at = 0
    while at < n:
        stop = min(n, at + BLOCK)
        if stop < n:  # cut where a word ends, so no word spans two blocks
            back = np.flatnonzero(~flag[raw[at:stop]])
            if len(back):
                stop = at + int(back[-1]) + 1
            else:
                nxt = stop
                while nxt < n and flag[raw[nxt]] and not _is_start(text_starts, nxt):
                    step = np.flatnonzero(~flag[raw[nxt : nxt + BLOCK]])
                    jump = nxt + (int(step[0]) if len(step) else min(BLOCK, n - nxt))
                    k = np.searchsorted(text_starts, nxt, "right")
                    nxt = min(jump, int(text_starts[k])) if k < len(text_starts) else jump
                stop = nxt
        block = raw[at:stop]
        is_word = flag[block]
        lo, hi = np.searchsorted(text_starts, [at, stop])
        cuts = text_starts[lo:hi] - at
        before = np.empty(len(block), bool)
        before[0] = False
        before[1:] = is_word[:-1]
        before[cuts] = False
        s = np.flatnonzero(is_word & ~before)
        after = np.empty(len(block), bool)
        after[-1] = False
        after[:-1] = is_word[1:]
        inner = cuts[cuts > 0]
        after[inner - 1] = False
        e = np.flatnonzero(is_word & ~after) + 1
        if len(s):
            hashes.append(word_hashes(table[block], s, e))
            starts.append(s + at)
            ends.append(e + at)
        at = stop
    if not starts:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    start = np.concatenate(starts)
    return Words(start, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(start, offsets))


def _is_start(text_starts: np.ndarray, at: int) -> bool:
    k = np.searchsorted(text_starts, at)
    return k < len(text_starts) and text_starts[k] == at


_SPREAD = [0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F]


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words (texts are not told apart here)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = out * np.uint64(0x2545F4914F6CDD1D) + words[j : j + n] * np.uint64(_SPREAD[j % len(_SPREAD)])
    return mix(out + np.uint64(width))


def sequence_hash(words: np.ndarray) -> int:
    """Hash of a whole word sequence; equal to ``shingle_hashes`` at its full width."""
    return int(shingle_hashes(words, len(words))[0])


def batches(batch: pa.RecordBatch, text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts sum to about ``limit`` bytes, one row at least."""
    _, offsets = text_buffer(batch.column(text))
    at, n = 0, batch.num_rows
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        stop = min(stop, n)
        yield batch.slice(at, stop - at)
        at = stop
