"""BPE encoding and decoding by speculation.

Greedy longest match proposes tokens for each distinct word, a vectorised
check tests every adjacent pair of proposals, and only words with a failing
pair go through exact merging.

Why the pair check is exact: a token is the result of its own merges, so inside
a token nothing changes unless a merge crosses a boundary.  At a boundary the
symbols that ever touch are the right spine of the left token's merge tree and
the left spine of the right token's.  A crossing merge of rank r happens if both
its symbols are alive at r, that is, before either is consumed by its own
parent.  On equal ranks the leftmost merge goes first, so the left symbol must
be consumed strictly later and the right one no earlier.  If no such merge
exists for any adjacent pair, the proposal is the merge result.

Defined cases: a null text encodes like an empty one (no ids, empty decoded
text); special-token strings inside a text become their ids, as the library does
by default; texts outside the fast path's alphabet go through the library's own
normaliser and splitter, then through the same codec; very long texts and words are
encoded whole; of merges of equal rank the leftmost goes first; rows that repeat a
doc_id each give a row, an empty table none; further columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import scan
from .shared import id_text, kept, mapped

#: Distinct words that one worker remembers before it starts anew.
CACHE_WORDS = 120_000
#: Longer words are encoded each time, so the cache's bytes stay bounded.
CACHE_CHARS = 64
_FAR = np.int64(1 << 40)
#: Base symbols: a byte inside a word, or 256 more at its end.
_SYMBOLS = 512
#: Words of more bytes go through the heap form of exact merging.
_ROW = 40
#: Characters of texts whose words are looked up together.
_TOGETHER = 2 << 20


def byte_alphabet() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = [""] * 256
    for b in plain:
        out[b] = chr(b)
    spare = iter(range(256, 512))
    for b in range(256):
        if not out[b]:
            out[b] = chr(next(spare))
    return out


class Merges:
    """A vocabulary with ranked merges and the tables that the pair check needs."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.vocab, self.suffix = vocab, suffix
        self.size = max(vocab.values()) + 1
        self.tokens = [""] * self.size
        for t, i in vocab.items():
            self.tokens[i] = t
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        left = np.full(self.size, -1, np.int64)
        right = np.full(self.size, -1, np.int64)
        made = np.full(self.size, -1, np.int64)
        for r, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((x, y), (r, z))
            if made[z] < 0:
                left[z], right[z], made[z] = x, y, r
        self.left, self.right, self.made = left, right, made
        codes = np.array([x * self.size + y for x, y in self.rank], np.int64)
        order = np.argsort(codes)
        self.codes = codes[order]
        self.ranks = np.array([r for r, _ in self.rank.values()], np.int64)[order]
        self.result = np.zeros(len(merges), np.int64)
        for r, z in self.rank.values():
            self.result[r] = z
        self.right_spine = self._spine(right)
        self.left_spine = self._spine(left)
        self.longest = max(len(t) for t in vocab)
        self.sound = self._sound()
        #: Tokens that greedy may propose; one whose own text merges otherwise is left out.
        self.offered = {t: i for t, i in vocab.items() if self.sound[i]}

    def _spine(self, child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per token the spine's nodes (-1 beyond its end) and the rank that consumes each."""
        nodes, until = [np.arange(self.size)], [np.full(self.size, _FAR)]
        while True:
            now = nodes[-1]
            nxt = np.where(now >= 0, child[now], -1)
            if (nxt < 0).all():
                break
            nodes.append(nxt)
            until.append(np.where(nxt >= 0, self.made[now], _FAR))
        return np.stack(nodes, 1), np.stack(until, 1)

    def _first_cross(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of a merge that crosses the boundary between tokens a and b; ``_FAR`` if none."""
        best = np.full(len(a), _FAR)
        rn, ru = self.right_spine[0][a], self.right_spine[1][a]
        ln, lu = self.left_spine[0][b], self.left_spine[1][b]
        for i in range(rn.shape[1]):
            live = np.flatnonzero(rn[:, i] >= 0)
            if not len(live):
                break
            for j in range(ln.shape[1]):
                rows = live[ln[live, j] >= 0]
                if not len(rows):
                    break
                code = rn[rows, i] * self.size + ln[rows, j]
                at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                rank = np.where(self.codes[at] == code, self.ranks[at], _FAR)
                ok = (rank < ru[rows, i]) & (rank <= lu[rows, j])
                best[rows] = np.where(ok, np.minimum(best[rows], rank), best[rows])
        return best

    def _sound(self) -> np.ndarray:
        """Whether a token's own text merges to that token."""
        out = self.made < 0
        made = np.flatnonzero(self.made >= 0)
        cross = np.full(self.size, _FAR)
        cross[made] = self._first_cross(self.left[made], self.right[made])
        for z in made[np.argsort(self.made[made])]:
            out[z] = out[self.left[z]] and out[self.right[z]] and cross[z] == self.made[z]
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._first_cross(a, b) >= _FAR

    def _ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Ranks of the merges of pairs; ``_FAR`` where there is none or a side is -1."""
        code = x * self.size + y
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.codes[at] == code) & (x >= 0) & (y >= 0), self.ranks[at], _FAR)

    def build_trie(self, bases: dict[str, int]) -> None:
        """A trie of the offered tokens over base symbols, as a sorted edge list."""
        edges: dict[int, int] = {}
        accept = [-1]
        for t, i in self.offered.items():
            body = t.removesuffix(self.suffix) if self.suffix and t.endswith(self.suffix) and len(t) > len(self.suffix) else t
            last = len(body) - 1
            node = 0
            for k, ch in enumerate(body):
                sym = bases.get(ch + self.suffix if k == last and body is not t else ch)
                if sym is None:
                    break
                node = edges.setdefault(node * _SYMBOLS + sym, len(accept))
                if node == len(accept):
                    accept.append(-1)
            else:
                accept[node] = i
        keys = np.array(list(edges), np.int64)
        order = np.argsort(keys)
        self.edge_keys, self.edge_to = keys[order], np.array(list(edges.values()), np.int64)[order]
        self.accept = np.array(accept, np.int64)

    def greedy(self, flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest-match tokens of all words in lockstep: (tokens, first token of each word).

        ``flat`` holds the words' base symbols one after another, ``first`` where each
        word begins (with the total at the end).  Every base symbol is a token."""
        n = len(first) - 1
        stop = first[1:]
        word = np.arange(n)
        at = first[:-1].copy()
        live = np.flatnonzero(at < stop)
        word, at = word[live], at[live]
        begin = at.copy()
        node = np.zeros(len(word), np.int64)
        best = np.full(len(word), -1)
        best_at = at.copy()
        out_word, out_at, out_token = [], [], []
        while len(word):
            open_ = at < stop[word]
            key = node * _SYMBOLS + flat[np.minimum(at, len(flat) - 1)]
            e = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
            go = open_ & (self.edge_keys[e] == key)
            node = np.where(go, self.edge_to[e], 0)
            at = at + go
            got = np.where(go, self.accept[node], -1)
            hit = got >= 0
            best = np.where(hit, got, best)
            best_at = np.where(hit, at, best_at)
            done = ~go
            if done.any():
                out_word.append(word[done])
                out_at.append(begin[done])
                out_token.append(best[done])
                at = np.where(done, best_at, at)
                begin = np.where(done, best_at, begin)
                best = np.where(done, -1, best)
                keep = ~(done & (at >= stop[word]))
                word, at, begin, node, best, best_at = word[keep], at[keep], begin[keep], node[keep], best[keep], best_at[keep]
        if not out_word:
            return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
        w, p, t = np.concatenate(out_word), np.concatenate(out_at), np.concatenate(out_token)
        order = np.argsort(p, kind="stable")
        return t[order], np.concatenate([[0], np.cumsum(np.bincount(w, minlength=n))])

    def merge_rows(self, rows: np.ndarray) -> np.ndarray:
        """Exact merging of padded rows (-1 beyond the end), one leftmost lowest-rank merge a row and step."""
        out = rows.copy()
        active = np.arange(len(rows))
        ids = rows
        rank = self._ranks(ids[:, :-1], ids[:, 1:])
        cols = np.arange(rows.shape[1])
        while len(active):
            k = rank.argmin(1)
            row = np.arange(len(active))
            low = rank[row, k]
            go = low < _FAR
            out[active[~go]] = ids[~go]
            if not go.all():
                active, ids, rank, k, low = active[go], ids[go], rank[go], k[go], low[go]
                row = np.arange(len(active))
            if not len(active):
                break
            shift = np.minimum(cols + (cols > k[:, None]), rows.shape[1] - 1)
            fresh = np.take_along_axis(ids, shift, 1)
            fresh[:, -1] = np.where(k == rows.shape[1] - 1, fresh[:, -1], -1)
            fresh[row, k] = self.result[low]
            ids = fresh
            rank = np.take_along_axis(rank, np.minimum(cols[:-1] + (cols[:-1] > k[:, None]), rows.shape[1] - 2), 1)
            rank[:, -1] = np.where(k == rows.shape[1] - 2, rank[:, -1], _FAR)
            here = ids[row, k]
            nxt = np.where(k + 1 < rows.shape[1], ids[row, np.minimum(k + 1, rows.shape[1] - 1)], -1)
            inner = k < rank.shape[1]
            rank[row[inner], k[inner]] = self._ranks(here[inner], nxt[inner])
            prev = k > 0
            rank[row[prev], k[prev] - 1] = self._ranks(ids[row[prev], k[prev] - 1], here[prev])
        return out

    def exact_long(self, symbols: list[str]) -> list[int]:
        """Merge lowest rank first, leftmost first; symbols without an id are dropped, as the library does."""
        import heapq

        ids = [self.vocab[s] for s in symbols if s in self.vocab]
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(m[0], k, ids[k], ids[k + 1], m[1]) for k in range(n - 1) if (m := self.rank.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, x, y, z = heapq.heappop(heap)
            j = after[k] if k < n else n
            if not alive[k] or ids[k] != x or j >= n or ids[j] != y:
                continue
            ids[k], alive[j] = z, False
            after[k] = after[j]
            if after[j] < n:
                before[after[j]] = k
            for p, q in ((before[k], k), (k, after[k])):
                if p >= 0 and q < n and (m := self.rank.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (m[0], p, ids[p], ids[q], m[1]))
        return [ids[k] for k in range(n) if alive[k]]


def fast_split() -> tuple[re.Pattern, re.Pattern]:
    """(a character that the fast path does not know, the words of a lower-cased text).

    Texts of the known characters alone are lower-cased and split as the tokenizer does it;
    NFC leaves them as they are.
    """
    letters = [chr(c) for c in range(128, 0x180) if unicodedata.category(chr(c))[0] == "L"]
    numbers = [chr(c) for c in range(128, 0x180) if unicodedata.category(chr(c))[0] == "N"]
    lets, nums = "a-z" + "".join(letters), "0-9" + "".join(numbers)
    words = f"[{lets}]+|[{nums}]|'(?:[stmd]|re|ve|ll)|[^\t\n\x0b\x0c\r {lets}{nums}]+"
    return re.compile("[^\t-\r -~\xa1-ſ]"), re.compile(words)


class WordCodec:
    """Encodes and decodes texts as one tokenizer file says."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = Merges(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.alphabet = byte_alphabet()
        self.plain, self.split = fast_split()
        self.special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self.pair_codes, self.pair_ok = np.zeros(0, np.int64), np.zeros(0, np.int64)
        suffix = self.merges.suffix
        bases = {self.alphabet[b]: b for b in range(256)} | {self.alphabet[b] + suffix: b + 256 for b in range(256)}
        self.base_ids = np.full(_SYMBOLS, -1, np.int64)
        for t, k in bases.items():
            self.base_ids[k] = self.merges.vocab.get(t, -1)
        self.whole = bool(suffix) and bool((self.base_ids >= 0).all())
        self.merges.build_trie(bases)
        self.ids: dict[str, bytes] = {}
        self.shown: dict[str, str] = {}
        self.proposed = self.merged = 0

    # words -------------------------------------------------------------

    def words(self, text: str) -> list[str]:
        """The library's words of a text without special tokens."""
        if not self.plain.search(text):
            return self.split.findall(text.lower())
        normal = self.library.normalizer.normalize_str(text)
        cut = [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return [w for w in cut if w]

    def symbols(self, word: str) -> list[str]:
        out = [self.alphabet[b] for b in word.encode("utf-8")]
        out[-1] += self.merges.suffix
        return out

    def _bases(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode("utf-8") for w in words]
        first = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        flat[first[1:] - 1] += 256
        return flat, first

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of distinct words, one after another, and where each word's begin
        (with the total at the end): speculate, verify all adjacent pairs together,
        merge what failed."""
        m = self.merges
        if not words:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        if not self.whole:  # some base symbol has no token: nothing to speculate with
            rows = [m.exact_long(self.symbols(w)) for w in words]
            return np.array([t for r in rows for t in r], np.int64), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        flat, first = self._bases(words)
        tokens, head = m.greedy(flat, first)
        bad = np.zeros(len(words), bool)
        inner = np.ones(max(len(tokens) - 1, 0), bool)
        inner[head[1:-1] - 1] = False
        at = np.flatnonzero(inner)
        if len(at):
            codes, back = np.unique(tokens[at] * m.size + tokens[at + 1], return_inverse=True)
            known = np.minimum(np.searchsorted(self.pair_codes, codes), max(len(self.pair_codes) - 1, 0))
            ok = np.where(self.pair_codes[known] == codes, self.pair_ok[known], -1) if len(self.pair_codes) else np.full(len(codes), -1)
            new = np.flatnonzero(ok < 0)
            if len(new):
                ok[new] = m.compatible(codes[new] // m.size, codes[new] % m.size)
                kept = (self.pair_codes, self.pair_ok) if len(self.pair_codes) < 2_000_000 else (self.pair_codes[:0], self.pair_ok[:0])
                both = np.concatenate([kept[0], codes[new]])
                order = np.argsort(both, kind="stable")
                self.pair_codes, self.pair_ok = both[order], np.concatenate([kept[1], ok[new]])[order]
            bad[np.searchsorted(head, at[ok[back] == 0], "right") - 1] = True
        self.proposed += len(words)
        self.merged += int(bad.sum())
        if not bad.any():
            return tokens, head
        count = np.diff(head)
        size = np.diff(first)
        failed = np.flatnonzero(bad)
        pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, their counts, their ids
        for k in failed[size[failed] > _ROW]:
            ids = np.array(m.exact_long(self.symbols(words[k])), np.int64)
            pieces.append((np.array([k]), np.array([len(ids)]), ids))
        failed = failed[size[failed] <= _ROW]
        failed = failed[np.argsort(size[failed], kind="stable")]
        for at in range(0, len(failed), 2000):
            part = failed[at : at + 2000]
            width = int(size[part].max())
            cols = np.arange(width)
            inside = cols < size[part][:, None]
            rows = np.where(inside, self.base_ids[flat[np.minimum(first[part][:, None] + cols, len(flat) - 1)]], -1)
            rows = m.merge_rows(rows)
            pieces.append((part, (rows >= 0).sum(1), rows[rows >= 0]))
        good = np.repeat(~bad, count)
        pieces.append((np.flatnonzero(~bad), count[~bad], tokens[good]))
        for part, n, _ in pieces:
            count[part] = n
        head = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(head[-1], np.int64)
        for part, n, ids in pieces:
            out[np.repeat(head[part] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, head

    # texts -------------------------------------------------------------

    def learn(self, need: set[str]) -> None:
        """Put words that are not yet known into the cache; on overflow only the words at hand stay."""
        if len(self.ids) > CACHE_WORDS:
            self.ids = {w: self.ids[w] for w in need if w in self.ids}
            self.shown = {w: self.shown[w] for w in self.ids}
        new = [w for w in need if w not in self.ids]
        tokens = self.merges.tokens
        for k in range(0, len(new), 20_000):
            some = new[k : k + 20_000]
            flat, head = self.encode_words(some)
            raw, cuts = flat.astype("<u4").tobytes(), (4 * head).tolist()
            self.ids.update(zip(some, [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))
            names, cuts = list(map(tokens.__getitem__, flat.tolist())), head.tolist()
            self.shown.update(zip(some, [" ".join(names[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))

    def _groups(self, texts: Iterable[str]) -> Iterator[list[list[str | list[str]]]]:
        """Texts as lists of special tokens and word lists, about ``_TOGETHER`` characters at a time."""
        group, size = [], 0
        for text in texts:
            parts = [p for p in self.special.split(text) if p] if self.special and "<|" in text else [text]
            group.append([p if p in self.specials else self.words(p) for p in parts])
            size += len(text)
            if size >= _TOGETHER:
                yield group
                group, size = [], 0
        if group:
            yield group

    def encode_batch(self, texts: Iterable[str]) -> Iterator[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text."""
        for group in self._groups(texts):
            need: set[str] = set()
            for parts in group:
                for p in parts:
                    if not isinstance(p, str):
                        need.update(p)
            self.learn(need)
            ids_of, shown_of = self.ids.__getitem__, self.shown.__getitem__
            for parts in group:
                if len(parts) == 1 and not isinstance(parts[0], str):
                    yield b"".join(map(ids_of, parts[0])), " ".join(map(shown_of, parts[0]))
                    continue
                ids, shown = [], []
                for p in parts:
                    if isinstance(p, str):
                        ids.append(np.array([self.specials[p]], "<u4").tobytes())
                        shown.append(p)
                    else:
                        ids += map(ids_of, p)
                        shown += map(shown_of, p)
                yield b"".join(ids), " ".join(shown)
            for w in [w for w in need if len(w) > CACHE_CHARS]:
                del self.ids[w], self.shown[w]

    def decode(self, ids: Iterable[int]) -> str:
        """The text that the library's ``decode(ids, skip_special_tokens=False)`` gives without a decoder: tokens joined by a space."""
        names = {i: s for s, i in self.specials.items()}
        size = self.merges.size
        return " ".join(names[i] if i in names else self.merges.tokens[i] for i in ids if i in names or 0 <= i < size)


def codec(path: str) -> WordCodec:
    """One codec for each worker process and file."""
    codecs = kept("bpe")
    if path not in codecs:
        codecs[path] = WordCodec(path)
    return codecs[path]


def encode_decode(docs: DataFrame, path: str, keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and on demand
    the ids (``ids``) and the decoded text (``decoded``).

    ``path`` names a tokenizer file that every executor can read.  A map over the
    input's partitions; no shuffle.  Null text: no tokens.  Repeated documents and
    doc_ids each give a row.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in (part for whole in rows for part in scan.batches(whole, "text", _TOGETHER)):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n, a, b, ids, shown = [], [], [], [], []
            for raw, text in c.encode_batch(texts):
                n.append(len(raw) // 4)
                a.append(hashlib.sha256(raw).hexdigest())
                b.append(hashlib.sha256(text.encode("utf-8")).hexdigest())
                if keep_ids:
                    ids.append(np.frombuffer(raw, "<u4").astype(np.int32))
                if keep_text:
                    shown.append(text)
            out = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}
            if keep_ids:
                out["ids"] = pa.array(ids, pa.list_(pa.int32()))
            if keep_text:
                out["decoded"] = pa.array(shown, pa.string())
            yield pa.RecordBatch.from_pydict(out)

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text
    return mapped(id_text(docs), run, schema, "bpe")
