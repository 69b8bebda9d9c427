"""Ops 9 and 10 and the pipeline against brute force."""

import hashlib
import random
import re

import pytest

from quern.llm import contamination, setjoin

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = [w for w in re.split("[ \t-\r]+", (text or "").translate(UPPER)) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if len(words) >= width else frozenset([tuple(words)])


def brute_components(rows, width, num, den):
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_group(rnd, n, size, edits, tag=""):
    """Copies of one text with random word edits, more and more of them; also copies of copies."""
    base = [f"{tag}w{rnd.randint(0, 4000)}" for _ in range(size)]
    out = [list(base)]
    for k in range(n):
        text = list(rnd.choice(out))
        for _ in range(rnd.randint(0, edits)):
            at = rnd.randrange(len(text))
            text[at] = f"{tag}x{rnd.randint(0, 10**6)}"
        out.append(text)
    rnd.shuffle(out)
    return [" ".join(t) for t in out]


@pytest.mark.parametrize("width,num", [(3, 90), (5, 80), (1, 50), (2, 100)])
def test_components_against_brute_force(spark, width, num):
    rnd = random.Random(width * num)
    texts = []
    for g in range(6):
        texts += near_group(rnd, 12, rnd.choice([4, 9, 15, 40, 90, 200]), 4, f"g{g}")
    texts += near_group(rnd, 60, 120, 9, "big")  # a group whose least id is no hub
    texts += [" ".join(f"t{rnd.randint(0, 12)}" for _ in range(rnd.randint(1, 9))) for _ in range(80)]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.near_components(df, width, num, 100).collect()}
    want = brute_components(rows, width, num, 100)
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows)


def test_components_odd_rows(odd, none):
    rows = setjoin.near_components(odd, 3, 90, 100).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[0].n_shingles == by[1].n_shingles == by[2].n_shingles == 0
    assert by[0].component_id == 0 and by[2].component_id == 2
    assert by[8].component_id == 7 and by[5].component_id == 5 and by[3].n_shingles == 1
    assert by[None].component_id is None
    assert setjoin.near_components(none).count() == 0
    kept = setjoin.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == sorted(str(r.doc_id) for r in odd.collect() if r.doc_id not in (8, 12))  # 12 is near 11
    assert setjoin.keep_one(none).count() == 0


@pytest.mark.parametrize("num", [50, 80, 90, 95])
def test_every_linked_pair_shares_a_key(num):
    """The pigeonhole guarantee, on sets at the threshold itself."""
    import numpy as np

    rnd = np.random.default_rng(num)
    bands = setjoin.Bands(num, 100)
    for size in (1, 2, 5, 9, 10, 20, 33, 64, 150, 600):
        for _ in range(25):
            base = rnd.integers(0, 2**64, size, dtype=np.uint64)
            differ = 2 * size * (100 - num) // (100 + num)
            drop = int(rnd.integers(0, differ + 1))
            other = np.concatenate([base[min(drop, size - 1) :], rnd.integers(0, 2**64, max(differ - drop, 0), dtype=np.uint64)])
            a, b = np.unique(base), np.unique(other)
            both = len(np.intersect1d(a, b))
            if 100 * both >= num * (len(a) + len(b) - both) and (len(a) != len(b) or (a != b).any()):
                assert np.intersect1d(bands.keys(a, setjoin.scan.mix(a)), bands.keys(b, setjoin.scan.mix(b))).size


def test_connected_components_of_paths_and_rings(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100 + k, 100 + (k * 7 + 1) % 20) for k in range(20)] + [(300, 200), (250, 300)]
    got = {r.node: r.root for r in setjoin.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(41)} == {0} and got[300] == got[250] == got[200] == 200
    assert setjoin.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_contaminated(docs, items, size=13, share=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and share * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_contamination_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(contamination, "BLOCK_BYTES", block)
    rnd = random.Random(block)
    word = lambda: f"{rnd.choice(['Ab', 'ab', 'é', 'x'])}{rnd.randint(0, 6)}"
    items = [(k, " ".join(word() for _ in range(rnd.choice([0, 1, 2, 3, 5, 12, 13, 14, 30])))) for k in range(25)] + [(90, None), (91, ""), (92, "!!! ...")]
    items += [(93, items[-4][1]), (11, items[5][1])]
    docs = []
    for k in range(60):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 30)))]
        if rnd.random() < 0.6:
            parts.append((items[rnd.randrange(25)][1] or "").upper().replace(" ", rnd.choice([" ", ", ", "\n"])))
            parts.append(" ".join(word() for _ in range(rnd.randint(0, 200))))
        docs.append((k, " ".join(parts)))
    docs += [(100, None), (101, ""), (102, "...")]
    d = spark.createDataFrame([(i, t, "a", "b") for i, t in docs], "doc_id long, text string, items string, row string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in contamination.contaminated(d, b).collect()]
    want = brute_contaminated(docs, items)
    assert sorted(got) == sorted(want)
    assert any(r[2] for r in want) and any(r[5] for r in want) and not all(r[5] for r in want)
    kept = contamination.drop_contaminated(d, b)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in want if not r[5]}


def test_contamination_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, " ".join(f"alpha{k} beta{k}" for k in range(9)))], "item_id long, text string")
    got = {r.doc_id: r for r in contamination.contaminated(odd, items, spans=True).collect()}
    assert got[11].n_hit == got[12].n_hit == 18 and got[12].hit_words[0] == 2 and got[11].items == ["1"]
    assert got[0].n_words == 0 and not got[0].contaminated
    empty = items.limit(0)
    assert {r.n_hit for r in contamination.contaminated(odd, empty).collect()} == {0}
    assert contamination.contaminated(none, items).count() == 0
    assert contamination.drop_contaminated(none, items).count() == 0


def thue_morse(bits):
    """A word over a and b and its complement, which polynomial hashes modulo a power of two cannot tell apart."""
    one = "".join("ab"[k.bit_count() % 2] for k in range(1 << bits))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("bits", [3, 7, 10, 12])
def test_structured_words_stay_apart(spark, bits):
    a, b = thue_morse(bits)
    df = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    if bits == 10:
        assert {r.doc_id: r.component_id for r in setjoin.near_components(df, 3, 90, 100).collect()} == {1: 1, 2: 2, 3: 1}
    items = spark.createDataFrame([(7, a), (8, b)], "item_id long, text string")
    got = {r.doc_id: r["items"] for r in contamination.contaminated(df, items, spans=True).collect()}
    assert got == {1: ["7"], 2: ["8"], 3: ["7"]}


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    """With a hash of the length only, windows are found by their bytes."""
    import numpy as np
    import pyarrow as pa

    scan = contamination.scan
    monkeypatch.setattr(scan, "word_hashes", lambda low, start, end: scan.mix((end - start).astype(np.uint64)))
    index = contamination.Index([(1, "ab cd ef"), (2, "ab xy ef")], 13, 3)
    index.order({})
    for text, want in (("q ab cd ef q", {0}), ("ab xy ef", {1}), ("ab zz ef", set())):
        raw, offsets = scan.text_buffer(pa.array([text]))
        words = scan.words_of(raw, offsets, scan.ALNUM, scan.ALNUM_FLAG)
        assert {index.holders[w][0] for w in index.hits(words, contamination._Lowered(raw))[1].tolist()} == want


def test_pipeline_against_plain_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rnd = random.Random(8)
    words = {"en": "the and of that with from this have thing other".split(), "de": "der die und nicht auch einen über schön für zwischen".split()}
    text = lambda lang, n: " ".join(rnd.choice(words[lang]) + str(rnd.randint(0, 300)).translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(n))
    rows = [(k, text(lang, 70), lang) for k in range(40) for lang in [rnd.choice(["en", "de"])]]
    item = text("en", 20)
    rows += [(50, rows[3][1], "en"), (51, " ".join(rows[4][1].split()[:-1]), "en"), (52, "123 456", "en"), (53, None, "en"), (54, item + " " + text("en", 30), "en")]
    data = [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # 50 loses its only line to 3, 51 is a near copy of 4, 52 and 53 have no language, 54 holds the item
    assert set(got) == set(range(40))
    from quern.llm import bpe
    from quern.llm.queries import tokenizer_path

    plain = dict(zip([r[0] for r in rows], bpe.WordCodec(tokenizer_path()).encode_batch([r[1] or "" for r in rows]), strict=True))
    assert all(got[i].ids_sha256 == hashlib.sha256(plain[i][0]).hexdigest() for i in got)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "bpe_codec"]


def test_pipeline_stages_against_brute_force(spark):
    """Every stage after the first on odd documents: repeated rows, clashing names, nulls, an empty table."""
    stages = dict(pytest.importorskip("corpus_pipeline").STAGES)
    from tokenizers import Tokenizer

    from quern.llm.queries import tokenizer_path

    from .test_urls_lines import brute as plain_lines

    rnd = random.Random(21)
    word = lambda: f"w{rnd.randint(0, 300)}"
    line = lambda n: " ".join(word() for _ in range(n))
    shared, item = [line(30), line(4), line(25)], line(20)
    rows = [(k, "\n".join([line(rnd.randint(5, 60)), *(shared if k % 4 == 0 else []), *([item] if k % 9 == 0 else []), line(9)])) for k in range(30)]
    rows += [(40 + k, " ".join([*rows[k][1].split(" ")[:-1], word()])) for k in range(6)] + [(60, rows[7][1]), (61, ""), (7, rows[7][1]), (None, line(60))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp string, b string, __gone string"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "x", "y", "z") for i, t in rows], schema)
    none = docs.limit(0)
    texts = lambda df: sorted((str(r.doc_id), r.text) for r in df.collect())

    got = stages["line_dedup"](spark, docs, "")
    want = [(i, plain_lines(rows)[i, t]) for i, t in rows]
    assert got.columns == docs.columns
    assert texts(got) == sorted((str(i), t) for (i, t), (_, old) in zip(want, rows, strict=True) if t or not old)
    got = stages["ngram_jaccard_join"](spark, docs, "")
    roots = {i: c for i, (_, c) in brute_components([r for r in rows if r[0] is not None], 5, 80, 100).items()}
    assert got.columns == docs.columns and texts(got) == sorted((str(i), t) for i, t in rows if i is None or roots[i] == i)
    assert len(set(roots.values())) < len(roots)
    kept = contamination.drop_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    bad = {r[0] for r in brute_contaminated(rows, [(1, item)]) if r[5]}
    assert bad and texts(kept) == sorted((str(i), t) for i, t in rows if i not in bad)
    library = Tokenizer.from_file(tokenizer_path())
    for r in stages["bpe_codec"](spark, docs, "").collect():
        assert r.n_tokens in {len(library.encode(t, add_special_tokens=False).ids) for i, t in rows if i == r.doc_id}
    for name in ("language_id", "line_dedup", "ngram_jaccard_join", "bpe_codec"):
        assert stages[name](spark, none, "").count() == 0


def test_a_worker_keeps_one_operators_memory(spark):
    """A codec stays from task to task of its own stage and goes when another operator's task comes."""
    import os

    import pyarrow as pa

    from quern.llm import bpe, shared
    from quern.llm.shared import kept, mapped

    from .conftest import tokenizer

    def task(operator):
        def run(rows):
            mine = kept(operator)
            for batch in rows:
                mine["n"] = mine.get("n", 0) + batch.num_rows
                yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "n": [mine["n"]], "operators": [sorted(shared._kept)]})

        return mapped(spark.range(0, 1, 1, 1), run, "pid long, n long, operators array<string>", operator).collect()[0]  # a worker that is not read to its end is not used again

    def same(operator, times=12):  # tasks of one worker, whichever serves most of them
        rows = [task(operator) for _ in range(times)]
        pid = max(rows, key=lambda r: r.n).pid
        return [r for r in rows if r.pid == pid]

    first, second = same("one"), same("two")
    assert first[-1].n == len(first) > 1 and second[-1].n == len(second) > 1
    assert all(r.operators == ["one"] for r in first) and all(r.operators == ["two"] for r in second)
    assert task("one").n == 1
    c = bpe.codec(tokenizer())
    assert bpe.codec(tokenizer()) is c and kept("other") == {} and bpe.codec(tokenizer()) is not c
