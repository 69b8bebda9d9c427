"""Ops 1, 2 and 3: exact round trips, the library's ids, odd rows."""

import hashlib
import random
import uuid
import zlib

import numpy as np
import pytest

from quern.llm import bpe, jpeg, media, tokens
from quern.llm.shared import shared_dir

from .conftest import tokenizer


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer())


def test_codec_matches_the_library_on_random_texts(library):
    rnd = random.Random(5)
    bits = ["a", "b", "th", "'s", "'", "é", " ", "\n", "<|endoftext|>", "İ", "Σ", "ς", "²", "日", "\u0301", "\u00a0", "\u0085", "\x1c", "\x00", "😀", "!!", "12", "ﬁ", "<|", "zz"]
    texts = ["", "<|endoftext|>", "aaaaaaaaaaaa", "x" * 4000] + ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 40))) for _ in range(3000)]
    codec = bpe.WordCodec(tokenizer())
    for t, (raw, shown) in zip(texts, codec.encode_batch(texts), strict=True):
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(raw, "<u4").tolist() == ids, t
        assert shown == library.decode(ids, skip_special_tokens=False) == codec.decode(ids), t
    assert 0 < codec.merged < codec.proposed


def test_codec_cache_overflow_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    monkeypatch.setattr(bpe, "_TOGETHER", 20)
    texts = [f"word{k} other{k} same" for k in range(40)]
    got = [np.frombuffer(r, "<u4").tolist() for r, _ in bpe.WordCodec(tokenizer()).encode_batch(texts)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_query_on_odd_rows(odd, none, library):
    rows = bpe.encode_decode(odd, tokenizer(), keep_ids=True, keep_text=True).collect()
    texts = [(r.doc_id, r.text or "") for r in odd.collect()]
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == sorted((str(i), len(library.encode(t, add_special_tokens=False).ids)) for i, t in texts)
    for r in rows:
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.encode_decode(none, tokenizer()).count() == 0


def test_token_table_round_trip(odd, none, library):
    rows = sorted(tokens.round_trip(odd, tokenizer()).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.start))
    texts = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for r, (i, t) in zip(rows, texts, strict=True):
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokens.round_trip(none, tokenizer()).count() == 0


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_table_selective_reads(spark, odd, library, encoding):
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    tokens.write(odd.filter("doc_id is not null"), path, tokenizer(), encoding=encoding, partitions=3)
    some = tokens.read(spark, path, 3, 7)
    assert {r.doc_id for r in some.collect()} == {3, 4, 5, 6}
    whole = {(r.doc_id, r.start): r.n_tokens for r in tokens.read(spark, path).collect()}
    meta = tokens.metadata(spark, path)
    assert {(r.doc_id, r.start): r.n_tokens for r in meta.collect()} == whole
    plan = meta._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema", 1)[1].split("\n", 1)[0]
    import glob

    import pyarrow.parquet as pq

    column = pq.read_metadata(glob.glob(f"{path}/part-*.parquet")[0]).row_group(0).column(4)
    assert column.has_offset_index and any(("DICT" in e) if encoding == "dictionary" else ("DELTA" in e) for e in column.encodings)


def test_token_table_refuses_an_unknown_encoding(odd):
    with pytest.raises(ValueError):
        tokens.write(odd, "/nowhere", tokenizer(), encoding="other")


@pytest.mark.parametrize("blocks", [1, 2, 5, 6, 7, 40])
def test_jpeg_payload_both_readers(blocks):
    payload = np.random.default_rng(blocks).integers(0, 256, 64 * blocks, dtype=np.uint8).tobytes()
    data = jpeg.encode_payload(payload)
    fast, slow = jpeg.decode(data), jpeg.decode(data, arrays=False)
    assert jpeg.payload_of(fast) == payload == jpeg.payload_of(slow)
    for a, b in zip(fast.components, slow.components, strict=True):
        assert (a.coefficients == b.coefficients).all()
    assert (jpeg.tensor(fast) == jpeg.tensor(slow)).all()


def test_jpeg_inverse_transform_and_upsampling():
    assert sorted(jpeg.ZIGZAG.tolist()) == list(range(64))
    image = jpeg.Image(16, 16, [jpeg.Component(1, 2, 2, 0, 2, 2, 2, 2, np.zeros((4, 64), np.int16)), jpeg.Component(2, 1, 1, 0, 1, 1, 1, 1, np.zeros((1, 64), np.int16)), jpeg.Component(3, 1, 1, 0, 1, 1, 1, 1, np.zeros((1, 64), np.int16))], {0: np.ones(64, np.float32)})
    image.components[0].coefficients[:, 0] = [0, 80, 160, 240]
    x = jpeg.tensor(image)
    assert x.shape == (16, 16, 3)
    assert [int(x[r, c, 0]) for r, c in ((0, 0), (0, 15), (15, 0), (15, 15))] == [128, 138, 148, 158]
    image.components[2].coefficients[0, 0] = 80
    assert int(jpeg.tensor(image)[0, 0, 0]) == 142


def test_jpeg_bit_reader_with_runs_and_interleaved_scan():
    """A hand-made stream: interleaved differential DC, AC with runs, an end-of-band run, a refinement."""
    bits = []

    def put(value, n):
        bits.extend((value >> (n - 1 - k)) & 1 for k in range(n))

    def flush():
        while len(bits) % 8:
            bits.append(1)
        out = np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\0")
        bits.clear()
        return out

    seg, scan = jpeg._segment, jpeg._scan
    frame = bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0])  # 16x8, one component, two blocks
    dht = seg(0xC4, bytes([0, 0, 2, *[0] * 14, 3, 2])) + seg(0xC4, bytes([0x10, 0, 3, *[0] * 14, 0x12, 0x10, 0x01])) + seg(0xC4, bytes([0x11, 0, 2, *[0] * 14, 0x01, 0x00]))
    put(0, 2), put(5, 3)  # DC 5
    put(1, 2), put(0, 2)  # difference -3
    dc = flush()
    put(0, 2), put(3, 2)  # run 1, size 2: coefficient 2 = 3
    put(1, 2), put(1, 1)  # EOB run of 2 + 1 blocks
    ac = flush()
    put(0, 2), put(1, 1)  # new coefficient 1 = +1; before it nothing is passed
    put(1, 2), put(1, 1)  # end of band; the correction bit of coefficient 2
    put(1, 2)
    refine = flush()
    data = b"\xff\xd8" + jpeg._DQT + seg(0xC2, frame) + dht + scan(1, 0, 0, 0, 0, 0, 1, dc) + scan(1, 0, 0, 1, 63, 0, 1, ac) + scan(1, 0, 1, 1, 63, 1, 0, refine) + b"\xff\xd9"
    c = jpeg.decode(data).components[0].coefficients
    assert c[:, 0].tolist() == [10, 4]
    assert c[0, :4].tolist() == [10, 1, 7, 0]
    assert not c[1, 1:].any()


@pytest.mark.parametrize("data", [b"", b"abc", b"\xff\xd8\xff\xd9x", b"\xff\xd8\xff\xc0\0\4ab", jpeg.encode_payload(bytes(64))[:200]])
def test_jpeg_refuses_broken_files(data):
    try:
        image = jpeg.decode(data)
    except jpeg.BadMedia:
        return
    with pytest.raises(jpeg.BadMedia):
        jpeg.payload_of(image)


def test_media_round_trip_and_tensors(spark, odd, none):
    rows = {(r.doc_id, r.n_bytes): r for r in media.round_trip(odd).collect()}
    for r in odd.collect():
        raw = (r.text or "").encode()
        p = media.pad(raw)
        got = rows[r.doc_id, len(raw)]
        assert (got.payload_bytes, got.payload_sha256, got.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert rows[7, 18].feature == rows[8, 18].feature and rows[7, 18].media_sha256 == rows[8, 18].media_sha256
    assert media.round_trip(none).count() == 0
    broken = spark.createDataFrame([(1, b"no image"), (2, None), (3, jpeg.encode_payload(bytes(64)))], "k int, media binary")
    out = {r.k: r for r in media.tensors(broken).collect()}
    assert out[1].error and out[1].rgb is None and out[2].rgb is None and out[2].error is None
    assert len(out[3].rgb) == out[3].height * out[3].width * 3


def test_stored_tensors_are_the_decoded_pictures(spark, odd, tmp_path):
    import numpy as np

    stored = media.store(odd.filter("doc_id <> 6"))
    media.store_tensors(stored, str(tmp_path / "rgb"))
    got = spark.read.parquet(str(tmp_path / "rgb"))
    assert got.columns == ["doc_id", "n_bytes", "height", "width", "rgb", "error"]
    want = {r.doc_id: media.jpeg.tensor(media.jpeg.decode(bytes(r.media))) for r in stored.collect()}
    for r in got.collect():
        picture = np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3)
        assert r.error is None and (picture == want[r.doc_id]).all()


def test_token_lookup_cuts_and_lays_out_whole_batches(library, monkeypatch):
    """Every white space of the fast alphabet, empty texts, long and odd words: the library's ids, with a full memory too; a distinct chunk is looked up once."""
    monkeypatch.setattr(tokens, "MEMORY", 20)
    rnd = random.Random(3)
    bits = ["a", "b's", "é", " ", "\n", "\x0b", "\x0c", "\r", "\t", "  ", "12", "y" * 70, "<|endoftext|>", "日", "İ", "!!"]
    texts = ["", "  ", " a "] + ["".join(rnd.choice(bits[: rnd.choice([12, 16])]) for _ in range(rnd.randint(0, 30))) for _ in range(600)]
    known = tokens.Library(tokenizer())
    for k in range(0, len(texts), 50):
        got = known.encode(texts[k : k + 50])
        assert [g.tolist() for g in got] == [e.ids for e in library.encode_batch(texts[k : k + 50], add_special_tokens=False)]
    assert known.encode([]) == [] and not any(len(w) > bpe.CACHE_CHARS for w in known.known)
    ids, first, apart = known.flat(["same words here", "日", "same words"])
    assert list(apart) == [1] and first.tolist()[1] == first.tolist()[2] and len(ids) == first[-1]
