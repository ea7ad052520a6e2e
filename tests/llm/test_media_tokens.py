"""Transport streams, tokens, bit planes and packing against plain versions."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import bitplane, media_ts, packing, tokens
from tidelog.llm.common import fresh_path
from tidelog.llm.queries import tokenizer_path

ODD = [None, "", "  a  b\n\n c \t d", "it's don't I'LL 'S", "x y", "<|endoftext|> a", "naïve ÀÉ ŁÓDŹ ıİ ß ſ", "a\n \n b ", "\n", "1234 5.6 ² ٣", "日本語 text", "é x", " !!!'s", "a_b_c", "word " * 9000, "same", "same"]


def frame(spark, texts=ODD):
    """With columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "en", "s", 1, 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, length int, feature string")


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=30_000))
def test_mux_round_trip(data):
    ts = media_ts.mux(data)
    s = media_ts.demux(ts)
    assert len(ts) % 188 == 0 and s.data.get(media_ts.ES_PID, b"") == data
    assert not s.cc_errors and not s.bad_sections and not s.lost_bytes
    assert s.programs == {1: media_ts.PMT_PID} and s.streams == {media_ts.ES_PID: (1, media_ts.STREAM_TYPE)}


def test_demux_reports_damage():
    ts = bytearray(media_ts.mux(bytes(range(256)) * 200))
    lost = bytes(ts[: 188 * 5] + ts[188 * 6 :])
    assert sum(media_ts.demux(lost).cc_errors.values()) == 1
    twice = bytes(ts[: 188 * 6] + ts[188 * 5 :])
    assert media_ts.demux(twice).duplicates == 1 and media_ts.demux(twice).data == media_ts.demux(bytes(ts)).data
    assert media_ts.demux(b"junk" + bytes(ts)).lost_bytes == 4
    ts[20] ^= 1
    assert media_ts.demux(bytes(ts)).bad_sections == 1
    assert media_ts.demux(None).packets == 0 and media_ts.demux(b"\x47").packets == 0


def test_time_stamps():
    s = media_ts.demux(media_ts.mux(bytes(576 * 16 * 20)))
    assert [p.pts for p in s.pes] == [k * 16 * media_ts.TICKS for k in range(20)]
    assert [p.index for p in s.pes if p.random_access] == [0, 8, 16] and s.pcr == [k * 16 * media_ts.TICKS * 300 for k in (0, 8, 16)]


def test_op1(spark):
    got = {r.doc_id: r for r in media_ts.op1_transport_stream(frame(spark)).collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert r.media_sha256 == hashlib.sha256(media_ts.mux(p)).hexdigest()
        x = media_ts.demux(media_ts.mux(p))
        assert [(a.pts, a.es_offset) for a in r.access_points] == [(q.pts, q.offset) for q in x.pes if q.random_access] and r.n_random_access == len(r.access_points) > 0
    assert got[15].feature == got[16].feature
    assert media_ts.pes_index(media_ts.encode_media(frame(spark))).where("random_access").count() >= len(ODD)
    assert media_ts.op1_transport_stream(frame(spark).limit(0)).count() == 0


def test_feature_holds_every_random_access_point():
    s = media_ts.demux(media_ts.mux(bytes(576 * 16 * 8 * 20)))
    listed = media_ts.feature(s).split(";raps=20@")[1].split(";")[0].split(",")
    assert listed == [f"{p.pts}/{p.offset}" for p in s.pes if p.random_access] and len(listed) == 20
    before = media_ts.feature(s)
    s.pes[5].pts += 1
    assert media_ts.feature(s) != before


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_the_tokenizer(name):
    e = tokens.Encoder(tokenizer_path(name), memo=50)
    assert e.cut
    rng = random.Random(3)
    alphabet = "abcXYZéñß'.,!0123  \n\t-_&µ²"
    for t in [t or "" for t in ODD] + ["".join(rng.choices(alphabet, k=200)) for _ in range(200)]:
        assert e.encode(t) == e._whole(t), t


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_added_tokens_are_the_contracts(name):
    from tokenizers import Tokenizer

    plain, e = Tokenizer.from_file(tokenizer_path(name)), tokens.Encoder(tokenizer_path(name))
    assert plain.token_to_id("<|endoftext|>") is not None
    for t in ["foo <|endoftext|> bar", "a<|startoftext|>b <|endoftext|>", "FOO <|ENDOFTEXT|> bar", "<|endoftext", "日本 <|endoftext|>"]:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=500), st.sampled_from([1, 8]), st.integers(1, 100))
def test_planes_round_trip(ids, unit, block):
    a = np.array(ids, "<u4")
    blob = bitplane.encode_ids(a, unit, block)
    assert (bitplane.decode_ids(blob) == a).all()
    if len(a):
        assert (bitplane.decode_ids(blob, range(1)) == a[:block]).all()


def test_damaged_chunk():
    blob = bytearray(bitplane.encode_ids(np.arange(100, dtype="<u4")))
    blob[-3] ^= 1
    with pytest.raises(Exception):
        bitplane.decode_ids(bytes(blob))
    with pytest.raises(ValueError):
        bitplane.decode_ids(b"NOPE" + bytes(blob[4:]))


def test_op8(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    chunks = bitplane.write_ids(frame(spark), path, 2, fresh_path(spark, "t"), unit=1, chunk_ids=100)
    got = bitplane.read_documents(chunks).orderBy("doc_id").collect()
    e, at = tokens.encoder(path), 0
    for r, t in zip(got, ODD, strict=True):
        raw = e._whole(t or "") + b"\2\0\0\0"
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(raw) // 4, zlib.crc32(raw))
        at += len(raw) // 4
    assert bitplane.op8_bit_planes(frame(spark).limit(0), path).count() == 0


def check_packing(rows, capacity=4096):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_op6(spark):
    path = tokenizer_path("word_bpe_49k.json")
    rows = packing.op6_vector_best_fit(frame(spark), path).collect()
    e = tokens.encoder(path)
    total = 0
    for i, t in enumerate(ODD):
        raw = e._whole(t or "") + b"\1\0\0\0"
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [(r.start, r.length, r.ids_crc32) for r in own] == [(a // 4, len(raw[a : a + 16384]) // 4, zlib.crc32(raw[a : a + 16384])) for a in range(0, len(raw), 16384)]
        total += len(raw) // 4
    assert check_packing(rows) == -(-total // 4096)
    assert packing.op6_vector_best_fit(frame(spark).limit(0), path).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 30), max_size=30), st.sampled_from(["norm", "dot"]), st.integers(1, 12), st.integers(10_000, 20_000))
def test_plan_keeps_every_capacity(histogram, score, documents, attention):
    slots, bins = packing.plan(histogram, packing.Capacity(100, documents, attention, (1, 0.5, 0.5), score))
    held = defaultdict(list)
    ranks = defaultdict(list)
    for s in slots:
        for k in range(s.last - s.first + 1):
            held[s.bin + k // s.each].append((s.offset + k % s.each * s.length, s.length))
            ranks[s.length].append(s.first + k)
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in histogram.items()} and len(held) == bins
    for v in held.values():
        assert len(v) <= documents and sum(n * n for _, n in v) <= attention and sum(n for _, n in v) <= 100
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
