import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from triplane.llm import flac_media as M

AWKWARD = [
    b"", b"a", b"\0" * 64, bytes(range(256)) * 40, b"hello world " * 1000, b"x" * 5000, random.Random(1).randbytes(10_000),
    bytes([0, 255] * 300), bytes([0] * 1000 + [255] + [0] * 3000), b"ab", b"abcdefgh", b"x" * (M.BLOCK * 140 + 3),
]


def test_round_trip_of_many_at_once():
    streams = M._encode_slice(AWKWARD)
    assert [x for x, _ in M._decode_slice(streams)] == AWKWARD
    assert [M._encode_slice([p])[0] for p in AWKWARD] == streams  # neighbours don't matter


def test_runs_of_frames_make_the_same_streams(monkeypatch):
    streams, features = M._encode_slice(AWKWARD), [M.feature(p) for p in AWKWARD]
    whole = M._decode_slice(streams)
    monkeypatch.setattr(M, "SLICE", 2 * M.BLOCK)
    monkeypatch.setattr(M, "DECODE_SLICE", 3 * M.BLOCK)
    assert M._encode_slice(AWKWARD) == streams and [M.feature(p) for p in AWKWARD] == features
    for (pcm, table), (pcm_in_runs, table_in_runs) in zip(whole, M._decode_slice(streams), strict=True):
        assert pcm == pcm_in_runs and table.tolist() == table_in_runs.tolist()


def test_seek_points_in_a_wrong_order_are_noticed():
    (stream,) = M._encode_slice([random.Random(6).randbytes(4 * M.BLOCK)])
    for point in range(4):
        for bit in (0, 30, 63):
            bad = bytearray(stream)
            bad[46 + 18 * point + 8 + bit // 8] ^= 1 << bit % 8
            with pytest.raises(M.CorruptMedia):
                M._decode_slice([bytes(bad)])


def test_a_long_payload_takes_a_few_copies_of_itself():
    """Peak memory, against that of a payload of one run."""
    code = """
import random, resource, sys
from triplane.llm import flac_media as M
def both(n):
    p = random.Random(5).randbytes(1 << 16) * (n >> 17) + b"many words of a text " * ((n >> 1) // 21)
    ((back, _),) = M._decode_slice(M._encode_slice([p]))
    assert back == p and M.feature(p)
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10
print(both(1 << 20), both(24 << 20))
"""
    import subprocess
    import sys

    short, long = map(int, subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, text=True, timeout=300).stdout.split())
    assert long - short < 8 * 24


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=5))
def test_any_bytes(payloads):
    if payloads:
        assert [x for x, _ in M._decode_slice(M._encode_slice(payloads))] == payloads


def test_blocks_can_be_sought():
    data = random.Random(2).randbytes(3 * M.BLOCK + 100)
    (stream,) = M._encode_slice([data])
    ((_, table),) = M._decode_slice([stream])
    assert table[:, 0].tolist() == [0, M.BLOCK, 2 * M.BLOCK, 3 * M.BLOCK]
    first = len(stream) - len(stream[stream.index(b"\xff\xf8") :])
    assert all(stream[first + o : first + o + 2] == b"\xff\xf8" for o in table[:, 1])


def test_every_flipped_bit_is_noticed():
    (stream,) = M._encode_slice([b"some text that is coded by residuals, some text again and again " * 20])
    for bit in range(8 * (42 + 4 + 18), 8 * len(stream)):
        bad = bytearray(stream)
        bad[bit // 8] ^= 1 << bit % 8
        with pytest.raises(M.CorruptMedia):
            M._decode_slice([bytes(bad)])


def test_crc_against_bitwise():
    def plain(data, poly, bits):
        r = 0
        for b in data:
            r ^= b << (bits - 8)
            for _ in range(8):
                r = (r << 1 ^ poly if r >> (bits - 1) & 1 else r << 1) & (1 << bits) - 1
        return r

    import numpy as np

    data = random.Random(3).randbytes(500)
    spans = [(0, 1), (1, 200), (200, 500)]
    got = M.crc16(np.frombuffer(data, dtype=np.uint8), np.array([a for a, _ in spans]), np.array([b for _, b in spans]))
    assert got.tolist() == [plain(data[a:b], 0x8005, 16) for a, b in spans]
    assert M.crc8(data) == plain(data, 0x07, 8)


def test_digest_on_spark(spark):
    rows = [(1, "Hello é" * 700, "x"), (2, None, "y"), (3, "", "z"), (4, "Hello é" * 700, None), (None, "b" * 64, "")]
    got = {r.doc_id: r for r in M.digest(spark.createDataFrame(rows, "doc_id long, text string, media string")).collect()}
    assert len(got) == 5
    for i, t, _ in rows:
        raw = (t or "").encode()
        whole = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        (stream,) = M._encode_slice([whole])
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(whole[-64:]), len(stream), hashlib.sha256(stream).hexdigest())
        assert r.feature == M.feature(whole)


def test_blocks_on_spark(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, b"ab" * 5000), (2, b""), (3, None)], "id long, raw binary")
    blocks = M.pcm_blocks(docs.withColumn("media", M.encode(F.col("raw"))), "id", "media").orderBy("id", "first_sample").collect()
    assert b"".join(bytes(b.pcm) for b in blocks) == b"ab" * 5000
    assert [b.first_sample for b in blocks] == [0, 4096, 8192]
    assert M.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
