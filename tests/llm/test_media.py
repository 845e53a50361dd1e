import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sonora.llm import media


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=2000), st.integers(0, 300))
def test_round_trip(data, more):
    payload = data * more if more < 60 else data
    stream = media.decode(media.encode(payload))
    assert stream.payload == payload
    assert stream.discontinuities == 0
    assert len(stream.timestamps) == -(-len(payload) // media.UNIT_BYTES)


def test_every_length_near_packet_edges():
    for n in [*range(0, 800), *range(16380, 16390), *range(65530, 65545)]:
        payload = bytes(i * 7 % 251 for i in range(n))
        assert media.decode(media.encode(payload)).payload == payload


def test_access_points_and_timestamps():
    stream = media.decode(media.encode(b"x" * (media.UNIT_BYTES * 9)))
    assert stream.timestamps == [3000 * i for i in range(9)]
    assert [t for _, t in stream.access] == [0, 12000, 24000]


def test_damage_is_seen():
    good = media.encode(b"abc" * 5000)
    with pytest.raises(ValueError):
        media.decode(b"\x00" + good[1:])
    with pytest.raises(ValueError):
        media.decode(good[:14] + b"\x55" + good[15:])
    lost = good[: 188 * 5] + good[188 * 6 :]
    with pytest.raises(ValueError):
        media.decode(lost)  # a continuity gap leaves an elementary packet too short


def test_query(spark):
    long = "é" * 70000
    texts = [(1, None), (2, ""), (3, "a" * 64), (4, "a" * 65), (5, long), (6, long), (None, "x")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "text as payload", "1 as media")
    rows = media.digests(docs).collect()
    assert len(rows) == 7
    for row in rows:
        text = next(t for i, t in texts if i == row.doc_id)
        raw = (text or "").encode()
        want = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert row.n_bytes == len(raw) and row.payload_bytes == len(want)
        assert row.payload_sha256 == hashlib.sha256(want).hexdigest()
        assert row.tail_crc32 == zlib.crc32(want[-64:])
        assert row.media_sha256 == hashlib.sha256(media.encode(want)).hexdigest()
        assert row.media_bytes == len(media.encode(want))
    assert media.digests(docs.limit(0)).count() == 0


#: Written by hand: program 1 on PID 0x1000 with one stream on PID 0x100; checksums are those of common encoders.
PAT = bytes.fromhex("4740001000" "00b00d0001c100000001f0002ab104b2").ljust(188, b"\xff")
PMT = bytes.fromhex("4750001000" "02b0120001c10000e100f0001be100f00015bd4d56").ljust(188, b"\xff")
PES = bytes.fromhex("000001bd000b8480052100010001") + b"abc"


def packet(counter, pes):
    field = 188 - 5 - len(pes)
    return bytes([0x47, 0x41, 0x00, 0x30 | counter, field, 0x40]) + b"\xff" * (field - 1) + pes


def test_a_stream_written_by_hand():
    later = PES[:9] + bytes.fromhex("2100017521") + b"xyz"  # its timestamp: 0x75 in the fourth byte, 16 in the fifth
    stream = media.decode(PAT + PMT + packet(0, PES) + packet(1, later))
    assert stream.payload == b"abcxyz" and stream.packets == 4 and stream.discontinuities == 0
    assert stream.timestamps == [0, 0x75 << 7 | 0x21 >> 1] and stream.access == [(2, 0), (3, stream.timestamps[1])]
    twice = media.decode(PAT + PMT + packet(0, PES) + packet(0, PES) + packet(1, later))
    assert twice.payload == b"abcxyz" and twice.discontinuities == 0 and twice.packets == 5
    gap = media.decode(PAT + PMT + packet(0, PES) + packet(2, later))
    assert gap.payload == b"abcxyz" and gap.discontinuities == 1
    filled = media.decode(PAT + PMT + packet(0, PES) + bytes([0x47, 0x1F, 0xFF, 0x10]) + b"\xff" * 184 + packet(1, later))
    assert filled.payload == b"abcxyz" and filled.discontinuities == 0


def test_damaged_streams_in_a_table(spark):
    good = media.encode(b"abc" * 100)
    rows = [(1, good), (2, good[:-1]), (3, None), (4, b""), (5, good[:14] + b"\x55" + good[15:]), (6, PAT + PMT + packet(0, PES[:5]))]
    df = spark.createDataFrame([(i, 300, bytearray(m) if m is not None else None) for i, m in rows], "doc_id long, n_bytes long, media binary")
    found = {r.doc_id: r for r in media.load(df).collect()}
    assert bytes(found[1].payload) == b"abc" * 100 and found[1].error is None
    assert all(found[i].payload is None and found[i].error for i in range(2, 7))
