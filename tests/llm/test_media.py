import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corelens.llm import media


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=1000), st.integers(0, 200))
def test_round_trip(data, times):
    payload = media.padded(data * times)
    assert len(payload) % 64 == 0 and payload[: len(data * times)] == data * times
    stream = media.mux(payload)
    found = media.demux(stream)
    assert found.payload == payload and found.continuity_errors == 0 and found.packets * 188 == len(stream)
    assert found.stamps == [k * media.TICKS for k in range(-(-len(payload) // media.UNIT))]
    assert [pts for pts, _ in found.access_points] == found.stamps[:: media.RAP_EVERY]


def test_tables_and_damage():
    stream = media.mux(media.padded(b"x" * 70_000))
    rows = np.frombuffer(stream, np.uint8).reshape(-1, 188)
    assert (rows[:, 0] == 0x47).all() and set((rows[:, 1].astype(int) & 0x1F) << 8 | rows[:, 2]) == {0, 0x1000, 0x100}
    lost = np.delete(rows, 10, axis=0).tobytes()
    assert media.demux(lost).continuity_errors == 1
    for bad in (b"", stream[:-1], b"\0" + stream[1:], stream[:20] + b"\x99" + stream[21:], stream[188 * 2 :]):
        with pytest.raises(ValueError):
            media.demux(bad)


def test_section_crc():
    assert media.section_crc(b"123456789") == 0x0376E6E7  # the published check value of CRC-32/MPEG-2


def test_columns(spark):
    long = "é" * 300_000
    df = spark.createDataFrame([(1, "abc", 5), (1, "abc", 5), (None, None, 6), (2, "", None), (3, long, None)], "doc_id long, text string, n_bytes int")
    rows = media.media_columns(df, keep_media=True).collect()
    texts = {1: b"abc", None: b"", 2: b"", 3: long.encode()}
    for r in rows:
        payload = media.padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest()) and "continuity_errors=0" in r.feature
        assert r.pts == [k * media.TICKS for k in range(-(-len(payload) // media.UNIT))] and [p.pts for p in r.access_points] == r.pts[:: media.RAP_EVERY]
        for p in r.access_points:  # the stream can be read from the tables before each of them
            assert media.demux(r.media[(p.packet - 2) * 188 :]).stamps[0] == p.pts
    assert len(rows) == 5 and len({repr(tuple(r)[1:]) for r in rows}) == 3
    assert media.media_columns(df.limit(0)).collect() == []


def test_units_with_a_lost_packet_are_left_out():
    payload = bytes(range(256)) * 400
    rows = np.frombuffer(media.mux(payload), np.uint8).reshape(-1, 188)
    starts = [k for k in range(len(rows)) if rows[k, 1] & 0x40 and (int(rows[k, 1]) & 0x1F) << 8 | int(rows[k, 2]) == media.ES_PID]
    found = media.demux(np.delete(rows, starts[2] + 3, axis=0).tobytes())
    assert (found.continuity_errors, found.lost_units) == (1, 1)
    assert found.payload == payload[: 2 * media.UNIT] + payload[3 * media.UNIT :] and found.stamps == [k * media.TICKS for k in range(7) if k != 2]
    twice = media.demux(np.repeat(rows, [2 if k == starts[1] else 1 for k in range(len(rows))], axis=0).tobytes())
    assert twice.payload == payload and twice.continuity_errors == 0


def test_several_programs_and_long_sections():
    """Two programs interleaved; the second one's PMT needs several packets."""
    a, b = media.padded(b"first " * 9_000), media.padded(b"second " * 8_000)
    streams = []
    for payload, pid in ((a, 0x0100), (b, 0x0200)):
        rows = np.frombuffer(media.mux(payload), np.uint8).reshape(-1, 188).copy()
        rows = rows[((rows[:, 1].astype(int) & 0x1F) << 8 | rows[:, 2]) == media.ES_PID]
        rows[:, 1], rows[:, 2] = rows[:, 1] & 0xE0 | pid >> 8, pid & 0xFF
        streams.append([r.tobytes() for r in rows])
    tables = media.section_packets(0, media.pat({0: 0x10, 1: 0x1000, 7: 0x1001}), 0) + media.section_packets(0x1000, media.pmt(1, 0x0100), 0) + media.section_packets(0x1001, media.pmt(7, 0x0200, bytes(range(250)) * 3), 0)
    mixed = b"".join(x for pair in zip(*streams) for x in pair) + b"".join(x for s in streams for x in s[min(map(len, streams)) :])
    assert media.demux(tables + mixed).payload == a
    assert media.demux(tables + mixed, 7).payload == b
