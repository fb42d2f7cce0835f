"""Media columns: payloads stored as MPEG transport streams and read back from them.

`mux` writes one program: a PAT, a PMT and one elementary stream of private PES packets. A PES packet carries one
access unit with a PTS; the first TS packet of an access unit carries a PCR and, at every RAP_EVERY-th unit, the
random-access flag, with the tables before it, so that reading can begin there. `demux` finds the stream through the program tables (of any number of programs, sections over any
number of packets), checks section CRCs and continuity counters, skips repeated packets, leaves out access units that miss a packet, reassembles
the others and lists their time stamps and the random-access points. Both lists are stored as columns.

Defined cases: a null text is the empty text; the payload of an empty text is 64 zero bytes; repeated rows give
repeated, equal rows; an empty table gives an empty table; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelens.session import bounded_batches

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, ES_PID = 0x0000, 0x1000, 0x0100
#: Bytes of an access unit, ticks of the 90 kHz clock between two, and access units from one random-access point to the next.
UNIT, TICKS, RAP_EVERY = 16_384, 3_600, 8
STREAM_TYPE, STREAM_ID = 0x06, 0xBD

MEDIA_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<bigint>, access_points array<struct<pts:bigint,packet:bigint>>"


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        value = byte << 24
        for _ in range(8):
            value = ((value << 1) ^ 0x04C11DB7 if value & 0x80000000 else value << 1) & 0xFFFFFFFF
        out.append(value)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """CRC-32 of program tables (polynomial 04C11DB7, no reflection)."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ _CRC[(crc >> 24) ^ byte]
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    section = bytes([table_id, 0xB0 | length >> 8, length & 0xFF, number >> 8, number & 0xFF, 0xC1, 0, 0]) + body
    return section + section_crc(section).to_bytes(4, "big")


def section_packets(pid: int, section: bytes, counter: int) -> bytes:
    """The TS packets of a section."""
    out, data = [], b"\0" + section
    for k, at in enumerate(range(0, len(data), PACKET - 4)):
        packet = bytes([SYNC, (0x00 if k else 0x40) | pid >> 8, pid & 0xFF, 0x10 | (counter + k) % 16]) + data[at : at + PACKET - 4]
        out.append(packet + b"\xff" * (PACKET - len(packet)))
    return b"".join(out)


def pat(programs: dict[int, int]) -> bytes:
    """The section that names the PMT's PID of each program."""
    return _section(0x00, 1, b"".join(bytes([n >> 8, n & 0xFF, 0xE0 | pid >> 8, pid & 0xFF]) for n, pid in programs.items()))


def pmt(number: int, pid: int, descriptors: bytes = b"") -> bytes:
    """The section of a program with one elementary stream."""
    return _section(0x02, number, bytes([0xE0 | pid >> 8, pid & 0xFF, 0xF0 | len(descriptors) >> 8, len(descriptors) & 0xFF]) + descriptors + bytes([STREAM_TYPE, 0xE0 | pid >> 8, pid & 0xFF, 0xF0, 0]))


_PAT, _PMT = pat({1: PMT_PID}), pmt(1, ES_PID)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 30 & 7) << 1, pts >> 22 & 0xFF, 1 | (pts >> 15 & 0x7F) << 1, pts >> 7 & 0xFF, 1 | (pts & 0x7F) << 1])


def _unit_packets(unit: bytes, number: int, counter: int) -> np.ndarray:
    """The TS packets of one access unit, as rows of 188 bytes."""
    pts = number * TICKS % (1 << 33)
    length = 8 + len(unit)
    pes = bytes([0, 0, 1, STREAM_ID, length >> 8, length & 0xFF, 0x84, 0x80, 5]) + _stamp(pts) + unit
    base = pts  # the PCR counts the same 90 kHz ticks
    lead = bytes([0x50 if number % RAP_EVERY == 0 else 0x10]) + (base << 15 | 0x7E00).to_bytes(6, "big")
    first = min(len(pes), PACKET - 4 - 1 - len(lead))
    rest = len(pes) - first
    n = 1 + -(-rest // 184)
    rows = np.full((n, PACKET), 0xFF, np.uint8)
    rows[:, 0], rows[:, 1], rows[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
    rows[:, 3] = 0x10 | (counter + np.arange(n)) % 16
    rows[0, 1] |= 0x40
    rows[0, 3] |= 0x20
    field_length = PACKET - 5 - first  # stuffing is part of the adaptation field
    rows[0, 4] = field_length
    rows[0, 5 : 5 + len(lead)] = np.frombuffer(lead, np.uint8)
    data = np.frombuffer(pes, np.uint8)
    rows[0, PACKET - first :] = data[:first]
    full, tail = divmod(rest, 184)
    if full:
        rows[1 : 1 + full, 4:] = data[first : first + full * 184].reshape(full, 184)
    if tail:
        rows[-1, 3] |= 0x20
        rows[-1, 4] = 183 - tail
        if tail < 183:
            rows[-1, 5] = 0
        rows[-1, PACKET - tail :] = data[len(pes) - tail :]
    return rows


def mux(payload: bytes) -> bytes:
    """The transport stream that stores payload."""
    parts, counter = [], 0
    for number, at in enumerate(range(0, len(payload), UNIT)):
        if number % RAP_EVERY == 0:
            parts += [section_packets(PAT_PID, _PAT, number // RAP_EVERY), section_packets(PMT_PID, _PMT, number // RAP_EVERY)]
        rows = _unit_packets(payload[at : at + UNIT], number, counter)
        counter = (counter + len(rows)) % 16
        parts.append(rows.tobytes())
    return b"".join(parts)


@dataclass
class Demuxed:
    """What a transport stream holds: payload, PTS of each access unit, (PTS, packet number) of random-access points; lost_units: access units left out."""

    payload: bytes
    stamps: list[int] = field(default_factory=list)
    access_points: list[tuple[int, int]] = field(default_factory=list)
    continuity_errors: int = 0
    lost_units: int = 0
    packets: int = 0


def _sections(rows: np.ndarray, pids: np.ndarray, pid: int, table_id: int) -> list[bytes]:
    """The sections of a PID, each packet's payload appended to the one that it goes on."""
    held, out = b"", []
    for k in np.flatnonzero(pids == pid).tolist():
        packet = rows[k].tobytes()
        data = packet[5 + packet[4] if packet[3] & 0x20 else 4 :]
        if packet[1] & 0x40:
            held, data = b"", data[1 + data[0] :]
        held += data
        while len(held) >= 3 and held[0] != 0xFF and len(held) >= (size := 3 + ((held[1] & 0x0F) << 8 | held[2])):
            section, held = held[:size], held[size:]
            if section[0] == table_id and section_crc(section):
                raise ValueError(f"damaged section on PID {pid:#x}")
            if section[0] == table_id:
                out.append(section)
    if not out:
        raise ValueError(f"no section on PID {pid:#x}")
    return out


def programs(rows: np.ndarray, pids: np.ndarray) -> dict[int, int]:
    """Elementary stream's PID of each program, by the first PAT and their PMTs."""
    table = _sections(rows, pids, PAT_PID, 0x00)[0]
    out = {}
    for at in range(8, len(table) - 4, 4):
        if number := table[at] << 8 | table[at + 1]:  # program 0 names the network's PID
            own = next(x for x in _sections(rows, pids, (table[at + 2] & 0x1F) << 8 | table[at + 3], 0x02) if x[3] << 8 | x[4] == number)
            info = (own[10] & 0x0F) << 8 | own[11]
            out[number] = (own[13 + info] & 0x1F) << 8 | own[14 + info]
    return out


def demux(stream: bytes, program: int | None = None) -> Demuxed:
    """Read a program of a transport stream, by default the first; raises ValueError where tables or packets are damaged."""
    if len(stream) % PACKET or not stream:
        raise ValueError("not whole packets")
    rows = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (rows[:, 0] != SYNC).any():
        raise ValueError("lost sync")
    pids = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    streams = programs(rows, pids)
    where = np.flatnonzero((pids == (streams[program] if program else next(iter(streams.values())))) & (rows[:, 3] & 0x10 > 0))
    own = rows[where]
    again = np.zeros(len(own), bool)
    again[1:] = (own[1:] == own[:-1]).all(axis=1)  # a packet may be sent twice
    where, own = where[~again], own[~again]
    out = Demuxed(b"", packets=len(rows))
    counters = own[:, 3].astype(int) & 0x0F
    gaps = np.concatenate([[0], np.cumsum((counters[1:] - counters[:-1]) % 16 != 1)])  # before each packet
    out.continuity_errors = int(gaps[-1]) if len(own) else 0
    adapted = (own[:, 3] & 0x20) > 0
    begins = np.where(adapted, 5 + own[:, 4].astype(int), 4)
    data = own[np.arange(PACKET)[None, :] >= begins[:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(PACKET - begins)])
    starts = np.flatnonzero(own[:, 1] & 0x40)
    parts = []
    for k, packet in enumerate(starts):
        stop = int(starts[k + 1]) if k + 1 < len(starts) else len(own)
        at, end = int(ends[packet]), int(ends[stop])
        if data[at : at + 3] != b"\0\0\1":
            raise ValueError("damaged PES header")
        size = data[at + 4] << 8 | data[at + 5]
        if gaps[stop - 1] != gaps[packet] or end - at < 6 + size:
            out.lost_units += 1
            continue
        head = data[at + 9 : at + 14]
        pts = (head[0] >> 1 & 7) << 30 | head[1] << 22 | (head[2] >> 1) << 15 | head[3] << 7 | head[4] >> 1
        out.stamps.append(pts)
        if adapted[packet] and own[packet, 4] and own[packet, 5] & 0x40:
            out.access_points.append((pts, int(where[packet])))
        parts.append(data[at + 9 + data[at + 8] : at + 6 + size])
    out.payload = b"".join(parts)
    return out


def padded(text: bytes) -> bytes:
    return text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))


def features(found: Demuxed) -> str:
    """Features of the samples read back and of the stream's structure."""
    counts = np.bincount(np.frombuffer(found.payload, np.uint8), minlength=256)
    shares = counts[counts > 0] / len(found.payload)
    mean = float((counts * np.arange(256)).sum() / len(found.payload))
    return f"mean={mean:.4f};entropy={-(shares * np.log2(shares)).sum():.4f};units={len(found.stamps)};last_pts={found.stamps[-1]};access_points={len(found.access_points)};packets={found.packets};continuity_errors={found.continuity_errors}"


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Store each text as a transport stream, read it back, and describe both; keep_media adds the stream itself.

    One map over the rows without a shuffle; memory is bounded by one text and its stream.
    """
    bounded_batches(docs.sparkSession)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or b""
                stream = mux(padded(text))
                found = demux(stream)
                rows.append(
                    (doc, len(text), len(found.payload), hashlib.sha256(found.payload).hexdigest(), zlib.crc32(found.payload[-64:]), len(stream), hashlib.sha256(stream).hexdigest(), features(found), found.stamps, [{"pts": pts, "packet": packet} for pts, packet in found.access_points], *([stream] if keep_media else []))
                )
            columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    names = [x.split()[0] for x in MEDIA_SCHEMA.split(", ")] + ["media"] * keep_media
    of = {"long": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "array<struct<pts:bigint,packet:bigint>>": pa.list_(pa.struct([("pts", pa.int64()), ("packet", pa.int64())]))}
    kinds = [of[x.split()[1]] for x in MEDIA_SCHEMA.split(", ")] + [pa.binary()] * keep_media
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(described, MEDIA_SCHEMA + ", media binary" * keep_media)
