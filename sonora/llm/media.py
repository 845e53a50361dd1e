"""MPEG transport streams as media columns.

A payload goes into one elementary stream of one program: a program association table and a program
map table, then elementary packets (PES) of a bounded size, each with a presentation timestamp, cut
into 188-byte packets with continuity counters. Every few elementary packets the tables are repeated
and the next packet is marked as a random-access point with a clock reference.

Reading checks the sync bytes, the tables' checksums, the continuity counters and the elementary
packets' lengths, and gives the payload with its timestamps and random-access points.

A packet that comes twice with the same counter and payload, as the standard allows, counts once.

Null and empty texts and payloads are streams of tables without elementary packets. A stream that is damaged, null or
empty gives a row with an error. Texts of any length are stored whole; one text and its stream are held at once. Rows
are independent, so repeated rows, equal ids and ties give equal rows, and null ids stay null. Empty tables give no
rows. Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonora.llm.common import map_rows

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, STREAM_PID = 0x0000, 0x1000, 0x0100
#: Packets that only fill; their counters mean nothing.
NO_PID = 0x1FFF
PROGRAM, PRIVATE_STREAM, PRIVATE_DATA = 1, 0xBD, 0x06
#: Payload bytes of an elementary packet, its duration in ticks of 90 kHz, and packets from one random-access point to the next.
UNIT_BYTES, UNIT_TICKS, UNITS_PER_ACCESS = 16384, 3000, 4


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 24
        for _ in range(8):
            value = (value << 1) ^ (0x04C11DB7 if value & 0x80000000 else 0)
        table.append(value & 0xFFFFFFFF)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """CRC-32/MPEG-2; a section with its own checksum gives 0."""
    value = 0xFFFFFFFF
    for byte in data:
        value = ((value << 8) & 0xFFFFFFFF) ^ _CRC[(value >> 24) ^ byte]
    return value


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", section_crc(head + body))


_PAT = _section(0x00, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
_PMT = _section(0x02, PROGRAM, struct.pack(">HHBHH", 0xE000 | STREAM_PID, 0xF000, PRIVATE_DATA, 0xE000 | STREAM_PID, 0xF000))


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    head = struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10 | counter & 15)
    return (head + b"\x00" + section).ljust(PACKET, b"\xff")


def _pts_field(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, pts >> 22 & 0xFF, 0x01 | (pts >> 14) & 0xFE, pts >> 7 & 0xFF, 0x01 | (pts << 1) & 0xFE])


def _pts_value(field: bytes) -> int:
    return (field[0] >> 1 & 7) << 30 | field[1] << 22 | (field[2] >> 1) << 15 | field[3] << 7 | field[4] >> 1


def _unit_packets(pes: bytes, counter: int, clock: int | None) -> tuple[bytes, int]:
    """An elementary packet as transport packets; the last one is stuffed by its adaptation field."""
    first = b""
    if clock is not None:  # random access with a program clock reference; the extension is 0
        first = b"\x50" + struct.pack(">IH", clock >> 1 & 0xFFFFFFFF, (clock & 1) << 15 | 0x7E00)
    out = []
    room = PACKET - 4 - (len(first) + 1 if first else 0)
    at = 0
    if first and len(pes) >= room:
        out.append(struct.pack(">BHBB", SYNC, 0x4000 | STREAM_PID, 0x30 | counter & 15, len(first)) + first + pes[:room])
        at, counter, first = room, counter + 1, b""
    whole = 0 if first else (len(pes) - at) // (PACKET - 4)
    if whole:
        packets = np.empty((whole, PACKET), np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, STREAM_PID >> 8, STREAM_PID & 0xFF
        packets[:, 3] = 0x10 | (counter + np.arange(whole)) & 15
        packets[:, 4:] = np.frombuffer(pes, np.uint8, whole * (PACKET - 4), at).reshape(whole, -1)
        if at == 0:
            packets[0, 1] |= 0x40
        out.append(packets.tobytes())
        at, counter = at + whole * (PACKET - 4), counter + whole
    if at < len(pes):
        rest = len(pes) - at
        field = PACKET - 5 - rest
        body = (first or (b"\x00" if field else b"")).ljust(field, b"\xff")
        out.append(struct.pack(">BHBB", SYNC, (0x4000 if at == 0 else 0) | STREAM_PID, 0x30 | counter & 15, field) + body + pes[at:])
        counter += 1
    return b"".join(out), counter


def encode(payload: bytes) -> bytes:
    """A payload as a transport stream."""
    out = [_table_packet(PAT_PID, _PAT, 0), _table_packet(PMT_PID, _PMT, 0)]
    tables, counter = 1, 0
    for unit, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        data = payload[at : at + UNIT_BYTES]
        pts = unit * UNIT_TICKS & 0x1FFFFFFFF
        access = unit % UNITS_PER_ACCESS == 0
        if access and unit:
            out += [_table_packet(PAT_PID, _PAT, tables), _table_packet(PMT_PID, _PMT, tables)]
            tables += 1
        pes = struct.pack(">IHBBB", 0x100 | PRIVATE_STREAM, len(data) + 8, 0x84, 0x80, 5) + _pts_field(pts) + data
        packets, counter = _unit_packets(pes, counter, pts if access else None)
        out.append(packets)
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds."""

    payload: bytes
    timestamps: list[int]
    access: list[tuple[int, int]]  # packet number, timestamp
    packets: int
    discontinuities: int


def _tables(data: bytes, starts: np.ndarray, pids: np.ndarray, begins: np.ndarray) -> int:
    """The elementary stream's PID by way of the program tables; every repetition is checked."""

    def section(packet: int) -> bytes:
        at, end = starts[packet], (packet + 1) * PACKET
        at += 1 + data[at]
        length = 3 + ((data[at + 1] & 0x0F) << 8 | data[at + 2])
        found = data[at : at + length]
        if at + length > end or section_crc(found):
            raise ValueError("a program table is damaged")
        return found

    pat = {section(p) for p in np.flatnonzero((pids == PAT_PID) & begins)}
    if len(pat) != 1:
        raise ValueError("there is not one program association table")
    pat = pat.pop()
    programs = [struct.unpack(">HH", pat[i : i + 4]) for i in range(8, len(pat) - 4, 4)]
    maps = [pid & 0x1FFF for number, pid in programs if number]
    if len(maps) != 1:
        raise ValueError("there is not one program")
    pmt = {section(p) for p in np.flatnonzero((pids == maps[0]) & begins)}
    if len(pmt) != 1:
        raise ValueError("there is not one program map table")
    pmt = pmt.pop()
    at = 12 + ((pmt[10] & 0x0F) << 8 | pmt[11])
    streams = []
    while at < len(pmt) - 4:
        _, pid, info = struct.unpack(">BHH", pmt[at : at + 5])
        streams.append(pid & 0x1FFF)
        at += 5 + (info & 0x0FFF)
    if len(streams) != 1:
        raise ValueError("there is not one elementary stream")
    return streams[0]


def decode(data: bytes) -> Stream:
    """Reads a transport stream of one program back; raises ValueError where it is damaged."""
    if not data or len(data) % PACKET:
        raise ValueError("not whole packets")
    grid = np.frombuffer(data, np.uint8).reshape(-1, PACKET)
    if (grid[:, 0] != SYNC).any() or (grid[:, 1] & 0x80).any():
        raise ValueError("sync is lost or a packet is marked as wrong")
    pids = (grid[:, 1].astype(np.int32) & 0x1F) << 8 | grid[:, 2]
    begins, control, counters = (grid[:, 1] & 0x40) > 0, grid[:, 3] >> 4 & 3, grid[:, 3] & 15
    field = np.where(control & 2, grid[:, 4].astype(np.int64) + 1, 0)
    if (field > PACKET - 4).any():
        raise ValueError("an adaptation field is too long")
    starts = np.arange(len(grid)) * PACKET + 4 + field
    pid = _tables(data, starts, pids, begins)
    lost, full = 0, control & 1 > 0
    for own in np.unique(pids[pids != NO_PID]):
        at = np.flatnonzero((pids == own) & full)
        step = np.diff(counters[at].astype(np.int16)) % 16
        if not step.all():
            twice = [k for k in np.flatnonzero(step == 0) if data[starts[at[k]] : (at[k] + 1) * PACKET] == data[starts[at[k + 1]] : (at[k + 1] + 1) * PACKET]]
            full[at[1:][twice]] = False
            step = np.delete(step, twice)
        lost += int((step != 1).sum())
    mine = np.flatnonzero((pids == pid) & full)
    flags = np.where((control[mine] & 2 > 0) & (field[mine] > 1), grid[mine, 5], 0)
    heads = np.flatnonzero(begins[mine])
    if len(mine) and (not len(heads) or heads[0]):
        raise ValueError("an elementary packet has no beginning")
    payload, stamps, access = [], [], []
    for k, head in enumerate(heads):
        own = mine[head : heads[k + 1] if k + 1 < len(heads) else len(mine)]
        plain = field[own] == 0
        if plain.all():
            pes = grid[own, 4:].tobytes()
        else:
            edge = np.flatnonzero(~plain)
            last = 0
            parts = []
            for e in edge:
                parts.append(grid[own[last:e], 4:].tobytes())
                parts.append(data[starts[own[e]] : (own[e] + 1) * PACKET])
                last = e + 1
            parts.append(grid[own[last:], 4:].tobytes())
            pes = b"".join(parts)
        if len(pes) < 14:
            raise ValueError("an elementary packet is too short")
        code, length, _, marks, header = struct.unpack(">IHBBB", pes[:9])
        if code != 0x100 | PRIVATE_STREAM or length != len(pes) - 6 or not marks & 0x80:
            raise ValueError("an elementary packet is damaged")
        stamps.append(_pts_value(pes[9:14]))
        if flags[head] & 0x40:
            access.append((int(own[0]), stamps[-1]))
        payload.append(pes[9 + header :])
    return Stream(b"".join(payload), stamps, access, len(grid), lost)


_KEEP = "doc_id long, n_bytes long"


def padded(docs: DataFrame, multiple: int = 64) -> DataFrame:
    """doc_id, n_bytes and payload: each text as UTF-8 with bytes 0 up to a positive multiple."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    zeros = F.greatest(F.lit(multiple), F.ceil(size / multiple) * multiple) - size
    fill = F.unhex(F.repeat(F.lit("00"), zeros.cast("int")))
    return docs.select(F.col("doc_id").cast("long"), size.alias("n_bytes"), F.concat(raw, fill).alias("payload"))


def _written(rows: list[tuple]) -> list[tuple]:
    return [(i, n, encode(p or b"")) for i, n, p in rows]


def _read(rows: list[tuple]) -> list[tuple]:
    out = []
    for i, n, media in rows:
        try:
            s = decode(media or b"")
        except (ValueError, IndexError, struct.error) as e:
            out.append((i, n, media, None, None, None, None, None, str(e)))
        else:
            out.append((i, n, media, s.payload, s.timestamps, [{"packet": k, "pts": t} for k, t in s.access], s.packets, s.discontinuities, None))
    return out


def store(payloads: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload) to (doc_id, n_bytes, media): the stored form of each payload."""
    return map_rows(payloads.select("doc_id", "n_bytes", "payload"), _written, f"{_KEEP}, media binary")


def load(stored: DataFrame) -> DataFrame:
    """Reads stored streams back: payload, timestamps, random-access points, packets, discontinuities, and error.

    A stream that cannot be read, null or empty ones included, has its reason in error, and nulls for the rest.
    """
    schema = f"{_KEEP}, media binary, payload binary, timestamps array<long>, access array<struct<packet: long, pts: long>>, packets long, discontinuities long, error string"
    return map_rows(stored.select("doc_id", "n_bytes", "media"), _read, schema)


def digests(docs: DataFrame) -> DataFrame:
    """Every text stored, read back and described; see the module on nulls and empty texts.

    feature: packets, elementary packets, last timestamp, random-access points and discontinuities. error is null
    unless a stored stream could not be read back.
    """
    back = load(store(padded(docs)))
    size = F.octet_length("payload")
    return back.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.format_string(
            "packets=%d;units=%d;last_pts=%d;access=%d;lost=%d",
            "packets",
            F.size("timestamps"),
            F.coalesce(F.try_element_at("timestamps", F.lit(-1)), F.lit(-1).cast("long")),
            F.size("access"),
            "discontinuities",
        ).alias("feature"),
        "error",
    )
