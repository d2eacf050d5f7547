"""Media columns as MPEG transport streams: write, check and take apart 188-byte packets.

`mux` stores a payload in units of 576 bytes (8-bit samples), 16 units to an access unit, one packetised elementary
packet (PES) with a time stamp for each. Every eighth access unit is a random-access point: program tables (PAT, PMT)
come before it, and its first packet carries the random-access flag and a clock reference. `demux` parses the program
tables with their checksums, follows each stream's continuity counter, reassembles the elementary packets and reads
time stamps and random-access points.

Tables' sections may run over several packets. Null and empty texts hold one unit of padding; texts are whole, however long. Equal texts give equal streams. Streams that are null
or no whole number of packets, or lack tables, give a feature of 'invalid' and an empty payload. Empty tables give no
rows, repeated rows repeated results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_steps

UNIT, UNITS_PER_ACCESS, RANDOM_ACCESS_EVERY = 576, 16, 8
ACCESS = UNIT * UNITS_PER_ACCESS
#: Fixed values of the format: packet size, sync byte, clock, the private stream's numbers, and this writer's PIDs.
PACKET, SYNC, CLOCK, PRIVATE_STREAM, PRIVATE_TYPE = 188, 0x47, 90_000, 0xBD, 0x06
PAT_PID, PMT_PID, MEDIA_PID, PROGRAM = 0, 0x1000, 0x100, 1
SAMPLES_A_SECOND = 48_000
STEP = ACCESS * CLOCK // SAMPLES_A_SECOND


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        c = byte << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


@lru_cache(4096)
def section_crc(section: bytes) -> int:
    """CRC-32/MPEG-2; 0 over a section that ends with its own checksum."""
    c = 0xFFFFFFFF
    for b in section:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | len(body) + 9, PROGRAM, 0xC1, 0, 0) + body
    return head + struct.pack(">I", section_crc(head))


def _table_packet(pid: int, section: bytes) -> bytes:
    return (struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + section).ljust(PACKET, b"\xff")


PAT = _table_packet(PAT_PID, _section(0, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID)))
PMT = _table_packet(PMT_PID, _section(2, struct.pack(">HHBHH", 0xE000 | MEDIA_PID, 0xF000, PRIVATE_TYPE, 0xE000 | MEDIA_PID, 0xF000)))


def _stamp(marker: int, ticks: int) -> bytes:
    return struct.pack(">BHH", marker << 4 | (ticks >> 29 & 0xE) | 1, (ticks >> 14 & 0xFFFE) | 1, (ticks << 1 & 0xFFFE) | 1)


def pad(data: bytes) -> bytes:
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b"\xff")


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload of whole units."""
    out: list[bytes] = []
    counter = tables = 0
    for k, at in enumerate(range(0, len(payload), ACCESS)):
        data = payload[at : at + ACCESS]
        ticks = k * STEP % (1 << 33)
        pes = b"\0\0\1" + struct.pack(">BHBBB", PRIVATE_STREAM, len(data) + 8, 0x84, 0x80, 5) + _stamp(2, ticks) + data
        field = b""
        if k % RANDOM_ACCESS_EVERY == 0:
            for packet in (PAT, PMT):
                out.append(packet[:3] + bytes([0x10 | tables & 15]) + packet[4:])
            tables += 1
            field = bytes([7, 0x50]) + struct.pack(">IH", ticks >> 1, (ticks & 1) << 15 | 0x7E00)
        # The first packet: with the field, or short enough to need one of stuffing.
        room = PACKET - 4 - len(field)
        first = pes[:room]
        out.append(_packet(0x4000, counter, field, first))
        counter += 1
        whole = (len(pes) - len(first)) // (PACKET - 4)
        if whole:
            grid = np.empty((whole, PACKET), dtype=np.uint8)
            grid[:, :3] = np.frombuffer(struct.pack(">BH", SYNC, MEDIA_PID), dtype=np.uint8)
            grid[:, 3] = 0x10 | (counter + np.arange(whole)) & 15
            grid[:, 4:] = np.frombuffer(pes, dtype=np.uint8, count=whole * (PACKET - 4), offset=len(first)).reshape(whole, -1)
            out.append(grid.tobytes())
            counter += whole
        if rest := pes[len(first) + whole * (PACKET - 4) :]:
            out.append(_packet(0, counter, b"", rest))
            counter += 1
    return b"".join(out)


def _packet(start: int, counter: int, field: bytes, data: bytes) -> bytes:
    short = PACKET - 4 - len(field) - len(data)
    if short:  # stuffing belongs to the adaptation field
        field = field or bytes([0, 0][: min(2, short)])
        field = field.ljust(PACKET - 4 - len(data), b"\xff")
        field = bytes([len(field) - 1]) + field[1:]
    return struct.pack(">BHB", SYNC, start | MEDIA_PID, (0x30 if field else 0x10) | counter & 15) + field + data


@dataclass
class Stream:
    """What demux found."""

    payload: bytes = b""
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    packets: int = 0
    continuity_errors: int = 0
    stamps: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)
    valid: bool = False

    @property
    def feature(self) -> str:
        if not self.valid:
            return "invalid"
        media = ",".join(f"{pid}:{kind}" for pid, kind in sorted(self.streams.items()))
        return f"programs={len(self.programs)};streams={media};packets={self.packets};continuity_errors={self.continuity_errors};access_units={len(self.stamps)};first_pts={self.stamps[0]};last_pts={self.stamps[-1]};random_access={len(self.random_access)}"


def _sections(rows: np.ndarray, begin: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """The whole sections in one stream's packets, in order: they may run over several packets, and a packet may hold several. Those with a wrong checksum are left out."""
    found: list[bytes] = []
    held: bytes | None = None

    def cut(raw: bytes) -> bytes:
        """Takes whole sections off; returns what is left of the last one."""
        while len(raw) >= 3 and raw[0] != 0xFF:  # 0xFF: stuffing up to the packet's end
            length = 3 + (struct.unpack_from(">H", raw, 1)[0] & 0xFFF)
            if len(raw) < length:
                return raw
            if length >= 12 and section_crc(raw[:length]) == 0:
                found.append(raw[:length])
            raw = raw[length:]
        return raw if raw[:1] != b"\xff" else b""

    for row, at, first in zip(rows, begin.tolist(), starts.tolist()):
        raw = row.tobytes()[at:]
        if first and raw:
            before, raw = raw[1 : 1 + raw[0]], raw[1 + raw[0] :]
            if held is not None:
                cut(held + before)
            held = b""
        if held is not None:
            held = cut(held + raw)
    return found


def demux(media: bytes | None) -> Stream:
    """Takes a transport stream apart; PES time stamps and random-access points by access unit."""
    found = Stream()
    if not media or len(media) % PACKET:
        return found
    rows = np.frombuffer(media, dtype=np.uint8).reshape(-1, PACKET)
    if (rows[:, 0] != SYNC).any():
        return found
    found.packets = len(rows)
    pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    starts, control, counter = rows[:, 1] & 0x40 != 0, rows[:, 3] >> 4 & 3, rows[:, 3] & 15
    begin = np.where(control & 2, 5 + rows[:, 4].astype(np.int64), 4)
    carries = control & 1 != 0
    tables = lambda own: dict.fromkeys(_sections(rows[k := np.flatnonzero((pid == own) & carries)], begin[k], starts[k]))  # noqa: E731  each once
    for section in tables(PAT_PID):
        if section[0] == 0:
            for program, where in struct.iter_unpack(">HH", section[8 : 8 + (len(section) - 12) // 4 * 4]):
                if program:
                    found.programs[program] = where & 0x1FFF
    for own in sorted(set(found.programs.values())):
        for section in tables(own):
            if section[0] != 2 or len(section) < 16:
                continue
            at = 12 + (struct.unpack_from(">H", section, 10)[0] & 0xFFF)
            while at + 5 <= len(section) - 4:
                kind, where, more = struct.unpack_from(">BHH", section, at)
                found.streams[where & 0x1FFF] = kind
                at += 5 + (more & 0xFFF)
    for own in {PAT_PID, *found.programs.values(), *found.streams}:
        count = counter[(pid == own) & carries].astype(np.int16)
        found.continuity_errors += int(((np.diff(count) - 1) % 16 != 0).sum())
    parts: list[bytes] = []
    for own in sorted(found.streams):
        own_rows = (pid == own) & carries
        data, first = rows[own_rows], begin[own_rows]
        if not len(data):
            continue
        flat = data[np.arange(PACKET) >= first[:, None]]
        stops = np.concatenate([[0], np.cumsum(PACKET - first)])
        heads = np.flatnonzero(starts[own_rows])
        flagged = (control[own_rows] & 2 != 0) & (data[:, 4] > 0) & (data[:, 5] & 0x40 != 0)
        for k, a, b in zip(heads.tolist(), stops[heads].tolist(), [*stops[heads[1:]].tolist(), int(stops[-1])]):
            pes = flat[a:b].tobytes()
            if len(pes) < 9 or pes[:3] != b"\0\0\1":
                return Stream(packets=len(rows))
            length = struct.unpack_from(">H", pes, 4)[0]
            stamp = -1
            if pes[7] & 0x80 and len(pes) >= 14:
                high, mid, low = struct.unpack_from(">BHH", pes, 9)
                stamp = (high >> 1 & 7) << 30 | mid >> 1 << 15 | low >> 1
            if flagged[k]:
                found.random_access.append(len(found.stamps))
            found.stamps.append(stamp)
            parts.append(pes[9 + pes[8] : 6 + length if length else None])
    found.payload, found.valid = b"".join(parts), bool(found.stamps)
    return found


def with_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, padded and stored as a transport stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_steps(batches):
            raw = [t.encode() for t in texts]
            media = pa.array([mux(pad(x)) for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(map(len, raw), pa.int64()), media], names=[id_column, "n_bytes", "media"])

    kind = dict(docs.dtypes)[id_column]
    return docs.select(text_column, id_column).mapInArrow(run, f"`{id_column}` {kind}, n_bytes bigint, media binary")


def read_media(stored: DataFrame, id_column: str = "doc_id", units: bool = False) -> DataFrame:
    """What the stored bytes hold: sizes, checksums and a feature; with units also time stamps and random-access points."""
    names = [id_column, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, extra = [], []
            for x in batch.column(2):
                media = x.as_py() or b""
                found = demux(media)
                rows.append((len(found.payload), hashlib.sha256(found.payload).hexdigest(), zlib.crc32(found.payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), found.feature))
                extra.append((found.stamps, found.random_access))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)]
            if units:
                columns += [pa.array(c, pa.list_(pa.int64())) for c in (zip(*extra) if extra else [()] * 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names + ["stamps", "random_access"] * units)

    kind = dict(stored.dtypes)[id_column]
    schema = f"`{id_column}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return stored.select(id_column, "n_bytes", "media").mapInArrow(run, schema + ", stamps array<bigint>, random_access array<bigint>" * units)
