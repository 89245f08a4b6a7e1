"""Media columns: texts stored as MPEG transport streams and read back with tables, counters, timestamps and access points."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sheaf.llm.common import arrow_limits, slices

#: Fixed values of the transport stream format (ISO/IEC 13818-1) and of the program that this module writes.
PACKET, SYNC, TABLE_PID, MAP_PID, DATA_PID, PROGRAM, PRIVATE_DATA, PRIVATE_STREAM = 188, 0x47, 0x0000, 0x0100, 0x0101, 1, 0x06, 0xBD
UNIT, UNITS, FRAME_TICKS = 576, 64, 3600  # bytes of a unit, units of an elementary packet, 90 kHz ticks of a unit


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(pid: int, table: int, ident: int, body: bytes) -> np.ndarray:
    """One packet with a table section; the continuity counter is filled in later."""
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF, ident >> 8, ident & 0xFF, 0xC1, 0, 0])
    section = head + body
    section += crc32_mpeg(section).to_bytes(4, "big")
    packet = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section
    return np.frombuffer(packet.ljust(PACKET, b"\xff"), np.uint8)


_TABLE = _section(TABLE_PID, 0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | MAP_PID).to_bytes(2, "big"))
_MAP = _section(MAP_PID, 0x02, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")


def _stamp(ticks: int) -> bytes:
    return bytes([0x21 | (ticks >> 29 & 0x0E), ticks >> 22 & 0xFF, 0x01 | (ticks >> 14 & 0xFE), ticks >> 7 & 0xFF, 0x01 | (ticks << 1 & 0xFE)])


def padded(text: bytes) -> bytes:
    """The text with bytes 255 up to a positive multiple of UNIT."""
    return text + b"\xff" * (-len(text) % UNIT if text else UNIT)


def mux(payload: bytes) -> bytes:
    """A transport stream: before each elementary packet both tables, so that each is a random access point."""
    parts, counters = [], 0
    for k, start in enumerate(range(0, len(payload), UNIT * UNITS)):
        data, ticks = payload[start : start + UNIT * UNITS], k * UNITS * FRAME_TICKS & 0x1FFFFFFFF
        body = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(ticks) + data
        n = 1 + max(0, -(-(len(body) - 176) // 184))
        packets = np.empty((n + 2, PACKET), np.uint8)
        packets[0], packets[1] = _TABLE, _MAP
        packets[:2, 3] = 0x10 | k & 15
        own = packets[2:]
        own[:, 0], own[:, 1], own[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
        own[:, 3] = 0x10 | (counters + np.arange(n)) & 15
        counters += n
        own[0, 1] |= 0x40
        own[0, 3] |= 0x20
        clock = ticks << 15 | 0x7E00  # base, six reserved bits, extension zero
        first = b"\x07\x50" + clock.to_bytes(6, "big")
        flat = np.frombuffer(body, np.uint8)
        if n == 1:  # the stuffing of a lone packet goes into its adaptation field
            room = 184 - len(body)
            field = bytes([room - 1]) + first[1:] + b"\xff" * (room - 8)
            own[0, 4 : 4 + room], own[0, 4 + room :] = np.frombuffer(field, np.uint8), flat
        else:
            own[0, 4:12], own[0, 12:] = np.frombuffer(first, np.uint8), flat[:176]
            whole = (len(flat) - 176) // 184
            own[1 : 1 + whole, 4:] = flat[176 : 176 + whole * 184].reshape(whole, 184)
            if rest := len(flat) - 176 - whole * 184:
                room = 184 - rest
                own[-1, 3] |= 0x20
                field = bytes([0]) if room == 1 else bytes([room - 1, 0]) + b"\xff" * (room - 2)
                own[-1, 4 : 4 + room], own[-1, 4 + room :] = np.frombuffer(field, np.uint8), flat[-rest:]
        parts.append(packets)
    return np.concatenate(parts).tobytes()


@lru_cache(4096)
def _section_of(packet: bytes, table: int) -> bytes | None:
    """The section that starts in a packet, if it has this table id and its checksum holds."""
    section = packet[5 + packet[4] :]
    section = section[: 3 + ((section[1] & 0x0F) << 8 | section[2])]
    return section if section[0] == table and crc32_mpeg(section) == 0 else None


def _sections(packets: np.ndarray, table: int) -> list[bytes]:
    """Distinct checked sections with this table id, each within a packet; the counter in the head doesn't matter."""
    found = dict.fromkeys(_section_of(p.tobytes(), table) for p in packets)
    return [x for x in found if x is not None]


def demux(media: bytes) -> dict:
    """Read a stream back: the program tables name the program and the data's PID; its continuity counters are checked; its elementary
    packets are put together. A packet sent twice counts once; an elementary packet that lacks a part is left out of the payload and
    counted as broken. Raises ValueError where the stream has no whole packets or no such program."""
    if not media or len(media) % PACKET:
        raise ValueError("not whole packets")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("lost sync")
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    tables = _sections(packets[pids == TABLE_PID], 0x00)
    if not tables:
        raise ValueError("no program association")
    program = tables[0][8] << 8 | tables[0][9]
    map_pid = (tables[0][10] & 0x1F) << 8 | tables[0][11]
    maps = _sections(packets[pids == map_pid], 0x02)
    if not maps:
        raise ValueError("no program map")
    at = 12 + ((maps[0][10] & 0x0F) << 8 | maps[0][11])
    kind, pid = maps[0][at], (maps[0][at + 1] & 0x1F) << 8 | maps[0][at + 2]
    where = np.flatnonzero(pids == pid)
    own = packets[where]
    once = np.ones(len(own), bool)
    once[1:] = ~((own[1:, 3] & 15 == own[:-1, 3] & 15) & (own[1:, 4:] == own[:-1, 4:]).all(1))
    where, own = where[once], own[once]
    if not len(own):
        return {"payload": b"", "program": program, "pid": pid, "stream_type": kind, "n_packets": len(packets), "continuity_errors": 0, "broken": 0, "pts": [], "access_points": []}
    control, counters = own[:, 3] >> 4 & 3, own[:, 3].astype(np.int16) & 15
    gaps = np.flatnonzero((counters[1:] - counters[:-1]) % 16 != 1) + 1  # before these packets something is missing
    errors = len(gaps)
    adapted = (control & 2) > 0
    starts = np.where(adapted, 5 + own[:, 4].astype(np.int64), 4)
    access = adapted & (own[:, 4] > 0) & (own[:, 5] & 0x40 > 0)
    begins = np.flatnonzero(own[:, 1] & 0x40)
    flat = own[np.arange(PACKET)[None, :] >= starts[:, None]]
    sizes = PACKET - starts
    ends = np.cumsum(sizes)
    cuts = np.append((ends - sizes)[begins], len(flat))
    torn = np.zeros(len(begins), bool)
    inside = np.searchsorted(begins, gaps, "right") - 1
    torn[inside[(inside >= 0) & ~np.isin(gaps, begins)]] = True
    parts, stamps, broken = [np.zeros(0, np.uint8)], [], int(len(begins) == 0 or begins[0] > 0)
    for a, b, gap in zip(cuts[:-1].tolist(), cuts[1:].tolist(), torn.tolist(), strict=True):
        head = flat[a : a + 14].tobytes()
        if gap or len(head) < 9 or head[:3] != b"\x00\x00\x01" or (head[4] << 8 | head[5]) != b - a - 6:
            broken += 1
            continue
        extra = head[8]
        if head[7] & 0x80:
            p = head[9:14]
            stamps.append((p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1)
        parts.append(flat[a + 9 + extra : b])
    return {"payload": np.concatenate(parts).tobytes(), "program": program, "pid": pid, "stream_type": kind, "n_packets": len(packets), "continuity_errors": errors, "broken": broken, "pts": stamps, "access_points": where[access].tolist()}


def _found(media: bytes | None) -> dict:
    try:
        return {} if media is None else demux(media)
    except ValueError as error:
        return {"error": str(error)}


def store(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, n_bytes and media: each whole text as a transport stream.

    A row per input row, no shuffle. A null or empty text is one unit of padding; a null id stays null; repeated rows give
    repeated results; an empty table gives none; other columns are ignored. Equal texts have equal media.
    """
    arrow_limits(docs.sparkSession)
    frame = docs.select(F.col(id_col), F.col(text_col).cast("string")).toDF("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], names=["id", "n_bytes", "media"])

    return frame.mapInArrow(run, f"id {frame.schema['id'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def read(stored: DataFrame, *, media_col: str = "media") -> DataFrame:
    """Adds what demux() finds in the stored bytes: payload, program, pid, stream_type, n_packets, continuity_errors, broken, pts and
    access_points; and `error`, why a stream can't be read, with the others null. A null stream gives nulls."""
    arrow_limits(stored.sparkSession)
    new = [("error", "string", pa.string()), ("payload", "binary", pa.binary()), ("program", "int", pa.int32()), ("pid", "int", pa.int32()), ("stream_type", "int", pa.int32()), ("n_packets", "int", pa.int32()), ("continuity_errors", "int", pa.int32()), ("broken", "int", pa.int32()), ("pts", "array<long>", pa.list_(pa.int64())), ("access_points", "array<int>", pa.list_(pa.int32()))]
    stored = stored.drop(*[n for n, _, _ in new])
    schema = StructType([*stored.schema.fields, *StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind, _ in new)).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(media_col))
            for start in range(0, batch.num_rows, 400):
                found = [_found(x.as_py()) for x in column.slice(start, 400)]
                arrays = [pa.array([f.get(n) for f in found], t) for n, _, t in new]
                yield pa.RecordBatch.from_arrays([*batch.slice(start, 400).columns, *arrays], names=[*batch.schema.names, *[n for n, _, _ in new]])

    return stored.mapInArrow(run, schema)
