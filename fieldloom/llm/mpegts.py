"""Media columns: MPEG transport streams (ISO/IEC 13818-1).

`mux` stores a byte payload as a single-program stream: a PAT, a PMT, then private-data PES packets, each with a
presentation timestamp, and each opening with a clock reference and the random-access flag. `demux` reads any such
stream back: it parses the program tables, checks their CRCs and every PID's continuity counter, reassembles the
elementary packets and lists timestamps with the byte offsets where a reader can start.

Null or empty payloads give a stream without elementary packets, whose payload reads back empty. Null streams give a
null report; streams that aren't whole 188-byte packets raise ValueError, since nothing in them can be trusted.
Continuity errors are counted, not raised. Columns besides the one named are passed through untouched.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PACKET, SYNC, PAT_PID, NULL_PID = 188, 0x47, 0, 0x1FFF
PMT_PID, DATA_PID, PRIVATE_STREAM, PRIVATE_TYPE = 0x1000, 0x0100, 0xBD, 0x06
#: Payload bytes of one elementary packet, and ticks of the 90 kHz clock between two of them.
UNIT_BYTES, UNIT_TICKS = 32_768, 3_600
FIRST_PTS = 90_000

UNIT = "array<struct<pid:int,pts:bigint,offset:bigint,n_bytes:bigint,random_access:boolean>>"
REPORT = f"struct<media_bytes:bigint,media_sha256:string,programs:int,streams:int,packets:bigint,continuity_errors:int,crc_errors:int,payload:binary,units:{UNIT}>"


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


@lru_cache(256)
def section_crc(section: bytes) -> int:
    """CRC-32/MPEG-2, which is 0 over a section with its CRC."""
    c = 0xFFFFFFFF
    for b in section:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _table_packet(pid: int, section: bytes) -> bytes:
    section += struct.pack(">I", section_crc(section))
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return (head + section).ljust(PACKET, b"\xff")


@lru_cache(1)
def _tables() -> bytes:
    pat = struct.pack(">BHHBBBHH", 0, 0xB00D, 1, 0xC1, 0, 0, 1, 0xE000 | PMT_PID)
    pmt = struct.pack(">BHHBBBHHBHH", 2, 0xB012, 1, 0xC1, 0, 0, 0xE000 | DATA_PID, 0xF000, PRIVATE_TYPE, 0xE000 | DATA_PID, 0xF000)
    return _table_packet(PAT_PID, pat) + _table_packet(PMT_PID, pmt)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 1 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 1 | pts << 1 & 0xFE])


def mux(payload: bytes | None) -> bytes:
    payload = payload or b""
    parts, counter = [_tables()], 0
    for k, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        data, pts = payload[at : at + UNIT_BYTES], (FIRST_PTS + k * UNIT_TICKS) & (1 << 33) - 1
        body = b"\0\0\1" + struct.pack(">BHBBB", PRIVATE_STREAM, 8 + len(data), 0x84, 0x80, 5) + _stamp(pts) + data
        # The first packet carries the clock (8 bytes of adaptation field), the last one is stuffed.
        room = np.full(1 + max(0, -(-(len(body) - 176) // 184)), 184)
        room[0] = 176
        room[-1] -= room.sum() - len(body)
        out = np.full((len(room), PACKET), 0xFF, np.uint8)
        cells = np.arange(PACKET) >= (PACKET - room)[:, None]
        out[cells] = np.frombuffer(body, np.uint8)
        out[:, 0], out[:, 1], out[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
        out[0, 1] |= 0x40
        field = 184 - room
        out[:, 3] = (counter + np.arange(len(room))) & 15 | np.where(field > 0, 0x30, 0x10)
        for row in {0, len(room) - 1}:
            if field[row]:
                out[row, 4] = field[row] - 1
            if field[row] > 1:
                out[row, 5] = 0x50 if row == 0 else 0
        out[0, 6:12] = np.frombuffer(struct.pack(">IH", pts >> 1, (pts & 1) << 15 | 0x7E00), np.uint8)
        counter = (counter + len(room)) & 15
        parts.append(out.tobytes())
    return b"".join(parts)


def _section(packet: np.ndarray, start: int) -> bytes:
    raw = packet[start:].tobytes()
    raw = raw[1 + raw[0] :]
    return raw[: 3 + (int.from_bytes(raw[1:3], "big") & 0xFFF)]


def _pts(b: bytes) -> int:
    return (b[0] & 0x0E) << 29 | b[1] << 22 | (b[2] & 0xFE) << 14 | b[3] << 7 | b[4] >> 1


def demux(media: bytes | None) -> dict | None:
    if media is None:
        return None
    if len(media) % PACKET:
        raise ValueError("a transport stream is made of whole 188-byte packets")
    p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any():
        raise ValueError("a packet doesn't start with the sync byte")
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    kind, field = p[:, 3] >> 4 & 3, p[:, 4].astype(np.int32)
    adapted, full = kind >= 2, (kind & 1) == 1
    start = np.where(adapted, 5 + field, 4)
    flags = np.where(adapted & (field > 0), p[:, 5], 0)
    opens = (p[:, 1] & 0x40) > 0

    crc_errors, maps, streams = 0, [], {}
    for i in np.flatnonzero((pid == PAT_PID) & opens & full):
        s = _section(p[i], start[i])
        crc_errors += section_crc(s) != 0
        maps += [int.from_bytes(s[k + 2 : k + 4], "big") & 0x1FFF for k in range(8, len(s) - 4, 4) if s[k : k + 2] != b"\0\0"]
    for i in np.flatnonzero(np.isin(pid, maps) & opens & full):
        s = _section(p[i], start[i])
        crc_errors += section_crc(s) != 0
        k = 12 + (int.from_bytes(s[10:12], "big") & 0xFFF)
        while k < len(s) - 4:
            streams[int.from_bytes(s[k + 1 : k + 3], "big") & 0x1FFF] = s[k]
            k += 5 + (int.from_bytes(s[k + 3 : k + 5], "big") & 0xFFF)

    errors, payload, units = 0, [], []
    for one in sorted(streams):
        at = np.flatnonzero((pid == one) & full)
        if not len(at):
            continue
        step = np.diff(p[at, 3].astype(np.int32) & 15) & 15
        same = np.zeros(len(at), bool)  # a packet may be sent twice
        for j in np.flatnonzero(step == 0) + 1:
            same[j] = not same[j - 1] and p[at[j]].tobytes() == p[at[j - 1]].tobytes()
        errors += int(((step != 1) & ~same[1:] & ((flags[at[1:]] & 0x80) == 0)).sum())
        at = at[~same]
        body = p[at][np.arange(PACKET) >= start[at][:, None]].tobytes()
        ends = np.cumsum(np.maximum(0, PACKET - start[at]))
        first = np.flatnonzero(opens[at])
        lo = (ends - np.maximum(0, PACKET - start[at]))[first]
        for j, a, b in zip(first, lo, [*lo[1:], len(body)], strict=True):
            if body[a : a + 3] != b"\0\0\1":
                errors += 1
                continue
            size, head = int.from_bytes(body[a + 4 : a + 6], "big"), 9 + body[a + 8]
            data = body[a + head : a + 6 + size if size else b]
            units.append((one, _pts(body[a + 9 : a + 14]) if body[a + 7] & 0x80 else None, int(at[j]) * PACKET, len(data), bool(flags[at[j]] & 0x40)))
            payload.append(data)
    return {"media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "programs": len(maps), "streams": len(streams), "packets": len(p), "continuity_errors": errors, "crc_errors": int(crc_errors), "payload": b"".join(payload), "units": units}


def _muxed(payload: pd.Series) -> pd.Series:
    return payload.map(mux, na_action=None)


def _demuxed(media: pd.Series) -> pd.DataFrame:
    names = [x.split(":")[0] for x in "media_bytes media_sha256 programs streams packets continuity_errors crc_errors payload units".split()]
    units = "pid pts offset n_bytes random_access".split()
    rows = [(demux(m) or dict.fromkeys(names)) for m in media]
    for r in rows:
        r["units"] = r["units"] and [dict(zip(units, u, strict=True)) for u in r["units"]]
    return pd.DataFrame(rows, columns=names)


def to_media(df: DataFrame, payload: str, out: str = "media") -> DataFrame:
    """Adds a column with each payload as a transport stream."""
    return df.withColumn(out, F.pandas_udf(_muxed, "binary")(F.col(payload)))


def from_media(df: DataFrame, media: str | Column, out: str = "report") -> DataFrame:
    """Adds a struct column with what `demux` finds in each stream."""
    return df.withColumn(out, F.pandas_udf(_demuxed, REPORT)(F.col(media) if isinstance(media, str) else media))


def access_points(df: DataFrame, key: str, report: str = "report") -> DataFrame:
    """One row for each elementary packet that a reader can start at."""
    return df.select(key, F.explode(f"{report}.units").alias("unit")).where("unit.random_access").select(key, "unit.pid", "unit.pts", "unit.offset", "unit.n_bytes")
