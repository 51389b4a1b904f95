"""Media columns: MPEG transport streams parsed into elementary packets with timestamps and random-access points."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zlib
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.session import ensure_importable

PACKET, SYNC, NULL_PID = 188, 0x47, 0x1FFF

_CRC = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = ((_c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if _c & 0x80000000 else (_c << 1) & 0xFFFFFFFF
    _CRC[_i] = _c
_CRC = [int(x) for x in _CRC]


def crc32_mpeg(data: bytes) -> int:
    """The CRC of tables: polynomial 0x04C11DB7, not reflected."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


# -- writing: what tests and the query's binding need


def _stamp(kind: int, t: int) -> bytes:
    return bytes([kind << 4 | (t >> 29 & 0xE) | 1, t >> 22 & 0xFF, (t >> 14 & 0xFE) | 1, t >> 7 & 0xFF, (t << 1 & 0xFE) | 1])


def _read_stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def table(table_id: int, ident: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF, ident >> 8, ident & 0xFF, 0xC1, 0, 0]) + body
    return b"\0" + head + crc32_mpeg(head).to_bytes(4, "big")


@dataclass
class Muxer:
    """Writes a transport stream packet by packet."""

    counters: dict[int, int] = field(default_factory=dict)
    out: list[bytes] = field(default_factory=list)

    def section(self, pid: int, payload: bytes) -> None:
        self._packets(pid, payload, False, filler=True)

    def tables(self, program: int, pmt_pid: int, streams: list[tuple[int, int]]) -> None:
        self.section(0, table(0, 1, program.to_bytes(2, "big") + (0xE000 | pmt_pid).to_bytes(2, "big")))
        body = (0xE000 | streams[0][1]).to_bytes(2, "big") + b"\xf0\0" + b"".join(bytes([kind]) + (0xE000 | pid).to_bytes(2, "big") + b"\xf0\0" for kind, pid in streams)
        self.section(pmt_pid, table(2, program, body))

    def pes(self, pid: int, stream_id: int, data: bytes, pts: int | None, dts: int | None = None, key: bool = False, bounded: bool = True) -> None:
        stamps = b"" if pts is None else _stamp(2, pts) if dts is None else _stamp(3, pts) + _stamp(1, dts)
        flags = 0 if pts is None else 0x80 if dts is None else 0xC0
        size = len(data) + len(stamps) + 3
        size = size if bounded and size < 65536 else 0
        self._packets(pid, b"\0\0\1" + bytes([stream_id]) + size.to_bytes(2, "big") + bytes([0x80, flags, len(stamps)]) + stamps + data, key)

    def _packets(self, pid: int, payload: bytes, key: bool, filler: bool = False) -> None:
        at, first = 0, True
        while at < len(payload) or first:
            cc = self.counters.get(pid, 0)
            self.counters[pid] = (cc + 1) & 15
            room = PACKET - 4 - (2 if key and first else 0)
            piece = payload[at : at + room]
            at += len(piece)
            field_ = b"\1\x40" if key and first else b""
            gap = room - len(piece)
            if gap and filler:
                piece += b"\xff" * gap
            elif gap and field_:
                field_ = bytes([1 + gap, 0x40]) + b"\xff" * gap
            elif gap:
                field_ = b"\0" if gap == 1 else bytes([gap - 1, 0]) + b"\xff" * (gap - 2)
            self.out.append(bytes([SYNC, (0x40 if first else 0) | pid >> 8, pid & 0xFF, (0x30 if field_ else 0x10) | cc]) + field_ + piece)
            first = False

    def null(self) -> None:
        self.out.append(bytes([SYNC, NULL_PID >> 8, NULL_PID & 0xFF, 0x10]) + b"\xff" * (PACKET - 4))

    def bytes(self) -> bytes:
        return b"".join(self.out)


def stream_of(data: bytes, number: int, unit: int = 1500) -> bytes:
    """A stream that carries data: units of two kinds in turn (video with a random-access point every fourth, audio every third unit), and by the row's number lost or repeated packets, so that a corpus has all cases."""
    m = Muxer()
    video, audio = 0x101, 0x102
    for k in range(max(1, -(-len(data) // unit))):
        if k % 8 == 0:
            m.tables(1, 0x100, [(0x1B, video), (0x0F, audio)])
        piece = data[k * unit : (k + 1) * unit]
        t = 90_000 + k * 3600
        if k % 3 == 2:
            m.pes(audio, 0xC0, piece, t)
        else:
            m.pes(video, 0xE0, piece, t + 7200, t, key=k % 4 == 0, bounded=k % 2 == 0)
        if k % 5 == 4:
            m.null()
    if number % 7 == 3 and len(m.out) > 6:
        del m.out[5]
    if number % 11 == 5:
        m.out.insert(4, m.out[3])
    return m.bytes()


# -- reading


def _sections(packets: np.ndarray, start: np.ndarray, pusi: np.ndarray, number: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The current sections with a right CRC, from the packets of one PID, and the number of the packet that each ends in."""
    held = b""
    for row, s, first, n in zip(packets, start, pusi, number.tolist()):
        piece = row[s:].tobytes()
        if first:
            if not piece:
                continue
            pointer = piece[0]
            if held:
                held += piece[1 : 1 + pointer]
                yield from ((n, x) for x in _whole(held))
            held = piece[1 + pointer :]
        elif held:
            held += piece
        rest = held
        while len(rest) >= 3 and rest[0] != 0xFF and len(rest) >= 3 + ((rest[1] & 15) << 8 | rest[2]):
            size = 3 + ((rest[1] & 15) << 8 | rest[2])
            yield from ((n, x) for x in _whole(rest[:size]))
            rest = rest[size:]
        held = rest


#: Ids of streams whose packets have no optional header: what follows the length is payload (map, padding, private 2, ECM, EMM, DSM-CC, H.222.1 type E, directory).
_BARE = {0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF}


def _whole(data: bytes) -> Iterator[bytes]:
    while len(data) >= 3 and data[0] != 0xFF:
        size = 3 + ((data[1] & 15) << 8 | data[2])
        if size > len(data):
            return
        if size >= 12 and data[5] & 1 and crc32_mpeg(data[:size]) == 0:  # the bit says that it applies already
            yield data[:size]
        data = data[size:]


def _align(raw: bytes) -> np.ndarray:
    """The packets of a stream: from the first place at which five (or all that follow) begin with the sync byte; what is no packet is skipped."""
    a = np.frombuffer(raw, np.uint8)
    n = len(a) // PACKET
    if n and len(a) == n * PACKET and (a[::PACKET] == SYNC).all():
        return a.reshape(n, PACKET)
    rows, at = [], 0
    sync = np.flatnonzero(a == SYNC)
    while True:
        k = np.searchsorted(sync, at)
        if k == len(sync) or sync[k] + PACKET > len(a):
            break
        i = int(sync[k])
        ahead = a[i : i + 5 * PACKET : PACKET]
        if (ahead == SYNC).all():
            m = (len(a) - i) // PACKET
            ok = a[i : i + m * PACKET : PACKET] == SYNC
            m = m if ok.all() else int(np.argmin(ok))
            rows.append(a[i : i + m * PACKET].reshape(m, PACKET))
            at = i + m * PACKET
        else:
            at = i + 1
    return np.concatenate(rows) if rows else np.zeros((0, PACKET), np.uint8)


def parse(raw: bytes) -> list[dict]:
    """The elementary packets (PES) of all streams that the program tables list, in the order of their first transport packet.

    A packet's counter must follow that of the PID's last packet with a payload; one that repeats the packet before is a duplicate and is dropped; a discontinuity flag excuses a jump. The program map that applies to a packet is the last that came before it (the first one, too, for what came earlier): a later version may change a PID's stream type or end the stream. An elementary packet that a jump falls into, or that is shorter than it says, isn't complete; bytes after a jump still belong to it until the next one begins.
    """
    p = _align(raw)
    if not len(p):
        return []
    usable = (p[:, 1] & 0x80) == 0
    number = np.flatnonzero(usable)
    p = p[usable]
    pid = (p[:, 1].astype(np.int64) & 31) << 8 | p[:, 2]
    pusi, afc, cc = (p[:, 1] & 0x40) > 0, p[:, 3] >> 4 & 3, (p[:, 3] & 15).astype(np.int64)
    has_field = (afc & 2) > 0
    field_len = np.where(has_field, p[:, 4], 0).astype(np.int64)
    flags = np.where(has_field & (field_len > 0), p[:, 5], 0)
    start = np.minimum(np.where(has_field, 5 + field_len, 4), PACKET)
    load = (afc & 1) > 0

    programs: dict[int, int] = {}
    sel = np.flatnonzero((pid == 0) & load)
    for _, s in _sections(p[sel], start[sel], pusi[sel], number[sel]):
        if s[0] == 0:
            for i in range(8, len(s) - 4, 4):
                if number_ := s[i] << 8 | s[i + 1]:
                    programs[(s[i + 2] & 31) << 8 | s[i + 3]] = number_
    maps: dict[int, list[tuple[int, dict[int, int]]]] = {}  # program: (first packet it applies to, kinds of its streams)
    streams: dict[int, int] = {}
    for pmt, program in programs.items():
        sel = np.flatnonzero((pid == pmt) & load)
        for at, s in _sections(p[sel], start[sel], pusi[sel], number[sel]):
            if s[0] == 2 and s[3] << 8 | s[4] == program:
                i, kinds = 12 + ((s[10] & 15) << 8 | s[11]), {}
                while i + 5 <= len(s) - 4:
                    kinds[(s[i + 1] & 31) << 8 | s[i + 2]] = s[i]
                    i += 5 + ((s[i + 3] & 15) << 8 | s[i + 4])
                known = maps.setdefault(program, [])
                known.append((at if known else 0, kinds))
                streams |= dict.fromkeys(kinds, program)
    out = []
    for es, program in streams.items():
        since = [at for at, _ in maps[program]]
        sel = np.flatnonzero((pid == es) & load)
        if not len(sel):
            continue
        same = np.zeros(len(sel), bool)
        same[1:] = (cc[sel][1:] == cc[sel][:-1]) & (p[sel][1:] == p[sel][:-1]).all(axis=1)
        sel = sel[~same]
        jump = np.zeros(len(sel), bool)
        jump[1:] = cc[sel][1:] != (cc[sel][:-1] + 1) & 15
        jump &= (flags[sel] & 0x80) == 0
        first = np.flatnonzero(pusi[sel])
        for k, i in enumerate(first):
            j = int(first[k + 1]) if k + 1 < len(first) else len(sel)
            rows = sel[i:j]
            data = b"".join(p[r, start[r] :].tobytes() for r in rows)
            jumps = int(jump[i + 1 : j].sum()) + (int(jump[j]) if j < len(sel) else 0)
            bare = len(data) > 3 and data[3] in _BARE
            kind = maps[program][bisect_right(since, int(number[rows[0]])) - 1][1].get(es)
            if kind is None or len(data) < (6 if bare else 9) or data[:3] != b"\0\0\1":
                continue
            said = data[4] << 8 | data[5]
            pts = dts = None
            body = 6 if bare else 9 + data[8]
            if not bare and data[7] & 0x80 and len(data) >= 14:
                pts = dts = _read_stamp(data[9:14])
                if data[7] & 0x40 and len(data) >= 19:
                    dts = _read_stamp(data[14:19])
            payload = data[body : 6 + said] if said else data[body:]
            out.append({"program": program, "pid": es, "stream_type": kind, "packet": int(number[rows[0]]), "pts": pts, "dts": dts, "random_access": bool(flags[rows[0]] & 0x40), "jumps": jumps, "complete": not jumps and (not said or len(data) >= 6 + said), "payload": payload})
    out.sort(key=lambda r: (r["packet"], r["pid"]))
    return out


_FIELDS = [("program", pa.int32()), ("pid", pa.int32()), ("stream_type", pa.int32()), ("packet", pa.int64()), ("pts", pa.int64()), ("dts", pa.int64()), ("random_access", pa.bool_()), ("jumps", pa.int32()), ("complete", pa.bool_()), ("payload", pa.binary())]


def transport_stream(data: Column, number: Column) -> Column:
    """A stream that carries the bytes of a text; null for null. The binding by which tables without media have a media column."""

    @F.arrow_udf("binary")
    def run(texts: pa.Array, numbers: pa.Array) -> pa.Array:
        return pa.array([None if t is None else stream_of(t.encode(), n or 0) for t, n in zip(texts.to_pylist(), numbers.to_pylist())], pa.binary())

    return run(data, number)


def elementary_packets(media: DataFrame, key: str, column: str, rows: int = 256) -> DataFrame:
    """One row for each elementary packet of the transport streams in a binary column: the key, seq (order of first transport packets in the row's stream), program, pid, stream_type, packet (index of the first transport packet), pts and dts (90 kHz), random_access, jumps (of the continuity counter), complete, size, crc32 and payload.

    Cases: null or empty streams, or ones without packets or program tables: no rows. Bytes before, between and after packets are skipped; a table with a wrong CRC, or that isn't current yet, is ignored. Streams whose ids have no optional header (private 2, padding and the like) are all payload, without time stamps. Long streams are parsed whole. Repeated rows and null keys are parsed like any other. Empty table: empty result; other columns are ignored.
    """
    ensure_importable(media.sparkSession)
    kind = media.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                found = [(i, k, r) for i, raw in enumerate(b.column(1).to_pylist()) if raw for k, r in enumerate(parse(raw))]
                if found:
                    cols = [b.column(0).take(pa.array([i for i, _, _ in found])), pa.array([k for _, k, _ in found], pa.int32())]
                    cols += [pa.array([r[f] for _, _, r in found], t) for f, t in _FIELDS]
                    cols += [pa.array([len(r["payload"]) for _, _, r in found], pa.int64()), pa.array([zlib.crc32(r["payload"]) for _, _, r in found], pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, [key, "seq", *[f for f, _ in _FIELDS], "size", "crc32"])

    schema = f"`{key}` {kind}, seq int, program int, pid int, stream_type int, packet long, pts long, dts long, random_access boolean, jumps int, complete boolean, payload binary, size long, crc32 long"
    return media.select(key, column).mapInArrow(run, schema)
