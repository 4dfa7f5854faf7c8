"""Operator 4, media columns: payloads in MPEG transport streams.

`mux` wraps a payload in a transport stream with one program: a program
association table, a program map table, and one elementary stream of private
data in PES packets with presentation times. `demux` parses any such stream: it
reads the tables, checks their CRCs and the continuity counters of each PID,
reassembles the elementary packets and keeps their timestamps and
random-access points.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lattica.llm.tokens import by_bytes
from lattica.session import materialize, table

#: Fixed values of the transport stream format (ISO/IEC 13818-1).
PACKET, SYNC = 188, 0x47
PAT_PID, STREAM_TYPE_PRIVATE, STREAM_ID_PRIVATE = 0, 0x06, 0xBD
#: Chosen here: the map table's and the stream's PID, the program's number.
PMT_PID, ES_PID, PROGRAM = 0x1000, 0x0100, 1
#: Payload bytes in one PES packet, a multiple of 64, and the 90 kHz ticks from one to the next.
UNIT_BYTES, UNIT_TICKS = 32_768, 3_600
#: Every so many units one is a random-access point with tables before it.
ACCESS_EVERY = 8
BATCH_BYTES = 4 << 20


def _crc_table() -> list[int]:
    out = []
    for k in range(256):
        c = k << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc_mpeg(data: bytes) -> int:
    """CRC-32 as sections carry it; 0 over a section with its CRC."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", crc_mpeg(head + body))


_PAT = _section(0x00, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
_PMT = _section(0x02, PROGRAM, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, STREAM_TYPE_PRIVATE, 0xE000 | ES_PID, 0xF000))


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    return (struct.pack(">BHBB", SYNC, 0x4000 | pid, 0x10 | counter, 0) + section).ljust(PACKET, b"\xff")


def _stamp(ticks: int) -> bytes:
    t = ticks & ((1 << 33) - 1)
    return struct.pack(">BHH", 0x21 | (t >> 29) & 0x0E, (t >> 14) & 0xFFFE | 1, (t << 1) & 0xFFFE | 1)


def _read_stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def mux(payload: bytes) -> bytes:
    """A transport stream that holds the payload losslessly; a function of the payload alone."""
    out: list[bytes] = []
    counter = 0
    for k, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        access = k % ACCESS_EVERY == 0
        ticks = k * UNIT_TICKS
        if access:
            n = k // ACCESS_EVERY & 15
            out += [_table_packet(PAT_PID, _PAT, n), _table_packet(PMT_PID, _PMT, n)]
        unit = payload[at : at + UNIT_BYTES]
        pes = struct.pack(">IHBBB", 0x100 | STREAM_ID_PRIVATE, len(unit) + 8, 0x84, 0x80, 5) + _stamp(ticks) + unit
        # the first packet's adaptation field: random access, and the clock at access points
        first = struct.pack(">BBIH", 7, 0x50, ticks >> 1 & 0xFFFFFFFF, (ticks & 1) << 15 | 0x7E00) if access else b""
        room = PACKET - 4 - len(first)
        body = len(pes) - room
        if body < 0:  # a single packet: stuffing in the adaptation field
            out.append(_stuffed(pes, 0x4000 | ES_PID, counter, first))
            counter = counter + 1 & 15
            continue
        out.append(struct.pack(">BHB", SYNC, 0x4000 | ES_PID, (0x30 if first else 0x10) | counter) + first + pes[:room])
        full, rest = divmod(body, PACKET - 4)
        if full:
            packets = np.empty((full, PACKET), np.uint8)
            packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
            packets[:, 3] = 0x10 | (np.arange(counter + 1, counter + 1 + full) & 15)
            packets[:, 4:] = np.frombuffer(pes, np.uint8, full * (PACKET - 4), room).reshape(full, PACKET - 4)
            out.append(packets.tobytes())
        if rest:
            out.append(_stuffed(pes[len(pes) - rest :], ES_PID, counter + full + 1 & 15, b""))
        counter = counter + 1 + full + bool(rest) & 15
    return b"".join(out)


def _stuffed(data: bytes, word: int, counter: int, field_: bytes) -> bytes:
    """One packet whose adaptation field is stretched so that the data ends with it."""
    length = PACKET - 5 - len(data)
    rest = field_[1:] or (b"\x00" if length else b"")
    return struct.pack(">BHBB", SYNC, word, 0x30 | counter, length) + rest.ljust(length, b"\xff") + data


@dataclass
class Stream:
    """What a transport stream holds."""

    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    units: list[bytes] = field(default_factory=list)
    times: list[int] = field(default_factory=list)
    access: list[bool] = field(default_factory=list)
    packets: int = 0
    counter_errors: int = 0
    crc_errors: int = 0

    def feature(self) -> str:
        """Program, streams, packets, errors, timestamps and random-access points, as one line."""
        programs = ",".join(f"{n}@{pid}" for n, pid in sorted(self.programs.items()))
        streams = ",".join(f"{pid}:{kind:#04x}" for pid, kind in sorted(self.streams.items()))
        span = f"{self.times[0]}-{self.times[-1]}" if self.times else ""
        points = ",".join(str(t) for t, a in zip(self.times, self.access) if a)
        return f"programs={programs};streams={streams};packets={self.packets};pes={len(self.units)};cc_errors={self.counter_errors};crc_errors={self.crc_errors};pts={span};access={points}"


def demux(data: bytes) -> Stream:
    """Parses a transport stream; raises ValueError where packets lose their sync byte."""
    out = Stream()
    if len(data) % PACKET:
        raise ValueError("not whole packets")
    p = np.frombuffer(data, np.uint8).reshape(-1, PACKET)
    out.packets = len(p)
    if not len(p):
        return out
    if (p[:, 0] != SYNC).any():
        raise ValueError("sync byte lost")
    pids = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    starts = (p[:, 1] & 0x40) > 0
    has_field, has_data = (p[:, 3] & 0x20) > 0, (p[:, 3] & 0x10) > 0
    counters = p[:, 3] & 15
    begin = np.where(has_field, 5 + p[:, 4].astype(np.int32), 4)
    # a packet may be sent twice, with the same counter and payload; a marked discontinuity starts counting anew
    jumps = has_field & (p[:, 4] > 0) & ((p[:, 5] & 0x80) > 0)
    twice = np.zeros(len(p), bool)
    for pid in np.unique(pids):
        mine = np.flatnonzero((pids == pid) & has_data)
        again = np.flatnonzero(counters[mine[1:]] == counters[mine[:-1]]) + 1
        for k in again.tolist():
            one, two = mine[k - 1], mine[k]
            twice[two] = not twice[one] and not jumps[two] and begin[one] == begin[two] and bool((p[one, begin[one] :] == p[two, begin[two] :]).all())
        mine = mine[~twice[mine]]
        c = counters[mine].astype(np.int32)
        out.counter_errors += int((((c[1:] - c[:-1]) % 16 != 1) & ~jumps[mine[1:]]).sum())
    has_data &= ~twice

    def sections(pid: int) -> Iterator[bytes]:
        """Whole sections of a table, however they are spread over packets."""
        held: bytes | None = None

        def whole() -> Iterator[bytes]:
            nonlocal held
            while held:
                if held[0] == 0xFF:  # stuffing up to the packet's end
                    held = None
                    return
                size = 3 + (struct.unpack_from(">H", held, 1)[0] & 0xFFF) if len(held) > 2 else PACKET
                if len(held) < size:
                    return
                body, held = held[:size], held[size:]
                if crc_mpeg(body):
                    out.crc_errors += 1
                else:
                    yield body

        for k in np.flatnonzero((pids == pid) & has_data):
            row = p[k, begin[k] :].tobytes()
            if not starts[k]:
                if held is not None:
                    held += row
                    yield from whole()
                continue
            pointer = row[0]
            if held:
                held += row[1 : 1 + pointer]
                yield from whole()
            held = row[1 + pointer :]
            yield from whole()

    for pat in set(sections(PAT_PID)):
        for at in range(8, len(pat) - 4, 4):
            number, pid = struct.unpack_from(">HH", pat, at)
            if number:
                out.programs[number] = pid & 0x1FFF
    for pmt_pid in out.programs.values():
        for pmt in set(sections(pmt_pid)):
            at = 12 + (struct.unpack_from(">H", pmt, 10)[0] & 0xFFF)
            while at < len(pmt) - 4:
                kind, pid, more = struct.unpack_from(">BHH", pmt, at)
                out.streams[pid & 0x1FFF] = kind
                at += 5 + (more & 0xFFF)
    for pid in out.streams:
        mine = np.flatnonzero((pids == pid) & has_data)
        heads = np.flatnonzero(starts[mine])
        for a, b in zip(heads, [*heads[1:], len(mine)]):
            rows = mine[a:b]
            plain = begin[rows] == 4
            if plain[1:-1].all():
                ends = [p[rows[0], begin[rows[0]] :].tobytes(), p[rows[1:-1], 4:].tobytes()]
                pes = b"".join(ends + ([p[rows[-1], begin[rows[-1]] :].tobytes()] if len(rows) > 1 else []))
            else:
                pes = b"".join(p[k, begin[k] :].tobytes() for k in rows)
            length = struct.unpack_from(">H", pes, 4)[0] or len(pes) - 6  # 0: up to the next unit
            if pes[:3] != b"\x00\x00\x01" or len(pes) < 6 + length:
                raise ValueError("damaged elementary packet")
            out.times.append(_read_stamp(pes[9:14]) if pes[7] & 0x80 else -1)
            out.access.append(bool(has_field[rows[0]] and p[rows[0], 4] and p[rows[0], 5] & 0x40))
            out.units.append(pes[9 + pes[8] : 6 + length])
    return out


def padded(text: str | None) -> tuple[bytes, int]:
    """The UTF-8 payload, with bytes 0 up to a positive multiple of 64, and its length without them."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 if raw else 64), len(raw)


def _mapped(df: DataFrame, schema: str, column: str, make: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, BATCH_BYTES, column):
            yield pa.RecordBatch.from_pydict(make(batch))

    return df.mapInArrow(run, schema)


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (binary transport stream) for every row of docs (doc_id, text).

    Null ids and repeated rows stay, a null text is empty and padded to 64 bytes,
    an empty table gives none, other columns are left behind.
    """

    def make(batch: pa.RecordBatch) -> dict:
        pairs = [padded(t) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id").cast(pa.int64()), "n_bytes": pa.array([n for _, n in pairs], pa.int64()), "media": pa.array([mux(p) for p, _ in pairs], pa.binary())}

    return _mapped(docs.select("doc_id", "text"), "doc_id long, n_bytes long, media binary", "text", make)


def read_media(media: DataFrame) -> DataFrame:
    """Parses the column `media` and describes the stored stream and the payload read back from it."""

    def make(batch: pa.RecordBatch) -> dict:
        stored = batch.column("media").to_pylist()
        streams = [demux(m) for m in stored]
        loads = [b"".join(s.units) for s in streams]
        return {
            "doc_id": batch.column("doc_id"),
            "n_bytes": batch.column("n_bytes"),
            "payload_bytes": pa.array([len(x) for x in loads], pa.int64()),
            "payload_sha256": [hashlib.sha256(x).hexdigest() for x in loads],
            "tail_crc32": pa.array([zlib.crc32(x[-64:]) for x in loads], pa.int64()),
            "media_bytes": pa.array([len(m) for m in stored], pa.int64()),
            "media_sha256": [hashlib.sha256(m).hexdigest() for m in stored],
            "feature": [s.feature() for s in streams],
        }

    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _mapped(media, fields, "media", make)


def op4_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a stored transport stream, and what parsing it gives back."""
    return read_media(materialize(store_media(table(spark, sf_dir, "documents")), "media"))
