"""Streams that the muxer doesn't make: tables over several packets, packets sent twice, marked discontinuities."""

from __future__ import annotations

import struct

from lattica.llm import media


def packets(pid, payload, counter, start=True):
    """Payload over packets of 184 bytes, filled up with 0xFF."""
    out = []
    while payload:
        out.append((struct.pack(">BHB", 0x47, (0x4000 if start else 0) | pid, 0x10 | counter) + payload[:184]).ljust(188, b"\xff"))
        payload, counter, start = payload[184:], (counter + 1) % 16, False
    return out


def tables(streams):
    pat = media._section(0, 1, struct.pack(">HH", 1, 0xE000 | 0x100))
    entries = b"".join(struct.pack(">BHH", kind, 0xE000 | pid, 0xF000) for pid, kind in streams.items())
    return pat, media._section(2, 1, struct.pack(">HH", 0xE1FF, 0xF000) + entries)


STREAMS = {0x200 + k: 6 + k % 3 for k in range(90)}


def unit(payload, counter):
    pes = b"\x00\x00\x01\xbd" + struct.pack(">H", len(payload) + 8) + b"\x80\x80\x05" + media._stamp(900) + payload
    fill = -len(pes) % 184
    return packets(0x200, pes + b"\xff" * fill, counter)


def test_table_over_several_packets():
    pat, pmt = tables(STREAMS)
    assert len(pmt) > 2 * 184
    sent = packets(0, b"\x00" + pat, 0) + packets(0x100, b"\x00" + pmt, 0)
    s = media.demux(b"".join(sent))
    assert s.programs == {1: 0x100} and s.streams == STREAMS and (s.counter_errors, s.crc_errors) == (0, 0)


def test_sections_back_to_back():
    """The second section begins behind the end of the first, in its last packet."""
    pat, pmt = tables(STREAMS)
    one = b"\x00" + pmt
    cut = len(one) - len(one) % 184
    first, rest = packets(0x100, one[:cut], 0), one[cut:]
    last = struct.pack(">BHB", 0x47, 0x4100, 0x10 | len(first)) + bytes([len(rest)]) + rest + pmt[: 184 - 1 - len(rest)]
    more = packets(0x100, pmt[184 - 1 - len(rest) :], len(first) + 1, start=False)
    s = media.demux(b"".join(packets(0, b"\x00" + pat, 0) + first + [last] + more))
    assert s.streams == STREAMS and (s.counter_errors, s.crc_errors) == (0, 0)


def test_packets_sent_twice_and_discontinuity():
    pat, pmt = tables({0x200: 6})
    head = packets(0, b"\x00" + pat, 0) + packets(0x100, b"\x00" + pmt, 0)
    body = unit(bytes(range(200)) * 3, 5)
    s = media.demux(b"".join(head + [body[0], body[0], *body[1:], body[-1]]))
    assert s.units == [bytes(range(200)) * 3] and s.counter_errors == 0 and s.times == [900]
    jump = struct.pack(">BHBBB", 0x47, 0x200, 0x30 | 3, 183 - 1, 0x80).ljust(187, b"\xff") + b"x"
    s = media.demux(b"".join(head + unit(b"a" * 10, 9) + [jump]))
    assert s.counter_errors == 0
    plain = struct.pack(">BHB", 0x47, 0x200, 0x10 | 3).ljust(188, b"x")
    assert media.demux(b"".join(head + unit(b"a" * 10, 9) + [plain])).counter_errors == 1
