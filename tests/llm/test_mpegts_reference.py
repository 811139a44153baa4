"""Streams written by hand, packet by packet after the standard, without the operator's own writer."""

import hashlib
import random

import pytest

from leadmill.llm import mpegts


def crc(data):
    """CRC-32/MPEG-2 by polynomial division of the bit string."""
    bits = [b >> 7 - k & 1 for b in data for k in range(8)] + [0] * 32
    for k in range(32):
        bits[k] ^= 1
    poly = [int(c) for c in "100000100110000010001110110110111"]
    for k in range(len(bits) - 32):
        if bits[k]:
            for j, p in enumerate(poly):
                bits[k + j] ^= p
    return int("".join(map(str, bits[-32:])), 2).to_bytes(4, "big")


def section(table, ident, body):
    size = len(body) + 9
    whole = bytes([table, 0xB0 | size >> 8, size & 255, ident >> 8, ident & 255, 0xC1, 0, 0]) + body
    return whole + crc(whole)


def packet(pid, counter, payload, start=False, adaptation=None):
    """One packet; short payloads are filled by an adaptation field."""
    room = 184 - len(payload)
    field = b""
    if adaptation is not None or room:
        inner = adaptation if adaptation is not None else (b"\0" if room > 1 else b"")
        inner += b"\xff" * (room - 1 - len(inner))
        field = bytes([len(inner)]) + inner
    out = bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, (0x30 if field else 0x10) | counter % 16]) + field + payload
    assert len(out) == 188
    return out


def tables(pid, whole, counter=0):
    """The packets of a section, with pointer field and stuffing."""
    data = b"\0" + whole
    return [packet(pid, counter + k, data[i : i + 184].ljust(184, b"\xff"), start=not i) for k, i in enumerate(range(0, len(data), 184))]


def stamp(t):
    return bytes([0x21 | t >> 29 & 14, t >> 22 & 255, t >> 14 & 254 | 1, t >> 7 & 255, t << 1 & 254 | 1])


def pes(payload, t, sized):
    head = b"\x80\x80\x05" + stamp(t)
    n = len(head) + len(payload) if sized else 0
    return b"\0\0\1\xe0" + n.to_bytes(2, "big") + head + payload


def unit(pid, counter, data, access=False):
    out, first = [], True
    while data or first:
        room = 182 if first and access else 184
        part, data = data[:room], data[room:]
        out.append(packet(pid, counter + len(out), part, first, b"\x40" if first and access else None))
        first = False
    return out


PAT = section(0, 1, b"\0\0\xe0\x10" + b"\0\7\xe1\0")
#: A program map of two streams with long descriptors, over three packets.
PMT = section(2, 7, b"\xe2\0" + b"\xf0\xc8" + b"\x05\xc6" + b"d" * 198 + b"\x1b\xe2\0\xf0\x64" + b"\x0a\x62" + b"x" * 98 + b"\x0f\xe2\1\xf0\0")


def stream(sized, seed=1):
    rng = random.Random(seed)
    payloads = [rng.randbytes(n) for n in (500, 1, 170, 2000, 183)]
    audio = [rng.randbytes(700)]
    out = tables(0, PAT) + tables(0x100, PMT)
    at = 5
    for k, p in enumerate(payloads):
        packets = unit(0x200, at, pes(p, 900 * k + 2**32, sized), access=k % 2 == 0)
        at += len(packets)
        out += packets
        if k == 1:
            out += unit(0x201, 0, pes(audio[0], 77, True))
    return out, b"".join(payloads), audio[0]


@pytest.mark.parametrize("sized", [True, False])
def test_reads_a_stream_of_the_standard(sized):
    packets, video, audio = stream(sized)
    assert len(tables(0x100, PMT)) == 2
    found = mpegts.demux(b"".join(packets))
    assert (found["program"], found["pid"], found["stream_type"], found["streams"]) == (7, 0x200, 0x1B, ["512:27", "513:15"])
    assert found["payload"] == video and found["lost"] == found["duplicates"] == 0
    assert found["pts"] == [2**32 + 900 * k for k in range(5)]
    starts = [i for i, p in enumerate(packets) if p[1] == 0x42 and p[2] == 0]
    assert found["access"] == starts[::2]
    other = mpegts.demux(b"".join(packets), pid=0x201)
    assert (other["payload"], other["pts"], other["stream_type"]) == (audio, [77], 0x0F)


def test_a_duplicate_packet_changes_nothing():
    packets, video, _ = stream(True)
    for k in range(len(packets)):
        found = mpegts.demux(b"".join(packets[: k + 1] + packets[k : k + 1] + packets[k + 1 :]))
        assert found["payload"] == video and found["lost"] == 0 and found["duplicates"] == (packets[k][1:3] in (b"\x42\0", b"\x02\0"))


def test_lost_packets_are_counted():
    packets, video, _ = stream(True)
    own = [k for k, p in enumerate(packets) if p[1] & 31 == 2 and p[2] == 0]
    for n in (1, 2, 5):
        gone = own[4 : 4 + n]
        found = mpegts.demux(b"".join(p for k, p in enumerate(packets) if k not in gone))
        assert found["lost"] == n and len(found["payload"]) < len(video)


def test_an_announced_discontinuity_loses_nothing():
    a = unit(0x200, 3, pes(b"first", 1, True))
    b = [packet(0x200, 9, pes(b"second", 2, True), True, b"\x80")]
    found = mpegts.demux(b"".join(tables(0, PAT) + tables(0x100, PMT) + a + b))
    assert (found["payload"], found["lost"]) == (b"firstsecond", 0)


def test_bytes_after_the_stated_length_are_no_payload():
    whole = pes(b"payload", 5, True) + b"\xff" * 20
    found = mpegts.demux(b"".join(tables(0, PAT) + tables(0x100, PMT) + unit(0x200, 0, whole)))
    assert found["payload"] == b"payload"


def test_the_writer_keeps_to_the_standard():
    """What ``mux`` writes, taken apart byte by byte."""
    payload = random.Random(4).randbytes(10_000)
    media = mpegts.mux(payload)
    parts = [media[i : i + 188] for i in range(0, len(media), 188)]
    data, clocks = b"", []
    for want, p in zip(([0x47], [0x47]), parts):
        assert list(p[:1]) == want
    assert parts[0][5:17] + crc(parts[0][5:17]) == parts[0][5:21]  # association table: 12 bytes and its checksum
    for k, p in enumerate(parts[2:]):
        assert p[3] & 15 == k % 16 and (p[1] & 31) << 8 | p[2] == 0x100
        at = 4 + (p[4] + 1 if p[3] & 0x20 else 0)
        if p[3] & 0x20 and p[4] and p[5] & 0x10:
            clocks.append((int.from_bytes(p[6:10], "big") << 1) | p[10] >> 7)
        if p[1] & 0x40:
            assert p[at : at + 4] == b"\0\0\1\xbd"
            at += 9 + p[at + 8]
        data += p[at:]
    assert data == payload and clocks == [mpegts.TICKS * k for k in range(-(-len(payload) // mpegts.BODY))]


def test_features_of_stored_texts(spark):
    """Media and features against the reference reading above, from the bytes alone."""
    texts = {1: "x" * 30_000, 2: None, 3: "é" * 999, 4: "x" * 30_000}
    rows = mpegts.digests(mpegts.parse(mpegts.store(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))).collect()
    for r in rows:
        media = mpegts.mux(mpegts.payload_of(texts[r.doc_id]))
        units = [i for i in range(0, len(media), 188) if media[i + 1] & 0x40 and media[i + 1] & 31 == 1]
        f = dict(x.split("=", 1) for x in r.feature.split(";"))
        assert r.media_sha256 == hashlib.sha256(media).hexdigest() and r.media_bytes == len(media)
        assert f["access"] == ",".join(str(i // 188) for i in units if media[i + 5] & 0x40) and int(f["units"]) == len(units)
        assert (f["program"], f["pid"], f["type"], f["streams"], f["lost"], f["duplicates"]) == ("1", "256", "6", "256:6", "0", "0") and int(f["packets"]) == len(media) // 188


def test_a_text_of_thirty_megabytes(spark):
    df = spark.createDataFrame([(1, 30_000_000)], "doc_id long, n long").selectExpr("doc_id", "repeat('abc', cast(n / 3 as int)) as text")
    r = mpegts.digests(mpegts.parse(mpegts.store(df))).first()
    assert r.payload_bytes == 30_000_000 // 192 * 192 + 192 * (30_000_000 % 192 > 0)
