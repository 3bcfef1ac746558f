"""Captures read in byte ranges: the rows of a sequential reader for every range size, block kinds, damaged files."""
import os
import random
import struct

import pytest

from packetloom.sources import captures
from tests.test_captures import PACKETS, ether, ip_packet, pcap


def long_pcap(order, n=400, seed=1, cut=0, payload=None):
    """Many packets; some hold a capture of their own as payload, so that a wrong start looks right."""
    rnd = random.Random(seed)
    out = struct.pack(order + "IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for i in range(n):
        inner = pcap(order)[24:] * 4 if i % 7 == 0 else rnd.randbytes(rnd.randrange(0, 60))
        frame = ether(ip_packet(f"10.0.{i % 5}.{i % 250}", "10.9.9.9", 1000 + i, 80, 17 if i % 3 else 6, payload=payload or inner))
        out += struct.pack(order + "IIII", 1000 + i, i, len(frame), len(frame)) + frame
    return out[:len(out) - cut] if cut else out


def block(order, kind, body):
    body += b"\0" * (-len(body) % 4)
    size = 12 + len(body)
    return struct.pack(order + "II", kind, size) + body + struct.pack(order + "I", size)


def section(order):
    return block(order, 0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))


def face(order, link, ticks=9, offset=None, snap=0):
    options = struct.pack(order + "HHB3x", 9, 1, ticks)
    if offset is not None:
        options += struct.pack(order + "HHq", 14, 8, offset)
    return block(order, 1, struct.pack(order + "HHI", link, 0, snap) + options + struct.pack(order + "HH", 0, 0))


def enhanced(order, number, ticks, frame, more=b""):
    return block(order, 6, struct.pack(order + "IIIII", number, ticks >> 32, ticks & 0xFFFFFFFF, len(frame), len(frame)) + frame
                 + b"\0" * (-len(frame) % 4) + more)


def old(order, number, ticks, frame):
    return block(order, 2, struct.pack(order + "HHIIII", number, 0, ticks >> 32, ticks & 0xFFFFFFFF, len(frame), len(frame)) + frame)


def simple(order, frame):
    return block(order, 3, struct.pack(order + "I", len(frame)) + frame)


def long_pcapng(n=120):
    """Two sections of different byte order, interfaces of different links and clocks, one declared late."""
    out, raw = b"", ip_packet("1.1.1.1", "2.2.2.2", 1, 2, 17, payload=b"z" * 5)
    for order, start in (("<", 0), (">", 5_000)):
        out += section(order) + face(order, 1) + face(order, 101, 6, offset=100)
        for i in range(n):
            second = start + i
            if i == n // 2:
                out += face(order, 101, 0x80 | 10)
            if i % 5 == 0:
                out += block(order, 5, b"\0" * 12) + block(order, 0xBAD, os.urandom(8))
            number = i % 3 if i > n // 2 else i % 2
            ticks = {0: second * 10 ** 9, 1: (second - 100) * 10 ** 6, 2: second * 1024}[number] if second >= 100 else second * 10 ** 9
            out += enhanced(order, number if second >= 100 else 0, ticks, ether(raw) if number == 0 or second < 100 else raw, b"\1\0\4\0note")
        out += old(order, 0, (start + n) * 10 ** 9, ether(raw)) + simple(order, ether(raw)) + enhanced(order, 9, 0, raw)
    return out


FILES = {
    "a.pcap": pcap("<"), "b/long.pcap": long_pcap("<"), "c.pcap": long_pcap(">", 150, 2), "cut.pcap": long_pcap("<", 60, 3, cut=11),
    "header.pcap": pcap("<")[:24], "short.pcap": pcap("<")[:20], "empty.pcap": b"", "no_capture.txt": b"hello world, this is no capture",
    "blocks.pcapng": long_pcapng(), "cut.pcapng": long_pcapng(30)[:-30], "giant.pcap": long_pcap("<", 3, payload=b"q" * 9_000),
    "odd name%20#1.pcap": pcap("<", True),
}


def plain(content):
    """Records of a classic capture, one after another: (microseconds, frame)."""
    order, unit = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000)}[content[:4]]
    at, out = 24, []
    while at + 16 <= len(content):
        sec, sub, size, _ = struct.unpack(order + "IIII", content[at:at + 16])
        if at + 16 + size > len(content):
            break
        out.append((sec * 1_000_000 + sub // unit, content[at + 16:at + 16 + size]))
        at += 16 + size
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    where = tmp_path_factory.mktemp("captures")
    for name, content in FILES.items():
        (where / name).parent.mkdir(exist_ok=True)
        (where / name).write_bytes(content)
    return str(where)


def by_file(rows):
    out = {}
    for r in rows.drop("number").collect():
        out.setdefault(os.path.basename(r["capture"]), []).append(tuple(r)[1:])
    return {name: sorted(found, key=lambda r: r[0]) for name, found in out.items()}


@pytest.fixture(scope="module")
def whole(spark, folder):
    """All rows, each file decoded as one content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return by_file(captures.decode(captures.numbered(files)))


def test_contents_equal_a_plain_reader(whole):
    for name in ("a.pcap", "b/long.pcap", "c.pcap", "cut.pcap", "giant.pcap"):
        expected, found = plain(FILES[name]), whole[os.path.basename(name)]
        assert [(r[0], r[1]) for r in found] == [(k, us) for k, (us, _) in enumerate(expected)]
        for row, (_, frame) in zip(found, expected):
            assert row[2] == (frame[12:14] in (b"\x08\x00", b"\x81\x00") and frame[9 + 14 + 4 * (frame[12:14] == b"\x81\x00")] in (6, 17))
    assert whole["long.pcap"][3][2:] == (True, "10.0.3.3", "10.9.9.9", 1003, 80, 6, len(plain(FILES["b/long.pcap"])[3][1]) - 54, False, False, False, True)


def test_block_kinds(whole):
    rows = whole["blocks.pcapng"]
    assert len(rows) == 2 * 123
    for start, part in ((0, rows[:123]), (5_000, rows[123:])):
        assert [r[1] for r in part[:121]] == [(start + i) * 1_000_000 for i in range(121)]
        assert all(r[2:] == (True, "1.1.1.1", "2.2.2.2", 1, 2, 17, 5, False, False, False, False) for r in part[:121])
        # a simple block has no time, and an undeclared interface no link
        assert part[121][1:3] == (None, False) and part[122][2] is False


@pytest.mark.parametrize("split", [333, 4_099, 1 << 25])
def test_ranges_equal_whole_contents(spark, folder, whole, split):
    assert by_file(captures.capture_packets(spark, folder, split)) == whole


@pytest.mark.parametrize("split", [900, 1 << 25])
def test_files_are_reported(spark, folder, whole, split):
    rows = {os.path.basename(r["path"]): r for r in captures.capture_files(spark, folder, split).collect()}
    # Spark lists no empty files
    filled = {name: content for name, content in FILES.items() if content}
    assert len(rows) == len(filled)
    for name, content in filled.items():
        r = rows[os.path.basename(name)]
        assert r["size"] == len(content) and r["records"] == len(whole.get(os.path.basename(r["path"]), []))
        assert r["known"] == (name not in ("short.pcap", "no_capture.txt"))
        assert r["cut"] == (name in ("cut.pcap", "cut.pcapng"))


def test_most_guesses_hold(spark, folder):
    """In files without traps few guesses are wrong; one that is costs a walk of the file's headers, not rows."""
    for order in "<>":
        walk = captures._Walk(captures._Content(long_pcap(order, 150, 5, payload=b"plain text and nothing else")))
        starts = [at - 16 for at, *_ in walk.records(24, walk.size)]
        assert sum(walk.guess(at + 1, walk.size) == after for at, after in zip(starts, starts[1:])) >= 0.98 * (len(starts) - 1)


def test_numbers_stay(spark, tmp_path):
    for k, name in enumerate(("m.pcap", "z.pcap")):
        (tmp_path / name).write_bytes(pcap("<"))
        os.utime(tmp_path / name, (1000 + k, 1000 + k))
    numbers = lambda rows: {os.path.basename(r["path"]): r["number"] for r in rows.collect()}
    first = captures.capture_files(spark, str(tmp_path)).select("path", "number")
    known = spark.createDataFrame(first.collect(), first.schema)
    (tmp_path / "a.pcap").write_bytes(pcap("<"))
    os.utime(tmp_path / "a.pcap", (2000, 2000))
    assert numbers(first) == {"m.pcap": 1, "z.pcap": 2}
    assert numbers(captures.capture_files(spark, str(tmp_path))) == {"m.pcap": 1, "z.pcap": 2, "a.pcap": 3}
    os.utime(tmp_path / "a.pcap", (1, 1))
    assert numbers(captures.capture_files(spark, str(tmp_path), known=known)) == {"m.pcap": 1, "z.pcap": 2, "a.pcap": 3}
    rows = captures.packet_rows(captures.capture_packets(spark, str(tmp_path), 100, known))
    assert rows.count() == rows.select("seq").distinct().count() == 12
