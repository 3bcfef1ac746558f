"""Capture files, written here byte by byte."""
import struct

from packetloom.operators import flows
from packetloom.sources import readers


def ip_packet(src, dst, sport, dport, proto=6, flags=0x10, payload=b"", version=4):
    if proto == 6:
        l4 = struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 5 << 4, flags, 0, 0, 0)
    else:
        l4 = struct.pack(">HHHH", sport, dport, 8 + len(payload), 0)
    size = 20 + len(l4) + len(payload)
    quad = lambda a: bytes(int(x) for x in a.split("."))
    return struct.pack(">BBHHHBBH", version << 4 | 5, 0, size, 0, 0, 64, proto, 0) + quad(src) + quad(dst) + l4 + payload


def ether(packet, kind=b"\x08\x00", tag=b""):
    return b"\0" * 12 + tag + kind + packet + b"\0" * max(0, 46 - len(packet))


PACKETS = [
    (1.25, ether(ip_packet("1.2.3.4", "5.6.7.8", 1000, 80, flags=0x02))),
    (1.5, ether(ip_packet("5.6.7.8", "1.2.3.4", 80, 1000, flags=0x12), tag=b"\x81\x00\x00\x05")),
    (1.75, ether(ip_packet("1.2.3.4", "5.6.7.8", 1000, 80, payload=b"x" * 100))),
    (2.0, ether(ip_packet("1.2.3.4", "5.6.7.8", 53, 53, 17, payload=b"y" * 9))),
    (2.1, ether(ip_packet("1.2.3.4", "5.6.7.8", 0, 0, 1))),
    (2.2, ether(b"\0" * 28, kind=b"\x08\x06")),
]


def pcap(order, nano=False):
    unit = 10 ** 9 if nano else 10 ** 6
    out = struct.pack(order + "IHHIIII", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for t, frame in PACKETS:
        out += struct.pack(order + "IIII", int(t), int(round((t - int(t)) * unit)), len(frame), len(frame)) + frame
    return out


def pcapng(order):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        size = 12 + len(body)
        return struct.pack(order + "II", kind, size) + body + struct.pack(order + "I", size)
    out = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
    out += block(1, struct.pack(order + "HHI", 1, 0, 0) + struct.pack(order + "HHB3x", 9, 1, 9) + struct.pack(order + "HH", 0, 0))
    out += block(5, b"\0" * 12)
    for t, frame in PACKETS:
        ticks = int(t * 10 ** 9)
        out += block(6, struct.pack(order + "IIIII", 0, ticks >> 32, ticks & 0xFFFFFFFF, len(frame), len(frame)) + frame)
    return out


def test_capture_files(spark, tmp_path):
    files = {"a.pcap": pcap("<"), "b.pcap": pcap(">"), "c.pcap": pcap("<", True), "sub/d.pcapng": pcapng("<"), "sub/e.pcapng": pcapng(">"),
             "not_a_capture.txt": b"hello world, this is no capture"}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    rows = readers.capture_packets(spark, str(tmp_path))
    assert readers.capture_counts(rows).first().asDict() == {"packets_read": 30, "admitted": 20, "ignored": 10}
    packets = readers.packet_rows(rows)
    seen = {}
    for r in packets.orderBy("seq").collect():
        seen.setdefault(r.capture, []).append(
            (r.ts.timestamp() % 100, r.src_ip, r.src_port, r.dst_port, r.proto, r.payload_len, r.syn, r.ack))
    assert len(seen) == 5 and packets.select("seq").distinct().count() == 20
    for got in seen.values():
        assert [g[1:] for g in got] == [
            ("1.2.3.4", 1000, 80, 6, 0, True, False), ("5.6.7.8", 80, 1000, 6, 0, True, True),
            ("1.2.3.4", 1000, 80, 6, 100, False, True), ("1.2.3.4", 53, 53, 17, 9, False, False)]
        assert [g[0] for g in got] == [1.25, 1.5, 1.75, 2.0]
    built = flows.build_flows(packets, mode="tracker", tracker="capture")
    assert sorted((f.proto, f.fwd_packets, f.bwd_packets, f.fwd_bytes) for f in built.collect()) == [(6, 2, 1, 100)] * 5 + [(17, 1, 0, 9)] * 5


def test_scratch_tables_can_be_cleared(spark):
    from packetloom import session
    from packetloom.sources.sinks import exists
    path = session.scratch(spark, "clear-me")
    held = list(session._scratch[spark.sparkContext.applicationId])
    session._scratch[spark.sparkContext.applicationId] = [path]
    spark.range(3).write.parquet(path)
    assert session.clear_scratch(spark) == 1 and not exists(spark, path)
    session._scratch[spark.sparkContext.applicationId] = held[:-1]
