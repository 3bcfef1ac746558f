"""Flow building on literal packets, and against a plain simulation."""
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from packetloom import schema
from packetloom.operators import chain, flows

A, B = "10.1.1.1", "10.2.2.2"
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def packet(seq, t, src=A, dst=B, sport=1000, dport=80, proto=6, size=0, flags=""):
    return (seq, T0 + timedelta(seconds=t), src, dst, sport, dport, proto, size, "s" in flags, "r" in flags,
            "f" in flags, "a" in flags)


def reply(seq, t, **k):
    return packet(seq, t, src=B, dst=A, sport=80, dport=1000, **k)


def frame(spark, rows):
    return spark.createDataFrame(rows, schema.PACKET)


def built(spark, rows, **k):
    return sorted(flows.build_flows(frame(spark, rows), **k).collect(), key=lambda r: r.flow_id)


PATHS = [{}, {"group_rows": 0}]


@pytest.mark.parametrize("path", PATHS)
def test_aggregate(spark, path):
    rows = [packet(1, 1.0, size=100, flags="s"), packet(2, 1.1, size=50, flags="a"), reply(3, 1.2, size=200, flags="a")]
    (f,) = built(spark, rows[::-1], **path)
    assert (f.src_ip, f.fwd_packets, f.fwd_bytes, f.bwd_packets, f.bwd_bytes) == (A, 2, 150, 1, 200)
    assert (f.syn_count, f.ack_count, f.rst_count, f.fin_count) == (1, 2, 0, 0)
    assert f.duration_s == pytest.approx(0.2)


@pytest.mark.parametrize("path", PATHS)
def test_close_rules(spark, path):
    assert len(built(spark, [packet(1, 1), reply(2, 1)], **path)) == 1
    assert len(built(spark, [packet(1, 1), packet(2, 1, sport=1001), packet(3, 1, dst="10.9.9.9")], **path)) == 3
    reset = [packet(1, 1, flags="s"), reply(2, 1.5, flags="r"), packet(3, 1.6)]
    assert [(f.fwd_packets, f.bwd_packets, f.rst_count) for f in built(spark, reset, **path)] == [(1, 1, 1), (1, 0, 0)]
    fins = [packet(1, 1), packet(2, 1.5, flags="f"), reply(3, 1.6, flags="f"), packet(4, 1.7, flags="a")]
    assert [(f.flow_id, f.fwd_packets, f.bwd_packets) for f in built(spark, fins, **path)] == [(1, 2, 1), (4, 1, 0)]
    one_side = [packet(i, 1 + i / 10, flags="f") for i in range(3)]
    assert len(built(spark, one_side, **path)) == 1
    udp = [packet(1, 1, proto=17, flags="r"), packet(2, 2, proto=17, flags="f"), reply(3, 3, proto=17, flags="f")]
    assert len(built(spark, udp, **path)) == 1
    own = [packet(1, 1, dst=A, dport=1000, flags="f"), packet(2, 2, dst=A, dport=1000, flags="f")]
    assert [(f.fwd_packets, f.bwd_packets) for f in built(spark, own, **path)] == [(2, 0)]


@pytest.mark.parametrize("path", PATHS)
def test_time_limits(spark, path):
    assert len(built(spark, [packet(1, 0, proto=17), packet(2, 14.999999, proto=17)], **path)) == 1
    assert len(built(spark, [packet(1, 0, proto=17), packet(2, 15, proto=17)], **path)) == 2
    steady = [packet(i, i * 10, proto=17) for i in range(14)]
    assert [f.fwd_packets for f in built(spark, steady, **path)] == [12, 2]
    # One tracker: the packet that reaches the limit still belongs to the flow, a pause of the whole tracker splits nothing.
    assert [f.fwd_packets for f in built(spark, steady, mode="tracker", **path)] == [13, 1]
    quiet = [packet(1, 0, proto=17), packet(2, 40, proto=17)]
    assert len(built(spark, quiet, mode="tracker", **path)) == 1
    seen = [packet(1, 1, proto=17), packet(2, 20, sport=7), packet(3, 21, proto=17)]
    assert len(built(spark, seen, mode="tracker", **path)) == 3


@pytest.mark.parametrize("path", PATHS)
@pytest.mark.parametrize("mode", ["per_flow", "tracker"])
def test_one_order_where_time_and_number_disagree(spark, mode, path):
    rows = [packet(2, 1.0), reply(1, 2.0)]
    (f,) = built(spark, rows, mode=mode, **path)
    assert (f.flow_id, f.src_ip, f.duration_s, f.fwd_packets, f.bwd_packets) == (2, A, 1.0, 1, 1)


def keys_of_any_kind(rng):
    """Packets of 400 keys: gaps at both limits, closes, ties, times against numbers, rows twice, nulls, times before 1970."""
    rows = []
    for key in range(400):
        t = rng.choice([0, 7.3, 119.999999, -3e9, 86399.5]) + rng.random()
        proto, kind = rng.choice([6, 17]), rng.randrange(8)
        for _ in range(rng.randrange(1, 14)):
            t += rng.choice([0, 0.1, 1.875, 3, 9, 14.999999, 15, 15.000001]) if kind else rng.choice([0, 1, 2.5, 11.9])
            seq = len(rows) if kind != 1 else 100_000 - len(rows)
            flags = "".join(f for f in "srfa" if rng.random() < (0.1 if kind in (2, 3) else 0.3 if f in "sa" else 0))
            way = {} if rng.random() < 0.6 else dict(src=B, dst=A, dport=1000 + key)
            row = list(packet(seq, t, **({"sport": 1000 + key} | ({} if not way else {"sport": 80}) | way), proto=proto, size=rng.randrange(1500), flags=flags))
            if kind == 4 and rng.random() < 0.2:
                row[rng.choice([0, 1, 7, 8, 9, 10, 11])] = None
            rows += [tuple(row)] * (2 if kind == 5 and rng.random() < 0.3 else 1)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limits", [(15.0, 120.0), (0.000003, 120.0), (20.0, 10.0), (86400.0, 345600.0)])
def test_keys_summed_up_whole_give_the_flows_of_the_fold(spark, monkeypatch, limits):
    packets = frame(spark, keys_of_any_kind(random.Random(21)))
    expected, folded, fold = flows.build_flows(packets, *limits, group_rows=None), [], flows._fold
    monkeypatch.setattr(flows, "_fold", lambda rows, *a: folded.append(rows.select("key").distinct().count()) or fold(rows, *a))
    found = flows.build_flows(packets, *limits, group_rows=None, whole=True)
    assert found.exceptAll(expected).isEmpty() and expected.exceptAll(found).isEmpty()
    assert 0 < folded[0] < 400


def test_steady_keys_are_summed_up_whole(spark, monkeypatch):
    """Gaps below 0.8 of the idle limit and spans below 100 s are always told; no packet is folded."""
    monkeypatch.setattr(flows, "_fold", None)
    rng, rows = random.Random(22), []
    for key in range(300):
        t = rng.random() * 1e4
        for k in range(9):
            rows.append(packet(len(rows), t, sport=1000 + key, proto=rng.choice([6]), flags="a"))
            t += 11.999 if key % 2 else rng.random() * 11.9
    assert flows.build_flows(frame(spark, rows), whole=True, group_rows=None).count() == 300


def test_admission(spark):
    rows = frame(spark, [packet(1, 1), packet(2, 1, proto=1), packet(3, 1, src="::1"), packet(4, 1, proto=17)])
    assert flows.admission_counts(rows).first().asDict() == {"packets_read": 4, "admitted": 2, "ignored": 2}
    assert flows.feature_columns(flows.build_flows(rows)).columns == [
        "flow_id", "duration_s", "protocol", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes"]


def demo_capture():
    rows = []
    for i in range(14):
        client = f"100.64.7.{i + 1}"
        for f in range(2):
            there = dict(src=client, dst="93.184.216.34", sport=40000 + 11 * i + f, dport=80)
            back = dict(src="93.184.216.34", dst=client, sport=80, dport=40000 + 11 * i + f)
            for step, (way, flags, size) in enumerate([
                    (there, "s", 0), (back, "sa", 0), (there, "a", 0), (there, "a", 90), (back, "a", 300),
                    (there, "a", 0), (there, "fa", 0), (back, "fa", 0)]):
                rows.append((i * 0.05 + f * 0.01 + step * 0.001, way, flags, size))
        if i % 3 == 0:
            for n, port in enumerate((22, 3389, 445, 8080)):
                there = dict(src=client, dst="93.184.216.34", sport=50000 + 10 * i + n, dport=port)
                back = dict(src="93.184.216.34", dst=client, sport=port, dport=50000 + 10 * i + n)
                rows += [(i * 0.05 + 0.03 + n * 0.001, there, "s", 0), (i * 0.05 + 0.0305 + n * 0.001, back, "ra", 0)]
    rows.sort(key=lambda r: r[0])
    return [packet(n, t, size=size, flags=flags, **way) for n, (t, way, flags, size) in enumerate(rows)]


@pytest.mark.parametrize("mode", ["per_flow", "tracker"])
def test_demo_capture(spark, mode):
    rows = demo_capture()
    out = built(spark, rows, mode=mode)
    shapes = [(f.fwd_packets, f.bwd_packets) for f in out]
    assert (len(rows), len(out), shapes.count((5, 3)), shapes.count((1, 1))) == (264, 48, 28, 20)
    assert all(f.src_ip != "93.184.216.34" for f in out)


def simulate(rows, idle, active, tracker=False):
    """Plain walk over the packets in order of arrival."""
    open_, done, clock = {}, [], None
    for seq, ts, src, dst, sport, dport, proto, size, syn, rst, fin, ack in rows:
        t = round((ts - T0).total_seconds() * 1e6)
        key = (*sorted([(src, sport), (dst, dport)]), proto)
        f = open_.get(key)
        now = (clock if clock is not None else t) if tracker else t
        if f and (now - f["last"] >= idle or now - f["first"] >= active):
            done.append(open_.pop(key))
            f = None
        if not f:
            f = open_[key] = dict(id=seq, who=(src, sport), first=t, last=t, fp=0, bp=0, ff=False, bf=False)
        fwd = (src, sport) == f["who"]
        f["fp" if fwd else "bp"] += 1
        f["last"] = max(f["last"], t)
        if fin:
            f["ff" if fwd else "bf"] = True
        if proto == 6 and (rst or (f["ff"] and f["bf"])):
            done.append(open_.pop(key))
        clock = t
    done += open_.values()
    return sorted((f["id"], f["fp"], f["bp"], f["last"] - f["first"]) for f in done)


@pytest.mark.parametrize("mode", ["per_flow", "tracker"])
@pytest.mark.parametrize("path", [{}, {"group_rows": 40}, {"group_rows": 0, "slice_s": 3.0}])
def test_against_simulation(spark, mode, path):
    rng, rows, t = random.Random(5), [], 0.0
    for seq in range(600):
        t += rng.choice([0, 0.5, 1, 2, 5, 7, 14.999999, 15, 20]) * (1 if rng.random() < 0.25 else 0.2)
        t = round(t, 6)
        hot = rng.random() < 0.5
        port, proto = (1, 6) if hot else (rng.randint(2, 6), rng.choice([6, 17]))
        flags = rng.choice(["", "", "", "a", "s", "f", "f" if not hot else "", "r" if rng.random() < 0.15 else ""])
        way = dict(sport=port, dport=80) if rng.random() < 0.6 else dict(src=B, dst=A, sport=80, dport=port)
        rows.append(packet(seq, t, proto=proto, flags=flags, **way))
    expected = simulate(rows, 15_000_000, 120_000_000, mode == "tracker")
    shuffled = rows[:]
    rng.shuffle(shuffled)
    out = built(spark, shuffled, mode=mode, **path)
    assert sorted((f.flow_id, f.fwd_packets, f.bwd_packets, round(f.duration_s * 1e6)) for f in out) == expected


def simulate_arrival(rows, idle, active, tracker=False):
    """Plain walk in order of arrival; clocks are the latest time seen by the key, or by the tracker before."""
    open_, tops, done, clock = {}, {}, [], None
    for seq, ts, src, dst, sport, dport, proto, size, syn, rst, fin, ack in sorted(rows):
        t = round((ts - T0).total_seconds() * 1e6)
        key = (*sorted([(src, sport), (dst, dport)]), proto)
        f, before = open_.get(key), tops.get(key)
        tops[key] = max(t, t if before is None else before)
        now = clock if tracker else tops[key]
        if f and (now - before >= idle or now - f["opened"] >= active):
            done.append(open_.pop(key))
            f = None
        if not f:
            f = open_[key] = dict(id=seq, who=(src, sport), first=t, opened=tops[key], last=t, fp=0, bp=0, ff=False, bf=False)
        fwd = (src, sport) == f["who"]
        f["fp" if fwd else "bp"] += 1
        f["last"] = max(f["last"], t)
        if fin:
            f["ff" if fwd else "bf"] = True
        if proto == 6 and (rst or (f["ff"] and f["bf"])):
            done.append(open_.pop(key))
        clock = max(t, t if clock is None else clock)
    done += open_.values()
    return sorted((f["id"], f["fp"], f["bp"], f["first"], f["last"]) for f in done)


def late_packets(seed=8, n=600):
    """Arrivals whose times go back: by little, by more than the idle limit, by more than the active one."""
    rng, rows, t = random.Random(seed), [], 500.0
    for seq in range(n):
        t = round(t + rng.choice([0, 0.5, 1, 2, 5, 7, 14.999999, 15, 20]) * (1 if rng.random() < 0.25 else 0.2), 6)
        back = rng.choice([0, 0, 0, 0, 0.3, 3, 14, 16, 40, 119, 130, 300])
        hot = rng.random() < 0.5
        port, proto = (1, 6) if hot else (rng.randint(2, 6), rng.choice([6, 17]))
        flags = rng.choice(["", "", "", "a", "s", "f", "f" if not hot else "", "r" if rng.random() < 0.15 else ""])
        way = dict(sport=port, dport=80) if rng.random() < 0.6 else dict(src=B, dst=A, sport=80, dport=port)
        rows.append(packet(seq, round(t - back, 6), proto=proto, flags=flags, **way))
    return rows


@pytest.mark.parametrize("mode", ["per_flow", "tracker"])
@pytest.mark.parametrize("path", [{}, {"group_rows": 40}, {"group_rows": 0, "slice_s": 3.0}])
def test_arrival_order_against_simulation(spark, monkeypatch, mode, path):
    monkeypatch.setattr(flows, "SLICE_ROWS", 50)
    rows = late_packets()
    expected = simulate_arrival(rows, 15_000_000, 120_000_000, mode == "tracker")
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    us = lambda x: round((x.replace(tzinfo=timezone.utc) - T0).total_seconds() * 1e6)
    out = built(spark, shuffled, mode=mode, order="arrival", **path)
    assert sorted((f.flow_id, f.fwd_packets, f.bwd_packets, us(f.first_ts), us(f.last_ts)) for f in out) == expected
    assert all(f.duration_s >= 0 for f in out)


@pytest.mark.parametrize("path", PATHS)
def test_late_packet_never_moves_the_start(spark, path):
    rows = [packet(1, 10.0), reply(2, 7.0), packet(3, 24.9), packet(4, 40.0)]
    first, second = built(spark, rows, order="arrival", **path)
    assert (first.flow_id, first.src_ip, first.fwd_packets, first.bwd_packets) == (1, A, 2, 1)
    assert first.duration_s == pytest.approx(14.9) and second.flow_id == 4
    # By time the reply comes first and owns the flow.
    by_time = built(spark, rows, **path)[0]
    assert (by_time.flow_id, by_time.src_ip) == (2, B)


def test_arrival_order_equals_time_order_where_they_agree(spark):
    rows = demo_capture()
    for mode in ("per_flow", "tracker"):
        assert built(spark, rows, mode=mode, order="arrival") == built(spark, rows, mode=mode)
    with pytest.raises(ValueError):
        flows.build_flows(frame(spark, rows), order="size")


def throttled(rows, gap):
    last, kept = {}, []
    for key, us, seq in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in last or us - last[key] >= gap:
            last[key] = us
            kept.append((key, seq))
    return sorted(kept, key=str)


@pytest.mark.parametrize("limit", [50_000, 0, 50])
def test_throttle_against_simulation(spark, limit):
    rng, us = random.Random(3), 0
    rows = []
    for seq in range(500):
        us += rng.choice([0, 1, 10, 90, 100, 250])
        rows.append((rng.choice([None, "a", "b", "b", "b", "b"]), us, seq))
    df = spark.createDataFrame(rows, "k string, us long, seq long").select(F.struct("k").alias("key"), "us", "seq")
    out = [(r.key.k, r.seq) for r in chain.fires(df, 100, limit).collect()]
    assert sorted(out, key=str) == throttled(rows, 100)


def test_expansion_round_trip(spark):
    one = spark.createDataFrame(
        [(7, A, B, 1000, 80, 6, 3.0, 2, 2, 150, 70)],
        "flow_id long, src_ip string, dst_ip string, src_port int, dst_port int, proto int, duration_s double, "
        "fwd_packets long, bwd_packets long, fwd_bytes long, bwd_bytes long")
    packets = flows.expand_to_packets(one).withColumn("seq", F.col("nth"))
    (f,) = flows.build_flows(packets).collect()
    assert (f.src_ip, f.fwd_packets, f.bwd_packets, f.fwd_bytes, f.bwd_bytes, f.duration_s) == (A, 2, 2, 150, 70, 3.0)
