"""Streams of packets: wall-clock expiry, several loads, restarts, late rows."""
import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from packetloom import schema
from packetloom.operators import flows as batch
from packetloom.plans import views
from packetloom.sources import readers
from packetloom.streaming import detect
from packetloom.streaming import flows as stream

START = dt.datetime(2024, 3, 1, 12)


def packet(seq, second, port=1000, proto=17, size=10, fin=False, back=False):
    ends = [("1.2.3.4", port), ("5.6.7.8", 53)]
    (src, sport), (dst, dport) = reversed(ends) if back else ends
    return (seq, START + dt.timedelta(seconds=second), src, dst, sport, dport, proto, size, False, False, fin, False)


COLUMNS = ("seq long, ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, proto int, payload_len int, "
           "syn boolean, rst boolean, fin boolean, ack boolean")


def table(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def arrive(spark, rows, folder):
    table(spark, rows).coalesce(1).write.mode("append").parquet(folder)


def rows_of(flow_rows):
    return sorted(tuple(r) for r in flow_rows.select(batch.FLOW_COLUMNS).collect())


def wait_for(condition, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        if condition():
            return True
        time.sleep(0.5)
    return False


def written(spark, sink):
    import os
    found = [f for f in os.listdir(sink) if f.endswith(".parquet")] if os.path.isdir(sink) else []
    return spark.read.schema(stream.OUTPUT).parquet(*[f"{sink}/{f}" for f in found]).collect() if found else []


def test_a_quiet_stream_gives_its_flows_without_a_further_packet(spark, tmp_path):
    """The last packet of a key is followed by none; its flow comes all the same, once, and leaves no state."""
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    first = [packet(1, 0), packet(2, 1, back=True, size=7), packet(3, 0, port=2000)]
    arrive(spark, first, source)
    run = stream.watch(readers.packet_stream(spark, source), sink, state, idle_s=3, active_s=600, every="500 milliseconds")
    try:
        assert wait_for(lambda: len(written(spark, sink)) >= 2)
        # a packet of the same key later on opens a flow of its own
        arrive(spark, [packet(4, 2)], source)
        assert wait_for(lambda: len(written(spark, sink)) >= 3)
        time.sleep(4)
    finally:
        run.stop()
    found = written(spark, sink)
    assert sorted((r["flow_id"], r["fp"], r["bp"], r["fb"], r["bb"]) for r in found) == [(1, 1, 1, 10, 7), (3, 1, 0, 10, 0), (4, 1, 0, 10, 0)]
    assert rows_of(stream.shape(spark.createDataFrame([r for r in found if r["flow_id"] != 4], stream.OUTPUT))) == rows_of(batch.build_flows(table(spark, first), 3, 600))
    assert stream.still_open(spark, state).isEmpty()


def test_live_limits_count_from_arrival(spark, tmp_path):
    """Packets that keep arriving hold a flow open until its active limit; a teardown ends it at once.

    The first batch of a cold session took 10 s here, so the limit is longer than that.
    """
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    arrive(spark, [packet(1, 0), packet(2, 0, port=3000, proto=6, fin=True), packet(3, 0, port=3000, proto=6, fin=True, back=True)], source)
    run = stream.watch(readers.packet_stream(spark, source), sink, state, idle_s=60, active_s=20, every="500 milliseconds")
    try:
        assert wait_for(lambda: any(r["flow_id"] == 2 and r["bp"] == 1 for r in written(spark, sink)))
        arrive(spark, [packet(4, 1)], source)
        assert wait_for(lambda: any(r["flow_id"] == 1 and r["fp"] == 2 for r in written(spark, sink)))
    finally:
        run.stop()
    assert len(written(spark, sink)) == 2


@pytest.mark.parametrize("loads", [1, 4])
def test_flows_over_several_loads_equal_the_batch(spark, sf, tmp_path, loads):
    """The stream is started anew for each load and goes on from its state."""
    packets = views.packets(spark, sf)
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    marks = packets.agg(F.percentile_approx(F.unix_micros("ts"), F.array(*[F.lit(k / loads) for k in range(loads + 1)]))).first()[0]
    for k in range(loads):
        us = F.unix_micros("ts")
        part = packets.filter((us >= marks[k]) & ((us < marks[k + 1]) if k + 1 < loads else F.lit(True)))
        part.coalesce(2).write.mode("append").parquet(source)
        stream.advance(readers.packet_stream(spark, source), sink, state, views.IDLE_S, views.ACTIVE_S, "1 day")
    found = stream.flushed(spark, sink, state)
    assert rows_of(found) == rows_of(batch.build_flows(packets, views.IDLE_S, views.ACTIVE_S))


def test_late_rows_are_counted(spark, tmp_path):
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    counts = []
    for rows in ([packet(1, 0), packet(2, 500, port=2000)], [packet(3, 100), packet(4, 600, port=2000)], [packet(5, 700, port=2000)]):
        arrive(spark, rows, source)
        run = stream.advance(readers.packet_stream(spark, source), sink, state, 15, 120, "10 seconds")
        counts.append(detect.late_packets(run.recentProgress))
    assert sum(counts) == 1
    found = rows_of(stream.flushed(spark, sink, state))
    assert [r[0] for r in found] == [1, 2, 4, 5]


def test_state_is_read_and_written_by_groups_of_keys(spark, tmp_path):
    """A state call costs more than many packets: there are no more of them than groups, however many keys are open."""
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    arrive(spark, [packet(k, 0, port=k) for k in range(1, 5001)], source)
    stream.advance(readers.packet_stream(spark, source), sink, state, 15, 120, "10 seconds")
    assert spark.read.format("statestore").option("path", state).option("stateVarName", "flow").load().count() <= stream.BUCKETS
    assert sorted(r["flow_id"] for r in stream.still_open(spark, state).collect()) == list(range(1, 5001))


@pytest.mark.parametrize("order", ["time", "arrival"])
def test_a_group_ends_the_flow_whose_limit_is_first(spark, tmp_path, monkeypatch, order):
    """Keys of one group share a timer: it follows the earliest limit, also that of a late packet."""
    monkeypatch.setattr(stream, "BUCKETS", 1)
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    loads = [packet(1, 50), packet(2, 90, port=2000)], [packet(3, 35, port=3000), packet(4, 95, port=2000)], [packet(5, 103, port=2000)]
    ended = []
    for rows in loads:
        arrive(spark, rows, source)
        stream.advance(readers.packet_stream(spark, source), sink, state, 30, 600, "60 seconds", order)
        ended.append(sorted(r["flow_id"] for r in written(spark, sink)))
    # The watermark is a minute behind: 43 s at the end. No limit is passed; at 68 s that of the late packet (65 s) is.
    assert ended == [[], [], []]
    arrive(spark, [packet(6, 128, port=4000)], source)
    stream.advance(readers.packet_stream(spark, source), sink, state, 30, 600, "60 seconds", order)
    assert sorted(r["flow_id"] for r in written(spark, sink)) == [3]
    assert sorted(r["flow_id"] for r in stream.still_open(spark, state).collect()) == [1, 2, 6]
    everything = table(spark, [r for rows in loads for r in rows] + [packet(6, 128, port=4000)])
    assert rows_of(stream.flushed(spark, sink, state)) == rows_of(batch.build_flows(everything, 30, 600, order=order))


def test_packet_stream_has_the_packet_shape(spark, tmp_path):
    arrive(spark, [packet(1, 0)], str(tmp_path / "in"))
    assert readers.packet_stream(spark, str(tmp_path / "in")).schema == spark.createDataFrame([], schema.PACKET).schema


def test_captures_are_taken_in_once_and_keep_their_numbers(spark, tmp_path):
    """Files in two loads with a restart; a batch that is run again changes nothing."""
    from packetloom.sources import captures as source
    from packetloom.streaming import captures
    from tests.test_capture_ranges import long_pcap
    folder = tmp_path / "files"
    folder.mkdir()
    places = [str(tmp_path / x) for x in ("packets", "numbers", "state")]
    seen = {}
    captures.ingest(spark, str(folder), *places)
    assert captures.arrived(spark, places[0]).isStreaming  # nothing has come yet
    for load, names in enumerate((["b.pcap", "a.pcap", "none.txt"], ["0.pcap"])):
        for k, name in enumerate(names):
            (folder / name).write_bytes(b"no capture" if name == "none.txt" else long_pcap("<", 60, seed=7 * load + k))
        captures.ingest(spark, str(folder), *places, split_bytes=900, files_per_batch=2)
        numbers = {r["path"].rsplit("/", 1)[-1]: r["number"] for r in captures.file_numbers(spark, places[1]).collect()}
        assert sorted(numbers.values()) == list(range(1, len(numbers) + 1))
        assert {n: numbers[n] for n in seen} == seen
        seen = numbers
    assert len(seen) == 4 and seen["0.pcap"] == 4
    known = captures.file_numbers(spark, places[1])
    expected = source.packet_rows(source.capture_packets(spark, str(folder), known=known)).select(captures.PACKET_COLUMNS)
    packets = lambda: spark.read.schema(schema.PACKET).option("recursiveFileLookup", True).parquet(places[0])
    rows = sorted(tuple(r) for r in packets().collect())
    assert rows == sorted(tuple(r) for r in expected.collect()) and rows
    files = sorted(packets().inputFiles())
    # The driver is lost after the last batch's packets were written, before it was noted as done.
    commits = tmp_path / "state" / "commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (commits / name).unlink()
    captures.ingest(spark, str(folder), *places, split_bytes=900, files_per_batch=2)
    assert sorted(packets().inputFiles()) == files


def test_many_small_captures_are_one_batch(spark, tmp_path):
    """Batches are bounded by bytes: their number does not grow with that of small files."""
    from packetloom.streaming import captures
    from tests.test_capture_ranges import long_pcap
    folder = tmp_path / "files"
    folder.mkdir()
    for k in range(70):
        (folder / f"{k}.pcap").write_bytes(long_pcap("<", 2, seed=k))
    places = [str(tmp_path / x) for x in ("packets", "numbers", "state")]
    captures.ingest(spark, str(folder), *places)
    assert [p.name for p in (tmp_path / "packets").iterdir()] == ["batch=0"]
    assert captures.file_numbers(spark, places[1]).count() == 70


def test_capture_loads_follow_time_where_numbers_do_not(spark, sf, tmp_path):
    """Later numbers with the same times again: no packet of theirs is late."""
    from packetloom.plans import queries_streams as q
    events = spark.read.parquet(f"{sf}/events.parquet")
    again = events.withColumns({"event_id": F.col("event_id") + 1_000_000, "user_id": F.col("user_id") + 1_000_000})
    events.unionByName(again).write.parquet(f"{tmp_path}/events.parquet")
    packets = views.packets(spark, str(tmp_path)).filter("payload_len % 9 <> 0").withColumns(
        {c: (F.col("proto") == 6) & F.col(c) for c in ("syn", "rst", "fin", "ack")})
    whole = batch.build_flows(packets, views.IDLE_S, views.ACTIVE_S).count()
    assert q.stream_captures(spark, str(tmp_path)).count() == whole
