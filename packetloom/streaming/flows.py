"""Flows from a packet stream: keyed state with timers, by event time or by the wall clock."""
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import fixed
from ..functions import net
from ..operators import flows
from .counters import counted

# An open flow; also the shape of an emitted one.
STATE = ("flow_id long, lo_first boolean, first_us long, last_us long, fp long, bp long, fb long, bb long, "
         "syn long, rst long, fin long, ack long, ff boolean, bf boolean")
FIELDS = [f.split(" ")[0] for f in STATE.split(", ")]
KEY = "lo_ip string, lo_port int, hi_ip string, hi_port int, proto int"
KEY_FIELDS = [f.split(" ")[0] for f in KEY.split(", ")]
OUTPUT = f"{KEY}, {STATE}"
# Groups of flow keys. A state call costs far more than a packet, so a group's flows are read and written by one call.
# Part of a checkpoint's meaning: a stream must go on with the number that it began with.
BUCKETS = 2048
# What a group keeps of a key: its flow (nulls where only the clock is kept), its clock, the wall-clock times of arrival.
HELD = f"flow_key string, {STATE}, top long, opened long, first_ms long, last_ms long"
GROUP = "held array<struct<" + HELD.replace(" ", ":").replace(",:", ",") + ">>, timer long"
FLOW, TOP, OPENED, FIRST_MS, LAST_MS = range(5)
NO_FLOW = (None,) * len(FIELDS)
# Bits of a packet's marks.
FROM_LO, SYN, RST, FIN, ACK, TCP = (1 << i for i in range(6))


def keyed_stream(packets: DataFrame, delay: str | None = "10 seconds") -> DataFrame:
    """Admitted packets with the key as text, its group, the flags as bits and, with a delay, a watermark."""
    rows = flows.admit(packets).withColumn("key", net.flow_key())
    lo = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port")) == F.col("key.lo")
    flags = {FROM_LO: lo, SYN: F.col("syn"), RST: F.col("rst"), FIN: F.col("fin"), ACK: F.col("ack"), TCP: F.col("proto") == 6}
    rows = rows.select(
        F.concat_ws("|", "key.lo.ip", F.col("key.lo.port").cast("string"), "key.hi.ip", F.col("key.hi.port").cast("string"),
                    F.col("proto").cast("string")).alias("flow_key"),
        "ts", F.unix_micros("ts").alias("us"), "seq", F.coalesce("payload_len", F.lit(0)).alias("payload_len"),
        sum((F.when(c, bit).otherwise(0) for bit, c in flags.items()), F.lit(0)).alias("marks"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("flow_key"), F.lit(BUCKETS)).cast("int"))
    return rows.withWatermark("ts", delay) if delay else rows.drop("ts")


def _ends(rows: DataFrame) -> DataFrame:
    """The key's text taken apart into KEY_FIELDS."""
    part = F.split("flow_key", r"\|")
    kinds = [f.split(" ")[1] for f in KEY.split(", ")]
    return rows.select(*[part[i].cast(kind).alias(name) for i, (name, kind) in enumerate(zip(KEY_FIELDS, kinds))], *FIELDS)


class FlowBuilder(StatefulProcessor):
    """One open flow per key. Passing the earlier of idle and active limit closes it.

    Keys come in groups; a group has at most one timer, never later than the first limit of its flows. When it fires too
    early, because packets have moved the limits since, it is set again. Packets of one batch are taken in (ts, seq) order. A
    late packet that still passes the watermark joins the open flow; it never moves first or last back. The limits are times
    of packets and the clock is the watermark, so a replay gives the flows of the batch operator; a stream without new
    packets stands still.
    """

    # Whether a key's clock outlives its flows.
    keeps_clock = False

    def __init__(self, idle_us: int, active_us: int):
        self.idle, self.active = idle_us, active_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("flow", GROUP)

    def _now_ms(self, timerValues) -> int:
        return timerValues.getCurrentWatermarkInMs()

    def _limit_ms(self, held) -> int:
        flow = held[FLOW]
        return -(-min(flow[3] + self.idle, flow[2] + self.active) // 1000)

    def _packets(self, rows) -> list:
        """By key, then in the order in which they are taken."""
        return sorted(self._tuples(rows, "us", "seq"))

    def _tuples(self, rows, *order):
        for part in rows:
            yield from zip(*[part[c].tolist() for c in ("flow_key", *order, "payload_len", "marks")])

    def _clock(self, held):
        """Latest time of the key, and what it was after the open flow's first packet."""
        return (held[FLOW][3], held[FLOW][2]) if held is not None else (None, None)

    def _forgets(self, held, now_ms: int) -> bool:
        """No flow is open: is nothing left to wait for?"""
        return True

    def _hold(self, flow, top, opened, held, timerValues):
        """What is kept of a key after a batch with packets of it; None if nothing."""
        return [flow, None, None, None, None] if flow is not None else None

    def _read(self):
        """What the group holds, by key, and when its timer fires."""
        group = self.state.get()
        if group is None:
            return {}, None
        last = 1 + len(FIELDS)
        return {h[0]: [list(h[1:last]) if h[1] is not None else None, *h[last:]] for h in group[0]}, group[1]

    def _write(self, held, timer) -> None:
        at = min(map(self._limit_ms, held.values()), default=None)
        if timer is not None and (at is None or at < timer):
            self.handle.deleteTimer(timer)
            timer = None
        if at is None:
            self.state.clear()
            return
        if timer is None:
            self.handle.registerTimer(at)
            timer = at
        self.state.update(([(key, *(h[FLOW] or NO_FLOW), *h[TOP:]) for key, h in held.items()], timer))

    def handleInputRows(self, key, rows, timerValues):
        held, timer = self._read()
        done = []
        for flow_key, packets in groupby(self._packets(rows), itemgetter(0)):
            kept = self._taken(flow_key, packets, held.get(flow_key), done, timerValues)
            if kept is not None:
                held[flow_key] = kept
            else:
                held.pop(flow_key, None)
        self._write(held, timer)
        return self._rows(done)

    def _taken(self, flow_key, packets, held, done, timerValues):
        """Take the packets of a key; flows that end go to `done`. Gives what is kept of the key."""
        flow = held[FLOW] if held is not None else None
        top, opened = self._clock(held)
        for _, us, seq, size, marks in packets:
            now = us if top is None else max(top, us)
            if flow is not None and (now - top >= self.idle or now - opened >= self.active):
                done.append((flow_key, flow))
                flow = None
            top = now
            lo = bool(marks & FROM_LO)
            if flow is None:
                flow, opened = [seq, lo, us, us, 0, 0, 0, 0, 0, 0, 0, 0, False, False], now
            forward, fin = lo == flow[1], bool(marks & FIN)
            flow[4 if forward else 5] += 1
            flow[6 if forward else 7] += size
            flow[8] += bool(marks & SYN)
            flow[9] += bool(marks & RST)
            flow[10] += fin
            flow[11] += bool(marks & ACK)
            flow[12] = flow[12] or (fin and forward)
            flow[13] = flow[13] or (fin and not forward)
            flow[3] = max(flow[3], us)
            if marks & TCP and (flow[9] > 0 or (flow[12] and flow[13])):
                done.append((flow_key, flow))
                flow = None
                top = top if self.keeps_clock else None
        return self._hold(flow, top, opened, held, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held, _ = self._read()
        now, done = self._now_ms(timerValues), []
        for flow_key, h in list(held.items()):
            if h[FLOW] is not None and now >= self._limit_ms(h):
                done.append((flow_key, h[FLOW]))
                h[FLOW] = None
            if h[FLOW] is None and self._forgets(h, now):
                del held[flow_key]
        self._write(held, None)
        return self._rows(done)

    def close(self) -> None:
        pass

    def _rows(self, done):
        return iter([pd.DataFrame([(key, *flow) for key, flow in done], columns=["flow_key", *FIELDS])] if done else [])


class ArrivalFlowBuilder(FlowBuilder):
    """Packets of one batch are taken by seq, and the limits count from a clock that never goes back, as in the batch
    operator's order 'arrival'. The clock of a key is kept after its flows, until no admitted packet can be earlier."""

    keeps_clock = True

    def _packets(self, rows) -> list:
        by_number = sorted(self._tuples(rows, "seq", "us"))
        return [(flow_key, us, seq, size, marks) for flow_key, seq, us, size, marks in by_number]

    def _clock(self, held):
        return (held[TOP], held[OPENED]) if held is not None else (None, None)

    def _hold(self, flow, top, opened, held, timerValues):
        return [flow, top, opened, None, None]

    def _limit_ms(self, held) -> int:
        top, opened = held[TOP], held[OPENED]
        return -(-(top if held[FLOW] is None else min(top + self.idle, opened + self.active)) // 1000)

    def _forgets(self, held, now_ms: int) -> bool:
        return now_ms >= self._limit_ms(held)


class LiveFlowBuilder(FlowBuilder):
    """The same flows, expired by the wall clock: idle after the last arrival or active after the first one.

    Packets still end flows by their own times. The timers count from arrival, so a stream that goes quiet gives its last
    flows without a further packet, and no packet is late. A restarted stream counts on from the stored arrivals.
    """

    def _now_ms(self, timerValues) -> int:
        return timerValues.getCurrentProcessingTimeInMs()

    def _limit_ms(self, held) -> int:
        return min(held[LAST_MS] + -(-self.idle // 1000), held[FIRST_MS] + -(-self.active // 1000))

    def _taken(self, flow_key, packets, held, done, timerValues):
        # The flow's list goes on through the batch: its number is noted before.
        self._number = held[FLOW][0] if held is not None else None
        return super()._taken(flow_key, packets, held, done, timerValues)

    def _hold(self, flow, top, opened, held, timerValues):
        if flow is None:
            return None
        now = self._now_ms(timerValues)
        return [flow, None, None, held[FIRST_MS] if flow[0] == self._number else now, now]


def completed(packets: DataFrame, idle_s: float = fixed.IDLE_S, active_s: float = fixed.ACTIVE_S,
              delay: str = "10 seconds", live: bool = False, order: str = "time") -> DataFrame:
    """Stream of flat flow rows, each when it closes or expires: by the times of packets, or by the wall clock (live).

    order 'arrival' takes packets by seq, as the batch operator does; micro-batches must follow seq.
    """
    if order not in ("time", "arrival") or (live and order != "time"):
        raise ValueError(f"no {'live ' if live else ''}stream in order {order!r}")
    limits = int(idle_s * 1e6), int(active_s * 1e6)
    rows = keyed_stream(packets, None if live else delay).groupBy("bucket")
    builder = (LiveFlowBuilder if live else ArrivalFlowBuilder if order == "arrival" else FlowBuilder)(*limits)
    return _ends(rows.transformWithStateInPandas(builder, f"flow_key string, {STATE}", outputMode="Append",
                                                 timeMode="ProcessingTime" if live else "EventTime"))


def shape(rows: DataFrame) -> DataFrame:
    """Flat flow rows in the columns of the batch operator."""
    end = lambda a: F.struct(F.col(f"{a}_ip").alias("ip"), F.col(f"{a}_port").alias("port"))
    keyed = rows.withColumn("key", F.struct(end("lo").alias("lo"), end("hi").alias("hi"), "proto"))
    return flows.shape(keyed)


def still_open(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Flows that were open when a stream ended, read from its state."""
    state = (spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "flow").load())
    return _ends(state.select(F.inline("value.held")).filter("flow_id is not null"))


def _writer(stream: DataFrame, sink: str, checkpoint: str):
    return counted(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append")


def advance(packets: DataFrame, sink: str, checkpoint: str, idle_s: float = fixed.IDLE_S,
            active_s: float = fixed.ACTIVE_S, delay: str = "10 seconds", order: str = "time"):
    """Run a stream over what has arrived since it last ran, append the flows that ended, and return the ended query."""
    run = _writer(completed(packets, idle_s, active_s, delay, order=order), sink, checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return run


def flushed(spark: SparkSession, sink: str, checkpoint: str) -> DataFrame:
    """All flows of a stream that has ended: those it wrote and those it held, as a batch would give them."""
    closed = spark.read.schema(OUTPUT).parquet(sink)
    return shape(closed.unionByName(still_open(spark, checkpoint).select(*KEY_FIELDS, *FIELDS)))


def replay(packets: DataFrame, sink: str, checkpoint: str, idle_s: float = fixed.IDLE_S,
           active_s: float = fixed.ACTIVE_S, delay: str = "10 seconds") -> DataFrame:
    """Run a finite stream to its end and flush."""
    advance(packets, sink, checkpoint, idle_s, active_s, delay)
    return flushed(packets.sparkSession, sink, checkpoint)


def watch(packets: DataFrame, sink: str, checkpoint: str, idle_s: float = fixed.IDLE_S, active_s: float = fixed.ACTIVE_S,
          every: str = "1 second"):
    """Start a live stream: flows that end or fall silent are appended `every` now and then, until it is stopped."""
    return _writer(completed(packets, idle_s, active_s, live=True), sink, checkpoint).trigger(processingTime=every).start()
