"""Packets to bidirectional flows."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import net, numeric
from ..session import cut
from . import chain
from .joins import bounded

FLOW_COLUMNS = [
    "flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "first_ts", "last_ts",
    "duration_s", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes",
    "syn_count", "rst_count", "fin_count", "ack_count",
]

SLICE_ROWS = 65_536


def admit(packets: DataFrame) -> DataFrame:
    """IPv4 TCP and UDP packets only."""
    return packets.filter(net.admitted())


def admission_counts(packets: DataFrame) -> DataFrame:
    """Packets read, admitted and ignored."""
    return packets.agg(F.count("*").alias("packets_read"),
                       F.count_if(net.admitted()).alias("admitted"),
                       F.count_if(~net.admitted()).alias("ignored"))


def _by_number() -> Column:
    """Slices of at most SLICE_ROWS packets of any key, in the order of arrival."""
    return F.floor(F.col("seq") / F.lit(SLICE_ROWS)).cast("long")


def keyed(packets: DataFrame, mode: str = "per_flow", tracker: str | None = None, order: str = "time") -> DataFrame:
    """Packets with key, us, clock, from_lo and the close marks.

    mode 'per_flow': each flow's own packets drive its clock. mode 'tracker': the
    packet before on the same tracker does, as when one tracker sees a whole capture;
    `tracker` names the column that holds the capture. order 'arrival': a tracker's clock
    is the latest time among all packets that arrived (by seq) before.
    """
    if order not in ("time", "arrival"):
        raise ValueError(f"unknown order {order!r}")
    us = numeric.micros(F.col("ts"))
    key = net.flow_key()
    rows = packets.withColumns({"us": us, "key": key})
    rows = rows.withColumn(
        "from_lo", F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port")) == F.col("key.lo"))
    if mode == "per_flow":
        return rows.withColumn("clock", F.col("us"))
    if mode != "tracker":
        raise ValueError(f"unknown mode {mode!r}")
    own = F.col(tracker) if tracker else F.lit("capture")
    flow = F.col("key")
    rows = rows.withColumns({"flow_key": flow, "key": F.struct(own.alias("tracker")),
                             "slice": _by_number() if order == "arrival" else F.floor(us / F.lit(60_000_000)).cast("long")})
    if order == "arrival":
        rows = chain.running_max(rows, "clock", F.col("us"), own=False, order=("seq",))
    else:
        rows = chain.carry(rows, {"clock": (F.col("us"), False)})
    return (rows.withColumn("key", F.struct(F.col("flow_key.lo").alias("lo"), F.col("flow_key.hi").alias("hi"),
                                     F.col("flow_key.proto").alias("proto"),
                                     F.col("key.tracker").alias("tracker")))
            .withColumn("clock", F.coalesce("clock", "us")).drop("flow_key", "slice"))


def build_flows(packets: DataFrame, idle_s: float = fixed.IDLE_S, active_s: float = fixed.ACTIVE_S,
                mode: str = "per_flow", tracker: str | None = None,
                group_rows: int | None = chain.GROUP_ROWS, slice_s: float | None = None,
                order: str = "time", whole: bool = False) -> DataFrame:
    """One row per flow, in FLOW_COLUMNS. flow_id is the seq of the first packet.

    order 'time': packets are taken by (ts, seq). order 'arrival': by seq, as a tracker
    meets them. A key's clock is then the latest time of its packets so far, so it never
    goes back; a flow's limits count from the clock at its first packet. A late packet
    joins the open flow; first_ts is the time of the packet that came first, also where
    a later one is stamped earlier, and duration_s is never below 0.

    Keys of up to `group_rows` packets are folded in one pass after one shuffle;
    larger keys go through the distributed chain. Both give the same flows. None: no key
    is so large, as the caller knows, and keys are not counted.

    whole: most keys hold one flow, as the caller knows, and packets of a key lie together. Keys that are surely one flow are
    then summed up before the shuffle, and only the packets of the others are dealt out and sorted. The flows are the same.
    """
    if whole and (mode != "per_flow" or order != "time"):
        raise ValueError("keys are summed up only by their own packets in the order of time")
    idle, active = int(round(idle_s * 1e6)), int(round(active_s * 1e6))
    rows = keyed(admit(packets), mode, tracker, order).select(
        "key", "us", "seq", "clock", "from_lo", "payload_len", "syn", "rst", "fin", "ack")
    if mode == "tracker" and group_rows is not None:
        rows = cut(rows)  # the tracker's clock is found once, not for each of the readers below
    if whole:
        sums = cut(_sums(rows, idle, active))
        one = sums.filter("sure").drop("sure")
        others = sums.filter("not sure").select("key")
        if others.isEmpty():
            return shape(one)
        return shape(one.unionByName(_split(rows.join(bounded(others), "key", "left_semi"), idle, active, mode, group_rows, slice_s, order)))
    return shape(_split(rows, idle, active, mode, group_rows, slice_s, order))


def _split(rows: DataFrame, idle: int, active: int, mode: str, group_rows: int | None, slice_s: float | None, order: str) -> DataFrame:
    """Flows of keyed packets: the fold, or the chain for larger keys."""
    heavy = None if group_rows is None else chain.hot_keys(rows, group_rows)
    if heavy is None:
        return _fold(rows, idle, active, order)
    heavy = bounded(heavy, made=True)
    cold = _fold(rows.join(heavy, "key", "left_anti"), idle, active, order)
    hot = rows.join(heavy, "key", "left_semi").withColumn("at", F.col("us"))
    if order == "arrival":
        hot = chain.running_max(hot.withColumn("slice", _by_number()), "us", F.col("at"), order=("seq",)).drop("slice")
        hot = hot.withColumn("clock", F.greatest("clock", "us")) if mode == "per_flow" else hot
    hot = _chained(hot, idle, active, int(slice_s * 1e6) if slice_s else None)
    return cold.unionByName(hot)


def _sums(rows: DataFrame, idle: int, active: int) -> DataFrame:
    """A row per key: the flow that it is if `sure`, which says that no packet of the key can begin another one.

    All are numbers of 64 bits, so packets are combined before the shuffle, in a hash map that never sorts. Time is marked in
    places of an eighth of the idle limit, modulo 64: if no seven places in a row are empty, no gap reaches the limit. The first
    packet is the one of least time and least seq; where these are two packets or on both sides, or a value is null, the key
    is not sure.
    """
    lo, us, size = F.col("from_lo"), F.col("us"), F.col("payload_len").cast("long")
    step = max(1, idle // 8)
    most = idle // step - 1  # places between neighbouring packets
    place = F.expr(f"(us - pmod(us, {step}L)) div {step}L")
    known = us.isNotNull() & F.col("seq").isNotNull() & lo.isNotNull() & size.isNotNull() & F.col("rst").isNotNull() & F.col("fin").isNotNull()
    both = F.try_add(us, F.col("seq"))
    sums = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(known).alias("known"), F.min("us").alias("first_us"), F.max("us").alias("last_us"),
        F.min("seq").alias("flow_id"), F.min(F.when(lo, both)).alias("lo"), F.min(F.when(~lo, both)).alias("hi"), F.count_if(lo).alias("lp"),
        F.sum(F.when(lo, size).otherwise(0)).alias("lb"), F.sum(F.when(~lo, size).otherwise(0)).alias("hb"),
        *[F.count_if(F.col(c)).alias(c) for c in ("syn", "rst", "fin", "ack")],
        F.count_if(F.col("fin") & lo).alias("lf"), F.count_if(F.col("fin") & ~lo).alias("hf"),
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))).alias("marks"))

    def shifted(name: str, x: Column, by: Column) -> Column:
        return F.call_function(name, x, by.cast("int"))

    least = F.try_add("first_us", "flow_id")
    sums = sums.withColumns({
        "base": F.expr(f"(first_us - pmod(first_us, {step}L)) div {step}L"), "top": F.expr(f"(last_us - pmod(last_us, {step}L)) div {step}L"),
        "lo_first": F.coalesce(F.col("lo") == least, F.lit(False)), "hi_first": F.coalesce(F.col("hi") == least, F.lit(False))})
    turn = F.pmod(F.col("base"), F.lit(64))
    sums = sums.withColumns({"seen": shifted("shiftrightunsigned", F.col("marks"), turn).bitwiseOR(shifted("shiftleft", F.col("marks"), 64 - turn)),
                             "width": F.col("top") - F.col("base") + 1})
    near = F.col("seen")
    for k in range(1, most):
        near = near.bitwiseOR(F.shiftleft("seen", k))
    every = shifted("shiftleft", F.lit(1).cast("long"), F.least("width", F.lit(62))) - 1
    gapless = (F.col("width") == 1) | (F.col("width") <= 62) & (near.bitwiseAND(every) == every)
    closed = (F.col("key.proto") == 6) & ((F.col("rst") > 0) | (F.col("lf") > 0) & (F.col("hf") > 0))
    sure = (F.col("n") == F.col("known")) & (F.col("lo_first") != F.col("hi_first")) & (F.col("last_us") - F.col("first_us") < active) & gapless & ~closed
    forward, others = F.col("lp"), F.col("n") - F.col("lp")
    return sums.select(
        "key", "flow_id", "lo_first", "first_us", "last_us",
        F.when(F.col("lo_first"), forward).otherwise(others).alias("fp"), F.when(F.col("lo_first"), others).otherwise(forward).alias("bp"),
        F.when(F.col("lo_first"), F.col("lb")).otherwise(F.col("hb")).alias("fb"), F.when(F.col("lo_first"), F.col("hb")).otherwise(F.col("lb")).alias("bb"),
        "syn", "rst", "fin", "ack", F.coalesce(sure, F.lit(False)).alias("sure"))


def _fold(rows: DataFrame, idle: int, active: int, order: str) -> DataFrame:
    """Flows of keys whose packets fit one array: sort, then one JVM-side fold."""
    position = ("seq", "us") if order == "arrival" else ("us", "seq")
    packet = F.struct(*position, "clock", "from_lo", "payload_len", "syn", "rst", "fin", "ack")
    gathered = rows.groupBy("key").agg(F.sort_array(F.collect_list(packet)).alias("p"))
    gathered = gathered.withColumn("tcp", F.col("key.proto") == 6)
    flow_type = ("struct<seq:long,lo_first:boolean,first:long,last:long,fp:long,bp:long,fb:long,bb:long,"
                 "syn:long,rst:long,fin:long,ack:long,ff:boolean,bf:boolean>")
    # top: latest time of the key so far; opened: what it was after the open flow's first packet.
    zero = F.struct(F.lit(None).cast(flow_type).alias("cur"), F.array().cast(f"array<{flow_type}>").alias("done"),
                    F.lit(None).cast("long").alias("top"), F.lit(None).cast("long").alias("opened"))

    def one(flag: Column) -> Column:
        return F.when(flag, 1).otherwise(0).cast("long")

    def step(acc: Column, p: Column) -> Column:
        cur = acc["cur"]
        shut = F.col("tcp") & ((cur["rst"] > 0) | (cur["ff"] & cur["bf"]))
        now = F.greatest(acc["top"], p["clock"])
        fresh = cur.isNull() | shut | (now - acc["top"] >= idle) | (now - acc["opened"] >= active)
        top = F.greatest(acc["top"], p["us"])
        forward = F.when(fresh, True).otherwise(p["from_lo"] == cur["lo_first"])
        size = p["payload_len"].cast("long")

        def grow(name: str, by: Column) -> Column:
            return (F.when(fresh, F.lit(0).cast("long")).otherwise(cur[name]) + by).alias(name)

        def mark(name: str, by: Column) -> Column:
            return (F.when(fresh, F.lit(False)).otherwise(cur[name]) | by).alias(name)

        grown = F.struct(
            F.when(fresh, p["seq"]).otherwise(cur["seq"]).alias("seq"),
            F.when(fresh, p["from_lo"]).otherwise(cur["lo_first"]).alias("lo_first"),
            F.when(fresh, p["us"]).otherwise(cur["first"]).alias("first"),
            F.when(fresh, p["us"]).otherwise(F.greatest(cur["last"], p["us"])).alias("last"),
            grow("fp", one(forward)), grow("bp", one(~forward)),
            grow("fb", F.when(forward, size).otherwise(0)), grow("bb", F.when(~forward, size).otherwise(0)),
            grow("syn", one(p["syn"])), grow("rst", one(p["rst"])),
            grow("fin", one(p["fin"])), grow("ack", one(p["ack"])),
            mark("ff", p["fin"] & forward), mark("bf", p["fin"] & ~forward))
        done = F.when(fresh & cur.isNotNull(), F.concat(acc["done"], F.array(cur))).otherwise(acc["done"])
        opened = F.when(fresh, top).otherwise(acc["opened"])
        return F.struct(grown.cast(flow_type).alias("cur"), done.alias("done"), top.alias("top"), opened.alias("opened"))

    flows = F.aggregate("p", zero, step, lambda acc: F.concat(acc["done"], F.array(acc["cur"])))
    return (gathered.select("key", F.explode(flows).alias("f"))
            .select("key", F.col("f.seq").alias("flow_id"), "f.lo_first",
                    F.col("f.first").alias("first_us"), F.col("f.last").alias("last_us"),
                    "f.fp", "f.bp", "f.fb", "f.bb", "f.syn", "f.rst", "f.fin", "f.ack"))


def _chained(rows: DataFrame, idle: int, active: int, slice_us: int | None = None) -> DataFrame:
    """Flows of heavy keys: distributed segment starts, then a partial aggregation.

    `us` orders the packets of a key and drives the limits; `at` is a packet's own time.
    """
    tcp = F.col("key.proto") == 6
    rows = rows.withColumns({
        "tag": F.struct("from_lo", "at"), "closes": tcp & F.col("rst"),
        "fin_a": tcp & F.col("fin") & F.col("from_lo"),
        "fin_b": tcp & F.col("fin") & ~F.col("from_lo")})
    rows = chain.segments(rows, idle, active, slice_us)
    forward = F.col("from_lo") == F.col("start.tag.from_lo")
    size = F.col("payload_len").cast("long")
    return rows.groupBy("key", "start").agg(
        F.max("at").alias("last_us"),
        F.count_if(forward).alias("fp"), F.count_if(~forward).alias("bp"),
        F.sum(F.when(forward, size).otherwise(0)).alias("fb"),
        F.sum(F.when(~forward, size).otherwise(0)).alias("bb"),
        *[F.count_if(F.col(c)).alias(c) for c in ("syn", "rst", "fin", "ack")],
    ).select("key", F.col("start.seq").alias("flow_id"), F.col("start.tag.from_lo").alias("lo_first"),
             F.col("start.tag.at").alias("first_us"), "last_us", "fp", "bp", "fb", "bb",
             "syn", "rst", "fin", "ack")


def shape(flows: DataFrame) -> DataFrame:
    a = F.when(F.col("lo_first"), F.col("key.lo")).otherwise(F.col("key.hi"))
    b = F.when(F.col("lo_first"), F.col("key.hi")).otherwise(F.col("key.lo"))
    return flows.select(
        "flow_id", a["ip"].alias("src_ip"), b["ip"].alias("dst_ip"),
        a["port"].alias("src_port"), b["port"].alias("dst_port"), F.col("key.proto").alias("proto"),
        F.timestamp_micros("first_us").alias("first_ts"), F.timestamp_micros("last_us").alias("last_ts"),
        (F.greatest(F.col("last_us") - F.col("first_us"), F.lit(0)) / 1e6).alias("duration_s"),
        F.col("fp").alias("fwd_packets"), F.col("bp").alias("bwd_packets"),
        F.col("fb").alias("fwd_bytes"), F.col("bb").alias("bwd_bytes"),
        F.col("syn").alias("syn_count"), F.col("rst").alias("rst_count"),
        F.col("fin").alias("fin_count"), F.col("ack").alias("ack_count"))


def feature_columns(flows: DataFrame) -> DataFrame:
    """The six model features as doubles, in contract order, beside the flow id."""
    wide = flows.withColumn("protocol", F.col("proto"))
    return wide.select("flow_id", *[F.col(c).cast("double").alias(c) for c in fixed.FEATURES])


def expand_to_packets(flows: DataFrame, start_us: Column | None = None) -> DataFrame:
    """Packets that rebuild each flow: forward ones first, each side's bytes on its
    first packet, time evenly spread. Needs flow_id, the 5-tuple and the features."""
    fp, bp = F.col("fwd_packets").cast("long"), F.col("bwd_packets").cast("long")
    total = fp + bp
    base = start_us if start_us is not None else F.lit(1_600_000_000_000_000)
    span = F.when(total > 1, F.col("duration_s") * 1e6 * F.col("i") / (total - 1)).otherwise(0.0)
    forward = F.col("i") < fp
    return (flows.filter(total > 0).withColumn("i", F.explode(F.sequence(F.lit(0), total - 1)))
            .select(
                "flow_id", F.col("i").alias("nth"),
                F.timestamp_micros((base + numeric.rounded(span)).cast("long")).alias("ts"),
                F.when(forward, F.col("src_ip")).otherwise(F.col("dst_ip")).alias("src_ip"),
                F.when(forward, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("dst_ip"),
                F.when(forward, F.col("src_port")).otherwise(F.col("dst_port")).alias("src_port"),
                F.when(forward, F.col("dst_port")).otherwise(F.col("src_port")).alias("dst_port"),
                "proto",
                F.when(F.col("i") == 0, F.when(fp > 0, F.col("fwd_bytes")).otherwise(F.col("bwd_bytes")))
                .when(F.col("i") == fp, F.col("bwd_bytes")).otherwise(0).cast("int").alias("payload_len"),
                F.lit(False).alias("syn"), F.lit(False).alias("rst"), F.lit(False).alias("fin"),
                (F.col("proto") == 6).alias("ack")))
