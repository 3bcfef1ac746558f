"""Streaming queries: the events table arrives as files and runs to its end."""
from pyspark.sql import functions as F

from ..functions import text
from ..operators import alerts, reads
from ..session import cut, scratch
from ..sources import readers
from ..streaming import captures, detect
from ..streaming import flows as flow_stream
from . import view_sql as v
from . import views
from .catalog import query
from .queries_flows import FLOW_SQL, _captures, _timed, _write_files
from .queries_reads import SENT, STAMP, TRIGGERED, WEEK

# How long a late packet is waited for; those of the table are 100 hours late at most.
LATEST = "5 days"


def _event_stream(spark, sf):
    """The events file as a stream of packets."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return views.packets_from(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf))


def _loads(rows, parts: int = 3, by=None):
    """The rows in `parts` loads by time, or by the column `by`."""
    us = F.unix_micros("ts") if by is None else F.col(by)
    marks = rows.agg(F.percentile_approx(us, F.array(*[F.lit(i / parts) for i in range(1, parts)])).alias("m")).first()["m"]
    edges = [None, *marks, None]
    for low, high in zip(edges, edges[1:]):
        part = rows if low is None else rows.filter(us >= low)
        yield part if high is None else part.filter(us < high)


def _replayed(spark, sf):
    """Packets arrive as files in loads; the stream is started anew for each load and goes on from its state."""
    source, sink, state = (scratch(spark, f"flows-{x}") for x in ("in", "out", "state"))
    for load in _loads(views.packets(spark, sf)):
        load.write.mode("append").parquet(source)
        flow_stream.advance(readers.packet_stream(spark, source), sink, state, views.IDLE_S, views.ACTIVE_S, "1 day")
    return flow_stream.flushed(spark, sink, state)


@query("stream_flows", v.over("flows") + FLOW_SQL)
def stream_flows(spark, sf):
    """Keyed state over several loads and restarts, then the flush: the same flows as the batch."""
    return _timed(_replayed(spark, sf))


@query("stream_flows_by_arrival", v.arrival_flows(tracker=False) + FLOW_SQL)
def stream_flows_by_arrival(spark, sf):
    """Late packets in loads as they arrive: the same flows as the batch in order of arrival."""
    source, sink, state = (scratch(spark, f"arrivals-{x}") for x in ("in", "out", "state"))
    for load in _loads(views.late_packets(spark, sf), by="seq"):
        load.write.mode("append").parquet(source)
        flow_stream.advance(readers.packet_stream(spark, source), sink, state, views.IDLE_S, views.ACTIVE_S, LATEST, "arrival")
    return _timed(flow_stream.flushed(spark, sink, state))


SEEN = """seen AS (SELECT * REPLACE (proto = 6 AND syn AS syn, proto = 6 AND rst AS rst, proto = 6 AND fin AS fin, proto = 6 AND ack AS ack)
  FROM packets WHERE payload_len % 9 <> 0)"""


@query("stream_captures", "WITH RECURSIVE " + ",\n".join([v.PACKETS, SEEN, v.KEYED.replace("FROM packets", "FROM seen"), v.walk(), v.FLOWS])
       + FLOW_SQL.replace("flow_id, ", ""))
def stream_captures(spark, sf):
    """Capture files arrive in three loads by the time of their first packet; each time they are taken in, and the flows
    go on from their state."""
    folder, packets, numbers, taken, sink, state = (
        scratch(spark, f"captures-{x}") for x in ("files", "packets", "numbers", "taken", "flows", "state"))
    files = cut(_captures(spark, sf))
    for load in _loads(files, by="first_us"):
        if load.isEmpty():  # a small table fills fewer than three files
            continue
        load.mapInPandas(_write_files(folder), "number long").write.format("noop").mode("overwrite").save()
        captures.ingest(spark, folder, packets, numbers, taken, split_bytes=10_000)
        flow_stream.advance(captures.arrived(spark, packets), sink, state, views.IDLE_S, views.ACTIVE_S, "1 day")
    return _timed(flow_stream.flushed(spark, sink, state)).drop("flow_id")


def _arriving(spark, rows, name):
    """The stream of some rows, once for each load by time that has arrived."""
    rows, source = cut(rows), scratch(spark, f"{name}-in")
    for load in _loads(rows):
        load.write.mode("append").parquet(source)
        yield spark.readStream.schema(rows.schema).parquet(source)


def _run_in_parts(spark, rows, operator, name):
    """Rows arrive in loads by time; the stream is run after each load."""
    sink, state = (scratch(spark, f"{name}-{x}") for x in ("out", "state"))
    for arrived in _arriving(spark, rows, name):
        stream = operator(arrived)
        detect.append_batches(stream, sink, state).awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)


def _run(spark, stream, name):
    path = scratch(spark, name)
    detect.append_batches(stream, path, scratch(spark, f"{name}-state")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("stream_telemetry", v.over("telemetry") + """SELECT id, ip, country, blacklisted, attacks, reports, rep_source FROM telemetry""")
def stream_telemetry(spark, sf):
    """Packets joined to the geo and reputation tables while they arrive."""
    rows = detect.telemetry_stream(_event_stream(spark, sf), views.geo(spark, sf), views.scored(spark, sf), views.counted(spark, sf))
    return _run(spark, rows, "telemetry").select("id", "ip", "country", "blacklisted", "attacks", "reports", "rep_source")


def _completed(spark, sf):
    return views.flow_rows(spark, sf).withColumn("ts", F.col("last_ts"))


def _stage(spark, sf):
    # Written once: every micro-batch joins them, and each join counts them first.
    dims = (cut(d) for d in (views.geo(spark, sf), views.scored(spark, sf), views.counted(spark, sf)))
    return detect.two_stage(views.formula_gate, views.formula_families, views.FAMILIES, *dims)


@query("stream_detections", v.over("detections") + """SELECT id, cnn_verdict, cnn_confidence, country, coalesce(technique_id, 'none') AS technique, rep_source
FROM detections""")
def stream_detections(spark, sf):
    """Completed flows arrive in loads and are classified and enriched on the way, gate first."""
    sink, state = (scratch(spark, f"detections-{x}") for x in ("out", "state"))
    made = lambda rows: rows.select(
        F.col("flow_id").alias("id"), "cnn_verdict", "cnn_confidence", "country",
        F.coalesce("technique_id", F.lit("none")).alias("technique"), F.col("rep.source").alias("rep_source"))
    stage = _stage(spark, sf)
    for arrived in _arriving(spark, _completed(spark, sf), "detections"):
        detect.run_to_sinks(arrived, state, {"detections": (sink, made)}, stage=stage).awaitTermination()
    return spark.read.parquet(sink).drop("batch")


@query("stream_batched_sinks", v.over("detections", "logs") + """SELECT 'detections' AS target, id, cnn_verdict AS verdict, cnn_confidence AS confidence, summary AS told FROM detections
UNION ALL SELECT 'logs', d.id, NULL, NULL, log FROM logs l JOIN detections d ON l.id = d.id * 2 + 1 WHERE d.cnn_verdict = 'suspicious'""")
def stream_batched_sinks(spark, sf):
    """Micro-batches, each written to two tables; whole rows of both."""
    paths = {n: scratch(spark, f"batched-{n}") for n in ("detections", "logs")}
    built, source = _completed(spark, sf), scratch(spark, "batched-in")
    built.write.parquet(source)
    arriving = spark.readStream.schema(built.schema).option("maxFilesPerTrigger", 2).parquet(source)
    told = lambda b: b.withColumn("summary", text.flow_summary())
    detect.run_to_sinks(arriving, scratch(spark, "batched-state"), {
        "detections": (paths["detections"], lambda b: told(b).select(
            F.col("flow_id").alias("id"), F.col("cnn_verdict").alias("verdict"), F.col("cnn_confidence").alias("confidence"),
            F.col("summary").alias("told"))),
        "logs": (paths["logs"], lambda b: told(b).filter(reads.suspicious()).select(F.col("flow_id").alias("id"), text.verdict_log().alias("told"))),
    }, stage=_stage(spark, sf)).awaitTermination()
    out = None
    for name, path in paths.items():
        part = spark.read.parquet(path).drop("batch").withColumn("target", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _alert_rows(spark, sf):
    return alerts.alert_input(views.detections(spark, sf))


@query("stream_throttled_alerts", v.over("detections", extra=SENT) + """
SELECT id, trigger, src_ip, technique_id FROM due WHERE id IN (SELECT seq FROM hop WHERE fire)""")
def stream_throttled_alerts(spark, sf):
    """The alerts of the batch operator, from a stream: both triggers share the throttle."""
    rows = _run_in_parts(spark, _alert_rows(spark, sf), lambda s: detect.throttled_alerts(s, WEEK), "alerts")
    return rows.select("id", "trigger", "src_ip", "technique_id")


@query("stream_first_sightings", v.over("detections", extra=TRIGGERED) + "SELECT id FROM firsts")
def stream_first_sightings(spark, sf):
    return _run_in_parts(spark, _alert_rows(spark, sf), detect.first_sights, "sightings").select("id")


@query("stream_packet_rate", v.over("packets") + """, w AS (
  SELECT (us // 21600000000 + i) * 21600000000 AS at_us FROM packets, (SELECT unnest([1, 2, 3, 4]) AS i))
SELECT strftime(make_timestamp(at_us), '%Y-%m-%d %H:%M:%S') AS at, count(*) AS packets, round(count(*) / 86400, 9) AS rate
FROM w GROUP BY at_us""")
def stream_packet_rate(spark, sf):
    """Packets per second over a day, every six hours, over several loads; the last windows are flushed."""
    span, step = 86_400, 21_600
    sink, state = (scratch(spark, f"rate-{x}") for x in ("out", "state"))
    for arrived in _arriving(spark, views.packets(spark, sf), "rate"):
        detect.append_batches(detect.packet_rate(arrived, span, step, "0 seconds"), sink, state).awaitTermination()
    return detect.rate_flushed(spark, sink, state, span, step).select(
        F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "packets", F.round("rate", 9).alias("rate"))


@query("stream_feed", v.over("telemetry") + f"SELECT id, ip, {STAMP} FROM telemetry WHERE blacklisted = 'Yes' ORDER BY telemetry.timestamp DESC, id DESC LIMIT 50")
def stream_feed(spark, sf):
    """The newest page for a filter, over what a stream has written so far."""
    rows = detect.telemetry_stream(_event_stream(spark, sf), views.geo(spark, sf), views.scored(spark, sf), views.counted(spark, sf))
    table = _run(spark, rows, "feed").filter("blacklisted = 'Yes'")
    return reads.page(table, 1, 50, ["id", "ip", "timestamp"]).withColumn("timestamp", text.stamp(F.col("timestamp")))
