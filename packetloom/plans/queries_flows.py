"""Queries on packets, flows, verdicts and enrichment."""
import uuid

from pyspark.sql import functions as F

from .. import fixed, schema
from ..functions import net, text
from ..operators import chain, enrich, flows, scoring
from ..session import scratch
from ..sources import readers, sinks
from ..streaming import counters
from ..streaming import flows as flow_stream
from . import view_sql as v
from . import views
from .catalog import query, stamped

DAY = 86_400_000_000

# --- packets ------------------------------------------------------------------


@query("packet_admission", v.over("packets") + f"""
SELECT count(*) AS packets_read, count(*) FILTER (WHERE ok) AS admitted, count(*) FILTER (WHERE NOT ok) AS ignored
FROM (SELECT proto_x IN (6, 17) AND regexp_matches(src_ip, '{v.V4}') AND regexp_matches(dst_ip, '{v.V4}') AS ok
      FROM (SELECT *, CASE WHEN payload_len % 9 = 0 THEN 1 ELSE proto END AS proto_x FROM packets))""")
def packet_admission(spark, sf):
    rows = views.packets(spark, sf).withColumn("proto", F.when(F.col("payload_len") % 9 == 0, 1).otherwise(F.col("proto")))
    return flows.admission_counts(rows)


@query("canonical_flow_key", v.over("packets", extra=v.KEYED) + """
SELECT fk AS flow_key, count(*) AS packets, count(DISTINCT src_ip) AS senders FROM keyed GROUP BY fk""")
def canonical_flow_key(spark, sf):
    k = flows.keyed(views.packets(spark, sf))
    side = lambda s: F.concat_ws(":", f"key.{s}.ip", F.col(f"key.{s}.port").cast("string"))
    name = F.concat_ws("|", side("lo"), side("hi"), F.col("key.proto").cast("string"))
    return k.groupBy(name.alias("flow_key")).agg(F.count("*").alias("packets"), F.countDistinct("src_ip").alias("senders"))


FLOW_SQL = """
SELECT flow_id, src_ip, dst_ip, src_port, dst_port, proto, first_us, last_us, duration_s, fwd_packets, bwd_packets,
  fwd_bytes, bwd_bytes, syn_count, rst_count, fin_count, ack_count FROM flows"""


def _timed(rows):
    return rows.withColumns({"first_us": F.unix_micros("first_ts"), "last_us": F.unix_micros("last_ts")}).drop("first_ts", "last_ts")


@query("build_flows", v.over("flows") + FLOW_SQL)
def build_flows(spark, sf):
    return _timed(views.flow_rows(spark, sf))


@query("build_flows_heavy_keys", v.over("flows") + FLOW_SQL)
def build_flows_heavy_keys(spark, sf):
    """Every key with more than 20 packets through the distributed chain."""
    return _timed(flows.build_flows(views.packets(spark, sf), views.IDLE_S, views.ACTIVE_S, group_rows=20))


TRACKER_WALK = v.walk().replace("k.us - w.last_us >=", "k.clock - w.last_us >=").replace(
    "k.us - w.first_us >=", "k.clock - w.first_us >=")
TRACKED = """tracked AS (SELECT *, coalesce(lag(us) OVER (ORDER BY us, seq), us) AS clock FROM packets)"""


@query("build_flows_one_tracker", "WITH RECURSIVE " + ",\n".join(
    [v.PACKETS, TRACKED, v.KEYED.replace("FROM packets", "FROM tracked"), TRACKER_WALK, v.FLOWS]) + FLOW_SQL)
def build_flows_one_tracker(spark, sf):
    """One tracker sees all packets: any packet moves its clock."""
    return _timed(flows.build_flows(views.packets(spark, sf), views.IDLE_S, views.ACTIVE_S, mode="tracker"))


@query("build_flows_by_arrival", v.arrival_flows(tracker=False) + FLOW_SQL)
def build_flows_by_arrival(spark, sf):
    """Packets that arrive late, taken as they arrive."""
    return _timed(flows.build_flows(views.late_packets(spark, sf), views.IDLE_S, views.ACTIVE_S, order="arrival"))


@query("build_flows_by_arrival_one_tracker", v.arrival_flows(tracker=True) + FLOW_SQL)
def build_flows_by_arrival_one_tracker(spark, sf):
    """The same, seen by one tracker; keys with more than 20 packets through the distributed chain."""
    return _timed(flows.build_flows(views.late_packets(spark, sf), views.IDLE_S, views.ACTIVE_S, mode="tracker",
                                    group_rows=20, order="arrival"))


@query("flow_segments", v.over("packets", extra=v.KEYED + ",\n" + v.walk(DAY // 2, 2 * DAY)) + """
SELECT seq, start_seq, rn = 1 OR seq = start_seq AS opens FROM walk""")
def flow_segments(spark, sf):
    """Segment of every packet, at half the usual limits, all keys in the distributed form."""
    rows = flows.keyed(views.packets(spark, sf))
    tcp = F.col("proto") == 6
    rows = rows.select("key", "us", "seq", "clock", (tcp & F.col("rst")).alias("closes"),
                       (tcp & F.col("fin") & F.col("from_lo")).alias("fin_a"),
                       (tcp & F.col("fin") & ~F.col("from_lo")).alias("fin_b"))
    out = chain.segments(rows, DAY // 2, 2 * DAY)
    return out.select("seq", F.col("start.seq").alias("start_seq"), (F.col("start.seq") == F.col("seq")).alias("opens"))


@query("tcp_teardown", v.over("flows") + """
SELECT CASE WHEN proto <> 6 THEN 'never' WHEN rst_count > 0 THEN 'reset' WHEN fin_count >= 2 THEN 'fin' ELSE 'open' END AS ended,
  count(*) AS flows, CAST(sum(fwd_packets + bwd_packets) AS BIGINT) AS packets FROM flows GROUP BY 1""")
def tcp_teardown(spark, sf):
    ended = (F.when(F.col("proto") != 6, "never").when(F.col("rst_count") > 0, "reset")
             .when(F.col("fin_count") >= 2, "fin").otherwise("open"))
    return views.flow_rows(spark, sf).groupBy(ended.alias("ended")).agg(
        F.count("*").alias("flows"), F.sum(F.col("fwd_packets") + F.col("bwd_packets")).alias("packets"))


@query("flow_features", v.over("flows") + """
SELECT flow_id, duration_s, CAST(proto AS DOUBLE) AS protocol, CAST(fwd_packets AS DOUBLE) AS fwd_packets,
  CAST(bwd_packets AS DOUBLE) AS bwd_packets, CAST(fwd_bytes AS DOUBLE) AS fwd_bytes, CAST(bwd_bytes AS DOUBLE) AS bwd_bytes
FROM flows""")
def flow_features(spark, sf):
    return flows.feature_columns(views.flow_rows(spark, sf))


@query("flow_expansion", v.over("flows") + """
SELECT flow_id, count(*) AS packets, CAST(sum(CASE WHEN i = 0 THEN CASE WHEN fwd_packets > 0 THEN fwd_bytes ELSE bwd_bytes END
    WHEN i = fwd_packets THEN bwd_bytes ELSE 0 END) AS BIGINT) AS bytes,
  count(*) FILTER (WHERE i < fwd_packets) AS forward
FROM (SELECT *, unnest(range(fwd_packets + bwd_packets)) AS i FROM flows) GROUP BY flow_id""")
def flow_expansion(spark, sf):
    """Flows taken apart into packets again."""
    f = views.flow_rows(spark, sf)
    p = flows.expand_to_packets(f)
    return p.join(f.select("flow_id", F.col("src_ip").alias("i_ip"), F.col("src_port").alias("i_port")), "flow_id").groupBy(
        "flow_id").agg(F.count("*").alias("packets"), F.sum("payload_len").alias("bytes"),
                       F.count_if((F.col("src_ip") == F.col("i_ip")) & (F.col("src_port") == F.col("i_port"))).alias("forward"))


# --- captures -----------------------------------------------------------------
def _captures(spark, sf):
    """Capture contents built from the packet rows: 500 packets to a file, raw IP link."""
    p = views.packets(spark, sf)
    hexed = lambda c, n: F.lpad(F.hex(c), n, "0")
    ip = lambda c: F.concat(*[hexed(F.element_at(F.split(c, r"\."), i).cast("long"), 2) for i in range(1, 5)])
    size = F.col("payload_len")
    tcp = F.col("proto") == 6
    own = F.when(tcp, 20).otherwise(8)
    flags = sum((F.when(F.col(c), b).otherwise(0) for c, b in (("syn", 2), ("rst", 4), ("fin", 1), ("ack", 16))), F.lit(0))
    l4 = F.concat(hexed(F.col("src_port"), 4), hexed(F.col("dst_port"), 4), F.when(
        tcp, F.concat(F.lit("0000000000000000" "50"), hexed(flags, 2), F.lit("000000000000")))
        .otherwise(F.concat(hexed(size + 8, 4), F.lit("0000"))))
    # Every ninth payload size stands for an ICMP packet, which is read and ignored.
    proto = F.when(size % 9 == 0, F.lit("01")).otherwise(hexed(F.col("proto"), 2))
    frame = F.concat(F.lit("4500"), hexed(20 + own + size, 4), F.lit("0000000040"), proto, F.lit("0000"),
                     ip(F.col("src_ip")), ip(F.col("dst_ip")), l4)
    us = F.unix_micros("ts")
    length = hexed(F.length(frame) / 2, 8)
    record = F.concat(hexed(F.floor(us / 1_000_000), 8), hexed(us % 1_000_000, 8), length, length, frame)
    rows = p.select(F.floor(F.col("seq") / 500).alias("number"), "seq", us.alias("us"), record.alias("record"))
    files = rows.groupBy("number").agg(F.min("us").alias("first_us"), F.sort_array(F.collect_list(F.struct("seq", "record"))).alias("r"))
    head = "a1b2c3d4" "00020004" "0000000000000000" "0000ffff" "00000065"
    return files.select(F.col("number").cast("string").alias("path"), "number", "first_us", F.unhex(
        F.concat(F.lit(head), F.array_join(F.transform("r", lambda r: r["record"]), ""))).alias("content"))


def _write_files(folder: str):
    def run(batches):
        from pyarrow import fs
        system, place = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(place)
        for pdf in batches:
            for number, content in zip(pdf["number"], pdf["content"]):
                # Written aside first, so that a task that is run twice leaves one whole file.
                aside = f"{place}/_{number}-{uuid.uuid4().hex}"
                with system.open_output_stream(aside) as out:
                    out.write(content)
                system.move(aside, f"{place}/{number}.pcap")
            yield pdf[["number"]]
    return run


def _scanned(spark, sf):
    """The capture files written to the shared folder and read back, each in several byte ranges."""
    folder = scratch(spark, "captures")
    _captures(spark, sf).mapInPandas(_write_files(folder), "number long").write.format("noop").mode("overwrite").save()
    return readers.capture_packets(spark, folder, split_bytes=10_000)


@query("capture_scan", v.over("packets") + """
SELECT seq // 500 AS number, seq % 500 AS nth, us, src_ip, dst_ip, src_port, CAST(dst_port AS INTEGER) AS dst_port, proto,
  payload_len, proto = 6 AND syn AS syn, proto = 6 AND rst AS rst, proto = 6 AND fin AS fin, proto = 6 AND ack AS ack
FROM packets WHERE payload_len % 9 <> 0""")
def capture_scan(spark, sf):
    number = F.regexp_extract("capture", r"(\d+)\.pcap$", 1).cast("long")
    return _scanned(spark, sf).filter("usable").withColumn("number", number).drop("usable", "capture")


@query("capture_counts", v.over("packets") + """
SELECT count(*) AS packets_read, count(*) FILTER (WHERE payload_len % 9 <> 0) AS admitted,
  count(*) FILTER (WHERE payload_len % 9 = 0) AS ignored FROM packets""")
def capture_counts(spark, sf):
    return readers.capture_counts(_scanned(spark, sf))


# --- verdicts -----------------------------------------------------------------
@query("verdict_threshold", v.over("flows", extra=v.SCORED) + """
SELECT flow_id, probability, cnn_verdict, cnn_confidence FROM judged""")
def verdict_threshold(spark, sf):
    return scoring.judge(views.formula_gate(views.flow_rows(spark, sf))).select(
        "flow_id", "probability", "cnn_verdict", "cnn_confidence")


@query("family_attribution", v.over("flows", "techniques", extra=v.SCORED) + """
SELECT j.flow_id, j.cnn_verdict, t.attack_family, t.technique_id,
  coalesce(t.technique_name, CASE WHEN cnn_verdict = 'suspicious' THEN 'technique unattributed' END) AS technique_name, t.tactic,
  CASE WHEN t.attack_family IS NOT NULL THEN round_even(top_p, 4) END AS attribution_confidence
FROM judged j LEFT JOIN techniques t ON t.attack_family = j.family""")
def family_attribution(spark, sf):
    rows = scoring.classify(views.flow_rows(spark, sf), views.formula_gate, views.formula_families, views.FAMILIES)
    return rows.select("flow_id", "cnn_verdict", "attack_family", "technique_id", "technique_name", "tactic",
                       "attribution_confidence")


@query("two_stage_gate", v.over("flows", extra=v.SCORED) + """
SELECT cnn_verdict, count(*) AS flows, count(family) AS attributed, count(*) FILTER (WHERE family IS NULL) AS unattributed
FROM judged GROUP BY 1""")
def two_stage_gate(spark, sf):
    rows = scoring.classify(views.flow_rows(spark, sf), views.formula_gate, views.formula_families, views.FAMILIES)
    return rows.groupBy("cnn_verdict").agg(F.count("*").alias("flows"), F.count("attack_family").alias("attributed"),
                                           F.count_if(F.col("attack_family").isNull()).alias("unattributed"))


@query("capture_to_verdicts", v.over("flows", "geo", "rep", "techniques", extra=v.SCORED + ",\n" + v.DETECTIONS) + """
SELECT country, cnn_verdict, coalesce(technique_id, 'none') AS technique, count(*) AS flows,
  CAST(sum(fwd_bytes + bwd_bytes) AS BIGINT) AS bytes FROM detections GROUP BY 1, 2, 3""")
def capture_to_verdicts(spark, sf):
    """Packets to flows, verdicts, families and places, in one plan."""
    rows = views.detections_from(views.flow_rows(spark, sf), views.geo(spark, sf), views.scored(spark, sf),
                                 views.counted(spark, sf))
    return rows.groupBy("country", "cnn_verdict", F.coalesce("technique_id", F.lit("none")).alias("technique")).agg(
        F.count("*").alias("flows"), F.sum(F.col("fwd_bytes") + F.col("bwd_bytes")).alias("bytes"))


# --- raw answers --------------------------------------------------------------
@query("geo_normalise", v.over("geo") + "SELECT ip, country, lat, lon FROM geo")
def geo_normalise(spark, sf):
    return views.geo(spark, sf)


@query("scored_reputation_normalise", v.over("rep") + """
SELECT ip, score >= 50 AS blacklisted, CAST(0 AS BIGINT) AS attacks, reports, CAST(score AS INTEGER) AS abuse_score,
  usage_type, isp, 'abuseipdb' AS source FROM rep_scored""")
def scored_reputation_normalise(spark, sf):
    return views.scored(spark, sf).select("ip", "rep.*")


@query("counted_reputation_normalise", v.over("rep") + """
SELECT ip, ok AND attacks > 0 AS blacklisted, CASE WHEN ok THEN attacks ELSE 0 END AS attacks,
  CASE WHEN ok THEN reports ELSE 0 END AS reports, CASE WHEN ok THEN 'blocklist.de' ELSE 'unknown' END AS source FROM rep_counted""")
def counted_reputation_normalise(spark, sf):
    return views.counted(spark, sf).select("ip", "rep.blacklisted", "rep.attacks", "rep.reports", "rep.source")


ODD_IP_SQL = """SELECT event_id, CAST(user_id % 300 AS VARCHAR) || '.' || k || '.' || ((k * 3) % 280) || '.'
  || CASE WHEN k % 10 = 0 THEN '0' ELSE '' END || (user_id % 256) AS ip
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""


def _odd_ips(spark, sf):
    k, uid = F.get_json_object("props", "$.k").cast("int"), F.col("user_id")
    return views.table(spark, sf, "events").select("event_id", F.concat(
        (uid % 300).cast("string"), F.lit("."), k.cast("string"), F.lit("."), ((k * 3) % 280).cast("string"), F.lit("."),
        F.when(k % 10 == 0, "0").otherwise(""), (uid % 256).cast("string")).alias("ip"))


@query("enrichable_address", f"""SELECT event_id, ip, {v.enrichable('ip')} AS enrichable FROM ({ODD_IP_SQL})""")
def enrichable_address(spark, sf):
    return _odd_ips(spark, sf).withColumn("enrichable", net.is_enrichable(F.col("ip")))


@query("valid_address", f"SELECT event_id, regexp_matches(ip, '{v.V4}') AS valid FROM ({ODD_IP_SQL})")
def valid_address(spark, sf):
    return _odd_ips(spark, sf).select("event_id", net.is_ip(F.col("ip")).alias("valid"))


# --- joins --------------------------------------------------------------------
@query("geo_join", v.over("packets", "geo", "rep", extra=f"e AS ({v.enriched('packets', 'src_ip')})") + """
SELECT seq, src_ip, country, lat, lon FROM e""")
def geo_join(spark, sf):
    return enrich.with_geo(views.packets(spark, sf).select("seq", "src_ip"), views.geo(spark, sf))


@query("reputation_fallback_join", v.over("packets", "geo", "rep", extra=f"e AS ({v.enriched('packets', 'src_ip')})") + """
SELECT seq, blacklisted, attacks, reports, CAST(abuse_score AS DOUBLE) AS abuse_score, usage_type, isp, rep_source FROM e""")
def reputation_fallback_join(spark, sf):
    rows = enrich.with_reputation(views.packets(spark, sf).select("seq", "src_ip"), views.scored(spark, sf), views.counted(spark, sf))
    return rows.select("seq", "rep.blacklisted", "rep.attacks", "rep.reports",
                       F.col("rep.abuse_score").cast("double").alias("abuse_score"), "rep.usage_type", "rep.isp",
                       F.col("rep.source").alias("rep_source"))


@query("missing_geo_labels", v.over("packets", "geo", "rep", extra=f"e AS ({v.enriched('packets', 'src_ip')})") + """
SELECT country, count(*) AS packets, count(lat) AS placed FROM e
WHERE country IN ('Internal/Private Range (Non-Routable)', 'Resolution Timeout/Error') GROUP BY 1""")
def missing_geo_labels(spark, sf):
    from .. import fixed
    rows = enrich.with_geo(views.packets(spark, sf).select("src_ip"), views.geo(spark, sf))
    return rows.filter(F.col("country").isin(fixed.PRIVATE_LABEL, fixed.FAILED_LABEL)).groupBy("country").agg(
        F.count("*").alias("packets"), F.count("lat").alias("placed"))


@query("reputation_as_of", v.over("flows") + f""",
hist AS (SELECT {v.client('user_id')} AS ip, epoch_us(ts) AS us, max(CAST(floor(value) AS INTEGER) % 101) AS score
         FROM events GROUP BY ALL)
SELECT f.flow_id, f.src_ip, strftime(make_timestamp(h.us), '%Y-%m-%d %H:%M:%S') AS seen_at, CAST(h.score AS DOUBLE) AS abuse_score
FROM flows f ASOF LEFT JOIN hist h ON f.src_ip = h.ip AND f.first_us >= h.us""")
def reputation_as_of(spark, sf):
    history = views.table(spark, sf, "events").select(views.client_ip(F.col("user_id")).alias("ip"), F.col("ts").cast("timestamp").alias("seen_at"),
                        (F.floor("value").cast("int") % 101).alias("abuse_score"))
    rows = enrich.reputation_as_of(views.flow_rows(spark, sf).select("flow_id", "src_ip", "first_ts"), history)
    return stamped(rows.select("flow_id", "src_ip", "seen_at", F.col("abuse_score").cast("double").alias("abuse_score")), "seen_at")


def fires_sql(source: str, gap_us: int) -> str:
    """Greedy throttle of rows (k, us, seq) as a recursive expression named kept."""
    return f"""ordered AS (SELECT k, us, seq, row_number() OVER (PARTITION BY k ORDER BY us, seq) AS rn FROM ({source})),
hop AS (
  SELECT k, us, seq, rn, us AS kept_us, true AS fire FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.k, o.us, o.seq, o.rn, CASE WHEN o.us - h.kept_us >= {gap_us} THEN o.us ELSE h.kept_us END, o.us - h.kept_us >= {gap_us}
  FROM hop h JOIN ordered o ON o.k = h.k AND o.rn = h.rn + 1)"""


@query("lookup_demand", v.over("packets", extra=fires_sql(
    f"SELECT src_ip AS k, us, seq FROM packets WHERE {v.enrichable('src_ip')}", DAY)) + """
SELECT k AS ip, count(*) AS requests, count(*) FILTER (WHERE fire) AS misses, count(*) FILTER (WHERE NOT fire) AS hits
FROM hop GROUP BY k""")
def lookup_demand(spark, sf):
    return enrich.lookup_demand(views.packets(spark, sf), 86_400, "src_ip")


@query("lookup_demand_heavy_addresses", v.over("packets", extra=fires_sql(
    f"SELECT src_ip AS k, us, seq FROM packets WHERE {v.enrichable('src_ip')}", DAY)) + """
SELECT k AS ip, count(*) AS requests, count(*) FILTER (WHERE fire) AS misses, count(*) FILTER (WHERE NOT fire) AS hits
FROM hop GROUP BY k""")
def lookup_demand_heavy_addresses(spark, sf):
    return enrich.lookup_demand(views.packets(spark, sf), 86_400, "src_ip", group_rows=30)


@query("reputation_notes", v.over("packets", "geo", "rep", extra=f"e AS ({v.enriched('packets', 'src_ip')})") + f"""
SELECT note, count(*) AS packets FROM (SELECT CASE WHEN NOT {v.enrichable('src_ip')}
    THEN {v.quoted(fixed.NOTE_PRIVATE)} WHEN rep_source = 'unknown' THEN {v.quoted(fixed.NOTE_FAILED)}
  WHEN abuse_score IS NOT NULL THEN {v.quoted(fixed.NOTE_SCORED)} WHEN NOT blacklisted THEN {v.quoted(fixed.NOTE_CLEAN)} END AS note FROM e) GROUP BY note""")
def reputation_notes(spark, sf):
    rows = enrich.with_reputation(views.packets(spark, sf).select("src_ip"), views.scored(spark, sf), views.counted(spark, sf))
    return rows.groupBy(enrich.reputation_note(F.col("src_ip"), F.col("rep")).alias("note")).agg(F.count("*").alias("packets"))


# --- sinks --------------------------------------------------------------------
@query("telemetry_sink", v.over("telemetry") + """
SELECT id, ip, country, lat, lon, summary, blacklisted, attacks, reports, CAST(abuse_score AS DOUBLE) AS abuse_score, rep_source,
  strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp FROM telemetry""")
def telemetry_sink(spark, sf):
    path = scratch(spark, "telemetry_sink")
    sinks.write_telemetry(views.telemetry(spark, sf), path)
    return stamped(sinks.read_fact(spark, path, schema.TELEMETRY).withColumn("abuse_score", F.col("abuse_score").cast("double")))


@query("detection_sink", v.over("detections") + """
SELECT id, src_ip, dst_ip, cnn_verdict, cnn_confidence, summary, technique_id, CAST(abuse_score AS DOUBLE) AS abuse_score, rep_reports, rep_source,
  CAST(NULL AS VARCHAR) AS triage_json, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp FROM detections""")
def detection_sink(spark, sf):
    path = scratch(spark, "detection_sink")
    sinks.write_detections(views.detections(spark, sf), path)
    return stamped(sinks.read_fact(spark, path, schema.DETECTION).select(
        "id", "src_ip", "dst_ip", "cnn_verdict", "cnn_confidence", "summary", "technique_id",
        F.col("abuse_score").cast("double").alias("abuse_score"), "rep_reports", "rep_source", "triage_json", "timestamp"))


@query("log_and_metric_sinks", v.over("logs", "metrics") + """
SELECT 'logs' AS sink, CAST(id AS BIGINT) AS id, epoch_us(timestamp) AS us, log, NULL::DOUBLE AS cpu, NULL::DOUBLE AS memory,
  NULL::DOUBLE AS disk, NULL::BIGINT AS network FROM logs
UNION ALL SELECT 'metrics', CAST(id AS BIGINT), epoch_us(timestamp), NULL, cpu, memory, disk, CAST(network AS BIGINT) FROM metrics""")
def log_and_metric_sinks(spark, sf):
    """Both tables through their sinks, whole rows."""
    out = None
    for name, rows, write in (("logs", views.logs(spark, sf), sinks.write_logs),
                              ("metrics", views.host_metrics(spark, sf), sinks.write_metrics)):
        path = scratch(spark, name)
        write(rows, path)
        part = sinks.read_fact(spark, path, sinks.ROUTES[name]).withColumns({"sink": F.lit(name), "us": F.unix_micros("timestamp")})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.drop("timestamp")


ROUTED = [f.rsplit(" ", 1)[0] for f in schema.TELEMETRY.split(", ")]


@query("routed_batch_sink", v.over("telemetry", "detections") + """
SELECT 'telemetry' AS target, id, ip, country, lat, lon, summary, blacklisted, attacks, reports, epoch_us(timestamp) AS us, abuse_score, rep_source FROM telemetry
UNION ALL SELECT 'detections', id, src_ip, country, lat, lon, summary, cnn_verdict, fwd_packets, rep_reports, epoch_us(timestamp), abuse_score, rep_source
FROM detections""")
def routed_batch_sink(spark, sf):
    """One mixed batch, one write per target table, all rows read back."""
    mixed = sinks.as_routed(views.telemetry(spark, sf), "telemetry").unionByName(
        sinks.as_routed(views.detections(spark, sf), "detections"))
    targets = {t: scratch(spark, f"routed-{t}") for t in ("telemetry", "detections")}
    sinks.route(mixed, targets)
    detections = sinks.read_fact(spark, targets["detections"], schema.DETECTION).withColumnsRenamed(
        {"src_ip": "ip", "cnn_verdict": "blacklisted", "fwd_packets": "attacks", "rep_reports": "reports"})
    both = sinks.read_fact(spark, targets["telemetry"], schema.TELEMETRY).select(F.lit("telemetry").alias("target"), *ROUTED).unionByName(
        detections.select(F.lit("detections").alias("target"), *ROUTED))
    return both.withColumn("us", F.unix_micros("timestamp")).drop("timestamp")


@query("annotation_upsert", v.over("detections") + """
SELECT id, CASE WHEN id % 4 = 0 THEN 'new ' || id WHEN id % 3 = 0 THEN 'old ' || id END AS triage_json,
  CASE WHEN id % 4 = 0 OR id % 3 = 0 THEN strftime(timestamp + CASE WHEN id % 4 = 0 THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END,
    '%Y-%m-%d %H:%M:%S') END AS triage_at FROM detections""")
def annotation_upsert(spark, sf):
    """New texts replace old ones; rows without a new text keep theirs."""
    d = views.detections(spark, sf).select("id", "timestamp")
    later = lambda h: F.col("timestamp") + F.expr(f"INTERVAL {h} HOUR")
    old = d.select("id", "timestamp", F.when(F.col("id") % 3 == 0, F.concat(F.lit("old "), F.col("id"))).alias("triage_json"),
                   F.when(F.col("id") % 3 == 0, later(1)).alias("triage_at"))
    notes = d.filter("id % 4 = 0").select("id", F.concat(F.lit("new "), F.col("id")).alias("body"), later(2).alias("at"))
    return stamped(sinks.annotate(old, notes, "triage").drop("timestamp"), "triage_at")


def _watched(spark, sf, packets):
    """Late rows, rows written and open flows of a stream over the packets; at its end those of the first third come again."""
    source, sink, state, table = (scratch(spark, f"counters-{x}") for x in ("in", "out", "state", "table"))
    lo, hi = packets.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    us, third = F.unix_micros("ts"), (hi - lo) // 3
    first = packets.filter(us < lo + third)
    progress = counters.Progress(spark, table)
    spark.streams.addListener(progress)
    try:
        for load in (first, packets.filter(us >= lo + third), first):
            load.write.mode("append").parquet(source)
            run = flow_stream.advance(readers.packet_stream(spark, source), sink, state, views.IDLE_S, views.ACTIVE_S, "1 day")
            progress.settle(run)
    finally:
        spark.streams.removeListener(progress)
    held = flow_stream.still_open(spark, state).agg(F.count("*").alias("open_flows"))
    return counters.totals(spark, table, str(run.id)).crossJoin(F.broadcast(held))


# The stream's clock ends a day before the last packet; flows whose limits lie behind that are open.
STREAM_END = f"(SELECT max(us) FROM packets) // 1000 - {DAY // 1000}"
OPEN_SQL = f"""SELECT count(*) FROM (SELECT start_seq, bool_or(shut) AS shut, min(first_us) AS f, max(last_us) AS l FROM walk GROUP BY 1)
  WHERE NOT shut AND -((-least(l + {v.IDLE_US}, f + {v.ACTIVE_US})) // 1000) >= {STREAM_END}"""


@query("job_counters", v.over("packets", "flows", extra=fires_sql(
    f"SELECT src_ip AS k, us, seq FROM packets WHERE {v.enrichable('src_ip')}", 900_000_000)) + f"""
SELECT (SELECT count(*) FROM packets) AS packets_read, (SELECT count(*) FROM packets WHERE proto IN (6, 17)) AS admitted,
  (SELECT count(*) FROM packets WHERE proto NOT IN (6, 17)) AS ignored, (SELECT count(*) FROM flows) AS flows_built,
  (SELECT count(*) FILTER (WHERE fire) FROM hop) AS lookup_misses, (SELECT count(*) FILTER (WHERE NOT fire) FROM hop) AS lookup_hits,
  (SELECT count(*) FROM packets WHERE us < (SELECT min(us) + (max(us) - min(us)) // 3 FROM packets)) AS late_rows,
  (SELECT count(*) FROM flows) - ({OPEN_SQL}) AS rows_written, ({OPEN_SQL}) AS open_flows""")
def job_counters(spark, sf):
    p = views.packets(spark, sf)
    lookups = enrich.lookup_demand(p, 900, "src_ip").agg(F.sum("misses").alias("lookup_misses"), F.sum("hits").alias("lookup_hits"))
    built = views.flow_rows(spark, sf).agg(F.count("*").alias("flows_built"))
    return flows.admission_counts(p).crossJoin(F.broadcast(built)).crossJoin(F.broadcast(lookups)).crossJoin(
        F.broadcast(_watched(spark, sf, p)))


# --- texts --------------------------------------------------------------------
@query("flow_summary_text", v.over("detections") + "SELECT id, summary FROM detections")
def flow_summary_text(spark, sf):
    return views.flow_rows(spark, sf).select(F.col("flow_id").alias("id"), text.flow_summary().alias("summary"))


@query("log_lines", v.over("logs") + "SELECT id, log FROM logs")
def log_lines(spark, sf):
    return views.logs(spark, sf).select("id", "log")


@query("first_address_in_message", v.over("logs") + """
SELECT id, nullif(regexp_extract(log, '\\b(?:[0-9]{1,3}\\.){3}[0-9]{1,3}\\b'), '') AS ip FROM logs""")
def first_address_in_message(spark, sf):
    return views.logs(spark, sf).select("id", net.first_ipv4(F.col("log")).alias("ip"))


@query("clean_places", v.over("geo") + """
SELECT ip, CASE WHEN len(parts) > 0 THEN array_to_string(parts, ', ') ELSE 'unknown' END AS place
FROM (SELECT ip, list_filter(list_transform(string_split(country, ','), lambda p: trim(p)),
        lambda p: lower(p) NOT IN ('none', 'unknown', 'not found', '')) AS parts FROM geo)""")
def clean_places(spark, sf):
    return views.geo(spark, sf).select("ip", text.clean_place(F.col("country")).alias("place"))
