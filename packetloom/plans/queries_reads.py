"""Queries of the read side: feeds, map, coverage, counters, alerts, monitors."""
from pyspark.sql import functions as F

from ..operators import alerts, migrate, monitor, reads
from ..session import scratch
from ..sources import sinks
from . import view_sql as v
from . import views
from .catalog import query, stamped
from .queries_flows import fires_sql

STAMP = "strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp"
DET = v.over("detections")


# --- pages --------------------------------------------------------------------
FEED = f"""id, src_ip, dst_ip, src_port, dst_port, proto, cnn_verdict, cnn_confidence, country, lat, lon, duration_s,
  fwd_packets, bwd_packets, fwd_bytes, bwd_bytes, summary, attack_family, technique_id, technique_name, tactic,
  CAST(abuse_score AS DOUBLE) AS abuse_score, rep_reports, rep_source, {STAMP}"""


def _shown(rows):
    return stamped(rows.withColumn("abuse_score", F.col("abuse_score").cast("double")))


@query("detections_page", DET + f"SELECT {FEED} FROM detections ORDER BY detections.timestamp DESC, id DESC LIMIT 40 OFFSET 40")
def detections_page(spark, sf):
    return _shown(reads.feed(views.detections(spark, sf), 2, 40))


@query("detections_page_of_verdict", DET + f"""SELECT {FEED} FROM detections WHERE cnn_verdict = 'suspicious'
ORDER BY detections.timestamp DESC, id DESC LIMIT 50""")
def detections_page_of_verdict(spark, sf):
    return _shown(reads.feed(views.detections(spark, sf), "junk", "junk", "suspicious"))


@query("detections_deep_page", DET + f"SELECT {FEED} FROM detections ORDER BY detections.timestamp DESC, id DESC LIMIT 30 OFFSET 60")
def detections_deep_page(spark, sf):
    """The page after row 60, found by that row's time and id."""
    d = views.detections(spark, sf)
    last = reads.page(d, 2, 30, ["timestamp", "id"]).orderBy("timestamp", "id").first()
    return _shown(reads.page_after(d, last["timestamp"], last["id"], 30, reads.FEED_COLUMNS))


@query("filtered_total", DET + """SELECT 'all' AS verdict, count(*) AS total FROM detections
UNION ALL SELECT 'suspicious', count(*) FROM detections WHERE cnn_verdict = 'suspicious'""")
def filtered_total(spark, sf):
    d = views.detections(spark, sf)
    name = lambda only: reads.total(reads.of_verdict(d, only)).select(F.lit(only or "all").alias("verdict"), "total")
    return name(None).unionByName(name("suspicious"))


@query("telemetry_page", v.over("telemetry") + f"""SELECT id, ip, country, lat, lon, summary, blacklisted, attacks, reports,
  CAST(abuse_score AS DOUBLE) AS abuse_score, rep_source, {STAMP} FROM telemetry ORDER BY telemetry.timestamp DESC, id DESC LIMIT 100 OFFSET 100""")
def telemetry_page(spark, sf):
    return _shown(reads.page(views.telemetry(spark, sf), 2, 100, reads.TELEMETRY_COLUMNS))


@query("detection_by_id", DET + f"SELECT {FEED} FROM detections WHERE id = (SELECT max(id) FROM detections)")
def detection_by_id(spark, sf):
    d = views.detections(spark, sf)
    return _shown(reads.by_id(d, d.agg(F.max("id")).first()[0]).select(*reads.FEED_COLUMNS))


@query("recent_logs", v.over("logs") + f"SELECT log, {STAMP} FROM logs ORDER BY logs.timestamp DESC, id DESC LIMIT 5")
def recent_logs(spark, sf):
    return stamped(reads.recent(views.logs(spark, sf), 5, ["log", "timestamp"]))


@query("log_page", v.over("logs") + f"SELECT log, {STAMP} FROM logs ORDER BY logs.timestamp DESC, id DESC LIMIT 50 OFFSET 100")
def log_page(spark, sf):
    return stamped(reads.page(views.logs(spark, sf), 3).select("log", "timestamp"))


@query("recent_telemetry", v.over("telemetry") + """SELECT ip, country, summary FROM telemetry
ORDER BY timestamp DESC, id DESC LIMIT 5""")
def recent_telemetry(spark, sf):
    return reads.recent(views.telemetry(spark, sf), 5, ["ip", "country", "summary"])


@query("log_search", v.over("logs") + f"SELECT id, log, {STAMP} FROM logs WHERE log ILIKE '%SUSPICIOUS (_.9%T1%'")
def log_search(spark, sf):
    return stamped(reads.search_logs(views.logs(spark, sf), "SUSPICIOUS (_.9%T1"))


# --- map ----------------------------------------------------------------------
POINTS = """points AS (
  SELECT round(lat, 1) + 0.0 AS lat, round(lon, 1) + 0.0 AS lon, country, count(*) AS count,
    count(*) FILTER (WHERE cnn_verdict = 'suspicious') AS suspicious_count, max(timestamp) AS last_seen
  FROM detections WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1, 2, 3)"""
MAP = v.over("detections", extra=POINTS)


@query("threat_map", MAP + """SELECT lat, lon, country, count, suspicious_count,
  CASE WHEN suspicious_count > 0 THEN 'suspicious' ELSE 'normal' END AS worst_verdict, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen
FROM points ORDER BY suspicious_count DESC, count DESC, lat, lon, country LIMIT 500""")
def threat_map(spark, sf):
    return stamped(reads.threat_map(views.detections(spark, sf)), "last_seen")


@query("top_map_points", MAP + """SELECT lat, lon, country, count, suspicious_count FROM points
ORDER BY suspicious_count DESC, count DESC, lat, lon, country LIMIT 10""")
def top_map_points(spark, sf):
    return reads.threat_map(views.detections(spark, sf), limit=10).select("lat", "lon", "country", "count", "suspicious_count")


@query("located_only", DET + """SELECT lat IS NOT NULL AND lon IS NOT NULL AS located, count(*) AS detections FROM detections GROUP BY 1""")
def located_only(spark, sf):
    d = views.detections(spark, sf)
    part = lambda rows, flag: rows.agg(F.count("*").alias("detections")).select(F.lit(flag).alias("located"), "detections")
    return part(d.filter(reads.located()), True).unionByName(part(d.filter(~reads.located()), False))


@query("top_origins", MAP + """SELECT origin, CAST(sum(count) AS BIGINT) AS count, CAST(sum(suspicious_count) AS BIGINT) AS suspicious,
  CAST(sum(count) - sum(suspicious_count) AS BIGINT) AS normal
FROM (SELECT *, CASE WHEN len(list_filter(string_split(country, ','), lambda p: lower(trim(p)) NOT IN ('none', 'unknown', 'not found', ''))) > 0
  THEN trim(list_filter(string_split(country, ','), lambda p: lower(trim(p)) NOT IN ('none', 'unknown', 'not found', ''))[1]) ELSE 'unknown' END AS origin
  FROM points) GROUP BY origin ORDER BY count DESC, origin LIMIT 6""")
def top_origins(spark, sf):
    return reads.top_origins(reads.map_points(views.detections(spark, sf)))


@query("map_summary", MAP + """SELECT count(*) AS locations, CAST(sum(suspicious_count) AS BIGINT) AS suspicious,
  greatest(max(count), 1) AS largest FROM points""")
def map_summary(spark, sf):
    return reads.map_summary(reads.map_points(views.detections(spark, sf)))


@query("map_dots", MAP + """SELECT lat, lon, country, round(3 + 9 * sqrt(count / (SELECT greatest(max(count), 1) FROM points)), 6) AS radius
FROM points""")
def map_dots(spark, sf):
    dots = reads.map_dots(reads.map_points(views.detections(spark, sf)))
    return dots.select("lat", "lon", "country", F.round("radius", 6).alias("radius"))


# --- coverage, counters, per address ------------------------------------------
@query("attack_coverage", DET + """SELECT technique_id, technique_name, tactic, attack_family, count(*) AS count,
  strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS last_seen
FROM detections WHERE cnn_verdict = 'suspicious' AND technique_id IS NOT NULL GROUP BY 1, 2, 3, 4 ORDER BY count DESC, technique_id""")
def attack_coverage(spark, sf):
    return stamped(reads.coverage(views.detections(spark, sf)), "last_seen")


@query("coverage_totals", DET + """SELECT count(technique_id) AS attributed, count(*) - count(technique_id) AS unattributed
FROM detections WHERE cnn_verdict = 'suspicious'""")
def coverage_totals(spark, sf):
    return reads.coverage_totals(views.detections(spark, sf))


@query("console_counters", v.over("detections", "telemetry") + """
SELECT (SELECT count(*) FROM telemetry) AS telemetry_rows, (SELECT count(DISTINCT ip) FROM telemetry) AS unique_ips,
  count(*) AS detections, count(*) FILTER (WHERE cnn_verdict = 'suspicious') AS suspicious,
  count(*) FILTER (WHERE lat IS NOT NULL AND lon IS NOT NULL) AS located_detections FROM detections""")
def console_counters(spark, sf):
    return reads.counters(views.telemetry(spark, sf), views.detections(spark, sf))


ENDS = """ends AS (SELECT src_ip AS ip, detections.* FROM detections UNION ALL
  SELECT dst_ip, detections.* FROM detections WHERE dst_ip <> src_ip)"""


@query("ip_activity", v.over("detections", extra=ENDS) + """SELECT ip, count(*) AS total_flows,
  count(*) FILTER (WHERE cnn_verdict = 'suspicious') AS suspicious_flows, count(DISTINCT dst_port) AS distinct_dst_ports FROM ends GROUP BY ip""")
def ip_activity(spark, sf):
    out = reads.ip_activity(views.detections(spark, sf))
    return out.withColumn("suspicious_flows", F.col("suspicious_flows").cast("long"))


@query("suspicious_history_count", DET + """SELECT src_ip, count(*) AS total_suspicious FROM detections
WHERE cnn_verdict = 'suspicious' GROUP BY 1""")
def suspicious_history_count(spark, sf):
    return reads.suspicious_totals(views.detections(spark, sf))


@query("newest_flows_per_ip", v.over("detections", extra=ENDS) + """SELECT ip, nth, id, dst_port, cnn_verdict FROM (
  SELECT *, row_number() OVER (PARTITION BY ip ORDER BY timestamp DESC, id DESC) AS nth FROM ends) WHERE nth <= 10""")
def newest_flows_per_ip(spark, sf):
    return reads.flows_by_ip(views.detections(spark, sf)).select("ip", "nth", "id", "dst_port", "cnn_verdict")


@query("suspicious_history_per_source", DET + """SELECT src_ip, nth, id, dst_ip, technique_id FROM (
  SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY timestamp DESC, id DESC) AS nth FROM detections
  WHERE cnn_verdict = 'suspicious') WHERE nth <= 10""")
def suspicious_history_per_source(spark, sf):
    return reads.history_by_source(views.detections(spark, sf)).select("src_ip", "nth", "id", "dst_ip", "technique_id")


@query("flows_touching_an_address", DET + f"""SELECT id, src_ip, dst_ip, {STAMP} FROM detections
WHERE src_ip = '{v.SERVER}' OR dst_ip = '{v.SERVER}' ORDER BY detections.timestamp DESC, id DESC LIMIT 10""")
def flows_touching_an_address(spark, sf):
    return stamped(reads.flows_for_ip(views.detections(spark, sf), v.SERVER).select("id", "src_ip", "dst_ip", "timestamp"))


# --- hosts and monitors -------------------------------------------------------
@query("resource_saturation", v.over("metrics") + """SELECT id, 'System Infrastructure Warning: Resource Saturation Threshold Breached - System CPU Usage: '
  || cpu || '%, RAM Utilization: ' || memory || '%, Disk Space State: ' || disk || '%.' AS message
FROM metrics WHERE cpu > 85 OR memory > 80 OR disk > 90""")
def resource_saturation(spark, sf):
    return reads.saturated(views.host_metrics(spark, sf)).select("id", "message")


def _samples(spark, sf):
    """Per user a counter that grows by the event's k; time in seconds."""
    k = F.get_json_object("props", "$.k").cast("long")
    return views.table(spark, sf, "events").select(
        (F.col("user_id") % 3).cast("string").alias("source"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), (F.col("event_id") * 10 + k).alias("counter"))


SAMPLES = """samples AS (SELECT CAST(user_id % 3 AS VARCHAR) AS source, epoch_us(ts) / 1000000.0 AS t,
  event_id * 10 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS counter FROM events)"""


@query("trailing_rate", f"WITH {SAMPLES}" + """
SELECT source, counter, round(CASE WHEN t > t0 THEN greatest((counter - c0) / (t - t0), 0) ELSE 0 END, 9) AS rate
FROM (SELECT *, first_value(t) OVER w AS t0, first_value(counter) OVER w AS c0 FROM samples
      WINDOW w AS (PARTITION BY source ORDER BY t, counter ROWS BETWEEN 31 PRECEDING AND CURRENT ROW))""")
def trailing_rate(spark, sf):
    return monitor.trailing_rate(_samples(spark, sf)).select("source", "counter", F.round("rate", 9).alias("rate"))


@query("counter_growth", f"WITH {SAMPLES}," + """
checks AS (SELECT source, CAST(floor(t / 3600) AS BIGINT) AS "check", arg_max(counter % 977, t) AS counter FROM samples GROUP BY 1, 2)
SELECT source, "check", counter - last AS grown, counter AS total FROM (
  SELECT *, greatest(coalesce(max(counter) OVER (PARTITION BY source ORDER BY "check" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS last
  FROM checks) WHERE counter > last""")
def counter_growth(spark, sf):
    """Growth of a counter that also falls back, checked every hour."""
    rows = _samples(spark, sf).withColumn("counter", F.col("counter") % 977)
    return monitor.growth_events(rows, interval_s=3600)


LOGINS = f"""attempts AS (SELECT {v.client('user_id')} AS address, epoch_us(ts) AS us, event_id AS seq, event_type = 'purchase' AS success,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
fold AS (
  SELECT *, false AS blocked, CASE WHEN success THEN []::BIGINT[] ELSE [us] END AS live FROM attempts WHERE rn = 1
  UNION ALL
  SELECT address, us, seq, success, rn, len(kept) >= 5, CASE WHEN len(kept) >= 5 THEN kept WHEN success THEN []::BIGINT[] ELSE list_append(kept, us) END
  FROM (SELECT a.*, list_filter(f.live, lambda t: a.us - t <= {5 * 86_400_000_000}) AS kept
        FROM fold f JOIN attempts a ON a.address = f.address AND a.rn = f.rn + 1))"""


@query("login_bursts", f"WITH RECURSIVE {LOGINS} SELECT address, seq, success, blocked FROM fold")
def login_bursts(spark, sf):
    rows = views.table(spark, sf, "events").select(views.client_ip(F.col("user_id")).alias("address"),
                     F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("seq"),
                     (F.col("event_type") == "purchase").alias("success"))
    return monitor.login_attempts(rows, window_s=5 * 86_400).select("address", "seq", "success", "blocked")


# --- alerts -------------------------------------------------------------------
TRIGGERED = """firsts AS (SELECT arg_min(id, (timestamp, id)) AS id FROM detections WHERE cnn_verdict = 'suspicious' AND technique_id IS NOT NULL
  GROUP BY technique_id),
due AS (SELECT d.*, CASE WHEN cnn_confidence >= 0.99 AND abuse_score >= 50 THEN 'corroborated' ELSE 'new-technique' END AS trigger
  FROM detections d WHERE cnn_verdict = 'suspicious' AND ((cnn_confidence >= 0.99 AND abuse_score >= 50) OR id IN (SELECT id FROM firsts)))"""
WEEK = 7 * 86_400
SENT = TRIGGERED + ",\n" + fires_sql(
    "SELECT src_ip || '|' || coalesce(technique_id, '-') AS k, epoch_us(timestamp) AS us, id AS seq FROM due", WEEK * 1_000_000)


@query("first_technique_sightings", v.over("detections", extra=TRIGGERED) + """
SELECT technique_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS first_ts, id FROM detections WHERE id IN (SELECT id FROM firsts)""")
def first_technique_sightings(spark, sf):
    return stamped(alerts.first_sights(alerts.alert_input(views.detections(spark, sf))), "first_ts")


@query("alert_triggers", v.over("detections", extra=TRIGGERED) + "SELECT id, trigger FROM due")
def alert_triggers(spark, sf):
    return alerts.triggers(alerts.alert_input(views.detections(spark, sf))).select("id", "trigger")


@query("throttled_alerts", v.over("detections", extra=SENT) + """
SELECT id, trigger, src_ip, technique_id FROM due WHERE id IN (SELECT seq FROM hop WHERE fire)""")
def throttled_alerts(spark, sf):
    rows = alerts.alert_input(views.detections(spark, sf))
    return alerts.alerts(rows, WEEK).select("id", "trigger", "src_ip", "technique_id")


@query("alert_payloads", v.over("detections", extra=SENT) + """
SELECT id, '[packetloom] CRITICAL: suspicious flow from ' || src_ip || ' ('
  || CASE WHEN technique_id IS NOT NULL THEN technique_id || ' ' || technique_name ELSE 'technique unattributed' END || ') -- '
  || CASE trigger WHEN 'corroborated' THEN 'ML verdict corroborated by third-party reputation' ELSE 'first occurrence of this ATT&CK technique' END
  || '. confidence=' || cnn_confidence || ', abuse_score=' || coalesce(CAST(abuse_score AS VARCHAR), 'None') AS text,
  'critical' AS severity, trigger, src_ip AS ip, rep_source AS reputation_source, strftime(timestamp, '%Y-%m-%d %H:%M:%SZ') AS timestamp
FROM due WHERE id IN (SELECT seq FROM hop WHERE fire)""")
def alert_payloads(spark, sf):
    sent = alerts.alerts(alerts.alert_input(views.detections(spark, sf)), WEEK)
    return alerts.payloads(sent).select("id", "text", "alert.severity", "alert.trigger", "alert.ip",
                                        F.col("alert.reputation.source").alias("reputation_source"), "alert.timestamp")


# --- legacy tables ------------------------------------------------------------
def _legacy(spark, sf):
    """Telemetry and verdict rows mixed in one table, as an older release kept them."""
    t = views.telemetry(spark, sf).select(
        "ip", F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise("IPv4").alias("type"), "country", "summary",
        "blacklisted", "attacks", "reports", "timestamp", F.lit(None).cast("string").alias("cnn_verdict"),
        F.lit(None).cast("double").alias("cnn_confidence"))
    d = views.detections(spark, sf).select(
        F.col("src_ip").alias("ip"), F.lit("FLOW").alias("type"), "country", "summary", F.lit("No").alias("blacklisted"),
        F.lit(0).cast("long").alias("attacks"), F.lit(0).cast("long").alias("reports"), "timestamp", "cnn_verdict", "cnn_confidence")
    return t.unionByName(d)


@query("legacy_split", v.over("detections", "telemetry") + """
SELECT 'detections' AS target, src_ip AS ip, country, summary, cnn_verdict, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp FROM detections
UNION ALL SELECT 'telemetry', ip, country, summary, NULL, strftime(timestamp, '%Y-%m-%d %H:%M:%S') FROM telemetry""")
def legacy_split(spark, sf):
    d, t = migrate.split_legacy(_legacy(spark, sf))
    a = d.select(F.lit("detections").alias("target"), F.col("src_ip").alias("ip"), "country", "summary", "cnn_verdict", "timestamp")
    b = t.select(F.lit("telemetry").alias("target"), "ip", "country", "summary", F.lit(None).cast("string").alias("cnn_verdict"), "timestamp")
    return stamped(a.unionByName(b))


@query("migration_rerun", v.over("detections", "telemetry") + """
SELECT 'detections' AS target, count(*) AS rows_kept, 5 AS first_run, 0 AS second_run FROM detections
UNION ALL SELECT 'telemetry', count(*), 5, 0 FROM telemetry""")
def migration_rerun(spark, sf):
    """Migrate twice; the second run moves nothing."""
    root = scratch(spark, "migration")
    _legacy(spark, sf).write.parquet(f"{root}/legacy")
    first, second = migrate.migrate(spark, root), migrate.migrate(spark, root)
    out = None
    for name in ("detections", "telemetry"):
        part = migrate.read_table(spark, root, name).agg(F.count("*").alias("rows_kept")).select(
            F.lit(name).alias("target"), "rows_kept", F.lit(len(first)).alias("first_run"), F.lit(len(second)).alias("second_run"))
        out = part if out is None else out.unionByName(part)
    return out


@query("additive_columns", DET + """SELECT cnn_verdict, count(*) AS rows_read, 0 AS with_family, 0 AS with_report FROM detections GROUP BY 1""")
def additive_columns(spark, sf):
    """Rows written before the later columns existed, read in today's shape."""
    from .. import schema
    root = scratch(spark, "old-shape")
    sinks.write_fact(views.detections(spark, sf), f"{root}/detections", schema.DETECTION_BASE)
    rows = migrate.read_table(spark, root, "detections")
    return rows.groupBy("cnn_verdict").agg(
        F.count("*").alias("rows_read"), F.count("attack_family").cast("int").alias("with_family"),
        F.count("report_json").cast("int").alias("with_report"))


@query("pending_migrations", DET + """SELECT name FROM (VALUES ('0001_split_network_requests', 0), ('0002_detection_attribution', 1),
  ('0003_detection_triage', 2), ('0004_reputation_scores', 3), ('0005_detection_report', 4)) s(name, place)
WHERE place NOT IN (SELECT DISTINCT id % 3 FROM detections)""")
def pending_migrations(spark, sf):
    done = views.detections(spark, sf).select((F.col("id") % 3).cast("int").alias("place")).distinct()
    steps = spark.createDataFrame(list(enumerate(migrate.STEPS)), "place int, name string")
    return migrate.pending(spark, steps.join(done, "place", "left_semi").select("name")).select("name")
