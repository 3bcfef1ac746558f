"""Queries on case files, reports and texts."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text
from ..operators import cases, retrieval
from ..session import scratch
from ..sources import sinks
from . import view_sql as v
from . import views
from .catalog import joined, query

# --- texts of conversations as model answers ----------------------------------
JSON_TEXT = """to_json({'severity': CASE WHEN conv_id % 4 = 0 THEN ' High ' WHEN conv_id % 4 = 1 THEN 'apocalyptic' ELSE 'low' END,
  'summary': text, 'likely_intent': role, 'recommended_actions': ['block ' || conv_id, ' ', 'watch'],
  'evidence': [{'tool': 'detection', 'finding': 'turn ' || turn}, {'tool': 'ghost', 'finding': 'x'}, {'tool': 'ip_reputation', 'finding': ' seen '},
    {'tool': 'detection', 'finding': ''}]})"""
ANSWERS = f"""answers AS (
  SELECT conv_id * 1000 + turn AS id, conv_id, turn, role, text, conv_id % 2 = 0 AS ran, CASE (conv_id + turn) % 5 WHEN 0 THEN body
    WHEN 1 THEN 'Here it is: ' || body || ' -- end' WHEN 2 THEN text WHEN 3 THEN '[1, 2]' ELSE '{{"other": 1}}' END AS content
  FROM (SELECT *, {JSON_TEXT} AS body FROM conversations))"""


def _answers(spark, sf):
    c, t = F.col("conv_id"), F.col("turn")
    say = lambda tool, finding: F.struct(F.lit(tool).alias("tool"), finding.alias("finding"))
    body = F.to_json(F.struct(
        F.when(c % 4 == 0, " High ").when(c % 4 == 1, "apocalyptic").otherwise("low").alias("severity"),
        F.col("text").alias("summary"), F.col("role").alias("likely_intent"),
        F.array(F.concat(F.lit("block "), c.cast("string")), F.lit(" "), F.lit("watch")).alias("recommended_actions"),
        F.array(say("detection", F.concat(F.lit("turn "), t.cast("string"))), say("ghost", F.lit("x")),
                say("ip_reputation", F.lit(" seen ")), say("detection", F.lit(""))).alias("evidence")))
    pick = (c + t) % 5
    content = (F.when(pick == 0, body).when(pick == 1, F.concat(F.lit("Here it is: "), body, F.lit(" -- end")))
               .when(pick == 2, F.col("text")).when(pick == 3, "[1, 2]").otherwise('{"other": 1}'))
    ran = F.when(c % 2 == 0, F.array(F.lit("ip_reputation"))).otherwise(F.array().cast("array<string>"))
    return views.table(spark, sf, "conversations").select((c * 1000 + t).alias("id"), content.alias("content"), ran.alias("executed"))


TRIAGE = f"WITH {ANSWERS}" + """
SELECT id, CASE WHEN conv_id % 4 = 0 THEN 'high' WHEN conv_id % 4 = 1 THEN 'unspecified' ELSE 'low' END AS severity, trim(text, E' \\n\\t\\r') AS summary,
  role AS likely_intent, 'block ' || conv_id || '|watch' AS actions,
  'detection=turn ' || turn || CASE WHEN ran THEN '|ip_reputation=seen' ELSE '' END AS evidence
FROM answers WHERE (conv_id + turn) % 5 IN (0, 1)"""


@query("triage_rows", TRIAGE)
def triage_rows(spark, sf):
    """Severity, actions and grounded evidence out of model answers."""
    said = F.transform("evidence", lambda e: F.concat(e["tool"], F.lit("="), e["finding"]))
    return cases.triage_rows(_answers(spark, sf)).select(
        "id", "severity", "summary", "likely_intent", joined(F.col("recommended_actions")).alias("actions"),
        joined(said).alias("evidence"))


@query("severity_levels", f"WITH {ANSWERS}" + """
SELECT CASE WHEN conv_id % 4 = 0 THEN 'high' WHEN conv_id % 4 = 1 THEN 'unspecified' ELSE 'low' END AS severity, count(*) AS answers
FROM answers WHERE (conv_id + turn) % 5 IN (0, 1) GROUP BY 1""")
def severity_levels(spark, sf):
    return cases.triage_rows(_answers(spark, sf)).groupBy("severity").agg(F.count("*").alias("answers"))


@query("grounded_evidence", f"WITH {ANSWERS}" + """
SELECT CASE WHEN ran THEN 'ip_reputation ran' ELSE 'nothing ran' END AS run, CAST(sum(CASE WHEN ran THEN 2 ELSE 1 END) AS BIGINT) AS kept
FROM answers WHERE (conv_id + turn) % 5 IN (0, 1) GROUP BY 1""")
def grounded_evidence(spark, sf):
    rows = cases.triage_rows(_answers(spark, sf))
    ran = F.when(F.floor(F.col("id") / 1000) % 2 == 0, "ip_reputation ran").otherwise("nothing ran")
    return rows.groupBy(ran.alias("run")).agg(F.sum(F.size("evidence")).alias("kept"))


# --- dossiers -----------------------------------------------------------------
CASES = """flagged AS (SELECT * FROM detections WHERE cnn_verdict = 'suspicious'),
ends AS (SELECT src_ip AS ip, detections.* FROM detections UNION ALL SELECT dst_ip, detections.* FROM detections WHERE dst_ip <> src_ip),
activity AS (SELECT ip, count(*) AS total_flows, count(*) FILTER (WHERE cnn_verdict = 'suspicious') AS suspicious_flows,
  count(DISTINCT dst_port) AS distinct_dst_ports FROM ends GROUP BY ip),
recent AS (SELECT ip, id, nth FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY timestamp DESC, id DESC) AS nth FROM ends) WHERE nth <= 20),
hist AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY timestamp DESC, id DESC) AS nth FROM flagged) WHERE nth <= 20),
totals AS (SELECT src_ip, count(*) AS total_suspicious FROM flagged GROUP BY 1),
lines AS (SELECT f.id AS case_id, h.id, h.timestamp, h.dst_ip, h.dst_port, h.technique_id, h.technique_name FROM flagged f JOIN hist h USING (src_ip)
  UNION SELECT id, id, timestamp, dst_ip, dst_port, technique_id, technique_name FROM flagged)"""
WITH = v.over("detections", extra=CASES)


def _cases(spark, sf, texts: bool = False):
    d = views.detections(spark, sf)
    rows = d.filter("cnn_verdict = 'suspicious'")
    if texts:
        body = F.to_json(F.struct(
            F.lit("high").alias("severity"), F.concat(F.lit("triaged "), F.col("id").cast("string")).alias("summary"),
            F.lit("probe").alias("likely_intent"), F.array(F.lit("a"), F.lit("b")).alias("recommended_actions")))
        rows = rows.withColumn("triage_json", F.when(F.col("id") % 3 == 0, body).when(F.col("id") % 3 == 1, "{corrupt"))
    return rows, d


def _dossiers(spark, sf, texts: bool = False):
    return cases.dossiers(*_cases(spark, sf, texts))


def _ids(items: Column) -> Column:
    return joined(F.transform(items, lambda x: x["id"]))


@query("dossiers", WITH + """
SELECT f.id, f.src_ip, coalesce(f.technique_id, 'none') AS technique, a.total_flows, a.suspicious_flows, a.distinct_dst_ports, t.total_suspicious,
  (SELECT string_agg(CAST(r.id AS VARCHAR), '|' ORDER BY r.nth) FROM recent r WHERE r.ip = f.src_ip) AS flow_ids,
  (SELECT string_agg(CAST(h.id AS VARCHAR), '|' ORDER BY h.nth) FROM hist h WHERE h.src_ip = f.src_ip) AS history_ids
FROM flagged f JOIN activity a ON a.ip = f.src_ip JOIN totals t USING (src_ip)""")
def dossiers(spark, sf):
    return _dossiers(spark, sf).select(
        "id", "detection.src_ip", F.coalesce("attribution.technique_id", F.lit("none")).alias("technique"),
        "activity.total_flows", "activity.suspicious_flows", "activity.distinct_dst_ports", "history.total_suspicious",
        _ids(F.col("activity.flows")).alias("flow_ids"), _ids(F.col("history.detections")).alias("history_ids"))


@query("related_flow_lists", WITH + "SELECT ip, string_agg(CAST(id AS VARCHAR), '|' ORDER BY nth) AS flow_ids FROM recent GROUP BY ip")
def related_flow_lists(spark, sf):
    return cases.related_flows(views.detections(spark, sf)).select("ip", _ids(F.col("flows")).alias("flow_ids"))


@query("case_timeline", WITH + """
SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY timestamp, id) AS place, id AS detection_id, id = case_id AS focal,
  'suspicious flow to ' || dst_ip || ':' || dst_port || CASE WHEN technique_id IS NOT NULL THEN ' attributed ' || technique_id || ' ' || technique_name
    ELSE ' (technique unattributed)' END AS event, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp FROM lines""")
def case_timeline(spark, sf):
    return _dossiers(spark, sf).select(F.col("id").alias("case_id"), F.posexplode("timeline").alias("place", "e")).select(
        "case_id", (F.col("place") + 1).cast("long").alias("place"), "e.detection_id", "e.focal", "e.event", "e.timestamp")


@query("case_indicators", WITH + """, own AS (SELECT case_id, string_agg(CAST(dst_port AS VARCHAR), ', ' ORDER BY dst_port) AS ports
  FROM (SELECT DISTINCT case_id, dst_port FROM lines) GROUP BY 1)
SELECT id, 'ipv4' AS type, src_ip AS value FROM flagged UNION ALL SELECT id, 'ipv4', dst_ip FROM flagged
UNION ALL SELECT case_id, 'dst_ports', ports FROM own
UNION ALL SELECT id, 'port_spread', CAST(distinct_dst_ports AS VARCHAR) FROM flagged JOIN activity ON ip = src_ip""")
def case_indicators(spark, sf):
    return _dossiers(spark, sf).select("id", F.explode("iocs").alias("i")).select("id", "i.type", "i.value")


@query("case_ports", WITH + """SELECT case_id AS id, string_agg(CAST(dst_port AS VARCHAR), ', ' ORDER BY dst_port) AS ports
FROM (SELECT DISTINCT case_id, dst_port FROM lines) GROUP BY 1""")
def case_ports(spark, sf):
    return _dossiers(spark, sf).select("id", F.explode("iocs").alias("i")).filter("i.type = 'dst_ports'").select(
        "id", F.col("i.value").alias("ports"))


@query("data_gaps", WITH + """SELECT id, array_to_string(list_filter([
  CASE WHEN id % 3 <> 0 THEN 'no triage has been run on this detection (agentic triage is operator-triggered)' END,
  CASE WHEN technique_id IS NULL THEN 'the Stage-2 attributor declined to name a technique for this flow (technique unattributed)' END,
  CASE WHEN rep_source = 'unknown' THEN 'no third-party reputation data was available for the source IP at classification time'
    WHEN abuse_score IS NULL THEN 'reputation source ''' || rep_source || ''' provides report counts, not a 0-100 abuse confidence score' END,
  CASE WHEN total_suspicious <= 1 THEN 'no prior suspicious detections from this source IP beyond this one' END], lambda g: g IS NOT NULL), '|') AS gaps
FROM flagged JOIN totals USING (src_ip)""")
def data_gaps(spark, sf):
    return _dossiers(spark, sf, True).select("id", joined(F.col("data_gaps")).alias("gaps"))


@query("cached_triage", WITH + """SELECT id, CASE WHEN id % 3 = 0 THEN 'high' END AS severity, CASE WHEN id % 3 = 0 THEN 'triaged ' || id END AS summary,
  CASE WHEN id % 3 = 0 THEN 'a|b' END AS actions FROM flagged""")
def cached_triage(spark, sf):
    return _dossiers(spark, sf, True).select("id", "triage.severity", "triage.summary",
                                             joined(F.col("triage.recommended_actions")).alias("actions"))


def _playbook_sql() -> str:
    from .. import fixed
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({quote(t)}, {quote(steps[0])}, {len(steps)})" for t, steps in fixed.PLAYBOOKS.items())


@query("technique_playbooks", WITH + f""", books(technique_id, first_step, steps) AS (VALUES {_playbook_sql()})
SELECT id, coalesce(first_step, 'Treat as unclassified suspicious activity: review the flow''s packet/byte profile and destination service.') AS first_step,
  coalesce(steps, 3) AS steps FROM flagged LEFT JOIN books USING (technique_id)""")
def technique_playbooks(spark, sf):
    return cases.with_playbook(_cases(spark, sf)[0]).select(
        "id", F.element_at("playbook", 1).alias("first_step"), F.size("playbook").alias("steps"))


@query("activity_summary", WITH + """SELECT f.id, total_flows, suspicious_flows, distinct_dst_ports, total_suspicious AS total_suspicious_detections
FROM flagged f JOIN activity ON ip = src_ip JOIN totals USING (src_ip)""")
def activity_summary(spark, sf):
    return cases.activity_summary(_dossiers(spark, sf))


# --- reports ------------------------------------------------------------------
def _narratives(rows):
    """Answers that cite the row itself, a repeat, a row never shown, and junk."""
    i = F.col("id").cast("string")
    body = F.concat(F.lit('{"severity": "HIGH", "executive_summary": " Case '), i, F.lit(' ", "narrative": "", '
                    '"recommended_actions": ["block | '), i, F.lit('", "  "], "cited_detections": [-5, '), i, F.lit(', "junk", "'), i,
                    F.lit('", 7000000000]}'))
    return rows.select("id", F.when(F.col("id") % 7 == 0, "no report here").otherwise(
        F.concat(F.lit("Sure: "), body)).alias("content"))


def _reports(spark, sf):
    rows, d = _cases(spark, sf, True)
    return cases.report_rows(cases.dossiers(rows, d), _narratives(rows), F.lit("2024-02-01 00:00:00").cast("timestamp"), "text-model")


@query("incident_reports", WITH + """SELECT id, 'Incident report: detection #' || id || ' -- ' || coalesce(technique_name, 'suspicious flow') || ' from ' || src_ip AS title,
  'high' AS severity, 'Case ' || id AS executive_summary, '' AS narrative, 'block | ' || id AS actions, CAST(id AS VARCHAR) AS cited,
  '2024-02-01 00:00:00Z' AS generated_at FROM flagged WHERE id % 7 <> 0""")
def incident_reports(spark, sf):
    return _reports(spark, sf).select(
        "id", "title", "severity", "executive_summary", "narrative", joined(F.col("recommended_actions")).alias("actions"),
        joined(F.col("cited_detections")).alias("cited"), "generated_at")


@query("report_markdown", WITH + """, n AS (SELECT case_id, count(*) AS events FROM lines GROUP BY 1)
SELECT id, '# Incident report: detection #' || id || ' -- ' || coalesce(technique_name, 'suspicious flow') || ' from ' || src_ip AS first_line,
  '| Source | ' || src_ip || ' |' AS source_line, '1. block | ' || id AS action_line,
  '- Recorded flows involving the source: ' || total_flows || ' (' || suspicious_flows || ' suspicious)' AS activity_line, events AS timeline_rows
FROM flagged JOIN activity ON ip = src_ip JOIN n ON case_id = id WHERE id % 7 <> 0""")
def report_markdown(spark, sf):
    """Markdown texts through their sink, then some of their lines."""
    path = scratch(spark, "reports")
    sinks.write_reports(cases.markdown(_reports(spark, sf)), path)
    lines = F.split("markdown", "\n")
    first = lambda start: F.element_at(F.filter(lines, lambda x: x.startswith(start)), 1)
    events = F.size(F.filter(lines, lambda x: x.rlike(r"^\| \d{4}-.*\| #")))
    return spark.read.parquet(path).select(
        "id", F.element_at(lines, 1).alias("first_line"), first("| Source |").alias("source_line"),
        first("1. ").alias("action_line"), first("- Recorded flows").alias("activity_line"), events.cast("long").alias("timeline_rows"))


@query("report_citations", WITH + """SELECT id AS report_id, id, coalesce(technique_id, 'none') AS technique_id, src_ip FROM flagged WHERE id % 7 <> 0""")
def report_citations(spark, sf):
    """Cited ids joined to the fields a citation shows."""
    cited = _reports(spark, sf).select(F.col("id").alias("report_id"), F.explode("cited_detections").alias("id"))
    return retrieval.citations(cited, views.detections(spark, sf)).select(
        "report_id", "id", F.coalesce("technique_id", F.lit("none")).alias("technique_id"), "src_ip")


@query("markdown_cells", "SELECT page_id, replace(coalesce(url, '—'), '|', '\\|') || replace(html, '|', '\\|') AS cell FROM pages")
def markdown_cells(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", F.concat(text.cell(F.col("url")), text.cell(F.col("html"))).alias("cell"))
