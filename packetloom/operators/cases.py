"""Case files: what is known about each suspicious detection."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import parsed, text
from . import reads
from .retrieval import grounded

DETECTION_FIELDS = [
    "id", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "cnn_verdict", "cnn_confidence",
    "country", "duration_s", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes", "summary",
    "attack_family", "technique_id", "technique_name", "tactic", "abuse_score", "rep_reports",
    "rep_source", "timestamp",
]
TRIAGE_KEYS = ["summary", "severity"]
NARRATIVE_KEYS = ["executive_summary"]


def playbook_table(spark) -> DataFrame:
    return spark.createDataFrame(list(fixed.PLAYBOOKS.items()), "technique_id string, playbook array<string>")


def with_playbook(rows: DataFrame) -> DataFrame:
    """Add the response steps of the technique; generic steps where it has none."""
    generic = F.array(*[F.lit(s) for s in fixed.GENERIC_PLAYBOOK])
    out = rows.join(F.broadcast(playbook_table(rows.sparkSession)), "technique_id", "left")
    return out.withColumn("playbook", F.coalesce("playbook", generic))


# --- per-source tables --------------------------------------------------------
def related_flows(detections: DataFrame, n: int = fixed.REPORT_ROWS) -> DataFrame:
    """ip, flows: the n newest flows with the address on either side, newest first."""
    item = F.struct("nth", *reads.FLOW_COLUMNS)
    return reads.flows_by_ip(detections, n).groupBy("ip").agg(F.sort_array(F.collect_list(item)).alias("flows"))


def suspicious_history(detections: DataFrame, n: int = fixed.REPORT_ROWS) -> DataFrame:
    """src_ip, history: the n newest suspicious detections of the source, newest first."""
    item = F.struct("nth", *reads.HISTORY_COLUMNS)
    return reads.history_by_source(detections, n).groupBy("src_ip").agg(
        F.sort_array(F.collect_list(item)).alias("history"))


def source_table(detections: DataFrame, sources: DataFrame, n: int = fixed.REPORT_ROWS) -> DataFrame:
    """One row per source of interest: totals, newest flows, suspicious history."""
    who = sources.select(F.col("src_ip").alias("ip")).distinct()
    ends = reads.endpoints(detections, sorted({*reads.FLOW_COLUMNS})).join(who, "ip", "left_semi")
    ports = ends.groupBy("ip", "dst_port").agg(F.count("*").alias("n"), F.count_if(reads.suspicious()).alias("s"))
    totals = ports.groupBy("ip").agg(F.sum("n").alias("total_flows"), F.sum("s").alias("suspicious_flows"),
                                     F.count("dst_port").alias("distinct_dst_ports"))
    item = F.struct("nth", *reads.FLOW_COLUMNS)
    newest = reads.recent_by(ends, "ip", n).groupBy("ip").agg(F.sort_array(F.collect_list(item)).alias("flows"))
    history = suspicious_history(detections, n).withColumnRenamed("src_ip", "ip")
    count = reads.suspicious_totals(detections).withColumnRenamed("src_ip", "ip")
    return totals.join(newest, "ip").join(history, "ip", "left").join(count, "ip", "left")


# --- parts of a dossier -------------------------------------------------------
def _event(dst_ip: Column, dst_port: Column, technique: Column, name: Column) -> Column:
    named = F.when(F.coalesce(technique, F.lit("")) != "", F.concat(
        F.lit(" attributed "), technique, F.lit(" "), text.show(name))).otherwise(" (technique unattributed)")
    return F.concat(F.lit("suspicious flow to "), text.endpoint(dst_ip, dst_port), named)


def timeline(history: Column) -> Column:
    """History events and the focal row, by time text and id, with the focal mark."""
    def entry(h, focal: Column) -> Column:
        return F.struct(text.stamp(h["timestamp"]).alias("timestamp"), h["id"].alias("detection_id"),
                        _event(h["dst_ip"], h["dst_port"], h["technique_id"], h["technique_name"]).alias("event"),
                        focal.alias("focal"))
    past = F.transform(history, lambda h: entry(h, h["id"] == F.col("id")))
    me = {c: F.col(c) for c in ("timestamp", "id", "dst_ip", "dst_port", "technique_id", "technique_name")}
    known = F.exists(history, lambda h: h["id"] == F.col("id"))
    return F.sort_array(F.when(known, past).otherwise(F.concat(past, F.array(entry(me, F.lit(True))))))


def ioc_ports(history: Column) -> Column:
    """Sorted distinct destination ports of the suspicious history and of the row itself."""
    seen = F.transform(history, lambda h: h["dst_port"])
    own = F.array(F.col("dst_port"))
    return F.array_sort(F.filter(F.array_union(seen, own), lambda p: p.isNotNull()))


def iocs(history: Column, spread: Column) -> Column:
    def item(kind: str, value: Column, role: str, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"),
                                     F.lit(role).alias("role")))
    ports = ioc_ports(history)
    listed = F.array_join(F.transform(ports, lambda p: p.cast("string")), ", ")
    items = F.array(
        item("ipv4", F.col("src_ip"), fixed.ROLE_SOURCE, F.lit(True)),
        item("ipv4", F.col("dst_ip"), fixed.ROLE_TARGET, F.coalesce(F.col("dst_ip"), F.lit("")) != ""),
        item("dst_ports", listed, fixed.ROLE_PORTS, F.size(ports) > 0),
        item("port_spread", spread, fixed.ROLE_SPREAD,
             F.coalesce(spread, F.lit(0)) > 0))
    return F.filter(items, lambda i: i.isNotNull())


def data_gaps(triage: Column, total_suspicious: Column) -> Column:
    source = F.col("rep_source")
    blind = source.isNull() | (source == "unknown")
    return F.filter(F.array(
        F.when(triage.isNull(), fixed.GAP_TRIAGE),
        F.when(F.col("technique_id").isNull(),
               fixed.GAP_TECHNIQUE),
        F.when(blind, fixed.GAP_REPUTATION)
        .when(F.col("abuse_score").isNull(), F.concat(
            F.lit("reputation source '"), source, F.lit("' provides report counts, not a 0-100 abuse confidence score"))),
        F.when(F.coalesce(total_suspicious, F.lit(0)) <= 1,
               fixed.GAP_HISTORY),
    ), lambda g: g.isNotNull())


def stored_triage(body: Column) -> Column:
    """Cached triage text as a struct; NULL when there is none or it is corrupt."""
    def field(name: str) -> Column:
        return F.get_json_object(body, f"$.{name}")
    valid = F.json_object_keys(body).isNotNull()
    return F.when(valid, F.struct(
        field("severity").alias("severity"), field("summary").alias("summary"),
        field("likely_intent").alias("likely_intent"),
        F.from_json(field("recommended_actions"), "array<string>").alias("recommended_actions"),
        F.from_json(field("evidence"), "array<struct<tool:string,finding:string>>").alias("evidence"),
        field("generated_at").alias("generated_at")))


def dossiers(cases: DataFrame, detections: DataFrame, n: int = fixed.REPORT_ROWS) -> DataFrame:
    """One dossier per case row (suspicious detections), all at once.

    The per-source table is made once per source, with at most n rows per list, and
    then joined; a source with many cases is split by AQE on the case side.
    """
    sources = source_table(detections, cases, n)
    rows = cases if "triage_json" in cases.columns else cases.withColumn("triage_json", F.lit(None).cast("string"))
    rows = with_playbook(rows).join(sources.withColumnRenamed("ip", "src_ip"), "src_ip", "left")
    empty = F.array().cast(sources.schema["history"].dataType)
    rows = rows.withColumn("history", F.coalesce("history", empty))
    history = F.col("history")
    return rows.select(
        "id", F.struct(*DETECTION_FIELDS).alias("detection"),
        F.struct("technique_id", "technique_name", "tactic", "attack_family", "playbook").alias("attribution"),
        stored_triage(F.col("triage_json")).alias("triage"),
        F.struct("abuse_score", F.col("rep_reports").alias("reports"), F.col("rep_source").alias("source")).alias("reputation"),
        F.struct(F.transform("flows", lambda f: f.dropFields("nth")).alias("flows"), "total_flows", "suspicious_flows",
                 "distinct_dst_ports").alias("activity"),
        F.struct(F.transform(history, lambda h: h.dropFields("nth")).alias("detections"),
                 F.coalesce("total_suspicious", F.lit(0)).alias("total_suspicious")).alias("history"),
        timeline(history).alias("timeline"), iocs(history, F.col("distinct_dst_ports")).alias("iocs"),
        data_gaps(stored_triage(F.col("triage_json")), F.col("total_suspicious")).alias("data_gaps"))


def dossier_ids() -> Column:
    """Ids that a report on this dossier may cite."""
    return F.array_union(F.array_union(F.array("detection.id"), F.transform("activity.flows", lambda f: f["id"])),
                         F.transform("history.detections", lambda h: h["id"]))


def activity_summary(rows: DataFrame) -> DataFrame:
    return rows.select("id", "activity.total_flows", "activity.suspicious_flows", "activity.distinct_dst_ports",
                       F.col("history.total_suspicious").alias("total_suspicious_detections"))


# --- texts to report rows -----------------------------------------------------
def evidence(body: Column, executed: Column) -> Column:
    """Evidence whose tool ran (or is 'detection') and that says something."""
    items = F.from_json(F.get_json_object(body, "$.evidence"), "array<string>")
    allowed = F.array_union(executed, F.array(F.lit("detection")))

    def field(i: Column, name: str) -> Column:
        return F.get_json_object(i, f"$.{name}")
    found = F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda i: F.struct(
        field(i, "tool").alias("tool"),
        F.trim(F.coalesce(F.nullif(field(i, "finding"), F.lit("")), field(i, "detail"), F.lit(""))).alias("finding")))
    return F.filter(found, lambda e: F.coalesce(F.array_contains(allowed, e["tool"]), F.lit(False)) & (e["finding"] != ""))


def _text(body: Column, name: str) -> Column:
    return F.trim(F.coalesce(F.get_json_object(body, f"$.{name}"), F.lit("")))


def triage_rows(texts: DataFrame) -> DataFrame:
    """Triage reports from texts (id, content, executed); texts without a report are dropped."""
    rows = texts.withColumn("body", parsed.object_text(F.col("content"), TRIAGE_KEYS)).filter("body is not null")
    body = F.col("body")
    return rows.select(
        "id", F.lit(fixed.TRIAGE_LABEL).alias("label"), text.severity(_text(body, "severity")).alias("severity"),
        _text(body, "summary").alias("summary"), _text(body, "likely_intent").alias("likely_intent"),
        parsed.string_items(body, "recommended_actions").alias("recommended_actions"),
        evidence(body, F.col("executed")).alias("evidence"))


def report_rows(dossier: DataFrame, texts: DataFrame, generated_at: Column | None = None,
                model: str = "unspecified") -> DataFrame:
    """Reports from dossiers and narrative texts (id, content).

    Facts come from the dossier; from the text come the summary, the narrative, the
    severity, the actions, and only those citations that are in the dossier.
    """
    told = texts.select("id", parsed.object_text(F.col("content"), NARRATIVE_KEYS).alias("body")).filter("body is not null")
    rows = dossier.join(told, "id")
    body = F.col("body")
    cited = F.coalesce(F.from_json(F.get_json_object(body, "$.cited_detections"), "array<string>"),
                       F.array().cast("array<string>"))
    at = generated_at if generated_at is not None else F.current_timestamp()
    title = F.concat(F.lit("Incident report: detection #"), F.col("id").cast("string"), F.lit(" -- "),
                     F.coalesce("detection.technique_name", F.lit("suspicious flow")), F.lit(" from "),
                     text.show(F.col("detection.src_ip")))
    return rows.select(
        "id", F.lit(fixed.REPORT_LABEL).alias("label"), title.alias("title"),
        text.severity(_text(body, "severity")).alias("severity"),
        _text(body, "executive_summary").alias("executive_summary"), _text(body, "narrative").alias("narrative"),
        parsed.string_items(body, "recommended_actions").alias("recommended_actions"),
        grounded(cited, dossier_ids()).alias("cited_detections"), "detection",
        F.col("attribution").alias("attack_mapping"), "reputation", "triage",
        F.struct("activity.total_flows", "activity.suspicious_flows", "activity.distinct_dst_ports",
                 F.col("history.total_suspicious").alias("total_suspicious_detections")).alias("activity_summary"),
        "timeline", "iocs", "data_gaps", F.lit(model).alias("model"), text.utc_stamp(at).alias("generated_at"))


# --- Markdown -----------------------------------------------------------------
def markdown(reports: DataFrame, sender: str = "packetloom") -> DataFrame:
    """Reports as Markdown documents: id, markdown."""
    d, dash = F.lit(text.DASH), text.DASH

    def det(name: str) -> Column:
        return F.col(f"detection.{name}")

    def rows_of(items: Column, line) -> Column:
        return F.array_join(F.transform(items, line), "\n")

    def or_dash(c: Column) -> Column:
        return F.coalesce(F.nullif(c, F.lit("")), d)

    def pair(a: str, b: str) -> Column:
        return F.concat(text.show(det(a)), F.lit(" / "), text.show(det(b)))

    fields = [
        ("Detection id", det("id")), ("Verdict", det("cnn_verdict")), ("Confidence", det("cnn_confidence")),
        ("Source", det("src_ip")), ("Destination", det("dst_ip")), ("Destination port", det("dst_port")),
        ("Protocol", det("proto")), ("Country", det("country")), ("Duration (s)", det("duration_s")),
        ("Packets fwd/bwd", pair("fwd_packets", "bwd_packets")), ("Bytes fwd/bwd", pair("fwd_bytes", "bwd_bytes")),
        ("Timestamp", text.stamp(det("timestamp"))),
    ]
    facts = [F.concat(F.lit(f"| {name} | "), text.cell(value), F.lit(" |")) for name, value in fields]
    m, act, rep, tri = "attack_mapping", "activity_summary", "reputation", "triage"
    technique = F.rtrim(F.concat(F.lit("- **Technique:** "), F.coalesce(f"{m}.technique_id", F.lit("unattributed")),
                                 F.lit(" "), F.coalesce(f"{m}.technique_name", F.lit(""))))
    ioc = rows_of(F.col("iocs"), lambda i: F.concat(
        F.lit("| "), text.cell(i["type"]), F.lit(" | "), text.cell(i["value"]), F.lit(" | "), text.cell(i["role"]), F.lit(" |")))
    events = rows_of(F.col("timeline"), lambda e: F.concat(
        F.lit("| "), text.cell(e["timestamp"]), F.lit(" | #"), text.cell(e["detection_id"]),
        F.when(e["focal"], " **(this report)**").otherwise(""), F.lit(" | "), text.cell(e["event"]), F.lit(" |")))
    reputation = F.when(F.coalesce(f"{rep}.source", F.lit("")) != "", F.concat_ws(
        "\n", F.concat(F.lit("- Source: "), F.col(f"{rep}.source")),
        F.concat(F.lit("- Abuse confidence score: "),
                 text.show(F.col(f"{rep}.abuse_score"), f"{dash} (source provides report counts only)")),
        F.concat(F.lit("- Reports: "), text.show(F.col(f"{rep}.reports"), dash)))).otherwise(
        "No third-party reputation data was available for the source IP at classification time.")
    triage = F.when(F.col(tri).isNotNull(), F.concat_ws("\n", *[
        F.concat(F.lit(f"- {name}: "), text.show(F.col(f"{tri}.{key}")))
        for name, key in (("Severity", "severity"), ("Summary", "summary"), ("Likely intent", "likely_intent"),
                          ("Generated", "generated_at"))])).otherwise("No triage has been run on this detection.")
    actions = or_dash(F.array_join(F.transform("recommended_actions", lambda a, i: F.concat(
        (i + 1).cast("string"), F.lit(". "), a)), "\n"))
    cites = or_dash(F.array_join(F.transform("cited_detections", lambda c: F.concat(F.lit("#"), c.cast("string"))), ", "))
    gaps = F.when(F.size("data_gaps") > 0, rows_of(F.col("data_gaps"), lambda g: F.concat(F.lit("- "), g))).otherwise("- none")

    def section(name: str) -> list[Column]:
        return [F.lit(""), F.lit(f"## {name}"), F.lit("")]

    def count(name: str) -> Column:
        return text.show(F.col(f"{act}.{name}"), dash)

    def table(head: str, body: Column, has: Column) -> list[Column]:
        width = head.count("|") - 1
        return [F.lit(head), F.lit("|" + "---|" * width), F.when(has, body)]

    lines = [
        F.concat(F.lit("# "), F.col("title")), F.lit(""),
        F.concat(F.lit("> **"), F.col("label"), F.lit("** · severity: **"), F.col("severity"), F.lit("** · generated "),
                 F.col("generated_at"), F.lit(" · model `"), F.col("model"), F.lit("`")),
        *section("Executive summary"), or_dash(F.col("executive_summary")),
        *section("Narrative"), or_dash(F.col("narrative")),
        *section("Detection"), F.lit("| Field | Value |"), F.lit("|---|---|"), *facts,
        *section("MITRE ATT&CK mapping"), technique,
        F.concat(F.lit("- **Tactic:** "), F.coalesce(f"{m}.tactic", d)),
        F.concat(F.lit("- **Attack family (Stage-2 attributor):** "), F.coalesce(f"{m}.attack_family", F.lit("unattributed"))),
        *section("Indicators (IOCs)"), *table("| Type | Value | Role |", ioc, F.size("iocs") > 0),
        *section("Timeline"), *table("| Time (UTC) | Detection | Event |", events, F.size("timeline") > 0),
        *section("Source IP activity"),
        F.concat(F.lit("- Recorded flows involving the source: "), count("total_flows"), F.lit(" ("),
                 count("suspicious_flows"), F.lit(" suspicious)")),
        F.concat(F.lit("- Distinct destination ports touched: "), count("distinct_dst_ports")),
        F.concat(F.lit("- Total suspicious detections from the source: "), count("total_suspicious_detections")),
        *section("Third-party reputation"), reputation,
        *section("Prior AI triage"), triage,
        *section("Recommended actions (advisory)"), actions,
        *section("Source detections cited"), cites,
        *section("Known data gaps"), gaps,
        F.lit(""), F.lit("---"),
        F.concat(F.lit("*"), F.col("label"), F.lit(f" {dash} synthesized from aggregated {sender} data; "
                 "factual sections are built directly from database rows.*")), F.lit("")]
    return reports.select("id", F.concat_ws("\n", *lines).alias("markdown"))
