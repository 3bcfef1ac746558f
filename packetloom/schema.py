"""Row shapes shared by the operators, as DDL strings."""

PACKET = (
    "seq long, ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, "
    "proto int, payload_len int, syn boolean, rst boolean, fin boolean, ack boolean"
)
TELEMETRY = (
    "id long, ip string, country string, lat double, lon double, summary string, "
    "blacklisted string, attacks long, reports long, timestamp timestamp, "
    "abuse_score int, rep_source string"
)
DETECTION_BASE = (
    "id long, src_ip string, dst_ip string, src_port int, dst_port int, proto int, "
    "cnn_verdict string, cnn_confidence double, country string, lat double, lon double, "
    "duration_s double, fwd_packets long, bwd_packets long, fwd_bytes long, bwd_bytes long, "
    "summary string, timestamp timestamp"
)
DETECTION_ADDED = {
    "0002_detection_attribution":
        "attack_family string, technique_id string, technique_name string, tactic string",
    "0003_detection_triage": "triage_json string, triage_at timestamp",
    "0004_reputation_scores": "abuse_score int, rep_reports long, rep_source string",
    "0005_detection_report": "report_json string, report_at timestamp",
}
DETECTION = ", ".join([DETECTION_BASE, *DETECTION_ADDED.values()])
LOG = "id long, timestamp timestamp, log string"
METRIC = "id long, timestamp timestamp, cpu double, memory double, disk double, network long"
LEDGER = "name string, applied_at timestamp"


def names(ddl: str) -> list[str]:
    """Column names of a DDL string, in order."""
    out, rest = [], ddl
    for part in rest.split(", "):
        out.append(part.rsplit(" ", 1)[0].strip("`"))
    return out
