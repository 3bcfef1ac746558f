"""Enrichment, alerts, reads, monitors and texts on literal rows."""
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from packetloom import fixed, schema
from packetloom.functions import net, parsed, text
from packetloom.operators import alerts, cases, enrich, evaluate, joins, migrate, monitor, prepare, reads, retrieval, scoring
from packetloom.sources import readers, sinks

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(s):
    return T0 + timedelta(seconds=s)


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("ip,public", [
    ("8.8.8.8", True), ("127.0.0.1", False), ("10.0.0.5", False), ("192.168.1.1", False), ("::1", False), ("172.15.0.1", True),
    ("172.16.0.1", False), ("172.31.9.9", False), ("172.32.0.1", True), ("100.64.0.1", True), ("224.0.0.1", True), ("192.0.0.9", True),
    ("192.0.0.8", False), ("198.17.0.1", True), ("198.19.0.1", False), ("240.0.0.1", False), ("255.255.255.255", False), ("0.1.2.3", False),
    ("01.2.3.4", False), ("1.2.3", False), ("1.2.3.256", False), ("144.76.114.3", False), ("159.89.102.253", False), (None, False), ("x", False),
])
def test_enrichable(spark, ip, public):
    assert one(spark, ip, net.is_enrichable) is public


@pytest.mark.parametrize("ip,valid", [
    ("::1", True), ("::", True), ("fe80::1%eth0", True), ("2001:db8::8:800:200c:417a", True), ("1:2:3:4:5:6:7:8", True),
    ("1:2:3:4:5:6:7", False), ("1::2::3", False), (":::", False), ("12345::", False), ("::ffff:1.2.3.4", True), ("1.2.3.4", True),
    (":1:2:3:4:5:6:7", False), ("", False), (None, False), ("g::1", False),
])
def test_valid_ip(spark, ip, valid):
    assert one(spark, ip, net.is_ip) is valid


def test_geo_records(spark):
    raw = spark.createDataFrame([("a", "Singapore", None, None, "1.3", "103.8"), ("b", "", "X", "Y", "Not found", "Not found"),
                                 ("c", "P", "Q", "R", "NaN", "5")],
                                "ip string, country_name string, city string, state string, latitude string, longitude string")
    got = {r.ip: (r.country, r.lat, r.lon) for r in enrich.geo_records(raw).collect()}
    assert got == {"a": ("Singapore, Unknown, Unknown", 1.3, 103.8), "b": ("Unknown, X, Y", None, None), "c": ("P, Q, R", None, 5.0)}


def answers(spark):
    a = spark.createDataFrame([("9.9.9.1", 200, '{"data": {"abuseConfidenceScore": 80, "totalReports": 12}}'),
                               ("9.9.9.2", 429, ""), ("9.9.9.3", 200, '{"data": {"abuseConfidenceScore": 49}}'),
                               ("9.9.9.4", 200, '{"data": {"abuseConfidenceScore": 50}}'), ("9.9.9.5", 500, "")],
                              "ip string, status int, body string")
    b = spark.createDataFrame([("9.9.9.2", 200, '{"attacks": 3, "reports": 4}'), ("9.9.9.5", 503, "")],
                              "ip string, status int, body string")
    return enrich.scored_source(a), enrich.count_source(b)


@pytest.mark.parametrize("small,heavy", [(200_000, 5_000_000), (0, 5_000_000), (0, 2)])
def test_reputation_fallback(spark, small, heavy, monkeypatch):
    plain = joins.lookup
    monkeypatch.setattr(enrich, "lookup", lambda r, t, on: plain(r, t, on, heavy, small))
    ips = ["9.9.9.1"] * 4 + ["9.9.9.2", "9.9.9.3", "9.9.9.4", "9.9.9.5", "9.9.9.6", "10.0.0.1"]
    rows = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "id int, src_ip string")
    out = enrich.with_reputation(rows, *answers(spark)).collect()
    got = {r.src_ip: (r.rep.source, r.rep.blacklisted, r.rep.attacks, r.rep.reports, r.rep.abuse_score) for r in out}
    assert len(out) == 10
    assert got == {
        "9.9.9.1": ("abuseipdb", True, 0, 12, 80), "9.9.9.2": ("blocklist.de", True, 3, 4, None),
        "9.9.9.3": ("abuseipdb", False, 0, 0, 49), "9.9.9.4": ("abuseipdb", True, 0, 0, 50),
        "9.9.9.5": ("unknown", False, 0, 0, None), "9.9.9.6": ("unknown", False, 0, 0, None), "10.0.0.1": ("none", False, 0, 0, None)}


def test_lookup_demand(spark):
    rows = [("8.8.8.8", at(t), i) for i, t in enumerate([0, 1, 899, 900, 901, 1799.5, 1800])] + [("10.0.0.1", at(0), 99)]
    got = enrich.lookup_demand(spark.createDataFrame(rows, "ip string, ts timestamp, seq long"), 900).collect()
    assert [(r.ip, r.requests, r.misses, r.hits) for r in got] == [("8.8.8.8", 7, 3, 4)]


def test_verdict_and_attribution(spark):
    rows = spark.createDataFrame([(1, 0.95, [0.4, 0.4, 0.2]), (2, 0.9499, [1.0, 0.0, 0.0]), (3, 0.99, [0.1, 0.1, 0.8]), (4, 0.99, [0.29, 0.29, 0.28])],
                                 "flow_id int, p double, family_probs array<double>")
    out = scoring.attribute(scoring.judge(rows.withColumnRenamed("p", "probability")), ["ddos", "dos", "other"])
    got = {r.flow_id: (r.cnn_verdict, r.cnn_confidence, r.attack_family, r.technique_id, r.technique_name) for r in out.collect()}
    assert got == {1: ("suspicious", 0.95, "ddos", "T1498", "Network Denial of Service"), 2: ("normal", 0.0501, None, None, None),
                   3: ("suspicious", 0.99, None, None, "technique unattributed"), 4: ("suspicious", 0.99, None, None, "technique unattributed")}


ALERT = ("ts timestamp, id long, verdict string, confidence double, src_ip string, technique_id string, technique_name string, "
         "tactic string, abuse_score int, rep_source string, summary string")


def alert_rows(spark, rows):
    return spark.createDataFrame([(at(t), i, v, c, ip, tech, "n", "t", abuse, "abuseipdb", "s") for i, (t, v, c, ip, tech, abuse) in enumerate(rows)], ALERT)


@pytest.mark.parametrize("limit", [50_000, 0])
def test_alerts(spark, limit):
    s = "suspicious"
    rows = [(0, s, .999, "a", "T1", 90), (1, "normal", .999, "a", "T1", 90), (2, s, .90, "a", "T1", 90), (3, s, .999, "a", "T1", 10),
            (4, s, .999, "a", "T1", None), (5, s, .5, "b", "T2", None), (6, s, .5, "c", "T2", None), (7, s, .999, "a", None, None),
            (299, s, .999, "a", "T1", 90), (299, s, .999, "b", "T1", 90), (300, s, .999, "a", "T1", 90), (301, s, .999, "z", None, 50), (302, s, .999, "z", None, 50)]
    out = alerts.alerts(alert_rows(spark, rows), group_rows=limit)
    assert sorted((r.id, r.trigger) for r in out.collect()) == [
        (0, "corroborated"), (5, "new-technique"), (9, "corroborated"), (10, "corroborated"), (11, "corroborated")]
    first = alerts.payloads(out).filter("id = 0").first()
    assert first.text == ("[packetloom] CRITICAL: suspicious flow from a (T1 n) -- ML verdict corroborated by third-party reputation. "
                          "confidence=0.999, abuse_score=90")
    assert first.alert.reputation.source == "abuseipdb" and first.alert.timestamp == "2024-01-01 00:00:00Z"


def detections(spark, rows):
    base = spark.createDataFrame(rows, "id long, src_ip string, dst_ip string, dst_port int, cnn_verdict string, country string, lat double, "
                                       "lon double, technique_id string, technique_name string, abuse_score int, rep_reports long, rep_source string, timestamp timestamp")
    return sinks.shaped(base, schema.DETECTION)


def test_reads(spark):
    paris, tokyo = ("France, Paris, X", 48.85, 2.35), ("Japan, Tokyo, Y", 35.68, 139.69)
    rows = [(1, "a", "z", 80, "suspicious", *paris, None, None, None, None, None, at(0)),
            (2, "a", "z", 81, "normal", *paris, None, None, None, None, None, at(0)),
            (3, "b", "z", 80, "normal", "France, Paris, X", 48.86, 2.36, None, None, None, None, None, at(0)),
            (4, "b", "b", 82, "normal", *tokyo, None, None, None, None, None, at(1)),
            (5, "c", "z", 80, "normal", "Internal", None, None, None, None, None, None, None, at(2))]
    d = detections(spark, rows)
    points = reads.threat_map(d).collect()
    assert [(p.lat, p.lon, p["count"], p.suspicious_count, p.worst_verdict) for p in points] == [
        (48.9, 2.4, 3, 1, "suspicious"), (35.7, 139.7, 1, 0, "normal")]
    pages = [[r.id for r in reads.feed(d, n, 2).collect()] for n in (1, 2, 3)]
    assert pages == [[5, 4], [3, 2], [1]]
    assert [r.id for r in reads.page_after(d, at(1), 4, 2).collect()] == [3, 2]
    assert [reads.within(x, 50, 500) for x in (10000, "junk", -5, None, "70", 0, "500", "501")] == [500, 50, 1, 50, 70, 1, 500, 500]
    assert [reads.within(x, 1) for x in (-5, "x", 10_000, " 3 ")] == [1, 1, 10_000, 3]
    act = {r.ip: (r.total_flows, r.suspicious_flows, r.distinct_dst_ports) for r in reads.ip_activity(d).collect()}
    assert act == {"a": (2, 1, 2), "b": (2, 0, 2), "c": (1, 0, 1), "z": (4, 1, 2)}
    assert reads.coverage_totals(d).first().asDict() == {"attributed": 0, "unattributed": 1}


def test_rate(spark):
    rows = [("s", float(t), 100 * t) for t in range(6)] + [("one", 1.0, 5), ("stall", 1.0, 5), ("stall", 1.0, 9)]
    rows += [("long", float(t), 7 * t * t) for t in range(100)]
    df = spark.createDataFrame(rows, "source string, t double, counter long")
    for width in (3600.0, 7.0):
        got = {(r.source, r.t, r.counter): r.rate for r in monitor.trailing_rate(df, slice_s=width).collect()}
        assert got["s", 5.0, 500] == 100.0 and got["s", 0.0, 0] == 0.0 and got["one", 1.0, 5] == 0.0 and got["stall", 1.0, 9] == 0.0
        assert got["long", 99.0, 7 * 99 * 99] == pytest.approx(7 * (99 ** 2 - 68 ** 2) / 31)


def test_login_bursts(spark):
    times = [0, 1, 2, 3, 4, 5, 6, 300, 300.5, 301, 600, 1000]
    rows = [("a", int(t * 1e6), i, False) for i, t in enumerate(times)]
    rows += [("b", int(t * 1e6), 100 + t, t == 3) for t in range(8)]
    got = monitor.login_attempts(spark.createDataFrame(rows, "address string, us long, seq long, success boolean"))
    blocked = sorted(r.seq for r in got.filter("blocked").collect())
    # a: the failures at 0..4 block until the first is more than 300 s old; the one at 300.5 then makes five
    # again, until that at 1 s is too old. b: the success at 3 clears.
    assert blocked == [5, 6, 7, 9]


def test_texts(spark):
    assert one(spark, "Web  Attack –\tXSS ", text.clean_label) == "Web Attack - XSS"
    assert one(spark, "Singapore, None, unknown", text.clean_place) == "Singapore"
    assert one(spark, "None, Not found,", text.clean_place) == "unknown"
    assert one(spark, None, text.cell) == "—" and one(spark, "a|b", text.cell) == "a\\|b"
    assert one(spark, " CRITICAL ", text.severity) == "critical" and one(spark, "apocalyptic", text.severity) == "unspecified"
    assert one(spark, 0.125, text.two_digits, "double") == "0.12"
    assert one(spark, "What came FROM 131.203.88.83? a T1046 scan", text.tokens) == ["came", "131.203.88.83", "t1046", "scan"]
    assert one(spark, "hit 1.2.3.4 then 5.6.7.8", net.first_ipv4) == "1.2.3.4"
    needs = lambda c: parsed.object_text(c, ["answer"])
    assert one(spark, 'x {"answer": 1} y', needs) == '{"answer": 1}'
    assert [one(spark, v, needs) for v in ("", None, "[1]", '{"other": 1}', "} {")] == [None] * 5
    cited = spark.createDataFrame([(["1", "2", "999999", "junk", "2", None],)], "c array<string>")
    allowed = F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)])
    assert cited.select(retrieval.grounded(F.col("c"), allowed).alias("g")).first().g == [1, 2]


def test_two_digits_round_as_the_sql_does(spark):
    """Durations that end in 5 ms, of every size up to four days, and two that differ by the way of rounding."""
    import duckdb
    us = [1_015_000, 1_005_000, *range(5_000, 3_000_000, 10_000), *range(345_000_005_000, 345_003_000_000, 10_000), *range(0, 9_000_000, 7_919)]
    sql = "SELECT CAST(CAST(round_even(us / 1000000.0, 2) AS DECIMAL(18,2)) AS VARCHAR) FROM (SELECT unnest(?) AS us)"
    wanted = [r[0] for r in duckdb.execute(sql, [us]).fetchall()]
    rows = spark.createDataFrame(list(enumerate(us)), "i long, us long").select("i", text.two_digits(F.col("us") / 1e6).alias("t"))
    assert [r.t for r in rows.orderBy("i").collect()] == wanted
    assert wanted[0] == "1.01"


def test_search(spark):
    rows = [(1, "131.203.88.83", "x", 80, "suspicious", "New Zealand", 0.0, 0.0, "T1046", "Network Service Discovery port scan", None, None, None, at(0)),
            (2, "59.246.32.135", "x", 80, "suspicious", "China", 0.0, 0.0, "T1499", "Endpoint Denial of Service", None, None, None, at(0)),
            (3, "8.8.8.8", "x", 443, "normal", "Germany", 0.0, 0.0, None, None, None, None, None, at(0))]
    docs = retrieval.incident_documents(detections(spark, rows))
    asked = ["any denial of service activity?", "what do we know about 131.203.88.83?", "port scan discovery from new zealand",
             "croissant recipe ingredients butter", "the and of"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    for bound in (100, 0):
        best = {r.query_id: r.doc_id for r in retrieval.search_text(docs, q, 1, bound).collect()}
        assert best == {0: 2, 1: 1, 2: 1}


def test_dossier(spark):
    who = "203.0.113.7"
    rows = [(1, who, "192.0.2.10", 80, "suspicious", "c", None, None, "T1498", "Network Denial of Service", 88, 17, "abuseipdb", at(0)),
            (2, who, "192.0.2.10", 443, "suspicious", "c", None, None, "T1498", "Network Denial of Service", 88, 17, "abuseipdb", at(5)),
            (3, who, "192.0.2.10", 80, "normal", "c", None, None, None, None, 88, 17, "abuseipdb", at(6)),
            (4, "198.51.100.9", "192.0.2.11", 22, "suspicious", "c", None, None, None, None, None, None, None, at(7))]
    d = detections(spark, rows)
    made = cases.dossiers(d.filter("cnn_verdict = 'suspicious'"), d)
    got = {r.id: r for r in made.collect()}
    a = got[1]
    assert (a.activity.total_flows, a.activity.suspicious_flows, a.history.total_suspicious) == (3, 2, 2)
    assert [(e.detection_id, e.focal) for e in a.timeline] == [(1, True), (2, False)]
    assert [(i.type, i.value) for i in a.iocs] == [("ipv4", who), ("ipv4", "192.0.2.10"), ("dst_ports", "80, 443"), ("port_spread", "2")]
    assert len(a.data_gaps) == 1 and len(got[4].data_gaps) == 4
    assert a.attribution.playbook == fixed.PLAYBOOKS["T1498"] and got[4].attribution.playbook == fixed.GENERIC_PLAYBOOK
    told = spark.createDataFrame([(1, '{"executive_summary": "x", "severity": "High", "cited_detections": [1, "2", 77, "junk", 2]}'), (2, "none")],
                                 "id long, content string")
    reports = cases.report_rows(made, told, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    r = reports.first()
    assert (r.id, r.severity, r.cited_detections, r.recommended_actions) == (1, "high", [1, 2], [])
    page = cases.markdown(reports).first().markdown.split("\n")
    assert page[0] == "# Incident report: detection #1 -- Network Denial of Service from 203.0.113.7"
    assert "| 2024-01-01 00:00:00 | #1 **(this report)** | suspicious flow to 192.0.2.10:80 attributed T1498 Network Denial of Service |" in page
    assert "#1, #2" in page and "- Abuse confidence score: 88" in page


def test_evidence(spark):
    body = ('{"severity": "Low", "evidence": [{"tool": "ghost", "finding": "x"}, {"tool": "detection", "finding": " y "}, '
            '{"tool": "ran", "detail": "z"}, {"tool": "ran"}, "loose"]}')
    rows = spark.createDataFrame([(1, body, ["ran"])], "id long, content string, executed array<string>")
    assert [(e.tool, e.finding) for e in cases.triage_rows(rows).first().evidence] == [("detection", "y"), ("ran", "z")]


def test_evaluation(spark):
    rows = spark.createDataFrame(
        [("BENIGN", 0, 0.1, 9.0), ("BENIGN", 0, 0.9, 1.0), ("A", 1, 0.9, 1.0), ("A", 1, 0.2, 1.0), ("B", 1, 0.96, 1.0)],
        "label string, y int, p double, mult double").withColumns({"model": F.lit("m"), "alpha": F.lit(0.0)})
    front = {r.threshold: r for r in evaluate.frontier(rows).collect()}
    assert (front[0.5].macro_recall, front[0.5].per_flow_benign_fpr, front[0.5].per_shape_benign_fpr) == (0.75, 0.1, 0.5)
    assert front[0.95].meets_fpr_budget and front[0.95].per_class_recall == {"A": 0.0, "B": 1.0}
    best = evaluate.operating_point(evaluate.frontier(rows)).first()
    assert (best.threshold, best.macro_recall) == (0.95, 0.5)
    assert evaluate.binary_scores(evaluate.decided(rows, 0.5)).first().asDict() == {
        "accuracy": 0.6, "precision": 0.6667, "recall": 0.6667, "f1": 0.6667, "roc_auc": 0.75}
    weights = {r.label: round(r.weight, 6) for r in prepare.class_weights(rows, "label", 1.0).collect()}
    assert weights["B"] == pytest.approx(2 * weights["A"]) and sum(
        w * n for w, n in zip((weights["BENIGN"], weights["A"], weights["B"]), (2, 2, 1))) == pytest.approx(5, abs=1e-4)


def test_migration(spark, tmp_path):
    old = spark.createDataFrame([("a", "FLOW", at(1)), ("b", "IPv4", at(2)), ("c", None, at(3)), ("d", "FLOW", at(4)), ("e", "IPv4", at(5))],
                                "ip string, type string, timestamp timestamp")
    old = migrate.add_columns(old, "country string, summary string, blacklisted string, attacks long, reports long")
    old.write.parquet(f"{tmp_path}/legacy")
    assert len(migrate.migrate(spark, str(tmp_path))) == 5 and migrate.migrate(spark, str(tmp_path)) == []
    d, t = (migrate.read_table(spark, str(tmp_path), n) for n in ("detections", "telemetry"))
    assert sorted((r.src_ip, r.cnn_verdict, r.lat) for r in d.collect()) == [("a", None, None), ("d", None, None)]
    assert sorted(r.ip for r in t.collect()) == ["b", "c", "e"]
    assert d.columns == schema.names(schema.DETECTION)
    assert d.filter(F.col("src_ip") == "a").first().timestamp == at(1).replace(tzinfo=None)


def test_csv_source(spark, tmp_path):
    head = "protocol,Total Fwd Packets,Flow Duration,Total Backward Packets,Total Length of Fwd Packets,Total Length of Bwd Packets,attack_label"
    (tmp_path / "x.csv").write_text(head + "\nTCP,2,-5,1,NaN,7,Web Attack – XSS\nicmp,1,2500000,0,inf,0,BENIGN\n", encoding="utf-8")
    rows = prepare.prepared(readers.labelled_csv(spark, str(tmp_path))).orderBy("y").collect()
    assert [(r.protocol, r.duration_s, r.fwd_bytes, r.y) for r in rows] == [(0.0, 2.5, 0.0, 0), (6.0, 0.0, 0.0, 1)]


def test_rerun_of_a_batch_doubles_nothing(spark, tmp_path):
    from packetloom.streaming import detect
    write = detect.to_sinks({"all": (str(tmp_path / "t"), lambda b: b)})
    for batch_id in (0, 1, 1):
        write(spark.range(3), batch_id)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 6
