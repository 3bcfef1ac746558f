"""The views of views.py as DuckDB common table expressions."""

IDLE_US = 86_400_000_000
ACTIVE_US = 4 * IDLE_US
SERVER = "93.184.216.34"


def client(uid: str) -> str:
    return (f"(CASE WHEN {uid} % 10 = 9 THEN '10' ELSE CAST(131 + ({uid} // 6250000) % 38 AS VARCHAR) END || '.' || CAST(({uid} // 25000) % 250 AS VARCHAR)"
            f" || '.' || CAST(({uid} // 100) % 250 AS VARCHAR) || '.' || CAST({uid} % 100 AS VARCHAR))")


OCT = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
V4 = rf"^{OCT}(?:\.{OCT}){{3}}$"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def number(ip: str) -> str:
    p = f"string_split({ip}, '.')"
    n = "0"
    for i in range(1, 5):
        n = f"({n} * 256 + CAST({p}[{i}] AS BIGINT))"
    return n


PRIVATE = [
    (0, 16777215), (167772160, 184549375), (2130706432, 2147483647), (2851995648, 2852061183),
    (2886729728, 2887778303), (3221225472, 3221225727), (3221225984, 3221226239),
    (3232235520, 3232301055), (3323068416, 3323199487), (3325256704, 3325256959),
    (3405803776, 3405804031), (4026531840, 4294967295),
]


def enrichable(ip: str) -> str:
    spans = " OR ".join(f"{number(ip)} BETWEEN {a} AND {b}" for a, b in PRIVATE)
    return (f"(CASE WHEN {ip} IS NULL OR NOT regexp_matches({ip}, '{V4}') THEN false "
            f"WHEN {ip} IN ('144.76.114.3', '159.89.102.253') THEN false "
            f"WHEN {number(ip)} IN (3221225481, 3221225482) THEN true "
            f"ELSE NOT ({spans}) END)")


PACKETS = f"""packets AS (
  SELECT event_id AS seq, ts, epoch_us(ts) AS us,
    CASE WHEN fw THEN cip ELSE '{SERVER}' END AS src_ip, CASE WHEN fw THEN '{SERVER}' ELSE cip END AS dst_ip,
    CASE WHEN fw THEN cport ELSE sport END AS src_port, CASE WHEN fw THEN sport ELSE cport END AS dst_port,
    CASE WHEN user_id % 4 = 0 THEN 17 ELSE 6 END AS proto, CAST(floor(value) AS INTEGER) AS payload_len,
    event_type = 'click' AS syn, event_type = 'error' AND k % 3 = 0 AS rst,
    event_type IN ('signup', 'purchase') AND k % 2 = 0 AS fin, event_type <> 'click' AS ack
  FROM (SELECT *, event_type IN ('click', 'view', 'signup') AS fw, {client('user_id')} AS cip,
          CAST(40000 + user_id % 20000 AS INTEGER) AS cport,
          [80, 443, 22, 8080][(user_id + date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) // 8) % 4 + 1] AS sport,
          CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""

KEYED = """keyed AS (
  SELECT *, row_number() OVER (PARTITION BY fk ORDER BY us, seq) AS rn FROM (
    SELECT *, CASE WHEN (src_ip, src_port) <= (dst_ip, dst_port)
        THEN src_ip || ':' || src_port || '|' || dst_ip || ':' || dst_port || '|' || proto
        ELSE dst_ip || ':' || dst_port || '|' || src_ip || ':' || src_port || '|' || proto END AS fk
    FROM packets))"""


def walk(idle: int = IDLE_US, active: int = ACTIVE_US) -> str:
    return f"""walk AS (
  SELECT fk, rn, seq, seq AS start_seq, us AS first_us, us AS last_us, src_ip AS i_ip, src_port AS i_port,
    proto = 6 AND rst AS shut, fin AS ff, false AS bf
  FROM keyed WHERE rn = 1
  UNION ALL
  SELECT fk, rn, seq, CASE WHEN fresh THEN seq ELSE start_seq END, CASE WHEN fresh THEN us ELSE first_us END,
    CASE WHEN fresh THEN us ELSE greatest(last_us, us) END,
    CASE WHEN fresh THEN src_ip ELSE i_ip END, CASE WHEN fresh THEN src_port ELSE i_port END,
    proto = 6 AND (rst OR ((CASE WHEN fresh THEN fin ELSE ff OR (fin AND fwd) END)
                       AND (CASE WHEN fresh THEN false ELSE bf OR (fin AND NOT fwd) END))),
    CASE WHEN fresh THEN fin ELSE ff OR (fin AND fwd) END,
    CASE WHEN fresh THEN false ELSE bf OR (fin AND NOT fwd) END
  FROM (SELECT k.*, w.start_seq, w.first_us, w.last_us, w.i_ip, w.i_port, w.ff, w.bf,
          w.shut OR k.us - w.last_us >= {idle} OR k.us - w.first_us >= {active} AS fresh,
          k.src_ip = w.i_ip AND k.src_port = w.i_port AS fwd
        FROM walk w JOIN keyed k ON k.fk = w.fk AND k.rn = w.rn + 1))"""


FLOWS = """flows AS (
  SELECT start_seq AS flow_id, min(CASE WHEN p.seq = start_seq THEN p.src_ip END) AS src_ip,
    min(CASE WHEN p.seq = start_seq THEN p.dst_ip END) AS dst_ip,
    CAST(min(CASE WHEN p.seq = start_seq THEN p.src_port END) AS INTEGER) AS src_port,
    CAST(min(CASE WHEN p.seq = start_seq THEN p.dst_port END) AS INTEGER) AS dst_port, min(p.proto) AS proto,
    min(p.us) AS first_us, max(p.us) AS last_us, (max(p.us) - min(p.us)) / 1000000.0 AS duration_s,
    count(*) FILTER (WHERE fwd) AS fwd_packets, count(*) FILTER (WHERE NOT fwd) AS bwd_packets,
    CAST(coalesce(sum(payload_len) FILTER (WHERE fwd), 0) AS BIGINT) AS fwd_bytes,
    CAST(coalesce(sum(payload_len) FILTER (WHERE NOT fwd), 0) AS BIGINT) AS bwd_bytes,
    count(*) FILTER (WHERE syn) AS syn_count, count(*) FILTER (WHERE rst) AS rst_count,
    count(*) FILTER (WHERE fin) AS fin_count, count(*) FILTER (WHERE ack) AS ack_count
  FROM (SELECT k.*, w.start_seq, k.src_ip = w.i_ip AND k.src_port = w.i_port AS fwd
        FROM keyed k JOIN walk w ON w.seq = k.seq) p
  GROUP BY start_seq)"""

LATE = """late AS (SELECT * REPLACE (us - CASE WHEN seq % 5 = 0 THEN seq % 11 * 36000000000 ELSE 0 END AS us) FROM packets)"""


def arrival_flows(tracker: bool) -> str:
    """Flows of the late packets in order of arrival; limits count from the running maximum of time."""
    now = "coalesce(max(us) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), us)" if tracker else "top"
    clocks = (f"timed AS (SELECT *, lag(top) OVER (PARTITION BY fk ORDER BY seq) AS before, {now} AS clock FROM (\n"
              "  SELECT *, max(us) OVER (PARTITION BY fk ORDER BY seq) AS top FROM keyed))")
    steps = (walk().replace("FROM keyed", "FROM timed").replace("JOIN keyed", "JOIN timed")
             .replace("us AS first_us", "top AS first_us").replace("fresh THEN us ELSE first_us", "fresh THEN top ELSE first_us")
             .replace("k.us - w.last_us >=", "k.clock - k.before >=").replace("k.us - w.first_us >=", "k.clock - w.first_us >="))
    own = "min(CASE WHEN p.seq = start_seq THEN p.us END)"
    out = FLOWS.replace("min(p.us) AS first_us", f"{own} AS first_us").replace("(max(p.us) - min(p.us))", f"(max(p.us) - {own})")
    ordered = KEYED.replace("FROM packets", "FROM late").replace("ORDER BY us, seq", "ORDER BY seq")
    return "WITH RECURSIVE " + ",\n".join([PACKETS, LATE, ordered, clocks, steps, out])


GEO = f"""raw_geo AS (
  SELECT {client('c_custkey')} AS ip, n_name AS country_name,
    CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN '' ELSE c_mktsegment END AS city,
    CASE WHEN c_custkey % 4 <> 0 THEN 'State ' || (c_custkey % 3) END AS state,
    CASE WHEN c_custkey % 7 = 0 THEN 'Not found' ELSE ((c_custkey * 37) % 170 - 85) || '.37' END AS latitude,
    CASE WHEN c_custkey % 7 = 0 THEN 'Not found' WHEN c_custkey % 13 = 5 THEN 'NaN'
         ELSE ((c_custkey * 71) % 340 - 170) || '.37' END AS longitude
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
geo AS (
  SELECT ip, coalesce(nullif(country_name, ''), 'Unknown') || ', ' || coalesce(nullif(city, ''), 'Unknown')
      || ', ' || coalesce(nullif(state, ''), 'Unknown') AS country,
    CASE WHEN isnan(TRY_CAST(latitude AS DOUBLE)) THEN NULL ELSE TRY_CAST(latitude AS DOUBLE) END AS lat,
    CASE WHEN isnan(TRY_CAST(longitude AS DOUBLE)) THEN NULL ELSE TRY_CAST(longitude AS DOUBLE) END AS lon
  FROM raw_geo)"""

REP = f"""rep_scored AS (
  SELECT {client('c_custkey')} AS ip, CASE WHEN c_custkey % 8 = 0 THEN 0 ELSE (c_custkey * 17) % 101 END AS score,
    (c_custkey * 7) % 40 AS reports, c_mktsegment AS usage_type, c_name AS isp
  FROM customer WHERE c_custkey % 3 <> 0),
rep_counted AS (
  SELECT {client('c_custkey')} AS ip, c_custkey % 5 <> 0 AS ok, (c_custkey * 3) % 5 AS attacks,
    (c_custkey * 3) % 9 AS reports FROM customer)"""


def enriched(rows: str, ip: str) -> str:
    """Columns country, lat, lon, blacklisted, attacks, reports, abuse_score, usage_type, isp, rep_source."""
    e = enrichable(f"b.{ip}")
    return f"""SELECT b.*,
    CASE WHEN NOT {e} THEN 'Internal/Private Range (Non-Routable)' ELSE coalesce(g.country, 'Resolution Timeout/Error') END AS country,
    CASE WHEN {e} THEN g.lat END AS lat, CASE WHEN {e} THEN g.lon END AS lon,
    CASE WHEN NOT {e} THEN false WHEN s.ip IS NOT NULL THEN s.score >= 50 WHEN c.ok THEN c.attacks > 0 ELSE false END AS blacklisted,
    CASE WHEN {e} AND s.ip IS NULL AND c.ok THEN c.attacks ELSE 0 END AS attacks,
    CASE WHEN NOT {e} THEN 0 WHEN s.ip IS NOT NULL THEN s.reports WHEN c.ok THEN c.reports ELSE 0 END AS reports,
    CASE WHEN {e} THEN CAST(s.score AS INTEGER) END AS abuse_score,
    CASE WHEN {e} THEN s.usage_type END AS usage_type, CASE WHEN {e} THEN s.isp END AS isp,
    CASE WHEN NOT {e} THEN 'none' WHEN s.ip IS NOT NULL THEN 'abuseipdb' WHEN c.ok THEN 'blocklist.de' ELSE 'unknown' END AS rep_source
  FROM {rows} b LEFT JOIN geo g ON g.ip = b.{ip} LEFT JOIN rep_scored s ON s.ip = b.{ip} LEFT JOIN rep_counted c ON c.ip = b.{ip}"""


FAMILY_LIST = "['botnet', 'brute-force', 'ddos', 'dos', 'other', 'port-scan', 'web-attack']"
TECHNIQUES = """techniques(attack_family, technique_id, technique_name, tactic) AS (VALUES
  ('port-scan', 'T1046', 'Network Service Discovery', 'Discovery'), ('ddos', 'T1498', 'Network Denial of Service', 'Impact'),
  ('dos', 'T1499', 'Endpoint Denial of Service', 'Impact'), ('brute-force', 'T1110', 'Brute Force', 'Credential Access'),
  ('botnet', 'T1071', 'Application Layer Protocol', 'Command and Control'),
  ('web-attack', 'T1190', 'Exploit Public-Facing Application', 'Initial Access'))"""

SCORED = f"""scored AS (
  SELECT *, (5000 - (fwd_bytes * 7 + bwd_bytes * 3 + fwd_packets * 131 + bwd_packets * 17 + src_port) % 1000) / 5000.0 AS probability,
    {FAMILY_LIST}[(fwd_packets * 5 + bwd_bytes + dst_port) % 7 + 1] AS top_family,
    (20 + fwd_bytes % 80) / 100.0 AS top_p FROM flows),
judged AS (
  SELECT *, CASE WHEN probability >= 0.95 THEN 'suspicious' ELSE 'normal' END AS cnn_verdict,
    CASE WHEN probability >= 0.95 THEN round_even(probability, 4) ELSE round_even(1 - probability, 4) END AS cnn_confidence,
    CASE WHEN probability >= 0.95 AND top_p >= 0.3 AND top_family <> 'other' THEN top_family END AS family
  FROM scored)"""

DETECTIONS = f"""enriched AS ({enriched('judged', 'src_ip')}),
detections AS (
  SELECT e.flow_id AS id, src_ip, dst_ip, src_port, dst_port, proto, cnn_verdict, cnn_confidence, country, lat, lon,
    duration_s, fwd_packets, bwd_packets, fwd_bytes, bwd_bytes,
    'Flow ' || src_ip || ':' || src_port || ' -> ' || dst_ip || ':' || dst_port || ' proto=' || proto || ' pkts='
      || (fwd_packets + bwd_packets) || ' dur=' || CAST(CAST(round_even(duration_s, 2) AS DECIMAL(18,2)) AS VARCHAR) || 's' AS summary,
    family AS attack_family, t.technique_id, t.technique_name, t.tactic, abuse_score,
    CAST(reports AS BIGINT) AS rep_reports, rep_source, date_trunc('second', make_timestamp(last_us)) AS timestamp
  FROM enriched e LEFT JOIN techniques t ON t.attack_family = e.family)"""

TELEMETRY = f"""telemetry AS (
  SELECT seq AS id, src_ip AS ip, country, lat, lon,
    'IP / ' || CASE WHEN proto = 6 THEN 'TCP' ELSE 'UDP' END || ' ' || src_ip || ':' || src_port || ' > ' || dst_ip || ':' || dst_port AS summary,
    CASE WHEN blacklisted THEN 'Yes' ELSE 'No' END AS blacklisted, CAST(attacks AS BIGINT) AS attacks,
    CAST(reports AS BIGINT) AS reports, ts AS timestamp, abuse_score, rep_source
  FROM ({enriched('packets', 'src_ip')}))"""

LOGS = """logs AS (
  SELECT id * 2 AS id, timestamp, 'Network Packet Ingested from source address: ' || ip || ' (' || country
      || ') - Target Infrastructure Blacklisted State: ' || CASE WHEN blacklisted = 'Yes' THEN 'True' ELSE 'False' END AS log
  FROM telemetry
  UNION ALL
  SELECT id * 2 + 1, timestamp, 'CNN flow verdict: ' || cnn_verdict || ' ('
      || CAST(CAST(round_even(cnn_confidence, 2) AS DECIMAL(18,2)) AS VARCHAR) || ')'
      || CASE WHEN cnn_verdict <> 'suspicious' THEN '' WHEN technique_id IS NOT NULL THEN ' [' || technique_id || ' ' || technique_name || ']'
              ELSE ' [technique unattributed]' END || ' - ' || summary FROM detections)"""

METRICS = """metrics AS (
  SELECT event_id AS id, ts AS timestamp, CAST(k AS DOUBLE) AS cpu, CAST((k * 7 + user_id) % 100 AS DOUBLE) AS memory,
    CAST((k * 13 + user_id) % 100 AS DOUBLE) AS disk, event_id AS network
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""

LABEL_LIST = ("['BENIGN', 'PortScan', 'DoS Hulk', 'DDoS', 'FTP-Patator', 'Bot', 'Web Attack – Brute Force', "
              "'Web Attack – XSS', 'Infiltration', 'Unlisted Thing']")

LINE_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"

LABELLED = f"""labelled_raw AS (
  SELECT {LINE_ID} AS row_id, CAST((l_partkey % 12) * 400000 - 400000 AS DOUBLE) AS dur_us,
    CASE WHEN l_linenumber % 3 = 0 THEN 'UDP' WHEN l_linenumber = 7 THEN 'icmp' ELSE 'tcp' END AS protocol,
    CAST(l_partkey % 7 + 1 AS DOUBLE) AS fp, CAST(l_suppkey % 5 AS DOUBLE) AS bp,
    CASE WHEN l_partkey % 97 = 0 THEN CAST('inf' AS DOUBLE) ELSE CAST((l_partkey % 7) * 40 AS DOUBLE) END AS fb,
    CAST((l_suppkey % 5) * 100 AS DOUBLE) AS bb,
    {LABEL_LIST}[CASE WHEN l_partkey % 3 <> 0 THEN 0 ELSE ((l_partkey // 3) * (l_partkey // 5)) % 10 END + 1] AS attack_label,
    {client('l_suppkey')} AS source_ip
  FROM lineitem),
labelled AS (
  SELECT row_id, greatest(dur_us / 1000000.0, 0) AS duration_s,
    CAST(CASE lower(protocol) WHEN 'tcp' THEN 6 WHEN 'udp' THEN 17 ELSE 0 END AS DOUBLE) AS protocol,
    fp AS fwd_packets, bp AS bwd_packets, CASE WHEN isinf(fb) THEN 0 ELSE fb END AS fwd_bytes, bb AS bwd_bytes,
    attack_label, source_ip, CASE WHEN upper(attack_label) <> 'BENIGN' THEN 1 ELSE 0 END AS y
  FROM labelled_raw)"""

SCORES = f"""scores AS (
  SELECT {LINE_ID} AS row_id, {LABEL_LIST}[pick + 1] AS label, CASE WHEN pick = 0 THEN 0 ELSE 1 END AS y,
    CASE WHEN pick = 0 THEN noise * CAST(0.00096 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) + noise * CAST(0.0007 AS DOUBLE) END AS p,
    CAST(l_partkey % 4 + 1 AS DOUBLE) AS mult, CAST(l_partkey % 10 AS INTEGER) AS fold
  FROM (SELECT *, CASE WHEN l_partkey % 3 <> 0 THEN 0 ELSE (l_partkey // 3) % 10 END AS pick,
          (l_orderkey * 13 + l_suppkey * 7 + l_linenumber * 101) % 1000 AS noise FROM lineitem))"""

FAMILY_SCORES = f"""family_scores AS (
  SELECT {LINE_ID} AS row_id, l_orderkey + l_suppkey AS turn, {FAMILY_LIST}[l_partkey % 7 + 1] AS family,
    {FAMILY_LIST}[CASE WHEN l_orderkey % 5 = 0 THEN (l_partkey + l_suppkey) % 7 ELSE l_partkey % 7 END + 1] AS pred,
    (20 + (l_orderkey * 3 + l_suppkey) % 80) / 100.0 AS conf
  FROM lineitem)"""

_CHAIN = {
    "packets": [PACKETS],
    "flows": [PACKETS, KEYED, walk(), FLOWS],
    "geo": [GEO], "rep": [REP],
    "detections": [PACKETS, KEYED, walk(), FLOWS, GEO, REP, TECHNIQUES, SCORED, DETECTIONS],
    "telemetry": [PACKETS, GEO, REP, TELEMETRY],
    "metrics": [METRICS], "labelled": [LABELLED], "scores": [SCORES], "family_scores": [FAMILY_SCORES],
    "techniques": [TECHNIQUES],
}
_CHAIN["logs"] = [*_CHAIN["detections"], TELEMETRY, LOGS]


def over(*views: str, extra: str = "") -> str:
    """WITH clause that defines the named views."""
    parts: list[str] = []
    for v in views:
        parts += [p for p in _CHAIN[v] if p not in parts]
    if extra:
        parts.append(extra)
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"
