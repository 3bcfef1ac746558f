"""Driver tables seen as network data.

events become packets (idle one day, active four days), customer rows become raw
geo and reputation answers, lineitem rows become labelled flows. The texts in
view_sql.py say the same in SQL.
"""
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text
from ..operators import enrich, flows, scoring
from ..session import scratch

IDLE_S = 86_400.0
ACTIVE_S = 4 * 86_400.0
SERVER = "93.184.216.34"
FAMILIES = ["botnet", "brute-force", "ddos", "dos", "other", "port-scan", "web-attack"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def client_ip(uid: Column) -> Column:
    """An address of its own for each of 237 million ids, but for those that end in 9: these are private and repeat after 6.25 million."""
    def digit(by: int, of: int) -> Column:
        return (F.floor(uid / by) % of).cast("string")
    net = F.when(uid % 10 == 9, F.lit("10")).otherwise((131 + F.floor(uid / 6_250_000) % 38).cast("string"))
    return F.concat_ws(".", net, digit(25_000, 250), digit(100, 250), digit(1, 100))


def packets_from(events: DataFrame) -> DataFrame:
    uid, kind = F.col("user_id"), F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date"))
    ip, port = client_ip(uid), (40000 + uid % 20000).cast("int")
    service = F.element_at(F.array(*[F.lit(p) for p in (80, 443, 22, 8080)]),
                           ((uid + F.floor(day / 8)) % 4 + 1).cast("int"))
    out = kind.isin("click", "view", "signup")
    return events.select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(out, ip).otherwise(SERVER).alias("src_ip"), F.when(out, F.lit(SERVER)).otherwise(ip).alias("dst_ip"),
        F.when(out, port).otherwise(service).alias("src_port"),
        F.when(out, service).otherwise(port).alias("dst_port"),
        F.when(uid % 4 == 0, 17).otherwise(6).alias("proto"),
        F.floor("value").cast("int").alias("payload_len"), (kind == "click").alias("syn"),
        ((kind == "error") & (k % 3 == 0)).alias("rst"),
        (kind.isin("signup", "purchase") & (k % 2 == 0)).alias("fin"), (kind != "click").alias("ack"))


def packets(spark: SparkSession, sf: str) -> DataFrame:
    return packets_from(table(spark, sf, "events"))


def late_packets(spark: SparkSession, sf: str) -> DataFrame:
    """The packets with times that go back: every fifth one is stamped up to 100 hours before those around it."""
    back = F.when(F.col("seq") % 5 == 0, F.col("seq") % 11 * 36_000_000_000).otherwise(0)
    return packets(spark, sf).withColumn("ts", F.timestamp_micros(F.unix_micros("ts") - back))


def flow_rows(spark: SparkSession, sf: str) -> DataFrame:
    return flows.build_flows(packets(spark, sf), IDLE_S, ACTIVE_S)


def formula_gate(rows: DataFrame) -> DataFrame:
    x = (F.col("fwd_bytes") * 7 + F.col("bwd_bytes") * 3 + F.col("fwd_packets") * 131
         + F.col("bwd_packets") * 17 + F.col("src_port")) % 1000
    return rows.withColumn("probability", (5000 - x) / 5000.0)


def formula_families(rows: DataFrame) -> DataFrame:
    pick = (F.col("fwd_packets") * 5 + F.col("bwd_bytes") + F.col("dst_port")) % 7
    top = (20 + F.col("fwd_bytes") % 80) / 100.0
    return rows.withColumn("family_probs", F.transform(
        F.sequence(F.lit(0), F.lit(6)), lambda i: F.when(i == pick, top).otherwise((1 - top) / 6)))


# --- raw answers of the lookup services ---------------------------------------
def raw_geo(spark: SparkSession, sf: str) -> DataFrame:
    c, key = table(spark, sf, "customer"), F.col("c_custkey")
    n = table(spark, sf, "nation")
    rows = c.join(n, c.c_nationkey == n.n_nationkey)
    degrees = lambda m, w: F.concat(((key * m) % w - F.lit(w // 2)).cast("string"), F.lit(".37"))
    return rows.select(
        client_ip(key).alias("ip"), F.col("n_name").alias("country_name"),
        F.when(key % 5 == 0, F.lit(None)).when(key % 5 == 1, "").otherwise(F.col("c_mktsegment")).alias("city"),
        F.when(key % 4 != 0, F.concat(F.lit("State "), (key % 3).cast("string"))).alias("state"),
        F.when(key % 7 == 0, "Not found").otherwise(degrees(37, 170)).alias("latitude"),
        F.when(key % 7 == 0, "Not found").when(key % 13 == 5, "NaN").otherwise(degrees(71, 340)).alias("longitude"))


def raw_scores(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    body = F.concat(
        F.lit('{"data": {"abuseConfidenceScore": '),
        F.when(key % 8 == 0, "null").otherwise(((key * 17) % 101).cast("string")),
        F.lit(', "totalReports": '), ((key * 7) % 40).cast("string"),
        F.lit(', "usageType": "'), F.col("c_mktsegment"), F.lit('", "isp": "'), F.col("c_name"), F.lit('"}}'))
    return table(spark, sf, "customer").select(
        client_ip(key).alias("ip"), F.when(key % 3 == 0, 429).otherwise(200).alias("status"), body.alias("body"))


def raw_counts(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    body = F.concat(F.lit('{"attacks": '), ((key * 3) % 5).cast("string"),
                    F.lit(', "reports": '), ((key * 3) % 9).cast("string"), F.lit("}"))
    return table(spark, sf, "customer").select(
        client_ip(key).alias("ip"), F.when(key % 5 == 0, 503).otherwise(200).alias("status"), body.alias("body"))


def geo(spark, sf):
    return enrich.geo_records(raw_geo(spark, sf))


def scored(spark, sf):
    return enrich.scored_source(raw_scores(spark, sf))


def counted(spark, sf):
    return enrich.count_source(raw_counts(spark, sf))


# --- fact tables --------------------------------------------------------------
def detections_from(built: DataFrame, geo_rows, scored_rows, counted_rows) -> DataFrame:
    """Classified, enriched flows in the detections shape (without the added texts)."""
    rows = scoring.classify(built, formula_gate, formula_families, FAMILIES)
    rows = enrich.enriched(rows, geo_rows, scored_rows, counted_rows)
    return rows.select(
        F.col("flow_id").alias("id"), "src_ip", "dst_ip", "src_port", "dst_port", "proto",
        "cnn_verdict", "cnn_confidence", "country", "lat", "lon", "duration_s", "fwd_packets",
        "bwd_packets", "fwd_bytes", "bwd_bytes", text.flow_summary().alias("summary"),
        "attack_family", "technique_id",
        F.when(F.col("technique_id").isNotNull(), F.col("technique_name")).alias("technique_name"), "tactic",
        F.col("rep.abuse_score").alias("abuse_score"), F.col("rep.reports").alias("rep_reports"),
        F.col("rep.source").alias("rep_source"), F.date_trunc("second", "last_ts").alias("timestamp"))


_made: dict[tuple, str] = {}


def _stored(spark: SparkSession, sf: str, name: str, make) -> DataFrame:
    """A fact table, written once per session to the shared folder and read back."""
    slot = (spark.sparkContext.applicationId, sf, name)
    if slot not in _made:
        path = scratch(spark, name)
        make().write.parquet(path)
        _made[slot] = path
    return spark.read.parquet(_made[slot])


def detections(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf, "detections", lambda: detections_from(
        flow_rows(spark, sf), geo(spark, sf), scored(spark, sf), counted(spark, sf)))


def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf, "telemetry", lambda: enrich.telemetry_rows(
        packets(spark, sf), geo(spark, sf), scored(spark, sf), counted(spark, sf)))


def logs(spark: SparkSession, sf: str) -> DataFrame:
    """Packet and verdict log lines."""
    t = telemetry(spark, sf).select(F.col("id") * 2, "timestamp", text.packet_log().alias("log"))
    d = detections(spark, sf).select(F.col("id") * 2 + 1, "timestamp", text.verdict_log().alias("log"))
    return t.union(d).toDF("id", "timestamp", "log")


def host_metrics(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("timestamp"),
        k.cast("double").alias("cpu"), ((k * 7 + F.col("user_id")) % 100).cast("double").alias("memory"),
        ((k * 13 + F.col("user_id")) % 100).cast("double").alias("disk"),
        F.col("event_id").alias("network"))


# --- labelled flows -----------------------------------------------------------
LABELS = [
    "BENIGN", "PortScan", "DoS Hulk", "DDoS", "FTP-Patator", "Bot", "Web Attack – Brute Force",
    "Web Attack – XSS", "Infiltration", "Unlisted Thing",
]


def line_id() -> Column:
    """Name of a lineitem row; order and line number alone do not identify one."""
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def labelled_raw(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as labelled flow rows; row_id orders them."""
    li = table(spark, sf, "lineitem")
    pk, sk, ln = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber").cast("long")
    pick = F.when(pk % 3 != 0, 0).otherwise((F.floor(pk / 3) * F.floor(pk / 5)) % 10).cast("int")
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), pick + 1)
    return li.select(
        line_id().alias("row_id"),
        ((pk % 12) * 400000 - 400000).cast("double").alias("Flow Duration"),
        F.when(ln % 3 == 0, "UDP").when(ln == 7, "icmp").otherwise("tcp").alias("protocol"),
        (pk % 7 + 1).cast("double").alias("Total Fwd Packets"), (sk % 5).cast("double").alias("Total Backward Packets"),
        F.when(pk % 97 == 0, float("inf")).otherwise(((pk % 7) * 40).cast("double")).alias("Total Length of Fwd Packets"),
        ((sk % 5) * 100).cast("double").alias("Total Length of Bwd Packets"),
        label.alias(fixed.LABEL_COLUMN), client_ip(sk).alias(fixed.GROUP_COLUMN))


def scored_rows(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as evaluated rows: label, y, probability, multiplicity, family probabilities."""
    li = table(spark, sf, "lineitem")
    pk, sk, ok = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    pick = F.when(pk % 3 != 0, 0).otherwise(F.floor(pk / 3) % 10).cast("int")
    noise = (ok * 13 + sk * 7 + F.col("l_linenumber") * 101) % 1000
    return li.select(
        line_id().alias("row_id"),
        F.element_at(F.array(*[F.lit(x) for x in LABELS]), pick + 1).alias("label"),
        F.when(pick == 0, 0).otherwise(1).alias("y"),
        (F.when(pick == 0, noise * 0.00096).otherwise(0.3 + noise * 0.0007)).alias("p"),
        (pk % 4 + 1).cast("double").alias("mult"), (pk % 10).cast("int").alias("fold"))


def family_scores(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as family-scored rows: true family and probabilities in FAMILIES order."""
    li = table(spark, sf, "lineitem")
    pk, sk, ok = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    true = (pk % 7).cast("int")
    pick = F.when(ok % 5 == 0, (pk + sk) % 7).otherwise(pk % 7).cast("int")
    top = (20 + (ok * 3 + sk) % 80) / 100.0
    names = F.array(*[F.lit(x) for x in FAMILIES])
    return li.select(
        line_id().alias("row_id"), (ok + sk).alias("turn"), F.element_at(names, true + 1).alias("family"),
        F.transform(F.sequence(F.lit(0), F.lit(6)),
                    lambda i: F.when(i == pick, top).otherwise((1 - top) / 6)).alias("family_probs"))
