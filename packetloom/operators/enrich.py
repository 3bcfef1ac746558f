"""Geo and reputation: normalise raw answers, join them to rows, account lookups."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import net, numeric
from . import chain
from .joins import lookup


# --- raw answers to records ---------------------------------------------------
def geo_records(raw: DataFrame) -> DataFrame:
    """ip, country text, lat, lon from raw geo answers."""
    def part(name: str) -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("Unknown"))
    place = F.struct(
        F.concat_ws(", ", part("country_name"), part("city"), part("state")).alias("country"),
        numeric.coordinate(F.col("latitude")).alias("lat"),
        numeric.coordinate(F.col("longitude")).alias("lon"))
    return newest_answer(raw, place, "place").select("ip", "place.*")


def newest_answer(raw: DataFrame, record: Column, name: str) -> DataFrame:
    """(ip, name): one row for each address, of its last answer by `ts` where there is one.

    Answers of one time are told apart by what they say, so a rerun takes the same.
    """
    at = F.col("ts") if "ts" in raw.columns else F.lit(None).cast("timestamp")
    last = raw.groupBy("ip").agg(F.max(F.struct(at.alias("at"), record.alias("record"))).alias("last"))
    return last.select("ip", F.col("last.record").alias(name))


def reputation_record(blacklisted, attacks, reports, score, usage, isp, source) -> Column:
    return F.struct(
        blacklisted.alias("blacklisted"), attacks.cast("long").alias("attacks"),
        reports.cast("long").alias("reports"), score.cast("int").alias("abuse_score"),
        usage.cast("string").alias("usage_type"), isp.cast("string").alias("isp"),
        F.lit(source).alias("source"))


def empty_record(source: str) -> Column:
    none = F.lit(None)
    return reputation_record(F.lit(False), F.lit(0), F.lit(0), none, none, none, source)


def _count(body: str, path: str) -> Column:
    return F.coalesce(F.get_json_object(F.col(body), path).try_cast("long"), F.lit(0))


def scored_source(raw: DataFrame) -> DataFrame:
    """ip, rep of the scored source; answers other than 200 are no answers."""
    score = _count("body", "$.data.abuseConfidenceScore")
    return newest_answer(raw.filter("status = 200"), reputation_record(
        score >= fixed.FLAG_SCORE, F.lit(0), _count("body", "$.data.totalReports"), score,
        F.get_json_object("body", "$.data.usageType"), F.get_json_object("body", "$.data.isp"),
        "abuseipdb"), "rep")


def count_source(raw: DataFrame) -> DataFrame:
    """ip, rep of the counting source; answers other than 200 are unknown, not clean."""
    attacks = _count("body", "$.attacks")
    none = F.lit(None)
    known = reputation_record(attacks > 0, attacks, _count("body", "$.reports"), none, none, none,
                              "blocklist.de")
    return newest_answer(raw, F.when(F.col("status") == 200, known).otherwise(empty_record("unknown")), "rep")


# --- joins --------------------------------------------------------------------
# The dimensions have one row per address; their size is counted before a broadcast,
# and a hot address never meets them in one task.
def answers(geo: DataFrame | None, scored: DataFrame | None, counted: DataFrame | None) -> DataFrame:
    """(ip, _geo, _scored, _counted): what is known of each address, side by side; a source that is None has no column."""
    sides = [] if geo is None else [geo.select("ip", F.struct("country", "lat", "lon").alias("_geo"))]
    sides += [s.select("ip", F.col("rep").alias(n)) for s, n in ((scored, "_scored"), (counted, "_counted")) if s is not None]
    out = sides[0]
    for side in sides[1:]:
        out = out.join(side, "ip", "full")
    return out


def _placed(rows: DataFrame, ip: str) -> DataFrame:
    public = net.is_enrichable(F.col(ip))
    return rows.withColumns({
        "country": F.when(~public, fixed.PRIVATE_LABEL).otherwise(F.coalesce("_geo.country", F.lit(fixed.FAILED_LABEL))),
        "lat": F.when(public, F.col("_geo.lat")), "lon": F.when(public, F.col("_geo.lon"))}).drop("_geo")


def _reputed(rows: DataFrame, ip: str) -> DataFrame:
    """rep: scored source, else counting source, else unknown; none if not looked up."""
    known = [c for c in ("_scored", "_counted") if c in rows.columns]
    looked = F.coalesce(*[F.col(c) for c in known], empty_record("unknown"))
    return rows.withColumn("rep", F.when(net.is_enrichable(F.col(ip)), looked).otherwise(empty_record("none"))).drop(*known)


def with_geo(rows: DataFrame, geo: DataFrame, ip: str = "src_ip") -> DataFrame:
    """Add country, lat, lon of an address."""
    return _placed(lookup(rows, answers(geo, None, None).withColumnRenamed("ip", ip), ip), ip)


def with_reputation(rows: DataFrame, scored: DataFrame | None, counted: DataFrame | None, ip: str = "src_ip") -> DataFrame:
    """Add rep, the record of an address's reputation."""
    if scored is not None or counted is not None:
        rows = lookup(rows, answers(None, scored, counted).withColumnRenamed("ip", ip), ip)
    return _reputed(rows, ip)


def enriched(rows: DataFrame, geo: DataFrame, scored: DataFrame | None, counted: DataFrame | None, ip: str = "src_ip") -> DataFrame:
    """Add place and reputation of an address: one join, so the rows are counted and moved once for both."""
    return _reputed(_placed(lookup(rows, answers(geo, scored, counted).withColumnRenamed("ip", ip), ip), ip), ip)


def reputation_as_of(rows: DataFrame, history: DataFrame, ip: str = "src_ip", ts: str = "first_ts",
                     row_id: str = "flow_id", slice_s: int = 86_400) -> DataFrame:
    """Add abuse_score and seen_at of the last history row at or before each row's time.

    history: ip, seen_at, abuse_score. Rows and history meet in one ordered sequence
    per address, cut in time slices so that a hot address spreads over many tasks.
    """
    value = "struct<us:long,score:int>"
    left = rows.select(F.struct(F.col(ip).alias("ip")).alias("key"), numeric.micros(F.col(ts)).alias("us"),
                       F.lit(1).alias("kind"), F.col(row_id).alias("rid"), F.lit(None).cast(value).alias("v"))
    right = history.select(
        F.struct("ip").alias("key"), numeric.micros(F.col("seen_at")).alias("us"), F.lit(0).alias("kind"),
        F.lit(None).cast(rows.schema[row_id].dataType).alias("rid"),
        F.struct(numeric.micros(F.col("seen_at")).alias("us"), F.col("abuse_score").cast("int").alias("score"))
        .cast(value).alias("v"))
    both = left.unionByName(right).withColumn(
        "slice", F.floor(F.col("us") / F.lit(slice_s * 1_000_000)).cast("long"))
    # Equal times on one address: the larger score is taken, so the answer is unique.
    both = chain.carry(both.withColumn("tie", F.coalesce("v.score", F.lit(0))),
                       {"hit": (F.col("v"), True)}, order=("us", "kind", "tie"))
    hits = both.filter("kind = 1").select(
        F.col("rid").alias(row_id), F.timestamp_micros("hit.us").alias("seen_at"),
        F.col("hit.score").alias("abuse_score"))
    return rows.join(hits, row_id, "left")


# --- lookups ------------------------------------------------------------------
def lookup_demand(requests: DataFrame, ttl_s: float, ip: str = "ip", ts: str = "ts", seq: str = "seq",
                  group_rows: int = chain.FIRE_ROWS) -> DataFrame:
    """Per address: requests, misses (one lookup per TTL window) and hits."""
    asked = requests.filter(net.is_enrichable(F.col(ip))).select(
        F.struct(F.col(ip).alias("ip")).alias("key"), numeric.micros(F.col(ts)).alias("us"),
        F.col(seq).alias("seq"))
    misses = chain.fires(asked, int(ttl_s * 1e6), group_rows).groupBy("key").agg(
        F.count("*").alias("misses"))
    total = asked.groupBy("key").agg(F.count("*").alias("requests"))
    return total.join(misses, "key").select(
        F.col("key.ip").alias("ip"), "requests", "misses",
        (F.col("requests") - F.col("misses")).alias("hits"))


def reputation_note(ip: Column, rep: Column) -> Column:
    """What kind of signal a reputation record is; NULL when there is nothing to add."""
    return (
        F.when(~net.is_enrichable(ip), fixed.NOTE_PRIVATE)
        .when(rep["source"] == "unknown", fixed.NOTE_FAILED)
        .when(rep["abuse_score"].isNotNull(), fixed.NOTE_SCORED)
        .when(~rep["blacklisted"], fixed.NOTE_CLEAN))


# --- fact rows ----------------------------------------------------------------
def telemetry_rows(packets: DataFrame, geo: DataFrame, scored: DataFrame | None,
                   counted: DataFrame | None) -> DataFrame:
    """One telemetry row per admitted packet, for its source address."""
    rows = packets.filter(net.admitted()).select(
        F.col("seq").alias("id"), F.col("src_ip").alias("ip"), F.col("ts").alias("timestamp"),
        F.concat(F.lit("IP / "), F.when(F.col("proto") == 6, "TCP").otherwise("UDP"), F.lit(" "),
                 F.col("src_ip"), F.lit(":"), F.col("src_port").cast("string"), F.lit(" > "),
                 F.col("dst_ip"), F.lit(":"), F.col("dst_port").cast("string")).alias("summary"))
    rows = enriched(rows, geo, scored, counted, "ip")
    return rows.select(
        "id", "ip", "country", "lat", "lon", "summary",
        F.when(F.col("rep.blacklisted"), "Yes").otherwise("No").alias("blacklisted"),
        F.col("rep.attacks").alias("attacks"), F.col("rep.reports").alias("reports"), "timestamp",
        F.col("rep.abuse_score").alias("abuse_score"), F.col("rep.source").alias("rep_source"))
