"""Text expressions: tokens, labels, log lines, report cells."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed

DASH = "—"


def tokens(text: Column) -> Column:
    """Search terms of a text: dotted quads whole, words lower-case, stopwords out."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({fixed.TOKEN_PATTERN})"), F.lit(1))
    return F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda t: ~t.isin(fixed.STOPWORDS))


def incident_text() -> Column:
    """Searchable text of a detection row; empty and missing parts are left out."""
    proto = (F.when(F.col("proto") == 6, "tcp").when(F.col("proto") == 17, "udp")
             .otherwise(show(F.col("proto"))))
    parts = F.array(
        F.concat(F.lit("detection "), F.col("id").cast("string")),
        F.col("cnn_verdict"), F.col("attack_family"), F.col("technique_id"),
        F.col("technique_name"), F.col("tactic"),
        F.concat(F.lit("src "), show(F.col("src_ip"))), F.col("country"),
        F.concat(F.lit("dst "), show(F.col("dst_ip")), F.lit(" port "), show(F.col("dst_port"))),
        proto, F.col("summary"), stamp(F.col("timestamp")),
    )
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), " ")


def show(value: Column, missing: str = "None") -> Column:
    return F.coalesce(value.cast("string"), F.lit(missing))


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def utc_stamp(ts: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd HH:mm:ss'Z'")


def endpoint(ip: Column, port: Column) -> Column:
    return F.concat_ws(":", show(ip), show(port))


def flow_summary() -> Column:
    packets = (F.col("fwd_packets") + F.col("bwd_packets")).cast("string")
    return F.concat(
        F.lit("Flow "), endpoint(F.col("src_ip"), F.col("src_port")), F.lit(" -> "),
        endpoint(F.col("dst_ip"), F.col("dst_port")), F.lit(" proto="), show(F.col("proto")),
        F.lit(" pkts="), packets, F.lit(" dur="), two_digits(F.col("duration_s")), F.lit("s"))


def two_digits(x: Column) -> Column:
    """Fixed two decimals, as the SQL's round_even: the double times 100 is rounded, ties to even.

    The product decides, not the number's shortest decimal text: 1.015 times 100 is below 101.5, so it gives 1.01.
    """
    return (F.rint(x * 100) / 100).cast("decimal(38,2)").cast("string")


def packet_log(ip="ip", country="country", blacklisted="blacklisted") -> Column:
    return F.concat(
        F.lit("Network Packet Ingested from source address: "), show(F.col(ip)), F.lit(" ("),
        show(F.col(country)), F.lit(") - Target Infrastructure Blacklisted State: "),
        F.when(F.col(blacklisted) == "Yes", "True").otherwise("False"))


def verdict_log() -> Column:
    note = (F.when(F.col("cnn_verdict") != "suspicious", "")
            .when(F.col("technique_id").isNotNull(),
                  F.concat(F.lit(" ["), F.col("technique_id"), F.lit(" "),
                           show(F.col("technique_name")), F.lit("]")))
            .otherwise(" [technique unattributed]"))
    return F.concat(F.lit("CNN flow verdict: "), F.col("cnn_verdict"), F.lit(" ("),
                    two_digits(F.col("cnn_confidence")), F.lit(")"), note, F.lit(" - "),
                    F.col("summary"))


def saturation_text(cpu="cpu", memory="memory", disk="disk") -> Column:
    return F.concat(
        F.lit("System Infrastructure Warning: Resource Saturation Threshold Breached - "
              "System CPU Usage: "), F.col(cpu).cast("string"), F.lit("%, RAM Utilization: "),
        F.col(memory).cast("string"), F.lit("%, Disk Space State: "),
        F.col(disk).cast("string"), F.lit("%."))


def clean_label(label: Column) -> Column:
    """En and em dashes to hyphens, runs of white space to one blank."""
    return F.trim(F.regexp_replace(F.translate(label, "–—", "--"), r"\s+", " "))


def clean_place(place: Column) -> Column:
    """Place text without its filler parts."""
    parts = F.transform(F.split(place, ","), lambda p: F.trim(p))
    real = F.filter(parts, lambda p: ~F.lower(p).isin("none", "unknown", "not found", ""))
    return F.when(F.size(real) > 0, F.array_join(real, ", ")).otherwise("unknown")


def country_name(place: Column) -> Column:
    return F.element_at(F.split(clean_place(place), ","), 1)


def severity(raw: Column) -> Column:
    level = F.lower(F.trim(raw))
    return F.when(level.isin(fixed.SEVERITIES), level).otherwise("unspecified")


def cell(value: Column) -> Column:
    """Table cell of a Markdown report."""
    return F.replace(show(value, DASH), F.lit("|"), F.lit("\\|"))
