"""Which detections alert, and how often."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import numeric, text
from . import chain
from .joins import bounded

# Alert input: ts, id, verdict, confidence, src_ip, technique_id, technique_name,
# tactic, abuse_score, rep_source, summary.


def alert_input(detections: DataFrame) -> DataFrame:
    return detections.select(
        F.col("timestamp").alias("ts"), "id", F.col("cnn_verdict").alias("verdict"),
        F.col("cnn_confidence").alias("confidence"), "src_ip", "technique_id", "technique_name",
        "tactic", "abuse_score", "rep_source", "summary")


def corroborated() -> Column:
    return F.coalesce((F.col("confidence") >= fixed.ALERT_CONFIDENCE)
                      & (F.col("abuse_score") >= fixed.ALERT_ABUSE), F.lit(False))


def first_sights(rows: DataFrame) -> DataFrame:
    """First suspicious row per technique: technique_id, first_ts, id."""
    known = rows.filter((F.col("verdict") == "suspicious") & F.col("technique_id").isNotNull())
    return (known.groupBy("technique_id").agg(F.min(F.struct("ts", "id")).alias("first"))
            .select("technique_id", F.col("first.ts").alias("first_ts"), F.col("first.id").alias("id")))


def triggers(rows: DataFrame) -> DataFrame:
    """Suspicious rows that would alert, with their trigger, before throttling.

    The first row of a technique can never be throttled: no earlier alert has that
    technique. So first sight does not depend on the throttle.
    """
    firsts = first_sights(rows).select("id", F.lit(True).alias("is_first"))
    marked = rows.filter("verdict = 'suspicious'").join(bounded(firsts), "id", "left")
    why = (F.when(corroborated(), "corroborated").when(F.col("is_first"), "new-technique"))
    return marked.withColumn("trigger", why).filter("trigger is not null").drop("is_first")


def alerts(rows: DataFrame, throttle_s: float = fixed.ALERT_THROTTLE_S,
           group_rows: int = chain.FIRE_ROWS) -> DataFrame:
    """Alerts after the throttle: one per (source, technique) and window."""
    due = triggers(rows)
    # order of arrival within one instant is the id
    keyed = due.select(F.struct("src_ip", "technique_id").alias("key"),
                       numeric.micros(F.col("ts")).alias("us"), F.col("id").alias("seq"))
    sent = chain.fires(keyed, int(throttle_s * 1e6), group_rows).select(F.col("seq").alias("id"))
    return due.join(sent, "id", "left_semi")


def payloads(sent: DataFrame, sender: str = "packetloom") -> DataFrame:
    """id, message text, and the structured alert as JSON."""
    label = F.when(F.col("technique_id").isNotNull(), F.concat_ws(
        " ", "technique_id", text.show(F.col("technique_name")))).otherwise(fixed.UNATTRIBUTED_NAME)
    reason = F.when(F.col("trigger") == "corroborated", fixed.REASON_CORROBORATED).otherwise(
        fixed.REASON_NEW)
    line = F.concat(
        F.lit(f"[{sender}] CRITICAL: suspicious flow from "), text.show(F.col("src_ip")), F.lit(" ("), label,
        F.lit(") -- "), reason, F.lit(". confidence="), text.show(F.col("confidence")),
        F.lit(", abuse_score="), text.show(F.col("abuse_score")))
    body = F.struct(
        F.lit("critical").alias("severity"), "trigger", F.col("src_ip").alias("ip"), "technique_id",
        "technique_name", "tactic", "confidence",
        F.struct("abuse_score", F.col("rep_source").alias("source")).alias("reputation"),
        "summary", text.utc_stamp(F.col("ts")).alias("timestamp"))
    return sent.select("id", line.alias("text"), line.alias("content"), body.alias("alert"))


def webhook_bodies(sent: DataFrame, sender: str = "packetloom") -> DataFrame:
    return payloads(sent, sender).select("id", F.to_json(
        F.struct("text", "content", "alert"), {"ignoreNullFields": "false"}).alias("body"))
