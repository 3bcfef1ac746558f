"""Legacy mixed table to fact tables, and named schema steps."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..sources import sinks

SPLIT = "0001_split_network_requests"
STEPS = [SPLIT, *schema.DETECTION_ADDED]
TELEMETRY_ADDED = {"0004_reputation_scores": "abuse_score int, rep_source string"}


def add_columns(rows: DataFrame, ddl: str) -> DataFrame:
    """Rows with the columns of `ddl` they lack, as NULL."""
    empty = rows.sparkSession.createDataFrame([], ddl)
    missing = [c for c in empty.columns if c not in rows.columns]
    return rows.unionByName(empty.select(*missing), allowMissingColumns=True) if missing else rows


def new_id():
    """Ids below zero: unique in the moved rows, and never those of live rows."""
    return (-1 - F.monotonically_increasing_id()).alias("id")


def legacy_detections(legacy: DataFrame) -> DataFrame:
    """Verdict rows of the mixed table; what it never stored stays NULL."""
    rows = add_columns(legacy, "type string, cnn_verdict string, cnn_confidence double")
    return rows.filter("type = 'FLOW'").select(
        new_id(), F.col("ip").alias("src_ip"), "cnn_verdict", "cnn_confidence", "country", "summary", "timestamp")


def legacy_telemetry(legacy: DataFrame) -> DataFrame:
    """Everything that is not a verdict row, also rows without a type."""
    rows = add_columns(legacy, "type string")
    return rows.filter("type is null or type <> 'FLOW'").select(
        new_id(), "ip", "country", "summary", "blacklisted", "attacks", "reports", "timestamp")


def split_legacy(legacy: DataFrame) -> tuple[DataFrame, DataFrame]:
    return legacy_detections(legacy), legacy_telemetry(legacy)


def pending(spark: SparkSession, ledger: DataFrame) -> DataFrame:
    """Steps that the ledger lacks, in order."""
    steps = spark.createDataFrame([(s, i) for i, s in enumerate(STEPS)], "name string, place int")
    return steps.join(ledger.select("name"), "name", "left_anti").orderBy("place")


def migrate(spark: SparkSession, root: str) -> list[str]:
    """Bring the tables below `root` up to date; gives the steps that ran.

    Tables are folders: legacy, telemetry, detections, ledger; moved rows lie beside the
    live ones in telemetry_moved and detections_moved. A step is recorded after its rows
    are written; a second run finds nothing to do. The legacy table is kept.
    """
    ledger_path = f"{root}/ledger"
    ledger = (spark.read.parquet(ledger_path) if sinks.exists(spark, ledger_path)
              else spark.createDataFrame([], schema.LEDGER))
    todo = [r["name"] for r in pending(spark, ledger).collect()]
    if SPLIT in todo and sinks.exists(spark, f"{root}/legacy"):
        flows, packets = split_legacy(spark.read.parquet(f"{root}/legacy"))
        # Overwrite: a run that died before its ledger row leaves nothing doubled.
        sinks.write_fact(flows, f"{root}/detections_moved", schema.DETECTION, "overwrite")
        sinks.write_fact(packets, f"{root}/telemetry_moved", schema.TELEMETRY, "overwrite")
    if todo:
        done = spark.createDataFrame([(s,) for s in todo], "name string").withColumn("applied_at", F.current_timestamp())
        done.coalesce(1).write.mode("append").parquet(ledger_path)
    return todo


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A fact table, live and moved rows, in its current shape whatever its older files have."""
    ddl = {"telemetry": schema.TELEMETRY, "detections": schema.DETECTION}[name]
    out = spark.createDataFrame([], ddl)
    for path in (f"{root}/{name}", f"{root}/{name}_moved"):
        if sinks.exists(spark, path):
            out = out.unionByName(sinks.read_fact(spark, path, ddl))
    return out
