"""Sinks: fact tables, annotations, metadata, models, reports."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def shaped(rows: DataFrame, ddl: str) -> DataFrame:
    """Rows in a table's columns and types; columns they lack are NULL."""
    target = rows.sparkSession.createDataFrame([], ddl).schema
    have = set(rows.columns)
    return rows.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in target])


def by_day(rows: DataFrame) -> DataFrame:
    return rows.withColumn("day", F.to_date("timestamp"))


def write_fact(rows: DataFrame, path: str, ddl: str, mode: str = "append") -> None:
    """Append fact rows, one folder per day, files sorted by time within.

    Rows are dealt out by day before, so a day gets few files; a day too large for one task is split over several.
    """
    out = by_day(shaped(rows, ddl)).hint("rebalance", "day")
    out.sortWithinPartitions("day", "timestamp").write.mode(mode).partitionBy("day").parquet(path)


def write_telemetry(rows: DataFrame, path: str) -> None:
    write_fact(rows, path, schema.TELEMETRY)


def write_detections(rows: DataFrame, path: str) -> None:
    write_fact(rows, path, schema.DETECTION)


def write_logs(rows: DataFrame, path: str) -> None:
    write_fact(rows, path, schema.LOG)


def write_metrics(rows: DataFrame, path: str) -> None:
    write_fact(rows, path, schema.METRIC)


def read_fact(spark: SparkSession, path: str, ddl: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Fact rows in the columns of `ddl`, whichever of them older files have. With first or last (days, both included)
    only the folders of those days are read."""
    rows = spark.read.schema(f"{ddl}, day date").parquet(path)
    if first is not None:
        rows = rows.filter(F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        rows = rows.filter(F.col("day") <= F.lit(last).cast("date"))
    return rows.drop("day")


def annotate(detections: DataFrame, notes: DataFrame, kind: str) -> DataFrame:
    """Detections with new triage or report texts; `notes` is (id, body, at).

    Rows without a new text keep their old one. The result is a new snapshot.
    """
    body, at = f"{kind}_json", f"{kind}_at"
    latest = notes.groupBy("id").agg(F.max_by(F.struct("body", "at"), "at").alias("n"))
    out = detections.join(latest, "id", "left")
    return out.withColumns({body: F.coalesce("n.body", body), at: F.coalesce("n.at", at)}).drop("n")


ROUTES = {"telemetry": schema.TELEMETRY, "detections": schema.DETECTION, "logs": schema.LOG, "metrics": schema.METRIC}


def route(batch: DataFrame, targets: dict[str, str]) -> None:
    """Write a mixed batch: rows carry `target` and their typed values in a struct of that name; one write per target.

    A target that has no path is an error, and then nothing is written.
    """
    held = batch.persist()
    try:
        other = held.filter(~F.coalesce(F.col("target").isin(*targets), F.lit(False))).select("target").first()
        if other is not None:
            raise ValueError(f"no path for rows of target {other['target']!r}")
        for name, path in targets.items():
            write_fact(held.filter(F.col("target") == name).select(f"{name}.*"), path, ROUTES[name])
    finally:
        held.unpersist()


def as_routed(rows: DataFrame, target: str) -> DataFrame:
    """Rows of one target in the shape of a mixed batch."""
    own = {name: F.struct(*shaped(rows, ddl).columns) if name == target else F.lit(None).cast(f"struct<{_fields(ddl)}>")
           for name, ddl in ROUTES.items()}
    return shaped(rows, ROUTES[target]).select(F.lit(target).alias("target"), *[v.alias(n) for n, v in own.items()])


def _fields(ddl: str) -> str:
    return ", ".join(f"{f.rsplit(' ', 1)[0]}: {f.rsplit(' ', 1)[1]}" for f in ddl.split(", "))


def write_json(rows: DataFrame, path: str) -> None:
    """Small result tables (metrics, settings) as one JSON file."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """Markdown texts, one row per report."""
    reports.select("id", "markdown").write.mode("overwrite").parquet(path)
