"""Detections, alerts and rates from streams."""
from contextlib import contextmanager, nullcontext

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import fixed
from ..operators import alerts, enrich, scoring


@contextmanager
def held(rows: DataFrame):
    kept = rows.persist()
    try:
        yield kept
    finally:
        kept.unpersist()


def two_stage(gate, attributor, classes: list[str], geo: DataFrame, scored: DataFrame | None, counted: DataFrame | None,
              threshold: float = fixed.VERDICT_THRESHOLD, family_threshold: float = fixed.ATTRIBUTION_THRESHOLD):
    """A stage of `to_sinks`: flows with verdict, family, place and reputation, as the batch operators give them.

    The gate runs on every row of a micro-batch and the family model on the flagged ones only. The dimensions are static
    tables; a micro-batch is joined to them like any batch, so their size is counted and hot addresses are joined apart.
    A fitted model is loaded once, by the caller, and sent to the executors.
    """
    @contextmanager
    def run(batch: DataFrame):
        with held(scoring.judge(gate(batch), threshold=threshold)) as judged:
            yield enrich.enriched(scoring.attributed(judged, attributor, classes, family_threshold), geo, scored, counted)
    return run


def to_sinks(targets: dict[str, tuple[str, object]], stage=nullcontext):
    """foreachBatch body: one write per target, from {name: (path, batch -> rows)}, of what `stage` makes of the batch.

    Each batch goes to its own folder, which is overwritten when the batch is run
    again, so a lost executor or a restart leaves no row doubled.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        with held(batch) as arrived, stage(arrived) as staged, held(staged) as rows:
            for path, make in targets.values():
                make(rows).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def run_to_sinks(stream: DataFrame, checkpoint: str, targets: dict, every: str | None = None, stage=nullcontext):
    """Start the micro-batch writer: now and then (`every`), or once over what is there."""
    writer = stream.writeStream.foreachBatch(to_sinks(targets, stage)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


# --- alerts -------------------------------------------------------------------
ALERT = ("id long, ts timestamp, verdict string, confidence double, src_ip string, technique_id string, "
         "technique_name string, tactic string, abuse_score int, rep_source string, summary string")
COLUMNS = [c.split(" ")[0] for c in ALERT.split(", ")]


class FirstSight(StatefulProcessor):
    """Per technique: passes the first row seen, once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows, timerValues):
        if self.seen.exists():
            return iter(())
        first = pd.concat([part.nsmallest(1, ["ts", "id"]) for part in rows]).nsmallest(1, ["ts", "id"])
        self.seen.update((True,))
        return iter([first[DUE].reset_index(drop=True)])

    def close(self) -> None:
        pass


class Throttle(StatefulProcessor):
    """Per (source, technique): passes a row at least `gap_us` after the last passed one.

    With `keep_ms` the state of a key ends that long after its last alert: a key quiet for longer than the gap needs none.
    """

    def __init__(self, gap_us: int, keep_ms: int | None = None):
        self.gap, self.keep = gap_us, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "us long", self.keep)

    def handleInputRows(self, key, rows, timerValues):
        last = self.last.get()[0] if self.last.exists() else None
        due = pd.concat(list(rows)).sort_values(["ts", "id"])
        sent = []
        for place, us in enumerate(due["ts"].astype("datetime64[us]").astype("int64")):
            if last is None or us - last >= self.gap:
                last = int(us)
                sent.append(place)
        if sent:
            self.last.update((last,))
        return iter([due.iloc[sent][DUE].reset_index(drop=True)])

    def close(self) -> None:
        pass


DUE = ["id", "ts", "src_ip", "technique_id", "trigger"]
DUE_DDL = "id long, ts timestamp, src_ip string, technique_id string, trigger string"


def first_sights(rows: DataFrame) -> DataFrame:
    """The rows, in the columns of DUE, that show a technique for the first time."""
    known = rows.filter("verdict = 'suspicious' and technique_id is not null").withColumn(
        "trigger", F.when(alerts.corroborated(), "corroborated").otherwise("new-technique"))
    known = known.select(F.col("technique_id").alias("technique"), *DUE)
    return known.groupBy("technique").transformWithStateInPandas(FirstSight(), DUE_DDL, outputMode="Append", timeMode="None")


def throttled_alerts(rows: DataFrame, throttle_s: float = fixed.ALERT_THROTTLE_S, live: bool = False,
                     late_s: float = 3600) -> DataFrame:
    """Alerts of a stream in the alert input shape, as the batch operator gives them, in the columns of DUE.

    First sights and corroborated rows go through one throttle, so that an alert of either kind holds back the next one
    of its source and technique. A row of both kinds comes twice, at one instant, and passes once. A live stream forgets
    a key throttle_s + late_s of wall-clock time after its last alert, so rows may arrive up to late_s late. Wall-clock
    state keeps a stream busy, so a run over what is there (availableNow) would never end; it takes live = False.
    """
    due = rows.filter((F.col("verdict") == "suspicious") & alerts.corroborated()).withColumn("trigger", F.lit("corroborated")).select(*DUE)
    due = due.unionByName(first_sights(rows)).withColumns({"source": F.col("src_ip"), "technique": F.col("technique_id")})
    return due.groupBy("source", "technique").transformWithStateInPandas(
        Throttle(int(throttle_s * 1e6), int((throttle_s + late_s) * 1e3) if live else None), DUE_DDL, outputMode="Append",
        timeMode="ProcessingTime" if live else "None")


# --- rates --------------------------------------------------------------------
def packet_rate(packets: DataFrame, window_s: int = 30, step_s: int = 1, delay: str = "10 seconds") -> DataFrame:
    """Packets per second in a sliding window: at (its end), packets, rate.

    Packets are counted once, by step; the sliding sum takes one row a step, so the window's length multiplies counts
    and not packets. Windows whose end the watermark has not reached are held back, see `rate_flushed`.
    """
    if window_s % step_s:
        raise ValueError("a window is a whole number of steps")
    step = F.window("ts", f"{step_s} seconds").alias("step")
    counts = packets.withWatermark("ts", delay).groupBy(step).agg(F.count("*").alias("n"))
    return _rates(_slid(counts, F.window_time("step"), window_s, step_s), window_s)


def rate_flushed(spark: SparkSession, sink: str, checkpoint: str, window_s: int = 30, step_s: int = 1) -> DataFrame:
    """All windows of a rate stream that has ended: those it wrote and those it held back, read from its state."""
    state = lambda nth: spark.read.format("statestore").option("path", checkpoint).option("operatorId", nth).load().select(
        F.col("key.*"), F.col("value.*"))
    # Operators are numbered from the sink up: the sliding sum, then the counts of steps.
    windows, steps = state(0).toDF("w", "packets"), state(1).toDF("step", "n")
    rest = _slid(steps, F.col("step.start"), window_s, step_s).unionByName(windows)
    rest = _rates(rest.groupBy("w").agg(F.sum("packets").alias("packets")), window_s)
    return spark.read.schema(rest.schema).parquet(sink).unionByName(rest)


def _slid(counts: DataFrame, at, window_s: int, step_s: int) -> DataFrame:
    return counts.groupBy(F.window(at, f"{window_s} seconds", f"{step_s} seconds").alias("w")).agg(F.sum("n").alias("packets"))


def _rates(windows: DataFrame, window_s: int) -> DataFrame:
    return windows.select(F.col("w.end").alias("at"), "packets", (F.col("packets") / window_s).alias("rate"))


def telemetry_stream(packets: DataFrame, geo: DataFrame, scored: DataFrame | None, counted: DataFrame | None) -> DataFrame:
    return enrich.telemetry_rows(packets, geo, scored, counted)


def late_packets(progress: list[dict]) -> int:
    """Rows dropped behind the watermark, over all progress reports of a query."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in progress for op in p.get("stateOperators", []))


def append_batches(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream to a Parquet table over everything that is there now."""
    return (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


__all__ = ["two_stage", "to_sinks", "run_to_sinks", "throttled_alerts", "first_sights", "packet_rate", "rate_flushed",
           "telemetry_stream", "late_packets", "append_batches"]
