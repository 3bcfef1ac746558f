"""Counters of running streams, kept in a table while they run."""
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

DDL = "query string, batch long, at timestamp, rows_read long, rows_written long, late_rows long"
WRITTEN = "written"


def counted(rows: DataFrame) -> DataFrame:
    """Rows on their way to a sink, counted as they pass."""
    return rows.observe(WRITTEN, F.count(F.lit(1)).alias("rows"))


class Progress(StreamingQueryListener):
    """Appends a row for every micro-batch to the table at `path`: rows read, written, and dropped as late.

    A batch that is run again after a restart is reported again; `totals` takes it once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._ended, self._news = set(), threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get(WRITTEN)
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        row = (str(p.id), p.batchId, p.timestamp, p.numInputRows, seen["rows"] if seen is not None else None, late)
        line = self.spark.createDataFrame([row], DDL.replace("timestamp", "string")).withColumn("at", F.col("at").cast("timestamp"))
        line.coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._news:
            self._ended.add(str(event.runId))
            self._news.notify_all()

    def settle(self, run, seconds: float = 60) -> None:
        """Wait until all batches of an ended run are in the table."""
        with self._news:
            if not self._news.wait_for(lambda: str(run.runId) in self._ended, seconds):
                raise TimeoutError(f"no end of run {run.runId} reported")


def totals(spark: SparkSession, path: str, query: str) -> DataFrame:
    """late_rows and rows_written of a query over all its runs, in one row."""
    rows = spark.read.schema(DDL).parquet(path).filter(F.col("query") == query)
    batches = rows.groupBy("batch").agg(F.max("late_rows").alias("late"), F.max("rows_written").alias("written"))
    return batches.agg(F.coalesce(F.sum("late"), F.lit(0)).alias("late_rows"), F.coalesce(F.sum("written"), F.lit(0)).alias("rows_written"))
