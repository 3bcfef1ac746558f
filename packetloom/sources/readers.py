"""Sources: labelled flows, captures, stored tables."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed, schema
from .captures import capture_counts, capture_files, capture_packets, decode, packet_rows

__all__ = ["labelled_parquet", "labelled_csv", "capture_packets", "capture_files", "capture_counts", "decode", "packet_rows",
           "packet_stream"]


def labelled_parquet(spark: SparkSession, path: str, groups: bool = True) -> DataFrame:
    """Labelled flows from Parquet; only the needed columns are read."""
    return _labelled(spark.read.parquet(path), groups)


def labelled_csv(spark: SparkSession, path: str, groups: bool = False) -> DataFrame:
    """Labelled flows from CSV with a header, in any column order."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    numbers = [c for c in fixed.LABELLED_COLUMNS if c != "protocol"]
    return _labelled(rows.withColumns({c: F.col(f"`{c}`").try_cast("double") for c in numbers}), groups)


def _labelled(rows: DataFrame, groups: bool) -> DataFrame:
    keep = [*fixed.LABELLED_COLUMNS, fixed.LABEL_COLUMN] + ([fixed.GROUP_COLUMN] if groups else [])
    return rows.select(*[F.col(f"`{c}`") for c in keep]).withColumnsRenamed(fixed.LABELLED_COLUMNS)


# --- packet streams -----------------------------------------------------------
def packet_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Packets that arrive as Parquet files in a folder."""
    return (spark.readStream.schema(schema.PACKET).option("maxFilesPerTrigger", files_per_trigger).parquet(path))
