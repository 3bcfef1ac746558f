"""Capture files that arrive in a folder, as numbered packets."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..sources import captures

NUMBERS = "path string, number long"
# A batch costs a handful of jobs whatever it holds and deals its files out in byte ranges, so it is bounded by bytes.
BATCH_BYTES = 8 << 30
PACKET_COLUMNS = [c.split(" ")[0] for c in schema.PACKET.split(", ")]


def ingest(spark: SparkSession, path: str, packets: str, numbers: str, checkpoint: str,
           split_bytes: int = captures.SPLIT, files_per_batch: int | None = None, bytes_per_batch: int = BATCH_BYTES):
    """Take in the capture files that have arrived since the last run; return the ended query.

    Every micro-batch numbers its files after all earlier ones, in `numbers`, and writes their packets, decoded in byte
    ranges, to a folder of its own below `packets`; `arrived` streams them on. A packet's seq is its file's number and its
    place in the file, so it says the order of arrival and never changes. A batch that is run again after a lost driver
    finds its files' numbers and, if its packets were written whole, leaves them as they are: no packet comes twice.

    Files must be moved into the folder whole. Those that are no captures get a number and give no packets; empty files
    and those whose names start with _ or a dot are not listed. A batch takes files up to `bytes_per_batch`, or as many
    as `files_per_batch` says.
    """
    # There may be nothing to take in yet; `arrived` needs the folder all the same.
    system, place = _folder(spark, packets)
    system.mkdirs(place)
    ranged = captures.direct(spark, path)
    limit = ("maxBytesPerTrigger", bytes_per_batch) if files_per_batch is None else ("maxFilesPerTrigger", files_per_batch)
    listed = (spark.readStream.schema("path string, modificationTime timestamp, length long, content binary")
              .format("binaryFile").option("recursiveFileLookup", True).option(*limit).load(path))
    # Without its column, content is never read here.
    listed = listed.select("path", "modificationTime", "length", *([] if ranged else ["content"]))

    def take(files: DataFrame, batch: int) -> None:
        given, into = f"{numbers}/batch={batch}", f"{packets}/batch={batch}"
        if not _whole(spark, given):
            known = _numbers(spark, numbers, batch)
            own = captures.numbered(files.select("path", "modificationTime"), known)
            own.select("path", "number").write.mode("overwrite").parquet(given)
        if _whole(spark, into):
            return
        own = files.join(spark.read.schema(NUMBERS).parquet(given), "path")
        rows = captures.ranges_decoded(captures.ranges(own, split_bytes)) if ranged else captures.decode(own)
        out = captures.packet_rows(rows).select(PACKET_COLUMNS)
        out.write.mode("overwrite").parquet(into)

    run = listed.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return run


def arrived(spark: SparkSession, packets: str, files_per_trigger: int = 1024) -> DataFrame:
    """The packets that `ingest` wrote, as a stream."""
    return (spark.readStream.schema(schema.PACKET).option("recursiveFileLookup", True)
            .option("maxFilesPerTrigger", files_per_trigger).parquet(packets))


def file_numbers(spark: SparkSession, numbers: str) -> DataFrame:
    """Path and number of every file that was taken in."""
    return spark.read.schema(NUMBERS).option("recursiveFileLookup", True).parquet(numbers)


def _numbers(spark: SparkSession, numbers: str, batch: int) -> DataFrame:
    """Numbers given by the batches before, all of which are whole by now."""
    if batch == 0:
        return spark.createDataFrame([], NUMBERS)
    return spark.read.schema(f"{NUMBERS}, batch long").parquet(numbers).filter(F.col("batch") < batch).drop("batch")


def _folder(spark: SparkSession, name: str):
    """The file system of a path, and the path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _whole(spark: SparkSession, folder: str) -> bool:
    """Was the folder written to its end?"""
    system, mark = _folder(spark, f"{folder}/_SUCCESS")
    return system.exists(mark)
