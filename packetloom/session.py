"""Session and shared work folder."""
import os
import re
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "packetloom", partitions: int = 8) -> SparkSession:
    """Single-machine session for tests and benches."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Only where that is unset on a local master (tests, a laptop) is a local folder made.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if shared is None and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.getCheckpointDir() is None:
        if shared is None:
            shared = tempfile.mkdtemp(prefix="packetloom-")
        sc.setCheckpointDir(shared)
    return shared or os.path.dirname(sc.getCheckpointDir())


_scratch: dict[str, list[str]] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new, unused folder path below the work folder."""
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables of this session, once nothing reads them any more."""
    return _delete(spark, _scratch.pop(spark.sparkContext.applicationId, []))


def _delete(spark: SparkSession, paths: list[str]) -> int:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    return len(paths)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back, without their lineage.

    A written table outlives executors and, unlike a checkpointed RDD, has a known
    size, so later joins with a small one need no shuffle.
    """
    spark = df.sparkSession
    path = scratch(spark, "cut")
    if getattr(_scopes, "open", None):
        _scopes.open[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_scopes = threading.local()
# Spark drops the shuffle files of a query as soon as it ends, not when the driver happens to collect its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing(spark: SparkSession):
    """What `cut` writes in this block, in this thread, is deleted at the block's end, and a query's shuffle files at the query's.

    Gives a function that writes rows as `cut` does, but outlives the block. No other table of the block may be read after it.
    """
    scopes = _scopes.__dict__.setdefault("open", [])
    own: list[str] = []
    scopes.append(own)

    def kept(df: DataFrame) -> DataFrame:
        scopes.pop()
        try:
            return cut(df)
        finally:
            scopes.append(own)

    usual = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield kept
    finally:
        spark.conf.set(FREE_SHUFFLES, usual)
        scopes.pop()
        held = _scratch.get(spark.sparkContext.applicationId, [])
        held[:] = [path for path in held if path not in own]
        _delete(spark, own)
