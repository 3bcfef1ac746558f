"""Counters, rates and sign-in bursts."""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from . import chain


def trailing_rate(samples: DataFrame, source: str = "source", window_s: float = fixed.RATE_WINDOW_S,
                  interval_s: float = fixed.RATE_INTERVAL_S, slice_s: float = 3600.0) -> DataFrame:
    """Units per second over the last int(window/interval)+2 samples of a source.

    Input source, t (double seconds), counter. Each time slice also gets the samples
    just before it, so a source with many samples spreads over many tasks.
    """
    keep = int(window_s / max(interval_s, 0.001)) + 2
    rows = samples.withColumn("slice", F.floor(F.col("t") / slice_s).cast("long"))
    # The last `keep - 1` samples of a slice, handed to the next slice that has samples.
    late = Window.partitionBy(source, "slice").orderBy(F.col("t").desc(), F.col("counter").desc())
    tails = rows.withColumn("nth", F.row_number().over(late)).filter(F.col("nth") < keep).drop("nth")
    counts = rows.select(source, "slice").distinct()
    w = Window.partitionBy(source).orderBy("slice")
    # keep - 1 earlier samples lie in at most keep - 1 earlier slices.
    reach = counts.withColumn("prior", F.collect_list("slice").over(w.rowsBetween(-(keep - 1), -1)))
    need = reach.select(source, F.col("slice").alias("into"), F.explode("prior").alias("slice"))
    halo = tails.join(need, [source, "slice"]).select(
        source, "t", "counter", F.col("into").alias("slice"), F.lit(False).alias("own"))
    both = rows.select(source, "t", "counter", "slice", F.lit(True).alias("own")).unionByName(halo)
    recent = Window.partitionBy(source, "slice").orderBy("t", "counter").rowsBetween(-(keep - 1), 0)
    dt = F.col("t") - F.col("t0")
    out = both.withColumns({"t0": F.first("t").over(recent), "c0": F.first("counter").over(recent)})
    return out.filter("own").select(
        source, "t", "counter",
        F.when(dt > 0, F.greatest((F.col("counter") - F.col("c0")) / dt, F.lit(0.0))).otherwise(0.0).alias("rate"))


def growth_events(samples: DataFrame, source: str = "source", interval_s: int = fixed.CHECK_INTERVAL_S) -> DataFrame:
    """Checks, one per interval, at which a counter exceeds every earlier check.

    Input source, t, counter. A check sees the last sample of its interval.
    """
    check = F.floor(F.col("t") / interval_s).cast("long")
    checks = samples.groupBy(source, check.alias("check")).agg(F.max_by("counter", "t").alias("counter"))
    before = F.max("counter").over(Window.partitionBy(source).orderBy("check").rowsBetween(
        Window.unboundedPreceding, -1))
    seen = checks.withColumn("last", F.greatest(F.coalesce(before, F.lit(0)), F.lit(0)))
    return seen.filter(F.col("counter") > F.col("last")).select(
        source, "check", (F.col("counter") - F.col("last")).alias("grown"), F.col("counter").alias("total"))


def login_attempts(attempts: DataFrame, failures: int = fixed.LOGIN_FAILURES,
                   window_s: float = fixed.LOGIN_WINDOW_S) -> DataFrame:
    """Each attempt with `blocked`.

    Input address, us, seq, success. An attempt is blocked when `failures` counted
    failures lie in the trailing window; a blocked attempt counts neither as failure
    nor as success; a success clears the address.

    A pause longer than the window empties an address's state, so the rows between
    pauses are separate pieces. Pieces with too few failures to block anything need
    no state. The others are read in order, in constant memory, by a small fold.
    """
    window = int(window_s * 1e6)
    rows = attempts.select(F.struct("address").alias("key"), "us", "seq", "success",
                           F.col("us").alias("clock"))
    rows = rows.withColumn("slice", F.floor(F.col("us") / F.lit(16 * window)).cast("long"))
    rows = chain.carry(rows, {"before": (F.col("us"), False)})
    opens = F.col("before").isNull() | (F.col("us") - F.col("before") > window)
    rows = chain.carry(rows, {"piece": (F.when(opens, F.struct("us", "seq")), True)})
    rows = rows.select(F.col("key.address").alias("address"), F.col("piece.seq").alias("piece"),
                       "us", "seq", "success")
    risky = rows.groupBy("address", "piece").agg(F.count_if(~F.col("success")).alias("f")).filter(
        F.col("f") >= failures).select("address", "piece")
    calm = rows.join(risky, ["address", "piece"], "left_anti").withColumn("blocked", F.lit(False))
    ordered = rows.join(risky, ["address", "piece"], "left_semi").repartition(
        "address", "piece").sortWithinPartitions("address", "piece", "us", "seq")
    folded = ordered.mapInPandas(
        _block_fold(failures, window), "address string, piece long, us long, seq long, success boolean, blocked boolean")
    return calm.unionByName(folded).drop("piece")


def _block_fold(failures: int, window: int):
    def run(batches):
        owner, live = None, []
        for pdf in batches:
            blocked = []
            for address, piece, us, success in zip(pdf["address"], pdf["piece"], pdf["us"], pdf["success"]):
                if (address, piece) != owner:
                    owner, live = (address, piece), []
                while live and us - live[0] > window:
                    live.pop(0)
                shut = len(live) >= failures
                blocked.append(shut)
                if not shut:
                    live = [] if success else [*live, us]
            yield pdf.assign(blocked=blocked)
    return run
