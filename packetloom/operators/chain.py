"""Greedy segmentation of ordered rows within a key, without a task per key.

A row starts a segment when there is none open, the row before closed it, the
clock is `idle_us` past the row before, or the clock is `active_us` past the
segment's first row. The last rule makes the starts a chain: each one depends on
the one before. For a key that holds a large part of all rows that chain is found
in a distributed way:

* rows are hashed by (key, time slice), so one key spreads over many tasks;
* values are carried over slice borders with one summary row per slice;
* rows that start a segment whatever came before (gap, close) are heads;
* every other row gets a pointer to the start that would follow it, and the rows
  reachable from the heads are found by pointer doubling, in log2(chain) rounds.

Input columns: key (struct), us (long), seq (long, unique in the key), clock (long, not
decreasing in the order of us and seq), and booleans closes, fin_a, fin_b.
"""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .joins import bounded

# Rows of one key that may be gathered in one array.
GROUP_ROWS = 5_000
# Distinct instants of one key that a throttle may gather: two numbers each, under a megabyte.
FIRE_ROWS = 50_000
POSITION = ("us", "seq")
# Slices are sorted and joined by a hash of the key first: two keys are then told apart without reading their texts.
SLICE = ("_hash", "key", "slice")


def hot_keys(rows: DataFrame, limit: int = GROUP_ROWS) -> DataFrame | None:
    """Keys with more than `limit` rows, cut from lineage; None when there are none."""
    heavy = rows.groupBy("key").count().filter(F.col("count") > limit).select("key")
    if limit > 0 and heavy.isEmpty():
        return None
    return cut(heavy)


def carry(rows: DataFrame, values: dict[str, tuple[Column, bool]], backward: bool = False,
          order: tuple[str, ...] = POSITION) -> DataFrame:
    """Add, per name, the nearest non-null value before (or after) each row in its key.

    `values` maps a name to (expression, include the row itself). Rows need the
    columns key and slice; only one summary row per (key, slice) crosses slices.
    """
    by = [F.col(c).desc() if backward else F.col(c).asc() for c in order]
    here = Window.partitionBy(*SLICE).orderBy(*by)
    rows = rows.withColumn("_hash", F.xxhash64("key"))
    tmp = {n: f"_v_{n}" for n in values}
    rows = rows.withColumns({tmp[n]: v for n, (v, _) in values.items()})
    local = {}
    for n, (_, own) in values.items():
        frame = here.rowsBetween(Window.unboundedPreceding, 0 if own else -1)
        local[n] = F.last(tmp[n], ignorenulls=True).over(frame)
    pick = F.min_by if backward else F.max_by
    place = F.struct(*order)
    edges = rows.groupBy(*SLICE).agg(*[
        pick(F.col(t), F.when(F.col(t).isNotNull(), place)).alias(t) for t in tmp.values()])
    across = Window.partitionBy("_hash", "key").orderBy(
        F.col("slice").desc() if backward else F.col("slice").asc()
    ).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(*SLICE, *[
        F.last(t, ignorenulls=True).over(across).alias(f"_e_{n}") for n, t in tmp.items()])
    out = rows.withColumns(local).join(edges, list(SLICE), "left")
    return (out.withColumns({n: F.coalesce(F.col(n), F.col(f"_e_{n}")) for n in values})
            .drop("_hash", *tmp.values(), *[f"_e_{n}" for n in values]))


def running_max(rows: DataFrame, name: str, value: Column, own: bool = True,
                order: tuple[str, ...] = POSITION) -> DataFrame:
    """Add the largest value up to each row of its key (or before it). Needs the columns key and slice, as `carry`."""
    here = Window.partitionBy(*SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    across = Window.partitionBy("_hash", "key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_m": value, "_hash": F.xxhash64("key")})
    edges = rows.groupBy(*SLICE).agg(F.max("_m").alias("_m")).select(*SLICE, F.max("_m").over(across).alias("_e"))
    out = rows.withColumn("_m", F.max("_m").over(here)).join(edges, list(SLICE), "left")
    return out.withColumn(name, F.greatest("_m", "_e")).drop("_m", "_e", "_hash")


def reachable(heads: DataFrame, jumps: DataFrame) -> DataFrame:
    """Nodes (key, seq) met by following jumps (key, seq, nxt) from the heads."""
    found, jumps = cut(heads), cut(jumps)
    while not jumps.isEmpty():
        found = cut(found.unionByName(
            found.join(jumps, ["key", "seq"]).select("key", F.col("nxt").alias("seq"))))
        step = jumps.select("key", F.col("seq").alias("nxt"), F.col("nxt").alias("far"))
        jumps = cut(jumps.join(step, ["key", "nxt"]).select("key", "seq", F.col("far").alias("nxt")))
    return found


def segments(rows: DataFrame, idle_us: int, active_us: int, slice_us: int | None = None,
             teardown: bool = True) -> DataFrame:
    """Add `start` = struct(us, seq, tag) of the row that opens each row's segment.

    `tag` is the opening row's value of the optional column tag.

    Every step reads its rows twice, for the values and for the slices' edges, so the rows are written between steps:
    else each step would compute all those before it twice over.
    """
    width = slice_us or active_us
    if "tag" not in rows.columns:
        rows = rows.withColumn("tag", F.lit(None).cast("boolean"))
    rows = cut(rows.withColumn("slice", F.floor(F.col("clock") / F.lit(width)).cast("long")))
    at = F.struct(*POSITION)
    rows = carry(rows, {"prev": (F.struct("us", "closes"), False)})
    rows = cut(rows.withColumn(
        "hard", F.col("prev").isNull() | F.col("prev.closes")
        | (F.col("clock") - F.col("prev.us") >= idle_us)).drop("prev"))
    ahead = {"to_hard": (F.when(F.col("hard"), at), False)}
    if teardown:
        ahead["succ"] = (at, False)
    timed = _first_at(rows, active_us, width)
    rows = cut(carry(rows, ahead, backward=True))
    candidates = []
    if teardown:
        rows = carry(rows, {
            "end_a": (F.when(F.col("fin_a"), F.struct(*POSITION, "succ")), True),
            "end_b": (F.when(F.col("fin_b"), F.struct(*POSITION, "succ")), True),
        }, backward=True)
        candidates.append(F.when(F.col("end_a").isNotNull() & F.col("end_b").isNotNull(),
                                 F.greatest("end_a", "end_b")["succ"]))
    rows = rows.join(timed, ["key", "seq"], "left")
    if teardown:
        # A tracker's clock may be past the limit of a late packet already: the next row starts anew.
        rows = rows.withColumn("to_active", F.when(F.col("to_active") <= at, F.col("succ")).otherwise(F.col("to_active")))
    candidates += [F.col("to_active"), F.col("to_hard")]
    rows = rows.withColumn("to_any", F.least(*candidates))
    rows = cut(rows.drop("succ", "end_a", "end_b", "to_active"))
    soft = F.col("to_any").isNotNull() & (F.col("to_hard").isNull() | (F.col("to_any") < F.col("to_hard")))
    jumps = rows.filter(soft).select("key", "seq", F.col("to_any.seq").alias("nxt"))
    opened = reachable(rows.filter("hard").select("key", "seq"), jumps)
    rows = cut(rows.drop("to_hard", "to_any", "hard").join(opened.withColumn("opens", F.lit(True)), ["key", "seq"], "left"))
    mine = F.struct("us", "seq", "tag")
    rows = carry(rows, {"start": (F.when(F.col("opens"), mine), True)})
    return rows.drop("slice", "opens")


def _first_at(rows: DataFrame, active_us: int, width: int) -> DataFrame:
    """(key, seq, to_active): first row whose clock is >= the row's us + active_us."""
    real = rows.select("key", "clock", *POSITION, F.lit(1).alias("is_row"),
                       F.struct(*POSITION).alias("here"), F.lit(None).cast("long").alias("asks"))
    probe = rows.select("key", (F.col("us") + active_us).alias("clock"), *POSITION, F.lit(0).alias("is_row"),
                        F.lit(None).cast("struct<us:long,seq:long>").alias("here"),
                        F.col("seq").alias("asks"))
    both = real.unionByName(probe).withColumn(
        "slice", F.floor(F.col("clock") / F.lit(width)).cast("long"))
    both = carry(both, {"to_active": (F.col("here"), True)}, backward=True,
                 order=("clock", "is_row", *POSITION))
    return both.filter("asks is not null").select("key", F.col("asks").alias("seq"), "to_active")


def fires(rows: DataFrame, gap_us: int, limit: int = FIRE_ROWS) -> DataFrame:
    """Greedy throttle: keep a row when it is >= gap_us after the last kept row of its key.

    Input columns key, us, seq; output key, seq, us of the kept rows.
    """
    # Rows of the same instant can never be kept together: one of them is enough.
    first = rows.groupBy("key", "us").agg(F.min("seq").alias("seq"))
    heavy = hot_keys(first, limit)
    heavy = heavy if heavy is None else bounded(heavy, made=True)
    cold = first if heavy is None else first.join(heavy, "key", "left_anti")
    gathered = cold.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("us", "seq"))).alias("rows"))
    none = F.array().cast("array<struct<us:long,seq:long>>")
    kept = F.aggregate("rows", none, lambda acc, r: F.when(
        (F.size(acc) == 0) | (r["us"] - F.try_element_at(acc, F.lit(-1))["us"] >= gap_us),
        F.concat(acc, F.array(r))).otherwise(acc))
    out = gathered.select("key", F.explode(kept).alias("r")).select("key", "r.seq", "r.us")
    if heavy is None:
        return out
    hot = first.join(heavy, "key", "left_semi").withColumns({"clock": F.col("us"), "closes": F.lit(False)})
    opened = segments(hot, gap_us, gap_us, teardown=False).filter(F.col("start.seq") == F.col("seq"))
    return out.unionByName(opened.select("key", "seq", "us"))
