"""Labelled flows to training sets."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import numeric, text
from ..session import cut
from .joins import bounded

BUCKET_BITS = 12
# Rows of a bucket that may be ranked in one task, and rows of one shape that are joined apart.
BUCKET_ROWS = 100_000
HEAVY_SHAPE = 1_000_000


# --- columns ------------------------------------------------------------------
def protocol_number(name: Column) -> Column:
    low = F.lower(name)
    out = F.lit(0)
    for word, number in fixed.PROTOCOL_NUMBERS.items():
        out = F.when(low == word, number).otherwise(out)
    return out.cast("double")


def prepared(raw: DataFrame) -> DataFrame:
    """Six clean feature columns, the label, the binary y; other columns are kept.

    Input has the source column names of a labelled-flow table, or the short ones.
    """
    rows = raw.withColumnsRenamed(fixed.LABELLED_COLUMNS)
    rows = rows.withColumn("protocol", protocol_number(F.col("protocol")))
    rows = rows.withColumn("duration_s", F.greatest(F.col("duration_s").cast("double") / 1e6, F.lit(0.0)))
    return rows.withColumns({c: numeric.finite(F.col(c)) for c in fixed.FEATURES}).withColumn(
        "y", F.when(F.upper(F.col(fixed.LABEL_COLUMN)) != fixed.BENIGN, 1).otherwise(0))


def reconstructable() -> Column:
    """There are packets, and bytes only where there are packets to carry them."""
    fp, bp = F.rint("fwd_packets"), F.rint("bwd_packets")
    return ((fp + bp > 0) & ~((F.col("fwd_bytes") > 0) & (fp == 0))
            & ~((F.col("bwd_bytes") > 0) & (bp == 0)))


def replay_safe(idle_s: float = fixed.IDLE_S, max_packets: int = 2000, max_duration_s: float = 100.0) -> Column:
    """Rows that one tracker would give back as exactly one flow."""
    fp, bp = F.rint("fwd_packets"), F.rint("bwd_packets")
    packets = fp + bp
    gap = F.when(packets > 1, F.col("duration_s") / (packets - 1)).otherwise(0.0)
    return (reconstructable() & (fp > 0) & (packets <= max_packets) & (F.col("duration_s") < max_duration_s)
            & (gap < idle_s * 0.8) & F.rint("protocol").isin(6, 17))


def where(rows: DataFrame, condition: Column) -> DataFrame:
    """rows.filter(condition), with each column of rows computed once a row.

    Spark moves a filter below the columns that it names and computes each anew wherever it is named, but not below row numbers.
    """
    name = "_row"
    while name in [c.lower() for c in rows.columns]:
        name = f"_{name}"
    return rows.withColumn(name, F.monotonically_increasing_id()).filter(condition & (F.col(name) >= 0)).drop(name)


def families(rows: DataFrame, label: str = fixed.LABEL_COLUMN) -> DataFrame:
    """Add the attack family of each raw label; unknown labels become the abstain family."""
    table = family_table(rows.sparkSession).withColumnRenamed("label", "_label")
    out = rows.withColumn("_label", text.clean_label(F.col(label))).join(F.broadcast(table), "_label", "left")
    return out.withColumn("family", F.coalesce("family", F.lit(fixed.ABSTAIN_FAMILY))).drop("_label")


def family_table(spark) -> DataFrame:
    return spark.createDataFrame(fixed.LABEL_FAMILY, "label string, family string")


def unmapped_labels(rows: DataFrame, label: str = fixed.LABEL_COLUMN) -> DataFrame:
    """Attack labels without a family."""
    seen = rows.filter(F.upper(F.col(label)) != fixed.BENIGN).select(text.clean_label(F.col(label)).alias("label")).distinct()
    return seen.join(F.broadcast(family_table(rows.sparkSession)), "label", "left_anti")


# --- hash order ---------------------------------------------------------------
def order_hash(row_id: Column, seed: int) -> Column:
    """60-bit number that orders rows at random but always the same way."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def in_order(rows: DataFrame, group: Column, row_id: str, seed: int) -> DataFrame:
    """(g, h, id) of rows, written: group, place in the hash order, id."""
    return cut(rows.select(group.alias("g"), order_hash(F.col(row_id), seed).alias("h"), F.col(row_id).alias("id")))


def cutoffs(rows: DataFrame, wanted: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The k-th smallest (h, id) of each group, for (g, mark, k) in `wanted`.

    rows: g, h, id, a written table. A histogram of the leading hash bits finds the
    bucket of each k-th row; buckets are split again, by the next bits, until they hold
    about `bucket_rows` rows, and only the rows of the last ones are ranked. The rows
    themselves are not shuffled, however large a group is. k = 0 gives no row.
    """
    count, shift = rows.count(), 60
    hit = wanted.select("g", F.lit(0).cast("long").alias("b"), "mark", F.col("k").cast("long").alias("k"))
    while shift == 60 or (shift > 0 and count >> (60 - shift) > bucket_rows):
        inside = rows.withColumn("b", F.shiftright("h", shift))
        if shift < 60:
            inside = inside.join(hit.select("g", "b").distinct(), ["g", "b"], "left_semi")
        shift -= BUCKET_BITS
        hist = inside.groupBy("g", "b", F.shiftright("h", shift).alias("c")).agg(F.count("*").alias("n"))
        upto = Window.partitionBy("g", "b").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("hi", F.sum("n").over(upto)).withColumn("lo", F.col("hi") - F.col("n"))
        hit = hist.join(hit, ["g", "b"]).filter((F.col("lo") < F.col("k")) & (F.col("k") <= F.col("hi")))
        hit = bounded(hit.select("g", F.col("c").alias("b"), "mark", (F.col("k") - F.col("lo")).alias("k")))
    inside = rows.withColumn("b", F.shiftright("h", shift)).join(hit, ["g", "b"])
    place = F.row_number().over(Window.partitionBy("g", "b", "mark").orderBy("h", "id"))
    return inside.withColumn("place", place).filter(F.col("place") == F.col("k")).select(
        "g", "mark", F.struct("h", "id").alias("cut"))


def stratified_split(rows: DataFrame, stratum: str, row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """Add `part`: 20% test, 20% val, 60% train within each stratum, by hash order."""
    h = order_hash(F.col(row_id), seed)
    slim = in_order(rows, F.col(stratum), row_id, seed)
    sizes = slim.groupBy("g").agg(F.count("*").alias("n"))
    test = F.ceil(F.col("n") * 0.2)
    val = F.ceil((F.col("n") - test) * 0.25)
    wanted = sizes.select("g", F.explode(F.array(
        F.struct(F.lit("test").alias("mark"), test.alias("k")),
        F.struct(F.lit("val").alias("mark"), (test + val).alias("k")))).alias("w")).select("g", "w.*")
    cuts = cutoffs(slim, wanted).groupBy("g").pivot("mark", ["test", "val"]).agg(F.first("cut"))
    me = F.struct(h.alias("h"), F.col(row_id).alias("id"))
    out = rows.withColumn("_me", me).join(bounded(cuts.withColumnRenamed("g", stratum)), stratum, "left")
    part = F.when(F.col("_me") <= F.col("test"), "test").when(F.col("_me") <= F.col("val"), "val").otherwise("train")
    return out.withColumn("part", part).drop("_me", "test", "val")


def group_split(rows: DataFrame, group: str = fixed.GROUP_COLUMN, held_out: float = 0.2, seed: int = 42) -> DataFrame:
    """Add `part`: whole groups are test or train; a fifth of the groups is test.

    One cut-off row decides, so rows of a hot group need no join on that group.
    """
    h = order_hash(F.col(group), seed)
    slim = in_order(rows.select(group).distinct(), F.lit(0), group, seed)
    wanted = slim.groupBy("g").agg(F.ceil(F.count("*") * held_out).alias("k")).withColumn("mark", F.lit("test"))
    last = cutoffs(slim, wanted).select("cut")
    me = F.struct(h.alias("h"), F.col(group).alias("id"))
    return rows.crossJoin(F.broadcast(last)).withColumn(
        "part", F.when(me <= F.col("cut"), "test").otherwise("train")).drop("cut")


def random_split(rows: DataFrame, stratum: str = "y", row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """80 / 20 within each stratum, before any dedup."""
    return stratified_split(rows, stratum, row_id, seed).withColumn(
        "part", F.when(F.col("part") == "test", "test").otherwise("train"))


def class_sample(rows: DataFrame, label: str = fixed.LABEL_COLUMN, per_attack: int = 25, benign: int = 120,
                 row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """A fixed number of rows per class, all of them where there are fewer.

    Spark keeps that many per class in each task before the shuffle.
    """
    order = Window.partitionBy(label).orderBy(order_hash(F.col(row_id), seed), row_id)
    most = max(per_attack, benign)
    limit = F.when(F.upper(F.col(label)) == fixed.BENIGN, benign).otherwise(per_attack)
    return (rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most)
            .filter(F.col("nth") <= limit).drop("nth"))


# --- balance, duplicates, weights ---------------------------------------------
def multiplicity(rows: DataFrame, heavy_rows: int = HEAVY_SHAPE, among: DataFrame | None = None) -> DataFrame:
    """Add mult: how often a benign row's exact vector occurs among all benign rows; attacks 1.

    `among` holds all rows where `rows` are those that are left of them: only these are joined then.
    Shapes of more than `heavy_rows` rows are at most rows / heavy_rows. They are sent to all tasks, so that no task
    gets the rows of a hot shape; the other rows are joined by shape.
    """
    shapes = cut((rows if among is None else among).filter("y = 0").groupBy(*fixed.FEATURES).agg(F.count("*").cast("double").alias("_m")))
    heavy = shapes.filter(F.col("_m") > heavy_rows)
    on = [F.col(f"r.{c}") == F.col(f"s.{c}") for c in fixed.FEATURES]
    if not heavy.isEmpty():
        rows = rows.alias("r").join(bounded(heavy).alias("s"), [*on, F.col("r.y") == 0], "left").select("r.*", F.col("s._m").alias("_hot"))
    else:
        rows = rows.withColumn("_hot", F.lit(None).cast("double"))
    benign, light = F.col("y") == 0, shapes.filter(F.col("_m") <= heavy_rows)
    some = rows.filter(benign & F.col("_hot").isNull()).alias("r").join(light.alias("s"), on, "left").select(
        "r.*", F.coalesce("s._m", F.lit(1.0)).alias("mult"))
    rest = rows.filter(~benign | benign.isNull() | F.col("_hot").isNotNull()).withColumn("mult", F.coalesce("_hot", F.lit(1.0)))
    return some.unionByName(rest).drop("_hot")


def balanced(rows: DataFrame, ratio: float = 2.0, row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """All attacks and at most `ratio` times as many benign rows, the first in hash order."""
    h = order_hash(F.col(row_id), seed)
    benign = rows.filter("y = 0")
    slim = in_order(benign, F.lit(0), row_id, seed)
    sizes = rows.agg(F.count_if(F.col("y") == 0).alias("b"), F.count_if(F.col("y") == 1).alias("a"))
    wanted = sizes.select(F.lit(0).alias("g"), F.least(F.col("b"), F.floor(F.col("a") * ratio)).alias("k"),
                          F.lit("keep").alias("mark"))
    last = cutoffs(slim, wanted).select("cut")
    me = F.struct(h.alias("h"), F.col(row_id).alias("id"))
    kept = benign.crossJoin(F.broadcast(last)).filter(me <= F.col("cut")).drop("cut")
    return rows.filter("y = 1").unionByName(kept)


def unique_shapes(rows: DataFrame, also: list[str], row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """First row, in hash order, per float32 vector and the columns in `also`.

    Duplicates are merged before the shuffle, so a shape with a third of all rows
    reaches its task as a few rows.
    """
    vector = {f"_f_{c}": F.col(c).cast("float") for c in fixed.FEATURES}
    order = F.struct(order_hash(F.col(row_id), seed), F.col(row_id))
    keep = F.struct(*rows.columns)
    return (rows.withColumns(vector).groupBy(*vector, *[F.col(c).alias(f"_k_{c}") for c in also])
            .agg(F.min_by(keep, order).alias("r")).select("r.*"))


def duplicate_stats(rows: DataFrame, also: list[str]) -> DataFrame:
    vector = F.struct(*[F.col(c).cast("float").alias(c) for c in fixed.FEATURES], *also)
    per = rows.groupBy(vector.alias("v")).agg(F.count("*").alias("n"))
    total, unique = F.sum("n"), F.count("*")
    return per.agg(total.alias("rows"), unique.alias("unique_rows"),
                   F.bround(1 - unique / total, 4).alias("duplicate_rate"))


def merged(rows: DataFrame, label: str = fixed.LABEL_COLUMN) -> DataFrame:
    """Rows of equal vector and label as one, with their number in `copies`."""
    return rows.groupBy(*fixed.FEATURES, "y", label).agg(F.count("*").alias("copies"))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def class_weights(rows: DataFrame, column: str, alpha: float) -> DataFrame:
    """Per class n and the weight n^-alpha, scaled so that the mean over rows is 1."""
    counts = rows.groupBy(column).agg(F.sum("copies").alias("n")) if "copies" in rows.columns else value_counts(rows, column)
    counts = counts.withColumn("_w", numeric.inverse_power(F.col("n"), alpha))
    mean = counts.agg((F.sum(F.col("n") * F.col("_w")) / F.sum("n")).alias("_mean"))
    return counts.crossJoin(F.broadcast(mean)).select(column, "n", (F.col("_w") / F.col("_mean")).alias("weight"))


def weighted(rows: DataFrame, column: str, alpha: float) -> DataFrame:
    """Add `weight` per row; alpha 0 is exactly 1 everywhere. A merged row has the weight of all its copies."""
    if alpha == 0:
        out = rows.withColumn("weight", F.lit(1.0))
    else:
        out = rows.join(bounded(class_weights(rows, column, alpha).drop("n")), column)
    return out.withColumn("weight", F.col("weight") * F.col("copies")) if "copies" in rows.columns else out
