"""Gapless ranks without gathering a group in one task."""
from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

# Rows that one task ranks, on average.
BUCKET = 200_000


def gapless(rows: DataFrame, draw: str, groups: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the rank, from 0, of each row in its group by (draw, *order). `draw` is uniform in [0, 1).

    The draw cuts a group into buckets of equal spread; a row's rank is the count of the buckets before its own, plus its
    rank there. Rows that agree in all of these get different ranks in any order.
    """
    rows = cut(rows)
    buckets = max(1, ceil(rows.count() / BUCKET))
    rows = rows.withColumn("_bucket", F.floor(F.col(draw) * buckets).cast("int"))
    by = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*groups, "_bucket"]
    before = (rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_before", F.coalesce(F.sum("_n").over(by), F.lit(0))).drop("_n"))
    own = F.row_number().over(Window.partitionBy(*keys).orderBy(draw, *order))
    return (rows.withColumn("_own", own).join(before, keys).withColumn(name, (F.col("_before") + F.col("_own") - 1).cast("long"))
            .drop("_bucket", "_own", "_before"))
