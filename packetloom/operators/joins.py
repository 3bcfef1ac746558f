"""Joins whose physical form depends on counted sizes."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

# Rows of a lookup table up to which it is broadcast (about 50 MB of lookup rows).
SMALL_ROWS = 200_000
# Rows of one key from which it is joined apart from the others.
HEAVY_ROWS = 5_000_000


def is_small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """Counted, not guessed: at most `rows` rows. Reads no more than it needs."""
    return df.limit(rows + 1).count() <= rows


def bounded(df: DataFrame, rows: int = SMALL_ROWS, made: bool = False) -> DataFrame:
    """The table with a broadcast hint if it is counted small, else as it is.

    It is written first, so that counting does not compute it twice; `made` says that
    it is a written table already.
    """
    df = df if made else cut(df)
    return F.broadcast(df) if is_small(df, rows) else df


def lookup(rows: DataFrame, table: DataFrame, on: str, heavy_rows: int = HEAVY_ROWS,
           small_rows: int = SMALL_ROWS) -> DataFrame:
    """Left join to a table with one row per key.

    A small table is broadcast. Otherwise the join is shuffled, but for keys that hold
    very many rows: their few table rows are broadcast, so no task gets a whole hot
    key. A stream can be counted neither way; it joins plainly.
    """
    if is_small(table, small_rows):
        return rows.join(F.broadcast(table), on, "left")
    if rows.isStreaming:
        return rows.join(table, on, "left")
    heavy = rows.groupBy(on).count().filter(F.col("count") > heavy_rows).select(on)
    heavy = cut(heavy)
    if heavy.isEmpty():
        return rows.join(table, on, "left")
    heavy = bounded(heavy, small_rows, made=True)
    hot = rows.join(heavy, on, "left_semi")
    cold = rows.join(heavy, on, "left_anti")
    hot_table = bounded(table.join(heavy, on, "left_semi"), small_rows)
    return cold.join(table, on, "left").unionByName(hot.join(hot_table, on, "left"))
