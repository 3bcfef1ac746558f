"""Number expressions."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed


def finite(x: Column) -> Column:
    """NaN, infinities and NULL become 0."""
    d = x.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")) | d.isNull(), 0.0).otherwise(d)


def rounded(x: Column) -> Column:
    """A double to a whole one, half away from zero, as round() gives it, but without a decimal number on the way."""
    near = F.rint(x)
    return F.when(F.abs(x - near) == 0.5, x + F.signum(x) * 0.5).otherwise(near)


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, rounded half to even; 0 where the whole is 0."""
    return F.bround(F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(0.0), digits)


def inverse_power(n: Column, alpha) -> Column:
    """Weight of a class with n rows: n^-alpha."""
    return F.pow(n.cast("double"), -alpha if isinstance(alpha, Column) else F.lit(-float(alpha)))


def bm25_idf(docs: Column, df: Column) -> Column:
    return F.log(1.0 + (docs - df + 0.5) / (df + 0.5))


def bm25_weight(tf: Column, length: Column, mean_length: Column) -> Column:
    k1, b = fixed.BM25_K1, fixed.BM25_B
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean_length))


def dot_radius(count: Column, largest: Column) -> Column:
    return 3 + 9 * F.sqrt(count / largest)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def coordinate(raw: Column) -> Column:
    """Numeric coordinate text, NULL for junk and NaN."""
    d = raw.try_cast("double")
    return F.when(~F.isnan(d), d)
