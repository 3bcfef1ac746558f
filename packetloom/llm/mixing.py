"""Mixing sources to target weights by Poisson replication."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup
from ..session import cut
from .common import fresh, let, unit
from .ranks import gapless

SEED = "mix-1"
# Target weight of a source: its rows to this power. Below 1, small sources are seen more often than large ones.
POWER = 0.5
# A mean above this is drawn as a sum of Poisson numbers of equal means of at most this.
MEAN = 64.0
# Copies that one step unfolds, so that a row of very many copies is never one long array.
STEP = 1024


def _key(source: str) -> Column:
    """Null sources are a source of their own."""
    return F.when(F.col(source).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(source).cast("string")))


def _cdf(mean: Column) -> Column:
    """P(X <= i) for i = 0.. of a Poisson number X, as far as doubles tell it from 1."""
    steps = F.sequence(F.lit(1), F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int"))
    first = F.exp(-mean)
    state = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * mean / i
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), F.concat(s["all"], F.array(s["c"] + p)).alias("all"))
    return F.aggregate(steps, state, step, lambda s: s["all"])


def rates(docs: DataFrame, source: str = "source", weights: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """(mix_key, rate, parts, cdf), one row for each source of docs: mean copies of a row, and how to draw them.

    weights: (source, weight) with weights >= 0; a source that is not listed gets 0. Without it, weight is rows ** POWER.
    total: rows wanted after mixing; by default as many as there are.
    """
    counts = cut(docs.groupBy(_key(source).alias("mix_key")).agg(F.count(F.lit(1)).alias("n")))
    if weights is None:
        weighted = counts.withColumn("w", F.pow("n", F.lit(POWER)))
    else:
        given = weights.groupBy(_key("source").alias("mix_key")).agg(F.sum("weight").alias("w"))
        weighted = counts.join(given, "mix_key", "left").fillna(0.0, ["w"])
    sums = weighted.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    wanted, share = (total if total is not None else sums["n"] or 0), (sums["w"] or 1.0)
    rate = F.col("w") / share * wanted / F.col("n")
    out = weighted.withColumn("rate", rate).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / MEAN)).cast("int"))
    return out.withColumn("cdf", _cdf(F.col("rate") / F.col("parts"))).select("mix_key", "rate", "parts", "cdf")


def drawn_by(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What a row's draws are hashed from: its id, or its text where it has none."""
    return F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("~"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))))


def copies(key: Column, parts: Column, cdf: Column) -> Column:
    """A Poisson number by inversion of a draw from (SEED, key), for each part."""
    def one(part: Column) -> Column:
        return let(unit(F.lit(SEED), key, part), lambda u: F.size(F.filter(cdf, lambda c: c <= u)))
    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0).cast("long"), lambda n, part: n + one(part))


def replicated(docs: DataFrame, rated: DataFrame, source: str = "source") -> DataFrame:
    """docs, each row as often as drawn, with struct column `mix`: copy (from 1), copies, rate and draw, the place in the mix.

    Rows of one id are drawn alike, and rows without one by their text, alike where it is the same. Rows that are drawn 0 times go: that is what mixing
    to lower weights does. An empty table gives an empty one.
    """
    names = docs.columns
    key, rate, parts, cdf, n, block, copy, by = (fresh(names, f"mix_{x}") for x in ("key", "rate", "parts", "cdf", "copies", "block", "copy", "by"))
    side = rated.select(F.col("mix_key").alias(key), F.col("rate").alias(rate), F.col("parts").alias(parts), F.col("cdf").alias(cdf))
    rows = lookup(docs.withColumns({key: _key(source), by: drawn_by() if "text" in names else F.col("doc_id").cast("string")}), side, key)
    rows = rows.withColumn(n, copies(F.col(by), F.col(parts), F.col(cdf))).drop(key, parts, cdf).filter(F.col(n) > 0)
    rows = rows.withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / STEP))))
    rows = rows.withColumn(copy, F.explode(F.sequence(F.col(block) * STEP + 1, F.least(F.col(n), (F.col(block) + 1) * STEP))))
    return rows.select(*[F.col(f"`{c}`") for c in names], F.struct(
        F.col(copy).alias("copy"), F.col(n).alias("copies"), F.col(rate).alias("rate"),
        unit(F.lit(SEED), F.col(by), F.col(copy), "place").alias("draw")).alias(fresh(names, "mix")))


def mixed_rows(docs: DataFrame, source: str = "source", weights: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """docs replicated to the target weights and shuffled over all partitions; its columns are kept."""
    mix = fresh(docs.columns, "mix")
    return replicated(docs, rates(docs, source, weights, total), source).orderBy(F.col(mix)["draw"]).drop(mix)


def mix_plan(docs: DataFrame) -> DataFrame:
    """(doc_id, source, rate, copies, copy, position, size, text_crc32): the mix, a row for each copy.

    Whole documents are replicated and shuffled to the order of their draws; size and crc32 are of the text that arrives
    there, in UTF-8 bytes, a null text has none. position is gapless from 0 over the whole mix, in the order of the draws.
    """
    mix = fresh(docs.columns, "mix")
    rows = replicated(docs, rates(docs)).orderBy(F.col(mix)["draw"])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = rows.select("doc_id", "source", F.round(f"{mix}.rate", 9).alias("rate"), f"{mix}.copies", f"{mix}.copy", f"{mix}.draw",
                       F.octet_length(text).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    return gapless(rows, "draw", [], ["doc_id", "text_crc32", "copy"], "position").drop("draw")


_BY = "coalesce(doc_id::VARCHAR, '~' || md5(coalesce(text, '')))"
MIX_SQL = f"""
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rated AS (SELECT source, pow(n, {POWER}) / sum(pow(n, {POWER})) OVER () * sum(n) OVER () / n AS rate FROM counts),
parted AS (SELECT *, greatest(1, ceil(rate / {MEAN}))::INT AS parts FROM rated),
cdf AS (SELECT source, rate, parts, rate / parts AS m, list_transform(range(0, ceil(rate / parts + 12 * sqrt(rate / parts) + 20)::INT + 1),
          lambda i: exp(i * ln(rate / parts) - rate / parts - lgamma(i + 1))) AS pmf FROM parted),
crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
numbered AS (SELECT row_number() OVER () AS row, doc_id, source, {_BY} AS mix_by, coalesce(text, '') AS text FROM documents),
sized AS (SELECT row, strlen(text) AS size, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(text), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS text_crc32 FROM numbered, crc),
drawn AS (SELECT row, d.doc_id, d.source, mix_by, c.rate, c.pmf, unnest(range(1, c.parts + 1)) AS part
          FROM numbered d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source),
us AS (SELECT *, ('0x' || substr(md5('{SEED}:' || mix_by || ':' || part), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM drawn),
ks AS (SELECT row, doc_id, source, mix_by, rate, part, list_sum(list_transform(range(1, len(pmf) + 1),
          lambda i: CASE WHEN list_sum(pmf[1:i]) <= u THEN 1 ELSE 0 END)) AS k FROM us),
summed AS (SELECT row, doc_id, source, mix_by, round(any_value(rate), 9) AS rate, sum(k)::BIGINT AS copies FROM ks GROUP BY row, doc_id, source, mix_by),
each AS (SELECT *, unnest(range(1, copies + 1)) AS copy FROM summed WHERE copies > 0)
SELECT doc_id, source, rate, copies, copy, size, text_crc32, row_number() OVER (ORDER BY
    ('0x' || substr(md5('{SEED}:' || mix_by || ':' || copy || ':place'), 1, 13))::BIGINT / 4503599627370496.0, doc_id NULLS FIRST, text_crc32, copy) - 1 AS position
FROM each JOIN sized USING (row)"""
