"""Quality rules: base counts of a text, and how much likelier trusted texts make its n-grams than the corpus does."""
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import is_small
from ..session import cut
from .common import BROADCAST_IDS, SPACE, let

# Buckets that words and pairs of words are hashed into; this bounds both multinomials.
BUCKETS = 1 << 14
# Counts added to each bucket, so that none is impossible.
PRIOR = 1.0
# Mean log-likelihood ratio of a text's n-grams, in nats, below which it is dropped.
THRESHOLD = -0.12
WINDOW = 5
SYMBOLS = "#*$%&|<>"
SPACES = "\x20\t\n\x0b\x0c\r"


def _range(first: int, last: Column) -> Column:
    """first..last, or no numbers."""
    return F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))


def word_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))


def buckets(hashes: Column) -> Column:
    """Buckets of all words, then of all pairs of words in a row."""
    single = F.transform(hashes, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    pairs = F.transform(_range(1, F.size(hashes) - 1), lambda i: F.pmod(F.xxhash64(F.get(hashes, i - 1), F.get(hashes, i)), F.lit(BUCKETS)).cast("int"))
    return F.concat(single, pairs)


def repeated_words(hashes: Column) -> Column:
    """Words in windows of WINDOW words that are found twice or more. Sorting finds the equal ones, in n log n steps."""
    windows = F.transform(_range(0, F.size(hashes) - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))

    def covered(places: Column) -> Column:
        steps = F.transform(_range(0, F.size(places) - 1),
                            lambda k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - F.get(places, k), F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def places(ordered: Column) -> Column:
        def again(k: Column) -> Column:
            own = F.get(ordered, k)["w"]
            return F.coalesce(F.get(ordered, k - 1)["w"] == own, F.lit(False)) | F.coalesce(F.get(ordered, k + 1)["w"] == own, F.lit(False))
        return F.sort_array(F.transform(F.filter(_range(0, F.size(ordered) - 1), again), lambda k: F.get(ordered, k)["at"]))

    def found(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(w)) < F.size(w), let(pairs, lambda ordered: let(places(ordered), covered))).otherwise(0)
    return let(windows, found)


def repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def ratios(docs: DataFrame, trusted: DataFrame) -> Column:
    """Constant array: log of target over raw probability of each bucket, in the order of the buckets.

    Target: rows of docs whose doc_id is in `trusted` (doc_id). Raw: all rows. The n-grams are counted where the texts
    are read, so at most BUCKETS rows leave a task.
    """
    ids = cut(trusted.select("doc_id").filter("doc_id is not null").distinct().withColumn("good", F.lit(1)))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    rows = rows.join(F.broadcast(ids) if is_small(ids, BROADCAST_IDS) else ids, "doc_id", "left")
    grams = rows.select(F.coalesce("good", F.lit(0)).alias("good"), F.explode(let(word_hashes(F.col("t")), buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("target"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    full = cut(every.join(counts, "bucket", "left").fillna(0, ["raw", "target"]))
    total = full.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    weight = (F.log((F.col("target") + PRIOR) / (total["target"] + PRIOR * BUCKETS))
              - F.log((F.col("raw") + PRIOR) / (total["raw"] + PRIOR * BUCKETS)))
    weights = [r["w"] for r in full.select("bucket", weight.alias("w")).orderBy("bucket").collect()]
    return F.from_json(F.lit(json.dumps(weights)), "array<double>")


def judged(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept), a row for each of docs.

    score is the mean log-likelihood ratio of the text's words and pairs of words, trusted texts against the corpus; null
    without words. A text that fails the base is dropped, else its score decides. Null and empty texts have no words and
    fail. Repeated rows get equal answers and count each time; further columns play no part; without trusted rows all
    weights come from the prior; an empty table gives an empty one.
    """
    weights = ratios(docs, trusted)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def scored(h: Column) -> Column:
        total = let(weights, lambda w: F.aggregate(buckets(h), F.lit(0.0), lambda a, b: a + F.get(w, b)))
        return F.struct(F.size(h).cast("long").alias("n_words"), repeated_words(h).cast("long").alias("n_repeat_words"),
                        F.when(F.size(h) > 0, total / (2 * F.size(h) - 1)).alias("score"))
    rows = docs.select(
        "doc_id", let(word_hashes(text), scored).alias("s"), F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        repeated_lines(text).cast("long").alias("n_dup_lines"))
    rows = rows.select("doc_id", "s.n_words", "word_chars", "n_symbols", "n_dup_lines", "s.n_repeat_words", "s.score")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(False)))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents whose every label says good quality and none says toxic."""
    marks = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return marks.filter("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")
