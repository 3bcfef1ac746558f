"""LM scoring: prediction by partial matching over bytes, and a unigram base over words."""
from math import log10
from uuid import uuid4

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..operators.joins import is_small, lookup
from ..session import cut
from .common import portions, remainder, small_batches, word_hashes

# Bytes of context. A gram is a context and the byte after it, packed in a 64-bit number, so 7 at most.
ORDER = 4
# Grams of all lengths together that are sent to every task: those of the most frequent contexts. All others are joined.
NODES = 1 << 20
# Words whose counts are sent to every task: the most frequent ones. All others are joined.
COMMON_WORDS = 100_000
# No byte of UTF-8: it ends a text, and stands before its start.
END = 255
SYMBOLS = 256
# Characters that are turned into grams at a time; a gram takes some 50 bytes meanwhile.
PART = 1_000_000


def grams(texts) -> tuple[np.ndarray, np.ndarray]:
    """(grams, counts): for all bytes of all texts, and each text's end, the byte with the ORDER bytes before it.

    counts: grams of each text, its bytes plus 1. A-Z count as a-z; a null text is empty.
    """
    pad = bytes([END]) * ORDER
    data = [t.encode().lower() if t else b"" for t in texts]
    lengths = np.fromiter(map(len, data), np.int64, len(data)) + 1
    flat = np.frombuffer(b"".join(pad + d + pad[:1] for d in data), np.uint8).astype(np.uint64)
    packed = np.zeros(len(flat), np.uint64)
    for k in range(ORDER + 1):
        packed[ORDER:] |= flat[ORDER - k:len(flat) - k] << np.uint64(8 * k)
    begins = np.cumsum(lengths + ORDER) - lengths
    coded = np.arange(lengths.sum()) + np.repeat(begins - (np.cumsum(lengths) - lengths), lengths)
    return packed[coded], lengths


def counted(texts) -> pd.DataFrame:
    """(kind, key, n): counts of grams (0), words (1) and ends (2) of some texts."""
    out = []
    for kind, found in ((0, grams(texts)[0]), (1, np.concatenate(word_hashes(texts)))):
        codes, keys = pd.factorize(found)
        out.append(pd.DataFrame({"kind": np.int32(kind), "key": keys.view(np.int64), "n": np.bincount(codes, minlength=len(keys))}))
    return pd.concat([*out, pd.DataFrame({"kind": np.array([2], np.int32), "key": [0], "n": [len(texts)]})])


def gathered(docs: DataFrame) -> DataFrame:
    """(kind, key, n) over all texts of docs; each task sums up what it reads before anything is shuffled."""
    def made(batches):
        for batch in batches:
            for part in portions(batch.t, 2 * PART):
                yield counted(part)
    return (docs.select(F.col("text").cast("string").alias("t")).mapInPandas(made, "kind int, key long, n long")
            .groupBy("kind", "key").agg(F.sum("n").alias("n")))


def trie(counts: DataFrame) -> tuple[list[tuple[np.ndarray, np.ndarray]], DataFrame | None]:
    """For each context length 0..ORDER the grams (sorted) of the most frequent contexts and their counts; and the table
    of all grams and contexts, (place, n, kinds, shadowed), or None if the first has all of them.

    Shorter grams sum up longer ones. A context is sent with all its grams or not at all, and what it ends in, being at
    least as frequent, is sent too; at most NODES grams reach the driver. No gram is dropped.
    """
    own = counts.filter("kind = 0")
    each = own.select("n", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("key").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("g"))
                                               for k in range(ORDER + 1)])).alias("x")).select("n", "x.*")
    sums = cut(each.groupBy("k", "g").agg(F.sum("n").alias("n")))
    sent, table = sums, None
    if not is_small(sums, NODES):
        # what the symbols of a context have in the next shorter one
        below = sums.select((F.col("k") + 1).alias("k"), F.col("g").alias("short"), F.col("n").alias("below"))
        longer = sums.withColumn("short", F.expr("g & (shiftleft(1L, 8 * k) - 1)"))
        contexts = cut(longer.join(below, ["k", "short"], "left").groupBy("k", F.shiftright("g", 8).alias("c")).agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"), F.coalesce(F.sum("below"), F.lit(0)).alias("shadowed")))
        bits = F.length(F.bin("n"))
        least, total = 65, 0
        for r in contexts.groupBy(bits.alias("bits")).agg(F.sum("kinds").alias("kinds")).orderBy(F.desc("bits")).collect():
            total += r["kinds"]
            if total > NODES:
                break
            least = r["bits"]
        frequent = contexts.filter(bits >= least).select("k", "c")
        sent = sums.withColumn("c", F.shiftright("g", 8)).join(frequent, ["k", "c"], "left_semi").select("k", "g", "n")
        none = F.lit(None).cast("long")
        table = sums.select(_place(F.col("k"), F.col("g"), 0).alias("place"), "n", none.alias("kinds"), none.alias("shadowed")).unionByName(
            contexts.select(_place(F.col("k"), F.col("c"), 1).alias("place"), "n", "kinds", "shadowed"))
    # by Arrow: a million rows as Python objects would take hundreds of MB
    kept = sent.toArrow().to_pandas().sort_values(["k", "g"])
    return [(x.g.to_numpy(np.int64).view(np.uint64), x.n.to_numpy(np.int64)) for k in range(ORDER + 1) for x in [kept[kept.k == k]]], table


def _place(k, key, context: int):
    """One number for a gram (0) or a context (1) of length k; works on columns and on arrays."""
    return (k * 2 + context) * (1 << 8 * (ORDER + 1)) + key


class Predictor:
    """log10 probabilities of grams. Escapes are estimated by the number of different symbols seen (method C); symbols
    of a longer context are excluded from the shorter one that it escapes to."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.levels = []
        for k, (keys, n) in enumerate(levels):
            contexts, first, kinds = np.unique(keys >> np.uint64(8), return_index=True, return_counts=True)
            total = np.add.reduceat(n, first) if len(n) else n
            shadowed = np.zeros(len(contexts), np.int64)
            if k and len(n):
                # what the symbols of this context have in the next shorter one
                found, at = self._find(levels[k - 1][0], keys & np.uint64((1 << 8 * k) - 1))
                shadowed = np.add.reduceat(np.where(found, levels[k - 1][1][at], 0), first)
            self.levels.append((keys, n, contexts, total, kinds, shadowed))

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return keys[at] == wanted, at

    def depth(self, wanted: np.ndarray) -> np.ndarray:
        """For each gram the length of its longest context that is here; -1 without any."""
        out = np.full(len(wanted), -1)
        for k in range(ORDER + 1):
            out[self._find(self.levels[k][2], (wanted & np.uint64((1 << 8 * (k + 1)) - 1)) >> np.uint64(8))[0]] = k
        return out

    def log10(self, wanted: np.ndarray, hidden: np.ndarray | None = None, kinds_hidden: np.ndarray | None = None) -> np.ndarray:
        """hidden, kinds_hidden: count and number of the symbols that longer contexts, which are not here, exclude."""
        out = np.zeros(len(wanted))
        todo = np.arange(len(wanted))
        hidden, kinds_hidden = (np.zeros(len(wanted), np.int64) if x is None else x.copy() for x in (hidden, kinds_hidden))
        for k in range(ORDER, -1, -1):
            keys, n, contexts, total, kinds, shadowed = self.levels[k]
            gram = wanted[todo] & np.uint64((1 << 8 * (k + 1)) - 1)
            known, at = self._find(contexts, gram >> np.uint64(8))
            if not known.any():
                continue
            places, at, gram = todo[known], at[known], gram[known]
            free, fresh = total[at] - hidden[places], kinds[at] - kinds_hidden[places]
            seen, where = self._find(keys, gram)
            whole = np.maximum(free + fresh, 1)
            with np.errstate(divide="ignore"):
                step = np.where(seen, np.log10(np.maximum(n[where], 1) / whole), np.where(fresh > 0, np.log10(np.maximum(fresh, 1) / whole), 0.0))
            out[places] += step
            hidden[places], kinds_hidden[places] = shadowed[at], kinds[at]
            done = np.zeros(len(todo), bool)
            done[np.flatnonzero(known)[seen]] = True
            todo = todo[~done]
        out[todo] -= np.log10(np.maximum(SYMBOLS - kinds_hidden[todo], 1))
        return out


# The trie that this process scores with, by the name of its fit.
_READY: dict[str, Predictor] = {}


def _asked(wanted: np.ndarray, predictor: Predictor) -> pd.DataFrame:
    """(gram, place): for each gram the grams and contexts of all lengths whose context the predictor has not."""
    depth, out = predictor.depth(wanted), []
    for k in range(ORDER + 1):
        own = wanted[depth < k]
        short = (own & np.uint64((1 << 8 * (k + 1)) - 1)).view(np.int64)
        out += [pd.DataFrame({"gram": own.view(np.int64), "place": _place(k, key, context)}) for context, key in ((0, short), (1, short >> 8))]
    return pd.concat(out)


def _joined_log10(rows: pd.DataFrame, predictor: Predictor) -> np.ndarray:
    """log10 probabilities of grams: first by what the table has of their contexts, then by the predictor."""
    out, todo = np.zeros(len(rows)), np.ones(len(rows), bool)
    hidden, kinds_hidden = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for k in range(ORDER, -1, -1):
        # 0 where the table has no such gram or context
        n, total, kinds, shadowed = (rows[f"{c}{k}"].to_numpy(np.int64) for c in ("n", "total", "kinds", "shadowed"))
        known = todo & (total > 0)
        seen, fresh = known & (n > 0), kinds - kinds_hidden
        whole = np.maximum(total - hidden + fresh, 1)
        missed = known & ~seen & (fresh > 0)
        out[seen] += np.log10(n[seen] / whole[seen])
        out[missed] += np.log10(fresh[missed] / whole[missed])
        hidden[known], kinds_hidden[known] = shadowed[known], kinds[known]
        todo &= ~seen
    out[todo] += predictor.log10(rows.gram.to_numpy(np.int64).view(np.uint64)[todo], hidden[todo], kinds_hidden[todo])
    return out


def _scored(texts, predictor: Predictor, whole: bool, words: np.ndarray, counts: np.ndarray, ends: int) -> pd.DataFrame:
    """Per text: key, n_tokens, tokens known and sum of log10(count + 1) by the common words, its other words, the score
    of the grams whose context the predictor has (all, if it is whole), its other grams."""
    found, lengths = grams(texts)
    codes, keys = pd.factorize(found)
    late = np.zeros(len(keys), bool) if whole else predictor.depth(keys) < ORDER
    ends_at = np.cumsum(lengths)
    score = np.add.reduceat(np.where(late, 0.0, predictor.log10(keys))[codes], ends_at - lengths)
    places = np.flatnonzero(late[codes])
    others = np.split(found[places], np.searchsorted(places, ends_at[:-1]))
    out = []
    for text, own, value, other in zip(texts, word_hashes(texts), score.tolist(), others):
        known, total, n = int(ends > 0), log10(ends + 1), len(own)
        if n and len(words):
            at = np.minimum(np.searchsorted(words, own), len(words) - 1)
            common = words[at] == own
            known += int(common.sum())
            total += float(np.log10(counts[at[common]] + 1.0).sum())
            own = own[~common]
        rare, times = np.unique(own, return_counts=True)
        other, other_times = np.unique(other, return_counts=True)
        out.append((xxhash.xxh64_intdigest((text or "").encode()) - (1 << 63), n + 1, known, total, rare.view(np.int64), times.astype(np.int32), value,
                    other.view(np.int64), other_times.astype(np.int32)))
    return pd.DataFrame(out, columns=["key", "n_tokens", "known", "total", "rare", "times", "score", "grams", "gram_times"])


def _late(rows: DataFrame, table: DataFrame, ready) -> DataFrame:
    """(key, late): of each text the score of the grams whose context was not sent; each distinct gram is looked up once."""
    texts = rows.filter(F.size("grams") > 0).select("key", "grams", "gram_times").dropDuplicates(["key"])
    each = cut(texts.select("key", F.explode(F.arrays_zip("grams", "gram_times")).alias("x")).select("key", F.col("x.grams").alias("gram"), "x.gram_times"))
    wanted = cut(each.select("gram").distinct())

    def asked(batches):
        for batch in batches:
            yield _asked(batch.gram.to_numpy(np.int64).view(np.uint64), ready())

    def valued(batches):
        for batch in batches:
            yield pd.DataFrame({"gram": batch.gram, "value": _joined_log10(batch, ready())})

    slot = F.shiftright("place", 8 * (ORDER + 1))
    facts = [F.coalesce(F.max(F.when(slot == 2 * k + context, F.col(c))), F.lit(0)).alias(f"{called}{k}") for k in range(ORDER + 1)
             for context, c, called in ((0, "n", "n"), (1, "n", "total"), (1, "kinds", "kinds"), (1, "shadowed", "shadowed"))]
    found = wanted.mapInPandas(asked, "gram long, place long").join(table, "place", "left").groupBy("gram").agg(*facts)
    # a gram is asked for with all lengths that it lacks, so none is missing from what was found
    values = cut(found.mapInPandas(valued, "gram long, value double"))
    return lookup(each, values, "gram").groupBy("key").agg(F.sum(F.col("gram_times") * F.col("value")).alias("late"))


def score_texts(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of docs.

    Both models learn from all rows whose fold is not `held`; a row with a null id is in no fold, teaches and is not held
    out. Null and empty texts have one token, their end. Repeated rows teach as often as they are there and get equal
    answers; further columns play no part. If nothing teaches, words have count 0 and all bytes are equally likely. An
    empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    out = F.coalesce(remainder("doc_id", folds) == held, F.lit(False))
    counts = cut(gathered(docs.filter(~out)))
    levels, table = trie(counts)
    sums = counts.filter("kind > 0").agg(
        F.sum("n").alias("tokens"), F.sum((F.col("kind") == 1).cast("int")).alias("kinds"), F.sum(F.when(F.col("kind") == 2, F.col("n"))).alias("ends")).first()
    tokens, ends = sums["tokens"] or 0, sums["ends"] or 0
    below = log10(tokens + (sums["kinds"] or 0) + (ends > 0) + 1)
    vocabulary = counts.filter("kind = 1").select("key", "n")
    common = vocabulary.orderBy(F.desc("n"), "key").limit(COMMON_WORDS).toPandas()
    words = common.key.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    name = uuid4().hex
    model = spark.sparkContext.broadcast((levels, table is None, words[order], common.n.to_numpy(np.int64)[order], ends))

    def ready() -> Predictor:
        if name not in _READY:
            _READY.clear()
            _READY[name] = Predictor(model.value[0])
        return _READY[name]

    @pandas_udf("key long, n_tokens long, known long, total double, rare array<long>, times array<int>, score double, grams array<long>, gram_times array<int>")
    def scored(texts: pd.Series) -> pd.DataFrame:
        parts = [_scored(x, ready(), *model.value[1:]) for x in portions(texts, PART)]
        return pd.concat(parts, ignore_index=True)

    rows = cut(docs.select("doc_id", out.alias("held_out"), scored(F.col("text").cast("string")).alias("s")).select("doc_id", "held_out", "s.*"))
    texts = rows.filter(F.size("rare") > 0).select("key", "rare", "times").dropDuplicates(["key"])
    each = texts.select(F.col("key").alias("text"), F.explode(F.arrays_zip("rare", "times")).alias("w")).select("text", F.col("w.rare").alias("key"), "w.times")
    rare = (each.join(vocabulary, "key").groupBy("text")
            .agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more")))
    if table is not None:
        rows = rows.join(_late(rows, table, ready), "key", "left").withColumn("score", F.col("score") + F.coalesce("late", F.lit(0.0)))
    joined = rows.drop("rare", "times").join(rare.withColumnRenamed("text", "key"), "key", "left").fillna(0, ["more_known", "more"])
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("more_known")).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("total") + F.col("more") - F.col("n_tokens") * below).alias("base_score"), "score")
