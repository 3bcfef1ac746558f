"""Phrase collocations by Toivonen's mining: a sample proposes phrases, full passes count them and their negative border."""
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..operators.joins import lookup
from ..session import cut
from .common import CHUNK, ODD, mixed, small_batches, span_hashes

# Words of the longest phrase, and occurrences of a phrase that counts.
LONGEST, SUPPORT = 4, 30
# One row in so many is in the sample, where a phrase is proposed from this share of its expected occurrences.
SAMPLE, LOWERED = 4, 0.4
# A phrase goes if a longer one that holds it has so many hundredths of its occurrences.
HELD_BY = 80
# Phrases that are returned of each language, and parts in which they are ranked first.
TOP, PARTS = 2000, 64
SCALE = 2_000_000
UNKNOWN = "und"
# Bits of a filter for each phrase, and bits at most (16 MB). A full filter only makes more phrases count.
BITS_EACH, BITS = 16, 1 << 27
# Bytes of text whose phrases a task counts at once.
READ = 2 * CHUNK
# Bytes hashed at once.
BLOCK = 1 << 17
# Phrases that a task remembers to have written.
SEEN = 1 << 20

_SPACE, _END = 32, 10
_BYTES = bytes(c + 32 if 65 <= c <= 90 else _SPACE if c in b" \t" else _END if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))


class Filter:
    """A set of hashes as a row of bits: it may hold more, never less."""

    def __init__(self, size: int, bits: np.ndarray | None = None):
        self.size = size
        self.bits = np.zeros(size // 8, np.uint8) if bits is None else bits

    @classmethod
    def of(cls, phrases: DataFrame, also: "Filter | None" = None, size: int | None = None) -> "Filter":
        """The hashes of (k, h), and those of a filter of that size. Bits are gathered where the rows are; the driver gets
        no more than the filter, which has BITS_EACH bits for a row and BITS at most."""
        if size is None:
            size, n = 1 << 16, phrases.count()
            while size < min(BITS, BITS_EACH * n):
                size *= 2
        at = F.col("h").bitwiseAND(F.lit(size - 1)) + 1
        blocks = phrases.groupBy(F.bitmap_bucket_number(at).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
        out = cls(size, also and also.bits.copy())
        for r in blocks.collect():
            own = out.bits[(r["block"] - 1) * 4096:r["block"] * 4096]
            own |= np.frombuffer(r["bits"], np.uint8)[:len(own)]
        return out

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes & np.uint64(self.size - 1)).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


class Words:
    """The words of texts in one language: their places in `raw`, hashes, and the piece that each is in. Words of a piece
    have one space between them."""

    def __init__(self, texts: list[bytes], lang: str):
        raw = np.frombuffer(b"\n".join(texts).translate(_BYTES), np.uint8)
        space = raw == _SPACE
        again = space[1:] & space[:-1]
        self.raw = raw = raw[np.append(~again, True)] if again.any() else raw
        end = raw == _END
        space = np.concatenate(([True], end | (raw == _SPACE), [True]))
        edges = np.flatnonzero(space[1:] != space[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.pieces = np.searchsorted(np.flatnonzero(end), self.starts)
        self.hashes = np.empty(len(self.starts), np.uint64)
        # hashed in blocks, so that the powers of the hash stay few
        for a in range(0, len(raw), BLOCK):
            first, last = np.searchsorted(self.starts, (a, a + BLOCK))
            if first < last:
                at, to = self.starts[first], self.ends[last - 1]
                self.hashes[first:last] = span_hashes(raw[at:to], self.starts[first:last] - at, self.ends[first:last] - at)
        self.language = np.array([xxhash.xxh64_intdigest(lang.encode())], np.uint64)
        self.hashes += self.language

    def phrases(self, longest: int):
        """For k = 1.. the hash of the k words from each place on, and whether they stand in one piece."""
        rolled = mixed(self.hashes)
        inside = np.ones(len(rolled), bool)
        yield 1, rolled, inside
        for k in range(2, longest + 1):
            n = max(0, len(self.hashes) - k + 1)
            rolled = mixed(rolled[:n] * ODD[0] + self.hashes[len(self.hashes) - n:])
            yield k, rolled, self.pieces[:n] == self.pieces[len(self.pieces) - n:]

    def texts(self, at: np.ndarray, k: int) -> pa.StringArray:
        """The k words from each of these places on, as they stand."""
        first = self.starts[at]
        lengths = self.ends[at + k - 1] - first
        ends = np.cumsum(lengths)
        letters = self.raw[np.arange(ends[-1] if len(at) else 0) + np.repeat(first - (ends - lengths), lengths)]
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(letters))


def tally(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct hash, in order of place, and how often the hash stands at the places `at`.

    The low bits of a hash give way to the number of its place, so that a plain sort finds equal ones; where hashes differ
    in these bits only, they are sorted whole.
    """
    if not len(at):
        return at, at
    own = hashes[at]
    low = np.uint64((1 << int(len(at)).bit_length()) - 1)
    order = np.sort((own & ~low) | np.arange(len(at), dtype=np.uint64))
    order, top = (order & low).astype(np.int64), order & ~low
    own = own[order]
    new = np.append(True, own[1:] != own[:-1])
    if (new[1:] & (top[1:] == top[:-1])).any():
        _, first, n = np.unique(hashes[at], return_index=True, return_counts=True)
    else:
        edges = np.flatnonzero(new)
        first, n = order[edges], np.diff(np.append(edges, len(at)))
    by_place = np.argsort(first)
    return at[first[by_place]], n[by_place]


def countable(words: Words, proposed: Filter | None, failed: Filter | None, longest: int):
    """For k = 1.. the hashes and places of the phrases to count: those whose first and last k - 1 words are proposed.
    Single words are always counted; without a filter nothing else is. With `failed`: only those phrases that hold a
    shorter failure, which takes the place of a proposal. None of them is countable without `failed`."""
    below = held = None
    for k, hashes, inside in words.phrases(longest):
        can = inside if k == 1 else inside & below[:-1] & below[1:]
        holds = np.zeros(len(can), bool) if k == 1 else can & (held[:-1] | held[1:])
        yield k, hashes, can if failed is None else holds
        if proposed is None or not len(can):
            return
        at = np.flatnonzero(can)
        known = proposed.holds(hashes[at])
        held, below = holds, np.zeros(len(can), bool)
        if failed is not None:
            held[at] |= failed.holds(hashes[at]) & ~known
        below[at] = known
        below |= held


def _batches(batches):
    """(lang, texts) of about READ bytes, or of one long text; longer texts are cut where a piece ends."""
    held, sizes = defaultdict(list), defaultdict(int)
    for batch in batches:
        for lang, data in zip(batch.column("lang").to_pylist(), batch.column("t").cast(pa.binary()).to_pylist()):
            if not data:
                continue
            if len(data) > 2 * READ:
                ends, at = _ends(data), 0
                while len(data) - at > 2 * READ and (k := np.searchsorted(ends, at + READ)) < len(ends):
                    yield lang, [data[at:ends[k]]]
                    at = int(ends[k])
                data = data[at:]
            held[lang].append(data)
            sizes[lang] += len(data) + 1
            if sizes[lang] > READ:
                yield lang, held.pop(lang)
                del sizes[lang]
            elif len(held) > 64 and sum(sizes.values()) > 4 * READ:
                yield from held.items()
                held.clear()
                sizes.clear()
    yield from held.items()


def _ends(data: bytes) -> np.ndarray:
    return np.flatnonzero(np.frombuffer(data.translate(_BYTES), np.uint8) == _END)


def _signed(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))


def counted(docs: DataFrame, proposed: Filter | None, failed: Filter | None, lengths: tuple[int, ...]) -> DataFrame:
    """(k, h, n): exact occurrences over all of (lang, t) of the countable phrases of these lengths, by the hash of
    language and words. k = 0 is the number of words of a language, where length 1 is asked for. Counts are added up for
    about READ bytes, then for a task, then over tasks."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((proposed, failed))

    def made(batches):
        for lang, texts in _batches(batches):
            words = Words(texts, lang)
            if 1 in lengths:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), _signed(words.language), pa.array([len(words.starts)], pa.int64())], ["k", "h", "n"])
            for k, hashes, can in countable(words, *sent.value, max(lengths)):
                if k in lengths:
                    at, n = tally(hashes, np.flatnonzero(can))
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(k, pa.int32()), len(at)), _signed(hashes[at]), pa.array(n, pa.int64())], ["k", "h", "n"])

    return docs.select("lang", "t").mapInArrow(made, "k int, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n"))


def spelled(docs: DataFrame, phrases: DataFrame, longest: int) -> DataFrame:
    """(k, h, lang, phrase): the words of the phrases of (k, h) that stand in (lang, t). A task writes each of them once,
    or once for about SEEN others."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(Filter.of(phrases))
    names = ["k", "h", "lang", "phrase"]

    def made(batches):
        seen = {k: np.empty(0, np.uint64) for k in range(longest + 1)}

        def new(k: int, hashes: np.ndarray) -> np.ndarray:
            """Places of the hashes that the task has not written; they count as written from now on."""
            at = np.flatnonzero(sent.value.holds(hashes))
            hashes, first = np.unique(hashes[at], return_index=True)
            near = np.searchsorted(seen[k], hashes)
            fresh = np.append(seen[k], 0)[near] != hashes if len(seen[k]) else np.ones(len(hashes), bool)
            fresh |= near == len(seen[k])
            seen[k] = np.sort(np.concatenate((seen[k] if len(seen[k]) < SEEN else seen[k][:0], hashes[fresh])))
            return np.sort(at[first[fresh]])

        for lang, texts in _batches(batches):
            words = Words(texts, lang)
            if len(new(0, words.language)):
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), _signed(words.language), pa.array([lang]), pa.array([""])], names)
            for k, hashes, inside in words.phrases(longest):
                places = np.flatnonzero(inside)
                at = places[new(k, hashes[places])]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(k, pa.int32()), len(at)), _signed(hashes[at]), pa.repeat(pa.scalar(lang), len(at)), words.texts(at, k)], names)

    found = docs.select("lang", "t").mapInArrow(made, "k int, h long, lang string, phrase string")
    return found.join(phrases.select("k", "h"), ["k", "h"]).distinct()


def proposals(sample: DataFrame, support: int, longest: int) -> Filter:
    """The phrases that occur `support` times in the sample, found one length after the other."""
    words = cut(counted(sample, None, None, (1,)).filter((F.col("k") == 1) & (F.col("n") >= support)))
    size = 1 << 16
    while size < min(BITS, BITS_EACH * longest * words.count()):
        size *= 2
    held = Filter.of(words, size=size)
    for k in range(2, longest):
        held = Filter.of(cut(counted(sample, held, None, (k,)).filter(F.col("n") >= support)), held, size)
    return held


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, sample: int = SAMPLE, lang: str = "lang") -> DataFrame:
    """(lang, k, phrase, n): all phrases of at most `longest` words with `support` occurrences or more, and with k = 0 the
    number of words of each language.

    The sample proposes phrases; a full pass counts these and the negative border, the phrases whose parts are all
    proposed but not they themselves, and single words. A phrase of the border that turns out frequent is a failure: a
    frequent phrase was left out only if it holds one. A further pass counts every phrase that holds a failure, however
    it goes on, which closes the border: whatever it finds frequent has been expanded by the same pass. Without failures
    there is no such pass. Phrases are counted by 64-bit hashes and spelled when they are known to be frequent, from the
    sample where it has them.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("t"), "doc_id")
    chosen = F.pmod(F.xxhash64("doc_id", "t"), F.lit(sample)) == 0
    rows, few = rows.drop("doc_id"), cut(rows.filter(chosen).drop("doc_id"))
    held = proposals(few, max(1, int(LOWERED * support / sample)), longest)
    often = (F.col("n") >= support) | (F.col("k") == 0)
    found = cut(counted(rows, held, None, tuple(range(1, longest + 1))).filter(often))
    failures = cut(found.filter(F.col("k").between(1, longest - 1)).filter(~_known(found, held)))
    if not failures.isEmpty():
        found = found.unionByName(cut(counted(rows, held, Filter.of(failures, size=held.size), tuple(range(2, longest + 1))).filter(often)))
    names = cut(spelled(few, found, longest))
    missing = cut(found.join(names, ["k", "h"], "left_anti").select("k", "h"))
    if not missing.isEmpty():
        names = names.unionByName(cut(spelled(rows, missing, longest)))
    return cut(found.join(names, ["k", "h"]).select("lang", "k", "phrase", "n"))


def _known(phrases: DataFrame, held: Filter) -> Column:
    """Whether the filter holds h."""
    sent = phrases.sparkSession.sparkContext.broadcast(held)

    @pandas_udf("boolean")
    def known(hashes: pd.Series) -> pd.Series:
        return pd.Series(sent.value.holds(hashes.to_numpy(np.int64).view(np.uint64)))
    return known("h")


def _whole(x: Column) -> Column:
    """Products of counts may pass 64 bits."""
    return x.cast("decimal(20,0)")


def _part(words: str, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def scored(phrases: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(lang, phrase, a, l, r, score) of each phrase of two words or more: its lowest-scoring cut, the first of equals,
    without those that a longer phrase holds nearly as often."""
    phrases = phrases.filter("k > 0")
    table = phrases.select(F.struct("lang", F.col("phrase").alias("part")).alias("key"), "n")
    made = phrases.filter((F.col("k") > 1) & (F.col("n") >= support)).select("lang", "phrase", "k", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    inner = made.filter("k > 2").select(
        "lang", "a", "k", "w", F.explode(F.expr("sequence(2, k - 1)")).alias("size")).select(
        "lang", "a", "w", "size", F.explode(F.expr("sequence(1, k - size + 1)")).alias("start")).select(
        "lang", _part("w", F.col("start"), F.col("size")).alias("phrase"), F.lit(None).cast("long").alias("a"), F.col("a").alias("longer"))
    both = made.select("lang", "phrase", "a", F.lit(None).cast("long").alias("longer")).unionByName(inner)
    # every part of a phrase that counts does so itself, so each group has its phrase
    kept = both.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("longer").alias("longer")).filter(
        F.col("longer").isNull() | (_whole(F.col("longer")) * 100 < _whole(F.col("a")) * HELD_BY)).drop("longer")
    parts = kept.select("lang", "phrase", "a", F.split("phrase", " ").alias("w")).select("*", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("cut"))
    parts = parts.select("lang", "phrase", "a", "cut", F.explode(F.array(
        F.struct(F.lit(True).alias("first"), _part("w", F.lit(1), F.col("cut")).alias("part")),
        F.struct(F.lit(False).alias("first"), _part("w", F.col("cut") + 1, F.size("w") - F.col("cut")).alias("part")))).alias("x"))
    parts = cut(parts.select("lang", "phrase", "a", "cut", "x.first", F.struct("lang", "x.part").alias("key")))
    cuts = lookup(parts, table, "key").groupBy("lang", "phrase", "a", "cut").agg(
        F.max(F.when(F.col("first"), F.col("n"))).alias("l"), F.max(F.when(~F.col("first"), F.col("n"))).alias("r"))
    score = F.expr(f"cast({SCALE} as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def collocations(docs: DataFrame, top: int = TOP, support: int = SUPPORT, longest: int = LONGEST, sample: int = SAMPLE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to `longest` words.

    A null lang is `und`. Null and empty texts have no words; a language without words or frequent phrases has no row,
    as has an empty table. Repeated rows count as often as they are there; doc_id decides with the text what is in the
    sample and may be null; further columns play no part. Ties in the score go by a, then by the phrase's bytes.
    """
    phrases = frequent_phrases(docs, support, longest, sample)
    totals = phrases.filter("k = 0").select("lang", F.col("n").alias("n"))
    found = cut(scored(phrases, support))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # ranked in parts first, so that a language is no single task's work
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    few = found.withColumn("part", part).withColumn("k", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("k") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return lookup(ranked, totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


COLLOCATIONS_SQL = f"""
WITH folded AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM folded),
listed AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM listed),
parted AS (SELECT lang, w, i, unnest(range(1, {LONGEST} + 1)) AS k FROM placed),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::HUGEINT AS n FROM parted WHERE i + k - 1 <= len(w) GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang),
made AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= {SUPPORT}),
sizes AS (SELECT *, unnest(range(2, k)) AS size FROM made),
starts AS (SELECT *, unnest(range(1, k - size + 2)) AS start FROM sizes),
held AS (SELECT lang, array_to_string(w[start:start + size - 1], ' ') AS phrase, max(a) AS longer FROM starts GROUP BY ALL),
kept AS (SELECT m.* FROM made m LEFT JOIN held h USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {HELD_BY} * a),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM kept),
valued AS (SELECT c.lang, c.phrase, c.a, c.cut, x.n AS l, y.n AS r, {SCALE} * c.a // (x.n + y.n) AS score FROM cuts c
    JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
    JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
best AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}"""
