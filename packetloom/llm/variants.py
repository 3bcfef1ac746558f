"""Spelling variants: words one edit apart, found by composing the vocabulary's acceptor with a one-edit transducer and itself."""
import re
import zlib
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import bounded
from ..session import cut
from .common import small_batches

RUN = re.compile("[A-Za-zÀ-ÿ]+")
# One run in so many loses a letter, so that a corpus without typing errors has some.
NOISE = 199
# Code points and occurrences from which a word is in the vocabulary.
LETTERS, OCCURRENCES = 6, 5
# A word's form must occur so many times as often.
RATIO = 5
# Words that one acceptor holds at most; prefixes with more are split by one more letter.
WORDS = 10_000
# Prefix lengths that one pass counts.
LENGTHS = 6
# Distinct words that a task holds before it hands on their counts.
HELD = 200_000

_FOLD = {c: c + 32 for c in range(65, 91)}


def runs(doc_id: int | None, text: str | None) -> Counter:
    """Occurrences of each result in one text: runs of letters, A-Z as a-z, some short of a code point. A null id is
    written as no text at all."""
    out: Counter = Counter()
    found = RUN.findall(text) if text and len(text) < 1 << 22 else map(re.Match.group, RUN.finditer(text or ""))
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    folded: Counter = Counter()
    for word, n in Counter(found).items():
        folded[word.lower() if word.isascii() else word.translate(_FOLD)] += n
    for word, n in folded.items():
        h = zlib.crc32(word.encode(), start)
        if h % NOISE == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
        out[word] += n
    return out


def vocabulary(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n): the words of all texts with at least so many code points and occurrences. Each task adds up its own
    counts before the shuffle, so a frequent word is a few rows."""
    small_batches(docs.sparkSession)

    def counted(batches):
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.doc_id, batch.t):
                for word, n in runs(doc_id, text).items():
                    if len(word) >= letters:
                        held[word] += n
                if len(held) > HELD:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held.clear()
        yield pd.DataFrame({"word": pd.Series(list(held), dtype=object), "n": pd.Series(list(held.values()), dtype="int64")})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("t"))
    return rows.mapInPandas(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


class Acceptor:
    """The minimal acyclic automaton of sorted distinct words, and the pairs that its composition with a one-edit
    transducer and itself accepts.

    States with the same right language are one state. A state knows how many words it accepts, so an accepted word is
    the sum of what it passes, not a string; `lengths` holds the lengths of its words modulo 64, as bits.
    """

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.final: list[bool] = []
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.counts: list[int] = []
        self.lengths: list[int] = []
        self.met: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def state(self, final: bool, arcs: list[tuple[str, int]]) -> int:
        key = (final, tuple(arcs))
        at = self.known.get(key)
        if at is None:
            at = self.known[key] = len(self.final)
            count, lengths, edges = int(final), int(final), {}
            for letter, to in arcs:
                edges[letter] = (to, count)
                count += self.counts[to]
                own = self.lengths[to]
                lengths |= (own << 1 | own >> 63) & 0xFFFFFFFFFFFFFFFF
            self.final.append(final)
            self.edges.append(edges)
            self.counts.append(count)
            self.lengths.append(lengths)
        return at

    def _below(self, a: int, b: int, without: str = "") -> tuple[list, list]:
        """Pairs that both states accept at once, and the arcs by which both go on: (rank in a, rank in b, states)."""
        left, right = self.edges[a], self.edges[b]
        out = [(0, 0)] if self.final[a] and self.final[b] else []
        arcs = []
        for letter in left if len(left) <= len(right) else right:
            x, y = left.get(letter), right.get(letter)
            if x and y and letter != without and self.lengths[x[0]] & self.lengths[y[0]]:
                arcs.append((x[1], y[1], (x[0], y[0])))
        return out, arcs

    def both(self, a: int, b: int) -> list[tuple[int, int]]:
        """Ranks in a and in b of the words that both accept. Each pair of states is explored once; no recursion, as
        words may be long."""
        todo = [(a, b)]
        while todo:
            pair = todo[-1]
            if pair in self.met:
                todo.pop()
            elif pair[0] == pair[1]:
                self.met[pair] = [(k, k) for k in range(self.counts[pair[0]])]
            else:
                out, arcs = self._below(*pair)
                missing = [p for _, _, p in arcs if p not in self.met]
                if missing:
                    todo += missing
                else:
                    self.met[pair] = out + [(i + x, j + y) for i, j, p in arcs for x, y in self.met[p]]
        return self.met[a, b]

    def edited(self, own: int, arcs: list[tuple[str, int]], first: int):
        """Pairs of words whose first difference is behind one prefix: `own` is its state, `first` its first word."""
        places = self.edges[own]
        for k, (letter, to) in enumerate(arcs):
            at = first + places[letter][1]
            # replaced: both go on, by different letters
            for other, there in arcs[k + 1:]:
                if self.lengths[to] & self.lengths[there]:
                    start = first + places[other][1]
                    for x, y in self.both(to, there):
                        yield at + x, start + y
            # inserted: one goes on by the letter, the other one stays, and does not use that letter next
            out, below = self._below(own, to, without=letter)
            for x, y in out:
                yield first + x, at + y
            for i, j, pair in below:
                for x, y in self.both(*pair):
                    yield first + i + x, at + j + y


def one_edit_pairs(words: list[str], prefix: int = 0):
    """Numbers (i, j) of all pairs of the sorted distinct words that share `prefix` code points or more before their one
    edit, each pair once.

    Words are added one after the other; once no further word can pass a prefix, its state is final, and what the
    composed automaton accepts from there on is enumerated.
    """
    machine = Acceptor()
    stack: list[list] = [[False, [], 0]]

    def closed(depth: int):
        while len(stack) > depth:
            final, arcs, first = stack.pop()
            own = machine.state(final, arcs)
            if len(stack) >= prefix:
                yield from machine.edited(own, arcs, first)
            if stack:
                stack[-1][1].append((before[len(stack) - 1], own))

    before = ""
    for k, word in enumerate(words):
        common = 0
        for a, b in zip(word, before):
            if a != b:
                break
            common += 1
        yield from closed(common + 1)
        stack += [[False, [], k] for _ in word[common:]]
        stack[-1][0] = True
        before = word
    yield from closed(0)


def _depths(words: DataFrame, most: int) -> DataFrame:
    """words with `depth`, the least length at which no more than `most` words share a word's prefix. Counts of longer
    prefixes are less, so a pass counts some lengths and only words that are crowded at all of them go on."""
    rows = cut(words.withColumn("depth", F.lit(1)))
    reached = 1
    while True:
        last = reached + LENGTHS - 1
        deep = rows.filter(F.col("depth") == reached)
        prefixes = deep.select(F.explode(F.transform(F.sequence(F.lit(reached), F.least(F.length("word"), F.lit(last))), lambda d: F.substring("word", 1, d))).alias("p"))
        crowded = bounded(prefixes.filter(F.length("p") >= reached).groupBy("p").count().filter(F.col("count") > most).select("p"))
        if crowded.isEmpty():
            return rows
        for d in range(reached, last + 1):
            here = crowded.filter(F.length("p") == d)
            at = (F.col("depth") == d) & (F.length("word") >= d)
            rows = rows.withColumn("p", F.when(at, F.substring("word", 1, d))).join(here.withColumn("more", F.lit(1)), "p", "left").select(
                *words.columns, (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        rows, reached = cut(rows), last + 1


def near_pairs(words: DataFrame, most: int = WORDS) -> DataFrame:
    """(word, near, near_n): each two words of (word, n) that differ by one inserted, deleted or replaced code point, both
    ways round. Words must be distinct and not null.

    The composed automaton is cut at its first states. Where both sides have read the same letters, one task goes on with
    the words of that prefix, of which there are at most `most`. Where the edit is among those first letters, what both
    sides still have to read must be equal, so that the two meet by a join on it: a row for each word and letter before
    the cut, with that letter left out, and one with all letters. A pair is found at its first difference only.
    """
    rows = _depths(words, most)

    def composed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("word", key=lambda s: s.map(lambda w: w.encode()))
        word, n = part.word.tolist(), part.n.tolist()
        pairs = list(one_edit_pairs(word, int(part.depth.iloc[0])))
        i, j = [p[0] for p in pairs] + [p[1] for p in pairs], [p[1] for p in pairs] + [p[0] for p in pairs]
        return pd.DataFrame({"word": [word[k] for k in i], "near": [word[k] for k in j], "near_n": [n[k] for k in j]}, dtype=object).astype({"near_n": "int64"})

    within = rows.withColumn("prefix", F.substring("word", F.lit(1), F.col("depth"))).groupBy("prefix").applyInPandas(
        composed, "word string, near string, near_n long")
    at = rows.select("word", "n", F.explode(F.sequence(F.lit(0), F.least(F.col("depth") - 1, F.length("word")))).alias("at"))
    letter = F.substring("word", F.col("at") + 1, F.lit(1)).alias("letter")
    without = at.filter(F.col("at") < F.length("word")).select(
        "word", "n", "at", letter, F.concat(F.substring("word", F.lit(1), F.col("at")), F.substring("word", F.col("at") + 2, F.length("word"))).alias("rest"))
    whole = at.select("word", "n", "at", letter, F.col("word").alias("rest"))
    # the words of a group differ in one letter, so a group has no more words than there are letters
    groups = (without.unionByName(whole).groupBy("at", "rest").agg(F.collect_list(F.struct("word", "n", "letter")).alias("all"))
              .filter(F.size("all") > 1).select("all", F.explode("all").alias("one")))
    across = (groups.select(F.col("one.word").alias("word"), F.explode(F.filter("all", lambda x: x["letter"] != F.col("one.letter"))).alias("other"))
              .select("word", F.col("other.word").alias("near"), F.col("other.n").alias("near_n")))
    return within.unionByName(across)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word that forms lead to. Each round doubles the steps; a form occurs RATIO
    times as often as its word, so chains are short and end."""
    steps = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = cut(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        steps = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return steps


def spelling_variants(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, ratio: int = RATIO, most: int = WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row for each word of the vocabulary of docs.

    form is the near word that occurs most, of equals the smallest, if it occurs `ratio` times as often as the word; root
    is where forms end. Null and empty texts have no words. Repeated rows count as often as they are there, a null id is
    written as no text, further columns play no part, and an empty table gives an empty one.
    """
    words = cut(vocabulary(docs, letters, occurrences))
    near = near_pairs(words, most).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("best"))
    told = cut(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "best"))
    often = -F.col("best.n") >= F.lit(ratio) * F.col("n")
    told = told.select("word", F.when(often, F.col("best.near")).alias("form"), "n", "n_near", F.when(often, -F.col("best.n")).alias("form_n"))
    roots = _roots(told.filter("form is not null"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


VARIANTS_SQL = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
found AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
told AS (SELECT doc_id, run, count(*) AS n FROM found GROUP BY doc_id, run),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(concat(doc_id, ':', run)), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS h FROM told, crc),
written AS (SELECT CASE WHEN h % {NOISE} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM written GROUP BY word HAVING length(word) >= {LETTERS} AND sum(n) >= {OCCURRENCES}),
cuts AS (SELECT word, n, unnest(range(length(word))) AS place FROM words),
short AS (SELECT word, n, place, substr(word, 1, place) || substr(word, place + 2) AS rest FROM cuts),
pairs AS (SELECT a.word, b.word AS near, b.n FROM short a JOIN short b ON a.place = b.place AND a.rest = b.rest AND a.word <> b.word
          UNION SELECT s.word, w.word, w.n FROM short s JOIN words w ON s.rest = w.word
          UNION SELECT w.word, s.word, s.n FROM short s JOIN words w ON s.rest = w.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS near, max(n) AS near_n FROM pairs GROUP BY word),
formed AS (SELECT w.word, CASE WHEN near_n >= {RATIO} * w.n THEN near END AS form, w.n, coalesce(n_near, 0) AS n_near,
           CASE WHEN near_n >= {RATIO} * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, form AS next FROM formed
          UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.next)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word AND c.next IS NULL"""
