"""License scans by ordered signature rules."""
import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import small_batches
from .license_rules import NAMES, PASSAGES

# The base: a phrase's words in a row, and its label.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
# Forms of a rule, first the strongest: priority, score, and what stands around the name.
TAG, NOTICE, PASSAGE, NAME, WEAK = range(5)
SCORES = (1.0, 0.95, 0.9, 0.7, 0.3)
WEAK_LABELS = {"unknown-license", "proprietary", "gpl", "lgpl", "bsd"}
_NOTICE = r"(?:licen[cs]ed|released|distributed|available|published|provided|covered|redistribute it) under (?:the )?(?:terms (?:of|and conditions of) )?(?:the )?"
# Bytes that are no words become spaces, A-Z become a-z.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _lines(table: str) -> list[list[str]]:
    return [[x.strip() for x in line.split(" | ", 2)] for line in table.strip().splitlines()]


def rules() -> list[tuple[int, str, bytes, re.Pattern]]:
    """(priority, label, keyword, expression): each name alone, in a notice and in a tag, and each passage."""
    out = []
    for label, keyword, name in _lines(NAMES):
        out.append((WEAK if label in WEAK_LABELS else NAME, label, keyword, f"(?:{name})"))
        out.append((NOTICE, label, keyword, f"{_NOTICE}(?:{name})"))
    for label in dict.fromkeys(x[0] for x in _lines(NAMES)):
        out.append((TAG, label, "spdx", f"spdx licen[cs]e identifier {re.sub('[^0-9a-z]+', ' ', label)}(?: only| or later)?"))
    for label, keyword, passage in _lines(PASSAGES):
        out.append((WEAK if label in WEAK_LABELS else PASSAGE, label, keyword, passage))
    # a name may only stand between words
    return [(p, label, k.encode(), re.compile(f"(?<= )(?:{x})(?= )".encode())) for p, label, k, x in out]


class Scanner:
    """Finds base phrases and detections in texts. A rule is tried only on texts that hold its keyword as a word."""

    def __init__(self):
        self.by_word: dict[bytes, list] = {}
        for rule in rules():
            self.by_word.setdefault(rule[2], []).append(rule)
        self.phrases = [(f" {p} ".encode(), label) for p, label in PHRASES]

    def detections(self, line: bytes, present: set[bytes]) -> list[tuple[int, int, int, str]]:
        """(priority, start, end, label) that no other one suppresses.

        The order is priority, then length, then place. A detection that lies within one kept before it, or is the same
        place under another rule, is suppressed.
        """
        found = sorted({(p, m.start() - m.end(), m.start(), label) for word in present for p, label, _, rx in self.by_word[word] for m in rx.finditer(line)})
        kept: list[tuple[int, int, int, str]] = []
        starts: list[int] = []
        # reach[k]: largest end of the kept intervals that start at or before starts[k]
        reach: list[int] = []
        for p, length, start, label in found:
            end, at = start - length, bisect_right(starts, start)
            if at and reach[at - 1] >= end:
                continue
            kept.append((p, start, end, label))
            starts.insert(at, start)
            reach.insert(at, max(end, reach[at - 1] if at else 0))
            while at + 1 < len(reach) and reach[at + 1] < end:
                at += 1
                reach[at] = end
        return kept

    def scan(self, text: str | None) -> tuple:
        words = (text or "").encode().translate(_TABLE).split()
        line = b" " + b" ".join(words) + b" "
        places, base = [], set()
        for phrase, label in self.phrases:
            at, counted, n = line.find(phrase), 0, 0
            while at >= 0:
                n += line.count(b" ", counted, at)
                counted = at
                places.append(n)
                base.add(label)
                at = line.find(phrase, at + 1)
        kept = self.detections(line, self.by_word.keys() & set(words)) if words else []
        labels = base | {x[3] for x in kept}
        score = max([SCORES[x[0]] for x in kept] + [SCORES[NOTICE]] * bool(base), default=0.0)
        return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)


_SCANNERS: list[Scanner] = []
COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row for each row of docs.

    Null and empty texts have no words, no labels and score 0. first_word and last_word are null without base phrases. The
    score is that of the strongest detection. Repeated rows get equal answers, null ids stay null, further columns play no
    part, and an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)

    @pandas_udf("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    def scanned(texts: pd.Series) -> pd.DataFrame:
        if not _SCANNERS:
            _SCANNERS.append(Scanner())
        out = pd.DataFrame([_SCANNERS[0].scan(t) for t in texts], columns=COLUMNS)
        return out.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.select("doc_id", scanned(F.col("text").cast("string")).alias("s")).select("doc_id", "s.*")
