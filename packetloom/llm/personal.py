"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds to them."""
import hashlib
import re
from bisect import bisect_left

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import small_batches

KINDS = ("email", "ip", "card", "phone")
# The labelled table: so many rows with personal data, and as many without.
ROWS = 400
# Rounds and step of the fit, and its pull towards zero.
ROUNDS, STEP, PULL = 120, 0.5, 1e-3
# Features are hashed into so many columns.
FEATURES = 1 << 12
# A run of words must be so likely, against the same words without labels, in nats.
EVIDENCE = 2.0
# Words that are decoded together.
WORDS = 20_000

Span = tuple[int, int, int]

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def _luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(2 * d - 9 * (d > 4) for d in values[1::2])) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, not overlapping: for each @, the longest run before it that no earlier match has, and a domain after it.
    Steps grow with the length of the text, whatever it holds."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
        free = found.end() if found else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by kind, then start; code points, end exclusive. Matches that fail their check are dropped."""
    out: list[Span] = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


# The field. Labels: 0 outside, then begin and inside of each kind.
LABELS = 1 + 2 * len(KINDS)
_WORD = re.compile(r"[^\s]+")
_TELLING = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_START = np.array([True] + [k % 2 == 1 for k in range(1, LABELS)])
# Inside follows begin or inside of its kind only; a run also starts and ends outside.
_ALLOWED = np.array([[b == 0 or b % 2 == 1 or a in (b - 1, b) for b in range(LABELS)] for a in range(LABELS)])


def shape(word: str) -> str:
    """X, x and 9 for letters and digits, other characters as they are; runs of one sign are cut to two."""
    signs = "".join("9" if c.isdigit() else ("X" if c.isupper() else "x") if c.isalpha() else c for c in word[:64])
    return re.sub(r"(.)\1\1+", r"\1\1", signs)


def runs(text: str) -> list[list[tuple[int, int]]]:
    """Words with a digit or an @, as lists of neighbours. All other words are outside by the model, so that decoding
    these runs, each from outside to outside, decodes the whole text. Each word is read once, however long it is."""
    out: list[list[tuple[int, int]]] = []
    for m in _TELLING.finditer(text):
        if out and not text[out[-1][-1][1]:m.start()].strip():
            out[-1].append(m.span())
        else:
            out.append([m.span()])
    return out


def _neighbour(text: str, at: int, step: int) -> str:
    part = text[max(0, at - 40):at] if step < 0 else text[at:at + 40]
    found = part.split()
    return shape(found[-1] if step < 0 else found[0]) if found else ""


def features(text: str, run: list[tuple[int, int]]) -> list[list[str]]:
    shapes = [shape(text[a:b].strip(".,;:!?\"'")) for a, b in run]
    before, after = _neighbour(text, run[0][0], -1)[-2:], _neighbour(text, run[-1][1], 1)[:2]
    out = []
    for k, (a, b) in enumerate(run):
        digits = sum(map(str.isdigit, text[a:b]))
        left, right = shapes[k - 1] if k else before, shapes[k + 1] if k + 1 < len(run) else after
        out.append(["bias", f"s={shapes[k]}", f"s2={re.sub(r'(.)\1+', r'\1', shapes[k])}", f"n={min(digits, 20)}", f"l={left}", f"r={right}",
                    f"@={'@' in text[a:b]}", f".={min(text[a:b].count('.'), 4)}", f"ls={left}|{shapes[k]}", f"sr={shapes[k]}|{right}"])
    return out


def _columns(rows: list[list[str]]) -> np.ndarray:
    return np.array([[xxhash.xxh32_intdigest(x) % FEATURES for x in r] for r in rows], np.int64)


class Field:
    """weights: FEATURES x LABELS. moves: LABELS x LABELS; a run starts and ends at label 0."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def batches(self, columns: list[np.ndarray]):
        """Runs of one length at a time: their numbers, and emissions (runs, words, labels)."""
        lengths = np.array([len(c) for c in columns])
        for n in np.unique(lengths):
            chosen = np.flatnonzero(lengths == n)
            stacked = np.stack([columns[k] for k in chosen])
            emitted = self.weights[stacked[:, :, 0]]
            for f in range(1, stacked.shape[2]):
                emitted += self.weights[stacked[:, :, f]]
            yield chosen, emitted

    def decode(self, columns: list[np.ndarray]) -> list[tuple[np.ndarray, float]]:
        """Viterbi for each run: its labels, and their lead in score over no labels at all."""
        out: list = [None] * len(columns)
        moves = np.where(_ALLOWED, self.moves, -1e9)
        for chosen, emitted in self.batches(columns):
            best, back = moves[0] + emitted[:, 0], []
            for t in range(1, emitted.shape[1]):
                paths = best[:, :, None] + moves[None]
                back.append(paths.argmax(axis=1))
                best = paths.max(axis=1) + emitted[:, t]
            best = best + moves[:, 0]
            path = [best.argmax(axis=1)]
            for step in reversed(back):
                path.append(step[np.arange(len(chosen)), path[-1]])
            labels = np.stack(path[::-1], axis=1)
            none = emitted[:, :, 0].sum(axis=1) + (emitted.shape[1] + 1) * moves[0, 0]
            for k, row, lead in zip(chosen, labels, best.max(axis=1) - none):
                out[k] = row, float(lead)
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def fit(columns: list[np.ndarray], labels: list[np.ndarray]) -> Field:
    """Maximum likelihood with a pull towards zero, by adaptive gradient steps over the whole labelled table."""
    field = Field(np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)))
    if not columns:
        field.moves[0, 0] = 1.0
        return field
    seen_w, seen_m = np.full_like(field.weights, 1e-8), np.full_like(field.moves, 1e-8)
    for _ in range(ROUNDS):
        grad_w, grad_m = np.zeros_like(field.weights), np.zeros_like(field.moves)
        moves = np.where(_ALLOWED, field.moves, -1e9)
        for chosen, emitted in field.batches(columns):
            cols = np.stack([columns[k] for k in chosen])
            truth = np.stack([labels[k] for k in chosen])
            ahead = [moves[0] + emitted[:, 0]]
            for t in range(1, emitted.shape[1]):
                ahead.append(_logsum(ahead[-1][:, :, None] + moves[None], 1) + emitted[:, t])
            behind = [np.broadcast_to(moves[:, 0], ahead[0].shape)]
            for t in range(emitted.shape[1] - 1, 0, -1):
                behind.insert(0, _logsum(moves[None] + (emitted[:, t] + behind[0])[:, None, :], 2))
            norm = _logsum(ahead[-1] + moves[:, 0], 1)
            for t in range(emitted.shape[1]):
                wrong = np.exp(ahead[t] + behind[t] - norm[:, None])
                if t == 0:
                    grad_m[0] -= wrong.sum(axis=0)
                    np.add.at(grad_m, (np.zeros_like(truth[:, 0]), truth[:, 0]), 1)
                else:
                    both = np.exp(ahead[t - 1][:, :, None] + moves[None] + (emitted[:, t] + behind[t])[:, None, :] - norm[:, None, None])
                    grad_m -= both.sum(axis=0)
                    np.add.at(grad_m, (truth[:, t - 1], truth[:, t]), 1)
                if t == emitted.shape[1] - 1:
                    grad_m[:, 0] -= wrong.sum(axis=0)
                    np.add.at(grad_m, (truth[:, t], np.zeros_like(truth[:, t])), 1)
                wrong = -wrong
                wrong[np.arange(len(chosen)), truth[:, t]] += 1
                np.add.at(grad_w, cols[:, t], wrong[:, None, :])
        grad_w -= PULL * len(columns) * field.weights
        grad_m -= PULL * len(columns) * field.moves
        seen_w += grad_w ** 2
        seen_m += grad_m ** 2
        field.weights += STEP * grad_w / np.sqrt(seen_w)
        field.moves += STEP * grad_m / np.sqrt(seen_m)
    return field


def labelled(text: str, spans: list[Span]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The runs of a text, as feature columns and labels by the spans that overlap their words."""
    columns, labels = [], []
    for run in runs(text):
        row, last = [], None
        for a, b in run:
            own = next((s for s in spans if s[1] < b and a < s[2]), None)
            row.append(0 if own is None else 1 + 2 * own[0] + (own is last))
            last = own
        columns.append(_columns(features(text, run)))
        labels.append(np.array(row))
    return columns, labels


def variants(text: str, spans: list[Span]) -> list[tuple[str, list[Span]]]:
    """Labelled rows that teach what the fixed patterns can't find: phones without + and country, cards in groups."""
    out = []
    for kind, a, b in spans:
        value = text[a:b]
        if kind == 3 and (bare := re.sub(r"^\+[0-9]+ *", "", value)) != value and len(_DIGIT.findall(bare)) >= 7:
            out.append((text[:a] + bare + text[b:], [(3, a, a + len(bare))]))
        if kind == 2 and value.isdigit():
            grouped = " ".join(value[k:k + 4] for k in range(0, len(value), 4))
            out.append((text[:a] + grouped + text[b:], [(2, a, a + len(grouped))]))
    return out


def learn(docs: DataFrame, text_col: str = "text") -> Field:
    """Fitted on a small labelled table: at most ROWS rows with spans of the patterns and ROWS with digits or an @ but
    without, the first in the order of a hash of the text, each cut to the surroundings of what was found."""
    marked = docs.select(F.col(text_col).cast("string").alias("t")).filter(F.col("t").rlike("[0-9@]")).select(
        "t", F.xxhash64("t").alias("h"), F.col("t").rlike(r"@[A-Za-z0-9-]+\.|\+[0-9]|[0-9]{13}|([0-9]+\.){3}").cast("int").alias("hit"))
    at = F.greatest(F.regexp_instr("t", F.lit(r"[0-9@]")) - 200, F.lit(1))
    pieces = marked.select("hit", "h", F.substring("t", at, F.lit(600)).alias("t")).dropDuplicates(["hit", "h"])
    first = Window.partitionBy("hit").orderBy("h", "t")
    chosen = pieces.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= ROWS)
    rows = [r["t"] for r in chosen.orderBy("hit", "k").collect()]
    columns, labels = [], []
    for text in rows:
        spans = base_spans(text)
        # a variant holds one span for sure, so only its run is learned from
        for t, s in [(text, spans), *variants(text, spans)]:
            c, y = labelled(t, s)
            keep = [k for k in range(len(c)) if t is text or y[k].any()]
            columns += [c[k] for k in keep]
            labels += [y[k] for k in keep]
    return fit(columns, labels)


def _free(found: list[Span]):
    """Whether a span lies apart from all of these."""
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b in found):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def free(a: int, b: int) -> bool:
        k = bisect_left(starts, b) - 1
        return k < 0 or ends[k] <= a
    return free


def _spans(text: str, run: list[tuple[int, int]], path: np.ndarray, free) -> list[Span]:
    out: list[Span] = []
    at = 0
    while at < len(path):
        if not path[at]:
            at += 1
            continue
        end = at + 1
        while end < len(path) and path[end] and not _START[path[end]]:
            end += 1
        a, b = run[at][0], run[end - 1][1]
        while a < b and not (text[a].isalnum() or text[a] in "(+"):
            a += 1
        while a < b and not text[b - 1].isalnum():
            b -= 1
        if a < b and free(a, b):
            out.append((int(path[at] - 1) // 2, a, b))
        at = end
    return out


def added(texts: list[str], found: list[list[Span]], field: Field) -> list[list[Span]]:
    """For each text what the field finds apart from the spans already found, cut to its first and last letter, digit or
    bracket. The runs of all texts are decoded together, WORDS at a time, those of one length at once."""
    out: list[list[Span]] = [[] for _ in texts]
    held: list[tuple[int, list]] = []
    columns: list[np.ndarray] = []
    free: dict[int, object] = {}

    def decoded():
        for (k, run), (path, lead) in zip(held, field.decode(columns)):
            if lead >= EVIDENCE and path.any():
                if k not in free:
                    free[k] = _free(found[k])
                out[k] += _spans(texts[k], run, path, free[k])
        held.clear()
        columns.clear()

    words = 0
    for k, text in enumerate(texts):
        for run in runs(text) if text else ():
            held.append((k, run))
            columns.append(_columns(features(text, run)))
            words += len(run)
            if words > WORDS:
                decoded()
                words = 0
    if held:
        decoded()
    return out


def added_spans(text: str, found: list[Span], field: Field) -> list[Span]:
    """added() for one text."""
    return added([text], [found], field)[0]


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row for each row of docs.

    The counts and the hash are of the fixed patterns; spans adds what the field finds apart from them. Null and empty
    texts have none, and the hash of no text. Repeated rows get equal answers, null ids stay null, further columns play no
    part, and an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    field = learn(docs)
    model = docs.sparkSession.sparkContext.broadcast((field.weights.astype(np.float32), field.moves))

    @pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def found(texts: pd.Series) -> pd.DataFrame:
        bases, rows = [base_spans(text) if text else [] for text in texts], []
        for base, more in zip(bases, added(list(texts), bases, Field(*model.value))):
            rows.append((*[sum(s[0] == k for s in base) for k in range(len(KINDS))],
                         hashlib.sha256(written(base).encode()).hexdigest(), written(base + more)))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select("doc_id", found(F.col("text").cast("string")).alias("f")).select("doc_id", "f.*")
