"""Helpers that several operators of this package use."""
import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import is_small
from ..session import cut

# Ids of 8 bytes up to which a list of ids is broadcast; beyond it, the join is shuffled.
BROADCAST_IDS = 500_000
# ASCII white space, as a class of Java's and DuckDB's expressions.
SPACE = "[\\x20\\x09-\\x0D]+"

ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


# Bytes hashed at a time.
CHUNK = 1 << 20
_BASE = np.uint64(0x9E6C63D0876A9A47)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, np.uint64)[_FOLD]
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_POWERS: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, for `n` places."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.full(max(n, CHUNK), x)) for x in (_BASE, _INVERSE)]
    return _POWERS


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word: a polynomial in its bytes, A-Z as a-z, from prefix sums over all of data."""
    raw = np.frombuffer(data, np.uint8)
    space = np.concatenate(([True], _IS_SPACE[raw], [True]))
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    return starts, span_hashes(raw, starts, ends)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes, A-Z as a-z; equal spans have equal hashes, wherever they stand."""
    power, inverse = _powers(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTER[raw] * power[: len(raw)])))
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * ODD[1])


def _pieces(data: bytes) -> list[bytes]:
    """A long text in pieces of about CHUNK bytes, cut before white space."""
    out, at = [], 0
    while len(data) - at > 2 * CHUNK:
        cut_at = next((k for k in range(at + CHUNK, len(data)) if _IS_SPACE[data[k]]), len(data))
        out.append(data[at:cut_at])
        at = cut_at
    return [*out, data[at:]]


def word_hashes(texts) -> list[np.ndarray]:
    """For each text the 64-bit hashes of its words: runs of anything but ASCII white space, A-Z as a-z. Null: none."""
    out: list[np.ndarray] = []
    held: list[bytes] = []

    def flush() -> None:
        lengths = np.fromiter(map(len, held), np.int64, len(held)) + 1
        starts, hashes = _hash_words(b" ".join(held))
        out.extend(np.split(hashes, np.searchsorted(starts, np.cumsum(lengths)[:-1])) if held else [])
        held.clear()

    size = 0
    for text in texts:
        data = text.encode() if text else b""
        if len(data) > 2 * CHUNK:
            flush()
            out.append(np.concatenate([_hash_words(x)[1] for x in _pieces(data)]))
            size = 0
            continue
        held.append(data)
        size += len(data) + 1
        if size > CHUNK:
            flush()
            size = 0
    flush()
    return out


def shingle_sets(texts, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of `width` words in a row; with fewer words, the whole sequence is one."""
    out: list[np.ndarray] = []
    for part in slices(list(texts), 256):
        found = word_hashes(part)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.concatenate(found) if found else np.empty(0, np.uint64)
        rolled = _rolled(flat, width)
        ends = np.cumsum(counts)
        for n, end in zip(counts.tolist(), ends.tolist()):
            if n >= width:
                own = np.sort(rolled[end - n:end - width + 1])
                new = np.empty(len(own), bool)
                new[0] = True
                np.not_equal(own[1:], own[:-1], out=new[1:])
                out.append(own[new])
            else:
                out.append(_rolled(flat[end - n:end], n) if n else np.empty(0, np.uint64))
    return out


def _rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    if len(hashes) < width:
        return np.empty(0, np.uint64)
    out = np.full(len(hashes) - width + 1, width, np.uint64)
    for k in range(width):
        out = out * ODD[0] + hashes[k:len(hashes) - width + 1 + k]
        out ^= out >> np.uint64(29)
    return mixed(out)


def portions(texts, size: int):
    """Lists of neighbouring texts, of about `size` characters, or of one longer text."""
    held, total = [], 0
    for text in texts:
        held.append(text)
        total += len(text or "")
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def slices(items, size: int):
    for k in range(0, len(items), size):
        yield items[k:k + size]


def remainder(doc_id: str | Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`: the fold of a document."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % by


def unit(*parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the parts, joined by ':'; SQL can state it. Null parts count as '~'."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("~")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def keep_ids(rows: DataFrame, ids: DataFrame, how: str = "left_semi", on: str = "doc_id", made: bool = False) -> DataFrame:
    """Rows whose id is in (left_semi) or not in (left_anti) a list of distinct ids.

    The list is broadcast if it is counted to hold no more than BROADCAST_IDS ids; else both sides are shuffled.
    """
    ids = ids if made else cut(ids)
    return rows.join(F.broadcast(ids) if is_small(ids, BROADCAST_IDS) else ids, on, how)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are long: fewer rows in an Arrow batch, unless the session names a number of its own."""
    name, usual = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(name, usual) == usual:
        spark.conf.set(name, str(rows))


def let(value: Column, use) -> Column:
    """use(value), with the value computed once for a row however often `use` names it, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def fresh(taken: list[str], name: str) -> str:
    """A column name that none of the taken ones equals, whatever its case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name
