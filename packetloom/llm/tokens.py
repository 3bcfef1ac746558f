"""Token counts of sections, from one encoding of the whole document."""
import base64
import re

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# How the vocabulary's texts are cut before pairs of bytes are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Runs of white space from this length on are encoded apart: the encoder's expressions fail on very long ones.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
Encoder = tuple[tiktoken.Encoding, np.ndarray]
_LOADED: dict[str, Encoder] = {}


def built(vocabulary: bytes) -> Encoder:
    """The encoder and the bytes of each token, from the lines of a vocabulary file."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def encoding(path: str = VOCABULARY) -> Encoder:
    """built() from a file, once in a process."""
    if path not in _LOADED:
        with open(path, "rb") as f:
            _LOADED[path] = built(f.read())
    return _LOADED[path]


def encoded(encoder: tiktoken.Encoding, text: str) -> list[int]:
    """The tokens of a text, as encode_ordinary() gives them. Of a long run of white space all but the last character are
    one piece by PATTERN, or all of it at the end of the text, so that it can be merged apart."""
    out, at = [], 0
    for run in _LONG_SPACE.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += encoder.encode_ordinary(text[at:run.start()])
        out += encoder._core_bpe.encode_single_piece(text[run.start():end].encode())
        at = end
    return out + encoder.encode_ordinary(text[at:]) if at else encoder.encode_ordinary(text)


def line_ends(data: np.ndarray) -> np.ndarray:
    """Ends, in bytes, of the sections of a text: its lines, each with its line feed. A text without bytes has one."""
    ends = np.flatnonzero(data == 10) + 1
    return ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data))


def allocate(tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, crossing) of each section, of tokens given by their lengths in bytes and sections given by their ends.

    A token belongs to the section that holds most of its bytes, to the first of these if several hold as many.
    crossing counts those of a section's tokens that reach into another one. Empty sections get no token.
    """
    stop = np.cumsum(tokens)
    start = stop - tokens
    first = np.searchsorted(ends, start, side="right")
    last = np.searchsorted(ends, stop - 1, side="right")
    owner = first.copy()
    for k in np.flatnonzero(first < last):
        edges = np.clip(ends[first[k]:last[k] + 1], start[k], stop[k])
        owner[k] += np.argmax(np.diff(edges, prepend=start[k]))
    return np.bincount(owner, minlength=len(ends)), np.bincount(owner[first < last], minlength=len(ends))


def _attributed(text: str | None, held: Encoder) -> list[dict]:
    encoder, lengths = held
    data = np.frombuffer((text or "").encode(), np.uint8)
    ends = line_ends(data)
    counts, crossing = allocate(lengths[np.array(encoded(encoder, text or ""), np.int64)], ends)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[ends]
    starts = np.concatenate(([0], points[:-1]))
    return [{"start": a, "end": b, "n_tokens": n, "n_crossing": c}
            for a, b, n, c in zip(starts.tolist(), points.tolist(), counts.tolist(), crossing.tolist())]


def attributed(spark: SparkSession, text: Column, path: str = VOCABULARY) -> Column:
    """array of (start, end, n_tokens, n_crossing): the sections of a text, in code points, end exclusive. The vocabulary,
    a file of one or two megabytes, is read by the driver and sent, so that executors need not see it."""
    with open(path, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())

    @pandas_udf("array<struct<start long, end long, n_tokens long, n_crossing long>>")
    def sections(texts: pd.Series) -> pd.Series:
        if path not in _LOADED:
            _LOADED[path] = built(sent.value)
        return pd.Series([_attributed(t, _LOADED[path]) for t in texts], dtype=object)
    return sections(text.cast("string"))


def section_tokens(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing), one row for each line of each row of docs, counted from 0.

    A document is encoded once and as a whole, so n_tokens sums to its tokens. Null and empty texts have one section of
    no token. Repeated rows give repeated sections, a null id stays null, further columns play no part, and an empty
    table gives an empty one.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.posexplode(attributed(docs.sparkSession, F.col("text"), path)).alias("section", "s"))
    return rows.select("doc_id", "section", "s.*")
