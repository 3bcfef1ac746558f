"""Capture files (pcap, pcapng) as packet rows, many tasks to a file.

Records of a capture form a chain, so a task that starts in the middle of a file cannot know where a record begins. Each
byte range therefore guesses its first record by a run of plausible headers, walks to its end and reports where it
started and where it would go on. If every range starts where the one before goes on, all guesses are right and the
ranges are decoded independently; a file for which that does not hold is walked once from its start, headers only. So
the rows, their numbers included, are those of a sequential reader for every range size.

Only paths that pyarrow opens (local and shared folders, s3, gs, hdfs) are read in ranges. Files of any other store are
read by Spark as whole contents, one file a row.
"""
import json
import re
import struct
from itertools import islice
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut

# Fixed values of the capture formats. File magic as stored: byte order and ticks per second.
MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1_000_000), b"\xa1\xb2\xc3\xd4": (">", 1_000_000),
    b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000), b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000),
}
SECTION, LITTLE, BIG = b"\x0a\x0d\x0d\x0a", b"\x4d\x3c\x2b\x1a", b"\x1a\x2b\x3c\x4d"
INTERFACE_BLOCK, OLD_PACKET_BLOCK, SIMPLE_BLOCK, PACKET_BLOCK = 1, 2, 3, 6
TICKS_OPTION, OFFSET_OPTION = 9, 14
# Link types and the bytes before the IP header: Ethernet, raw IP, BSD loopback, Linux cooked.
LINK_BYTES = {1: 14, 101: 0, 12: 0, 0: 4, 113: 16}
CAPTURE = ("capture string, number long, nth long, us long, usable boolean, src_ip string, dst_ip string, src_port int, "
           "dst_port int, proto int, payload_len int, syn boolean, rst boolean, fin boolean, ack boolean")
PARTS = ("path string, number long, size long, part long, first long, next long, records long, faces string, "
         "known boolean, cut boolean")
BATCH = 50_000
SPLIT = 32 << 20
STEP = 4 << 20
# A guess must hold for this many records in a row, or up to the end of the file. Bytes of the longest plausible record.
RUN, LONGEST = 8, 1 << 18
DIRECT = ("file", "s3", "s3a", "gs", "hdfs")


# --- operators ------------------------------------------------------------------
def capture_packets(spark: SparkSession, path: str, split_bytes: int = SPLIT, known: DataFrame | None = None) -> DataFrame:
    """Packet rows of all capture files below a path; nth counts the records of a file from 0.

    Rows that are not IPv4 TCP or UDP, or that have no time (simple packet blocks), have usable = false. A record that
    the file's end cuts, a damaged one and all after it give no row; `capture_files` says which files hold some.
    `known` (path, number) holds the numbers that files were given before, see `numbered`.
    """
    if not direct(spark, path):
        files = numbered(_listed(spark, path), known).join(_listed(spark, path, content=True).select("path", "content"), "path")
        return decode(files)
    return ranges_decoded(parts(spark, path, split_bytes, known))


def capture_files(spark: SparkSession, path: str, split_bytes: int = SPLIT, known: DataFrame | None = None) -> DataFrame:
    """One row per file: path, number, size, records, known (false: no capture), cut (its last record can't be read).

    Spark lists neither empty files nor those whose names start with _ or a dot."""
    if not direct(spark, path):
        files = numbered(_listed(spark, path), known).join(_listed(spark, path, content=True).select("path", "content"), "path")
        rows = files.select("path", "number", "content").mapInPandas(_walked_contents, PARTS)
    else:
        rows = parts(spark, path, split_bytes, known)
    return rows.groupBy("path", "number").agg(F.max("size").alias("size"), F.sum("records").alias("records"),
                                              F.bool_and("known").alias("known"), F.bool_or("cut").alias("cut"))


def decode(files: DataFrame) -> DataFrame:
    """Packet rows of capture contents that are already rows: path, number, content."""
    return files.select("path", "number", "content").mapInPandas(_decode_contents, CAPTURE)


def packet_rows(captured: DataFrame) -> DataFrame:
    """Usable captured packets in the packet shape; seq is unique over all files."""
    seq = F.col("number") * F.lit(1 << 32) + F.col("nth")
    return captured.filter("usable").select(
        seq.alias("seq"), F.timestamp_micros("us").alias("ts"), "src_ip", "dst_ip", "src_port", "dst_port",
        "proto", "payload_len", "syn", "rst", "fin", "ack", "capture")


def capture_counts(captured: DataFrame) -> DataFrame:
    return captured.agg(F.count("*").alias("packets_read"), F.count_if("usable").alias("admitted"),
                        F.count_if(~F.col("usable")).alias("ignored"))


def numbered(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Files (path, modificationTime) with `number`: known ones keep theirs, others follow by time of writing, then path.

    So files that are added later leave the numbers of earlier ones alone; to be safe from changed times as well, keep
    (path, number) and hand it in. Only the file list passes through the window, never contents.
    """
    if known is None:
        return files.withColumn("number", F.row_number().over(Window.orderBy("modificationTime", "path")).cast("long"))
    rows = files.join(known.select("path", F.col("number").alias("held")), "path", "left")
    new = F.row_number().over(Window.partitionBy(F.col("held").isNull()).orderBy("modificationTime", "path"))
    top = known.agg(F.coalesce(F.max("number"), F.lit(0)).alias("top"))
    return rows.withColumn("nth_new", new).crossJoin(F.broadcast(top)).withColumn(
        "number", F.coalesce("held", F.col("top") + F.col("nth_new")).cast("long")).drop("held", "nth_new", "top")


def parts(spark: SparkSession, path: str, split_bytes: int = SPLIT, known: DataFrame | None = None) -> DataFrame:
    """Byte ranges of the files, with their true first record, the place after their last one, and their count."""
    return ranges(numbered(_listed(spark, path), known), split_bytes)


def ranges(files: DataFrame, split_bytes: int = SPLIT) -> DataFrame:
    """The same for listed and numbered files: path, number, length."""
    spark = files.sparkSession
    count = F.greatest(F.ceil(F.col("length") / split_bytes).cast("long"), F.lit(1))
    pieces = files.select("path", "number", F.col("length").alias("size"), F.explode(F.sequence(F.lit(0), count - 1)).alias("part"))
    tasks = spark.sparkContext.defaultParallelism * 4
    guessed = cut(pieces.repartition(tasks, "path", "part").mapInPandas(_guesses(split_bytes), PARTS))
    before = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    due = F.max("next").over(before)
    end = F.least((F.col("part") + 1) * split_bytes, F.col("size"))
    # A range without a record start lies within one record.
    right = (F.col("part") == 0) | F.coalesce(F.when(F.col("first").isNull(), due >= end).otherwise(due == F.col("first")), F.lit(False))
    wrong = guessed.withColumn("right", right).filter("known and not right").select("path").distinct()
    wrong = cut(wrong)
    again = guessed.filter("part = 0").join(wrong, "path", "left_semi").select("path", "number", "size")
    mended = again.repartition(tasks, "path").mapInPandas(_walked(split_bytes), PARTS)
    return guessed.join(wrong, "path", "left_anti").unionByName(mended)


def ranges_decoded(rows: DataFrame) -> DataFrame:
    before = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"base": F.coalesce(F.sum("records").over(before), F.lit(0)),
                             "past": F.collect_list("faces").over(before)}).filter("records > 0")
    tasks = rows.sparkSession.sparkContext.defaultParallelism * 4
    return rows.select("path", "number", "first", "records", "base", "past").repartition(
        tasks, "path", "first").mapInPandas(_decode_ranges, CAPTURE)


def _listed(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found if content else found.select("path", "modificationTime", "length")


def direct(spark: SparkSession, path: str) -> bool:
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):/", path)
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return (scheme[1].lower() if scheme else default.split(":")[0]) in DIRECT


# --- bytes ------------------------------------------------------------------------
class _Content:
    """Contents at hand, read like a file."""

    def __init__(self, content: bytes):
        self.content = content

    def size(self) -> int:
        return len(self.content)

    def read_at(self, n: int, at: int) -> bytes:
        return self.content[at:at + n]


def _open(path: str):
    """A file by the path that Spark lists, in which no character is escaped."""
    from pyarrow import fs
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    scheme, store, place = re.match(r"([^:/]+)://([^/]*)(.*)", path, re.DOTALL).groups()
    system, place = fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{store}{quote(place)}")
    return system.open_input_file(place)


class _Walk:
    """The chain of records of one file from a given place on."""

    def __init__(self, source, past: list[str] = ()):
        self.source, self.size = source, source.size()
        self.held, self.held_at = b"", 0
        self.faces, self.added, self.cut = [], [], False
        head = self.take(0, 24)
        self.blocks = head[:4] == SECTION and head[8:12] in (LITTLE, BIG)
        self.known = self.blocks or (head[:4] in MAGIC and len(head) == 24)
        self.start = 0 if self.blocks else 24
        if self.blocks:
            self.order = "<" if head[8:12] == LITTLE else ">"
        elif self.known:
            self.order, self.ticks = MAGIC[head[:4]]
            self.link = struct.unpack(self.order + "I", head[20:])[0] & 0xFFFF
        for text in past:
            for entry in json.loads(text):
                self._learn(entry)
        self.at = self.start

    def take(self, at: int, n: int) -> bytes:
        if at < self.held_at or at + n > self.held_at + len(self.held):
            self.held_at, self.held = at, self.source.read_at(max(n, STEP), at)
        return self.held[at - self.held_at:at - self.held_at + n]

    def _learn(self, entry):
        """A byte order opens a section and ends its interfaces; all else is an interface."""
        if isinstance(entry, str):
            self.order, self.faces = entry, []
        else:
            self.faces.append(entry)

    def records(self, at: int, stop: int):
        """(place, length, link, microseconds or None) of the packets whose records start before `stop`."""
        self.at = at
        yield from (self._from_blocks(stop) if self.blocks else self._from_records(stop))

    def _from_records(self, stop: int):
        header = struct.Struct(self.order + "IIII")
        while self.at < stop:
            head = self.take(self.at, 16)
            if len(head) < 16:
                self.cut = True
                return
            sec, sub, size, _ = header.unpack(head)
            if self.at + 16 + size > self.size:
                self.cut = True
                return
            yield self.at + 16, size, self.link, sec * 1_000_000 + sub * 1_000_000 // self.ticks
            self.at += 16 + size

    def _from_blocks(self, stop: int):
        while self.at < stop:
            total, order = self.block(self.at, self.order)
            if total is None:
                self.cut = True
                return
            body = self.take(self.at, total)
            kind = struct.unpack(order + "I", body[:4])[0]
            if body[:4] == SECTION:
                self._learn(order)
                self.added.append(order)
            elif kind == INTERFACE_BLOCK and total >= 20:
                link, _, snap = struct.unpack(order + "HHI", body[8:16])
                face = [link, *_clock(order, body[16:-4]), snap]
                self._learn(face)
                self.added.append(face)
            elif kind in (PACKET_BLOCK, OLD_PACKET_BLOCK) and total >= 32:
                face, high, low, size = struct.unpack(order + "IIII", body[8:24])
                if kind == OLD_PACKET_BLOCK:
                    face = struct.unpack(order + "H", body[8:10])[0]
                link, ticks, offset, _ = self.faces[face] if face < len(self.faces) else (-1, 1_000_000, 0, 0)
                us = ((high << 32) | low) * 1_000_000 // ticks + offset * 1_000_000
                yield self.at + 28, min(size, total - 32), link, us
            elif kind == SIMPLE_BLOCK and total >= 16:
                size = struct.unpack(order + "I", body[8:12])[0]
                link, _, _, snap = self.faces[0] if self.faces else (-1, 1, 0, 0)
                yield self.at + 12, min(size, total - 16, snap or size), link, None
            self.at += total

    def block(self, at: int, order: str):
        """Length and byte order of the block at a place; no length if there is none."""
        head = self.take(at, 12)
        if len(head) < 12:
            return None, order
        if head[:4] == SECTION:
            if head[8:12] not in (LITTLE, BIG):
                return None, order
            order = "<" if head[8:12] == LITTLE else ">"
        total = struct.unpack(order + "I", head[4:8])[0]
        if total < 12 or total % 4 or at + total > self.size or (head[:4] == SECTION and total < 28):
            return None, order
        return (total if self.take(at, total)[-4:] == head[4:8] else None), order

    def guess(self, start: int, end: int) -> int | None:
        """The first place from `start` on where a run of records seems to begin."""
        for at in range(start, end, STEP):
            piece = np.frombuffer(self.source.read_at(min(STEP, end - at) + 16, at), np.uint8)
            for place in self._plausible(piece, at, min(at + STEP, end)):
                if self._holds(int(place)):
                    return int(place)
        return None

    def _plausible(self, piece, at, end):
        places = np.arange(max(0, min(end - at, len(piece) - 15)))
        if self.blocks:
            places = places[(places + at) % 4 == 0]
        word = lambda off: sum(piece[places + off + i].astype(np.int64) << (8 * (i if self.order == "<" else 3 - i)) for i in range(4))
        if self.blocks:
            total = word(4)
            return at + places[(total >= 12) & (total % 4 == 0) & (at + places + total <= self.size)]
        sub, size, whole = word(4), word(8), word(12)
        return at + places[(sub < self.ticks) & (size <= whole) & (whole <= LONGEST) & (at + places + 16 + size <= self.size)]

    def _holds(self, at: int) -> bool:
        for _ in range(RUN):
            if at == self.size:
                return True
            if self.blocks:
                total, _ = self.block(at, self.order)
                if total is None:
                    return False
                at += total
                continue
            head = self.take(at, 16)
            if len(head) < 16:
                return False
            _, sub, size, whole = struct.unpack(self.order + "IIII", head)
            if sub >= self.ticks or size > whole or whole > LONGEST or at + 16 + size > self.size:
                return False
            at += 16 + size
        return True


def _clock(order: str, options: bytes) -> tuple[int, int]:
    """Ticks per second and seconds to add of an interface; a microsecond clock unless an option says so."""
    at, ticks, offset = 0, 1_000_000, 0
    while at + 4 <= len(options):
        code, size = struct.unpack(order + "HH", options[at:at + 4])
        if code == TICKS_OPTION and size and at + 4 < len(options):
            value = options[at + 4]
            ticks = 2 ** (value & 127) if value & 128 else 10 ** value
        if code == OFFSET_OPTION and size == 8 and at + 12 <= len(options):
            offset = struct.unpack(order + "q", options[at + 4:at + 12])[0]
        at += 4 + size + (-size % 4)
    return ticks, offset


# --- tasks ------------------------------------------------------------------------
def _part(walk, path, number, part, first, stop):
    """A row of PARTS: the records from `first` on that start before `stop`."""
    walk.added, records = [], 0
    if first is not None:
        records = sum(1 for _ in walk.records(first, stop))
    after = None if first is None or walk.cut else walk.at
    return (path, number, walk.size, part, first, after, records, json.dumps(walk.added) if walk.added else None, walk.known, walk.cut)


def _table(rows):
    names = [c.split(" ")[0] for c in PARTS.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({"first": "Int64", "next": "Int64"})


def _guesses(split: int):
    def run(batches):
        for pdf in batches:
            rows = []
            for path, number, size, part in zip(pdf["path"], pdf["number"], pdf["size"], pdf["part"]):
                with _open(path) as source:
                    walk = _Walk(source)
                    start, end = part * split, min((part + 1) * split, walk.size)
                    first = None
                    if walk.known:
                        first = walk.start if part == 0 else walk.guess(start, end)
                    rows.append(_part(walk, path, number, part, first, end))
            yield _table(rows)
    return run


def _walked(split: int):
    def run(batches):
        for pdf in batches:
            for path, number in zip(pdf["path"], pdf["number"]):
                with _open(path) as source:
                    yield from _sequential(_Walk(source), path, number, split)
    return run


def _walked_contents(batches):
    for pdf in batches:
        for path, number, content in zip(pdf["path"], pdf["number"], pdf["content"]):
            yield from _sequential(_Walk(_Content(content)), path, number, SPLIT)


def _sequential(walk, path, number, split):
    rows, at = [], walk.start if walk.known else None
    while True:
        stop = walk.size if at is None else min((at // split + 1) * split, walk.size)
        rows.append(_part(walk, path, number, 0 if at is None else at // split, at, stop))
        if at is None or walk.cut or walk.at >= walk.size:
            break
        at = walk.at
    yield _table(rows)


def _decode_ranges(batches):
    for pdf in batches:
        for path, number, first, records, base, past in zip(*(pdf[c] for c in ("path", "number", "first", "records", "base", "past"))):
            with _open(path) as source:
                walk = _Walk(source, past)
                yield from _decoded(walk, path, number, islice(walk.records(int(first), walk.size), int(records)), base)


def _decode_contents(batches):
    for pdf in batches:
        for path, number, content in zip(pdf["path"], pdf["number"], pdf["content"]):
            walk = _Walk(_Content(content))
            if walk.known:
                yield from _decoded(walk, path, number, walk.records(walk.start, walk.size), 0)


def _decoded(walk, path, number, records, base):
    """Frames of the packets of some records, STEP bytes or BATCH packets at a time."""
    held, low = [], 0
    for record in records:
        if held and (len(held) == BATCH or record[0] + record[1] - low > STEP):
            yield _frame(walk, path, number, base, held)
            base, held = base + len(held), []
        if not held:
            low = record[0]
        held.append(record)
    if held:
        yield _frame(walk, path, number, base, held)


def _frame(walk, path, number, base, held):
    """Packet rows of some records, decoded together: usable ones have the 5-tuple, payload length and flags."""
    low = held[0][0]
    data = np.frombuffer(walk.source.read_at(held[-1][0] + held[-1][1] - low, low) + bytes(64), np.uint8)
    places, sizes, links = (np.array([r[i] for r in held], np.int64) for i in range(3))
    places -= low
    byte = lambda at: data[np.minimum(at, len(data) - 1)].astype(np.int64)
    pair = lambda at: byte(at) << 8 | byte(at + 1)
    skip = np.full(len(held), -1, np.int64)
    for link, n in LINK_BYTES.items():
        skip[links == link] = n
    ether = links == 1
    tag = np.where(ether & (pair(places + 12) == 0x8100), 4, 0)
    ip, left = places + skip + tag, sizes - skip - tag
    header, proto = (byte(ip) & 15) * 4, byte(ip + 9)
    tcp = proto == 6
    body = ip + header
    good = (skip >= 0) & (left >= 20) & (byte(ip) >> 4 == 4) & (tcp | (proto == 17)) & (pair(ip + 6) & 0x1FFF == 0)
    good &= (~ether | (pair(places + 12 + tag) == 0x0800)) & (left - header >= np.where(tcp, 20, 8))
    timed = np.array([r[3] is not None for r in held])
    good &= timed
    own = np.where(tcp, (byte(body + 12) >> 4) * 4, 8)
    flags = np.where(tcp, byte(body + 13), 0)
    out = {"capture": path, "number": number, "nth": base + np.arange(len(held)),
           "us": pd.array([r[3] for r in held], "Int64"), "usable": good,
           "src_ip": _dotted(pair(ip + 12) << 16 | pair(ip + 14), good), "dst_ip": _dotted(pair(ip + 16) << 16 | pair(ip + 18), good)}
    numbers = {"src_port": pair(body), "dst_port": pair(body + 2), "proto": proto, "payload_len": np.maximum(0, pair(ip + 2) - header - own)}
    out |= {n: pd.arrays.IntegerArray(v.astype(np.int32), ~good) for n, v in numbers.items()}
    out |= {n: pd.arrays.BooleanArray(flags & bit != 0, ~good) for n, bit in (("syn", 2), ("rst", 4), ("fin", 1), ("ack", 16))}
    return pd.DataFrame(out)


def _dotted(words, good):
    different, at = np.unique(words, return_inverse=True)
    texts = np.array([f"{w >> 24}.{w >> 16 & 255}.{w >> 8 & 255}.{w & 255}" for w in different.tolist()], object)[at]
    return np.where(good, texts, None)
