"""N-gram Jaccard join: size-aware, with subsets for small sets and inverted lists for large ones."""
from itertools import combinations
from math import comb, log

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..operators.joins import lookup
from ..session import cut, passing
from .common import fresh, keep_ids, shingle_sets, slices, small_batches
from .graph import components

# Places of the sketches of a set, a multiple of 64.
SPOTS = 512
# Sets above this size are also sketched by counts, as parities fill up.
LARGE = 1000
# Bits that mark shingles of more than one row; they are broadcast. Once all are set, the order is by hash alone.
MARKS = 1 << 27
# Most shingles that are put last in the order as frequent; it bounds what is broadcast to 16 bytes each.
FREQUENT = 1_000_000
# Subsets are tried as the way for sets of up to this size.
LARGEST_SMALL = 39
# Shingles of a component's texts that one task compares with each other; larger components are cut into blocks.
BLOCK = 300_000
# Bytes of sketches that one task compares with each other, of components above BLOCK.
SKETCHED = 8_000_000


class Threshold:
    """Two sets link when den * intersection >= num * union."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("the threshold is a fraction above 0 and at most 1")
        self.num, self.den = num, den
        # share of the shingles, by hash, whose rows are counted: twice what the longest prefix takes of a set
        self.counted = min(1.0, 2 * (den - num) / den + 0.01)

    def overlap(self, a, b):
        """Least intersection of linked sets of sizes a and b."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def least(self, n):
        """Least size of a set linked with one of size n; also its least overlap with any."""
        return -(-self.num * n // self.den)

    def prefix(self, n):
        """So many of the first elements in a common order: two linked sets share one of them."""
        return n - self.least(n) + 1

    def step(self, n: str) -> Column:
        """Linked sets are on the same step of size or on neighbouring ones."""
        if self.num == self.den:
            return F.col(n)
        return F.floor(F.log(n) / (log(self.den / self.num) * (1 + 1e-9))).cast("int")

    def subset_sizes(self, n: int, most: int) -> list[int]:
        """Sizes of the subsets that a small set of size n has in common with linked sets of up to `most`."""
        partners = range(max(1, self.least(n)), min(most, n * self.den // self.num) + 1)
        return sorted({c for b in partners if (c := self.overlap(n, b)) <= min(n, b)})


def boundary(sizes: dict[int, int], at: Threshold, list_cost: float = 4.0) -> int:
    """The largest size handled by subsets: the one of least total cost, counted in keys that are written.

    sizes: number of sets of each size up to LARGEST_SMALL. A subset is one key. A posting costs `list_cost` keys, as
    its list is scanned too. Sizes above LARGEST_SMALL cost the same whatever the boundary.
    """
    def cost(x: int) -> float:
        light = sum(k * sum(comb(n, c) for c in at.subset_sizes(n, x)) for n, k in sizes.items() if n <= x)
        return light + list_cost * sum(k * at.prefix(n) for n, k in sizes.items() if n >= at.least(x + 1))
    return min(range(LARGEST_SMALL + 1), key=lambda x: (cost(x), x))


def _node(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63)


def _described(texts, width: int, spread_from: int) -> pd.DataFrame:
    out = []
    for part in slices(list(texts), 256):
        sets = shingle_sets(part, width)
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        spots = (np.concatenate(sets) >> np.uint64(7)).astype(np.int64) % SPOTS + np.repeat(np.arange(len(sets)) * SPOTS, sizes)
        counts = np.bincount(spots, minlength=len(sets) * SPOTS).reshape(len(sets), SPOTS)
        frame = pd.DataFrame(np.packbits(counts & 1, axis=1).view(np.int64), columns=[f"b{k}" for k in range(SPOTS // 64)])
        frame.insert(0, "node", np.array([_node(x) for x in sets], np.int64))
        frame.insert(0, "n", sizes.astype(np.int32))
        # cut off counts differ no more than the counts do
        counts = np.minimum(counts.reshape(len(sets), -1, 2).sum(axis=2), 127).astype(np.int8)
        frame["spread"] = [counts[k] if n >= spread_from else None for k, n in enumerate(sizes.tolist())]
        out.append(frame)
    return pd.concat(out)


def picked(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Hash of a row's id and text, both of which may be null or repeated: rows that it tells apart differ in one of them."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def describe(docs: DataFrame, width: int, at: Threshold, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pick, n, node, b0..., spread): size and hash of each row's set, and sketches of it. Equal sets have equal nodes.

    The elements are counted by hash in SPOTS places: b0... hold the parities, spread the counts, for large sets only.
    """
    @pandas_udf(", ".join(["n int", "node long", *[f"b{k} long" for k in range(SPOTS // 64)], "spread array<tinyint>"]))
    def described(texts: pd.Series) -> pd.DataFrame:
        return _described(texts, width, at.least(LARGE + 1))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), picked(id_col, text_col).alias("pick"),
                       described(F.col(text_col).cast("string")).alias("d")).select("doc_id", "pick", "d.*")


class Order:
    """A common order of all shingles; any order is right, this one makes inverted lists short.

    First come the shingles of the counted share that are in one row only, then the other counted ones, then those not
    counted, each by hash; last the most frequent ones, rarest first. `marks` has a bit for each place that a shingle of
    two or more rows falls on, so what it calls single is single.
    """

    def __init__(self, limit: int, marks: np.ndarray, tokens: np.ndarray, places: np.ndarray):
        self.limit, self.marks, self.tokens, self.places = np.uint64(limit), marks, tokens, places

    def postings(self, found: np.ndarray, size: int) -> np.ndarray:
        """The first `size` of a set's shingles, without those that no other row has."""
        end = np.searchsorted(found, self.limit)
        counted, others = found[:end], found[end:]
        at = (counted & np.uint64(MARKS - 1)).astype(np.int64)
        counted = counted[(self.marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0]
        size -= end - len(counted)
        if size <= 0 or not len(self.tokens):
            return np.concatenate((counted, others))[:max(size, 0)]
        at = np.minimum(np.searchsorted(self.tokens, counted), len(self.tokens) - 1)
        late = self.tokens[at] == counted
        return np.concatenate((counted[~late], others, counted[late][np.argsort(self.places[at[late]])]))[:size]


def common_order(docs: DataFrame, width: int, at: Threshold, total: int, text_col: str) -> tuple:
    """The parts of an Order, from counts over all rows. At most FREQUENT shingles can be in more than total / FREQUENT
    rows, and the marks take MARKS / 8 bytes, so what reaches the driver is bounded."""
    limit = min(2**64 - 1, int(at.counted * 2**64))
    above = max(8, total // FREQUENT)

    def counted(batches):
        for batch in batches:
            for part in slices(batch.t, 2048):
                found = np.sort(np.concatenate([x[: np.searchsorted(x, np.uint64(limit))] for x in shingle_sets(part, width)]))
                new = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))[: len(found)])
                yield pd.DataFrame({"token": found[new].view(np.int64), "n": np.diff(np.append(new, len(found)))})

    again = cut(docs.select(F.col(text_col).cast("string").alias("t")).mapInPandas(counted, "token long, n long")
                .groupBy("token").agg(F.sum("n").alias("n")).filter("n > 1"))
    top = again.filter(F.col("n") > above).toPandas().sort_values(["n", "token"])
    tokens = top.token.to_numpy(np.int64).view(np.uint64)
    place = F.col("token").bitwiseAND(F.lit(MARKS - 1)) + 1
    blocks = again.groupBy(F.bitmap_bucket_number(place).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    marks = np.zeros(MARKS // 8, np.uint8)
    for r in blocks.collect():
        marks[(r["block"] - 1) * 4096:r["block"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    rank = np.argsort(tokens)
    return limit, marks, tokens[rank], rank


def keys(docs: DataFrame, width: int, at: Threshold, most: int, order: tuple, text_col: str) -> DataFrame:
    """(c, key, node, n). c = 0: those of the set's first shingles in the common order that other rows have. c > 0: hashes
    of its subsets of c."""
    held = docs.sparkSession.sparkContext.broadcast(order)

    def made(batches):
        first = Order(*held.value)
        for batch in batches:
            for part in slices(batch.t, 512):
                seen, out = set(), []
                for found in shingle_sets(part, width):
                    n = len(found)
                    if not n or (node := _node(found)) in seen:
                        continue
                    seen.add(node)
                    if n >= at.least(most + 1):
                        out.append((0, first.postings(found, at.prefix(n)), node, n))
                    if n <= most:
                        spread = found * np.uint64(0xD6E8FEB86659FD93)
                        whole = spread.sum(dtype=np.uint64)
                        for c in at.subset_sizes(n, most):
                            gone = np.array(list(combinations(range(n), n - c)), np.int64).reshape(comb(n, c), n - c)
                            out.append((c, np.unique(whole - spread[gone].sum(axis=1, dtype=np.uint64)), node, n))
                lengths = [len(x[1]) for x in out]
                yield pd.DataFrame({
                    "c": np.repeat(np.array([x[0] for x in out], np.int32), lengths),
                    "key": np.concatenate([x[1] for x in out]).view(np.int64) if out else np.empty(0, np.int64),
                    "node": np.repeat(np.array([x[2] for x in out], np.int64), lengths),
                    "n": np.repeat(np.array([x[3] for x in out], np.int32), lengths)})

    return docs.select(F.col(text_col).cast("string").alias("t")).mapInPandas(made, "c int, key long, node long, n int")


def candidates(found: DataFrame, classes: DataFrame, at: Threshold) -> DataFrame:
    """Edges (a, b) that tie all sets together that may link; no more edges than keys, whatever the size of a group.

    Small sets: whoever shares a subset of c and links with another of the group also links with the smallest of the
    group, so each is tied to that one. Large sets: an inverted list is split by steps of size, and those sets of a part
    that another one is near to, by size and sketches, are tied to the first of these. An element that differs changes one
    parity, and one count by one, so no linked pair is lost.
    """
    # dealt out by key once, for the count and for the join
    found = found.repartition("c", "key")
    shared = found.groupBy("c", "key").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x <> y").select("c", "key")
    found = cut(found.join(shared, ["c", "key"], "left_semi").dropDuplicates(["c", "key", "node"]))
    small = found.filter("c > 0")
    hub = small.groupBy("c", "key").agg(F.min(F.struct("n", "node")).alias("hub"))
    linked = at.num * (F.col("n") + F.col("hub.n")) <= (at.num + at.den) * F.col("c")
    stars = (small.join(hub, ["c", "key"]).filter((F.col("node") != F.col("hub.node")) & linked)
             .select(F.col("hub.node").alias("a"), F.col("node").alias("b")))
    bits = [f"b{k}" for k in range(SPOTS // 64)]
    listed = found.filter("c = 0").select("key", "node", "n", F.explode(F.array(at.step("n"), at.step("n") + 1)).alias("step"))
    # where all rows of a part are of the step below, they have met in the part of that step
    shared = (listed.groupBy("key", "step").agg(F.min("node").alias("x"), F.max("node").alias("y"), F.max(at.step("n")).alias("own"))
              .filter("x <> y and own = step").select("key", "step"))
    listed = cut(listed.join(shared, ["key", "step"], "left_semi"))
    usual = listed.filter(F.col("n") <= LARGE).join(classes.select("node", *bits), "node")
    large = listed.filter(F.col("n") >= at.least(LARGE + 1)).join(classes.select("node", *bits, "spread"), "node")

    def near(l: str, r: str) -> Column:
        def of(c: str) -> tuple[Column, Column]:
            return F.col(f"{l}.{c}"), F.col(f"{r}.{c}")
        (x, y), (m, n) = of("node"), of("n")
        sizes = at.num * F.greatest(m, n) <= at.den * F.least(m, n)
        differ = sum((F.bit_count(p.bitwiseXOR(q)) for p, q in map(of, bits[1:])), F.bit_count(of(bits[0])[0].bitwiseXOR(of(bits[0])[1])))
        # m + n - 2 * overlap elements differ at most, and overlap >= num * (m + n) / (num + den)
        return (x != y) & sizes & (differ * (at.num + at.den) <= (m + n) * (at.den - at.num))

    def close(l: str, r: str) -> Column:
        m, n, p, q = (F.col(f"{t}.{c}") for c in ("n", "spread") for t in (l, r))
        apart = F.aggregate(F.zip_with(p, q, lambda x, y: F.abs(x.cast("int") - y)), F.lit(0), lambda a, x: a + x)
        return near(l, r) & (F.greatest(m, n) > LARGE) & (apart * (at.num + at.den) <= (m + n) * (at.den - at.num))

    tied = []
    for rows, test in ((usual, near), (large, close)):
        same = (F.col("l.key") == F.col("r.key")) & (F.col("l.step") == F.col("r.step"))
        some = rows.alias("l").join(rows.alias("r"), same & test("l", "r"), "left_semi").select("key", "step", "node")
        tied.append(cut(some))  # one after the other, so that the shuffles of both are not there at one time
    tied = cut(tied[0].unionByName(tied[1]).distinct())
    first = tied.groupBy("key", "step").agg(F.min("node").alias("a"))
    return tied.join(first, ["key", "step"]).filter("a <> node").select("a", F.col("node").alias("b")).unionByName(stars).distinct()


def _parities(found: np.ndarray) -> bytes:
    """The set's elements counted by hash in as many places as a power of two of its size, as parities; at least 64 places."""
    places = 1 << max(6, len(found).bit_length() + 1)
    counts = np.bincount((found >> np.uint64(7) & np.uint64(places - 1)).astype(np.int64), minlength=places)
    return np.packbits(counts & 1, bitorder="little").tobytes()


def _near(group: pd.DataFrame, at: Threshold) -> pd.DataFrame:
    """Of one block pair (i, j) of a part: edges of a spanning forest of the sets that may link by their sketches."""
    i, j = int(group.i.iloc[0]), int(group.j.iloc[0])
    group = group.sort_values(["n", "node"])
    least = group.bits.map(len).min()
    # a sketch of more places, folded, is the one of fewer
    bits = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, least // 8), axis=0) for x in group.bits])
    sizes, nodes, block = group.n.to_numpy(np.int64), group.node.to_numpy(), group.block.to_numpy()
    rows, others = np.flatnonzero(block == i), np.flatnonzero(block == j)
    theirs, parent, edges = bits[others], list(range(len(sizes))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x in rows:
        first = np.searchsorted(others, x + 1) if i == j else np.searchsorted(sizes[others], at.least(sizes[x]))
        last = np.searchsorted(sizes[others], sizes[x] * at.den // at.num, "right")
        near = others[first:last]
        differ = np.bitwise_count(theirs[first:last] ^ bits[x]).sum(axis=1, dtype=np.int64)
        for y in near[differ * (at.num + at.den) <= (sizes[x] + sizes[near]) * (at.den - at.num)].tolist():
            if (p := root(x)) != (q := root(y)):
                parent[q] = p
                edges.append((nodes[x], nodes[y]))
    return pd.DataFrame(edges, columns=["a", "b"]).astype("int64")


def refined(members: DataFrame, texts: DataFrame, width: int, at: Threshold) -> DataFrame:
    """(node, label) of the sets that may link by sketches as fine as the sets are large, in components of these.

    A list ties sets that are near to others than each other, so with many texts most large sets are tied into one component,
    whose texts would all meet. Sketches have a few hundredths of the texts' bytes. They are compared in parts by steps of size.
    members: pick, node, label. texts: pick, t.
    """
    def sketched(batches):
        for batch in batches:
            sets = shingle_sets(batch.t, width)
            yield batch[["node", "label"]].assign(n=np.array([len(x) for x in sets], np.int32), bits=[_parities(x) for x in sets])

    sketches = cut(texts.join(members.select("pick", "node", "label"), "pick").select("node", "label", "t")
                   .mapInPandas(sketched, "node long, label long, n int, bits binary"))
    parts = sketches.select("*", at.step("n").alias("own"), F.explode(F.array(at.step("n"), at.step("n") + 1)).alias("step"))
    weight = (parts.groupBy("label", "step").agg(F.ceil(F.sum(F.length("bits")) / SKETCHED).cast("int").alias("blocks"), F.max("own").alias("top"), F.count(F.lit(1)).alias("k"))
              .filter("top = step and k > 1").drop("top", "k"))
    parts = parts.join(weight, ["label", "step"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    parts = parts.select("label", "step", "node", "n", "bits", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return components(parts.groupBy("label", "step", "i", "j").applyInPandas(lambda g: _near(g, at), "a long, b long"))


def _verified(group: pd.DataFrame, width: int, at: Threshold) -> pd.DataFrame:
    """Of one block pair (i, j) of a component: edges of a spanning forest, and each set's links weighted by copies."""
    i, j = int(group.i.iloc[0]), int(group.j.iloc[0])
    group = group.drop_duplicates("node").reset_index(drop=True)
    sets = shingle_sets(group.t, width)
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    # inverted lists: of each distinct shingle, the sets that have it
    _, tokens, lengths = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owners = np.repeat(np.arange(len(sets)), sizes)[np.argsort(tokens, kind="stable")]
    begins = np.cumsum(lengths) - lengths
    nodes, copies, block = group.node.to_numpy(), group.copies.to_numpy(), group.block.to_numpy()
    links, parent, edges = np.zeros(len(sets), np.int64), list(range(len(sets))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x in np.flatnonzero(block == i):
        others = np.arange(x + 1, len(sets)) if i == j else np.flatnonzero(block == j)
        others = others[(sizes[others] >= at.least(sizes[x])) & (sizes[x] >= at.least(sizes[others]))]
        if not len(others):
            continue
        mine = tokens[starts[x]:ends[x]]
        long = lengths[mine]
        steps = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long - begins[mine], long)
        common = np.bincount(owners[steps], minlength=len(sets))[others]
        linked = others[at.den * common >= at.num * (sizes[x] + sizes[others] - common)]
        links[x] += copies[linked].sum()
        np.add.at(links, linked, copies[x])
        for y in linked.tolist():
            if (p := root(x)) != (q := root(y)):
                parent[q] = p
                edges.append((nodes[x], nodes[y], 0))
    rows = edges + [(node, node, k) for node, k in zip(nodes.tolist(), links.tolist()) if k]
    return pd.DataFrame(rows, columns=["a", "b", "links"]).astype("int64")


def jaccard_groups(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, n_links), one for each row of docs; all links, however large a group.

    Two rows link when den * intersection >= num * union of their sets of `width`-word shingles. component_id is the
    smallest doc_id that links reach, itself included; n_links counts the other rows that link with this one.
    Equal sets are one class before anything is compared, so copies are never paired. Candidates are tied into
    components, and the texts of a component are compared exactly, in blocks of bounded size.

    Null and empty texts have an empty set, no links and their own id. Texts with fewer than `width` words have one
    shingle. Repeated rows are copies that link with each other. A null doc_id takes part, and is never the smallest
    but where all are null. Further columns are ignored, whatever their names. An empty table gives an empty one.
    """
    return _grouped(docs, width, num, den, id_col, text_col).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "n_links")


def _grouped(docs: DataFrame, width: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, pick, n, component_id, n_links, keep); keep is the pick of the row with the component's smallest doc_id, nulls
    last, and of equal ones that with the smallest node. Rows with an empty set keep themselves."""
    spark = docs.sparkSession
    small_batches(spark)
    at = Threshold(num, den)
    rows = cut(describe(docs, width, at, id_col, text_col))
    sketches = [*[f"b{k}" for k in range(SPOTS // 64)], "spread"]
    with passing(spark) as kept:
        classes = cut(rows.filter("n > 0").groupBy("node").agg(
            F.min("doc_id").alias("first"), F.min("pick").alias("pick"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "pick")).alias("best"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), *[F.first(b).alias(b) for b in sketches]))
        total = rows.agg(F.sum("n")).first()[0] or 0
        sizes = {r["n"]: r["count"] for r in classes.filter(F.col("n") <= LARGEST_SMALL).groupBy("n").count().collect()}
        most = boundary(sizes, at)
        with passing(spark) as tables:
            found = cut(keys(docs, width, at, most, common_order(docs, width, at, total, text_col), text_col))
            tied = tables(components(candidates(found, classes, at)))

        repeated = not rows.filter("n > 0").groupBy("pick").count().filter("count > 1").isEmpty()

        def texts_of(members: DataFrame) -> DataFrame:
            """The text of each class, from one of its rows."""
            texts = docs.select(picked(id_col, text_col).alias("pick"), F.col(text_col).cast("string").alias("t"))
            texts = keep_ids(texts, members.select("pick"), on="pick")
            return texts.dropDuplicates(["pick"]) if repeated else texts

        members = tied.join(classes.select("node", "pick", "copies", "n"), "node")
        above = cut(members.groupBy("label").agg(F.sum("n").alias("weight")).filter(F.col("weight") > BLOCK).select("label"))
        if not above.isEmpty():
            with passing(spark) as tables:
                large = cut(keep_ids(members, above, on="label", made=True).select("pick", "node", "label"))
                finer = refined(large, texts_of(large), width, at).join(large.select("node", "pick"), "node")
                finer = tables(finer.join(classes.select("node", "copies", "n"), "node").select(*members.columns))
            members = keep_ids(members, above, "left_anti", on="label", made=True).unionByName(finer.select(*members.columns))
        weight = members.groupBy("label").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
        members = cut(members.join(weight, "label").select(
            "pick", "node", "label", "copies", "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block")))
        texts = texts_of(members).join(members, "pick").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        texts = texts.select("label", "node", "copies", "block", "t", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        checked = cut(texts.groupBy("label", "i", "j").applyInPandas(lambda g: _verified(g, width, at), "a long, b long, links long"))

        joined = components(checked.filter("a <> b"))
        counts = checked.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
        named = classes.select("node", "first", "best", "copies").join(joined, "node", "left").join(counts, "node", "left")
        named = cut(named.withColumn("label", F.coalesce("label", "node")))
        least = named.groupBy("label").agg(F.min("first").alias("component_id"), F.min(F.struct("best.col1", "best.doc_id", "node", "best.pick")).alias("keep"))
        answer = kept(named.join(least, "label").select(
            "node", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("keep.pick").alias("keep")))
    filled = lookup(rows.filter("n > 0").select("doc_id", "pick", "n", "node"), answer, "node").drop("node")
    empty = rows.filter("n = 0").select("doc_id", "pick", "n", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"),
                                        F.col("pick").alias("keep"))
    return filled.unionByName(empty)


def one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs without near copies: of each group, the one with the smallest doc_id stays, once; null ids count as
    the largest. Ids may be null or repeated: rows are told apart by id and text.

    Rows without words are linked with nothing and stay, each as often as its doc_id and text differ. Columns are kept.
    """
    with passing(docs.sparkSession) as kept:
        groups = kept(_grouped(docs, width, num, den, "doc_id", "text").select("pick", "keep"))
    gone = groups.filter("pick <> keep").select("pick").distinct()
    name = fresh(docs.columns, "pick")
    stay = keep_ids(docs.withColumn(name, picked()), gone.withColumnRenamed("pick", name), "left_anti", on=name)
    repeated = cut(groups.groupBy("pick").count().filter("count > 1").select(F.col("pick").alias(name)))
    if not repeated.isEmpty():
        stay = (keep_ids(stay, repeated, "left_anti", on=name, made=True)
                .unionByName(keep_ids(stay, repeated, "left_semi", on=name, made=True).dropDuplicates([name])))
    return stay.select(*[F.col(f"`{c}`") for c in docs.columns])
