"""Sharding by a weighted hash tree: region, rack, shard."""
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, unit
from .ranks import gapless

SHARDS = 16
RACKS, PER_RACK = 2, 4


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int = SHARDS, racks: int = RACKS, per_rack: int = PER_RACK) -> tuple[Leaf, ...]:
    """Shards 0.. of equal weight, `per_rack` to a rack and `racks` racks to a region."""
    return tuple(Leaf(s // (racks * per_rack), s // per_rack, s) for s in range(shards))


def grown(leaves: tuple[Leaf, ...], weight: float = 1.0) -> tuple[Leaf, ...]:
    """One more shard, in a region of its own: no other subtree's weight changes, so rows move only into it."""
    return (*leaves, Leaf(max(x.region for x in leaves) + 1, max(x.rack for x in leaves) + 1, max(x.shard for x in leaves) + 1, weight))


def reweighted(leaves: tuple[Leaf, ...], shard: int, weight: float) -> tuple[Leaf, ...]:
    return tuple(replace(x, weight=weight) if x.shard == shard else x for x in leaves)


def descend(key: Column, leaves: tuple[Leaf, ...]) -> Column:
    """The shard of a key. At each level every child draws -ln(u) / weight, with u hashed from the key and the child and
    the weight that of its subtree; the least draw wins. Rows move only out of or into subtrees whose weight changed, and
    below a node whose children kept their weights its rows stay where they were. Children of weight 0 get no row."""
    node = F.lit(0)
    for parent, level in ((None, "region"), ("region", "rack"), ("rack", "shard")):
        weights: dict[int, dict[int, float]] = {}
        for x in leaves:
            if x.weight > 0:
                below = weights.setdefault(getattr(x, parent) if parent else 0, {})
                below[getattr(x, level)] = below.get(getattr(x, level), 0.0) + x.weight
        children = F.array(*[F.array(*[F.struct(F.lit(c).alias("id"), F.lit(w).alias("w")) for c, w in sorted(weights.get(k, {}).items())])
                             if k in weights else F.array().cast("array<struct<id:int,w:double>>") for k in range(max(weights) + 1)])

        node = F.array_min(F.transform(F.element_at(children, node + 1), _drawn(key, level)))["id"]
    return node


def _drawn(key: Column, level: str):
    def drawn(child: Column) -> Column:
        u = unit(key, F.concat(F.lit(level), child["id"].cast("string")))
        return F.struct((-F.log(u + 2.0**-53) / child["w"]).alias("draw"), child["id"].alias("id"))
    return drawn


def assigned(docs: DataFrame, leaves: tuple[Leaf, ...] | None = None) -> DataFrame:
    """docs with a column `shard`, or `_shard` where docs has that name. No row is moved to find it."""
    return docs.withColumn(fresh(docs.columns, "shard"), descend(F.col("doc_id"), leaves or tree()))


def write_shards(docs: DataFrame, path: str, leaves: tuple[Leaf, ...] | None = None, files: int = 8) -> None:
    """One folder shard=<k> for each shard, with `files` files each, so that a shard is no single task's work."""
    rows = docs.drop("shard").withColumn("shard", descend(F.col("doc_id"), leaves or tree()))
    salt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(files)).cast("int")
    rows.withColumn("_salt", salt).repartition("shard", "_salt").drop("_salt").write.partitionBy("shard").parquet(path)


def placements(docs: DataFrame, leaves: tuple[Leaf, ...] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row for each row of docs.

    The law is `key`: the id and the tree decide, so repeated ids share a shard and a null id is a key of its own. Size is
    the UTF-8 bytes plus 1; a null text has none, and the crc32 of no bytes. slot counts a shard's rows from 0 in the
    order of a hash of the id. Columns besides doc_id and text play no part; an empty table gives an empty one.
    """
    leaves = leaves or tree()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        descend(F.col("doc_id"), leaves).alias("shard"), descend(F.col("doc_id"), grown(leaves)).alias("grown_shard"),
        unit(F.col("doc_id"), "slot").alias("draw"))
    ranked = gapless(rows, "draw", ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _sql_draw(name: str) -> str:
    return f"(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '~') || ':{name}'), 1, 13))::BIGINT / 4503599627370496.0)"


def _sql_descend(leaves: tuple[Leaf, ...], levels: tuple[str, ...] = ("region", "rack", "shard")) -> str:
    """descend() over a documents table, as nested choices of the least draw."""
    children: dict[int, list[Leaf]] = {}
    for x in leaves:
        children.setdefault(getattr(x, levels[0]), []).append(x)
    draws = ", ".join(f"{{d: -ln({_sql_draw(f'{levels[0]}{c}')} + 1.1102230246251565e-16) / {sum(x.weight for x in own)}, id: {c}}}" for c, own in children.items())
    best = f"list_sort([{draws}])[1].id"
    if len(levels) == 1:
        return best
    below = " ".join(f"WHEN {c} THEN {_sql_descend(tuple(own), levels[1:])}" for c, own in children.items())
    return f"CASE {best} {below} END"


PLACEMENTS_SQL = f"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
sized AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, list_prepend(4294967295, list_transform(
    regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: ('0x' || x)::BIGINT)) AS bytes FROM documents),
placed AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS text_crc32,
    {_sql_descend(tree())} AS shard, {_sql_descend(grown(tree()))} AS grown_shard FROM sized, crc)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
    row_number() OVER (PARTITION BY shard ORDER BY {_sql_draw('slot')}, doc_id, text_crc32, size) - 1 AS slot FROM placed"""
