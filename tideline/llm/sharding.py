"""Hierarchical weighted hash tree: rows to shards, native DataFrame functions only.

A row descends region, rack and shard.  At every level each child draws
``-ln(u) / weight`` with ``u`` hashed from the row's key and the child's path,
and the smallest draw wins, so a child is taken in proportion to its weight and
a change of one weight moves rows only out of or into that child.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm import store


class Shard(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float = 1.0


#: Rows are numbered inside a shard by this many hash groups, so that no task sorts a whole shard.
SLOT_GROUPS = 512


def tree(shards: int, regions: int = 2, racks: int = 4, per_rack: int = 5) -> list[Shard]:
    """The layout for a number of shards: a function of that number alone.

    The first ``regions * racks * per_rack`` shards fill the planned racks.
    Every further shard stands as a region of its own, so that adding it changes
    no weight inside another subtree and rows move only into it.
    """
    planned = regions * racks * per_rack
    if shards < 1:
        raise ValueError("there must be at least one shard")
    if shards < planned:  # a small cluster: every shard its own region
        return [Shard(s, 0, s) for s in range(shards)]
    out = [Shard(s // (racks * per_rack), s // per_rack % racks, s) for s in range(planned)]
    return out + [Shard(regions + s - planned, 0, s) for s in range(planned, shards)]


def _descend(key: Column, children: Column) -> Column:
    """The path of the child with the smallest weighted draw; children: array of (path, weight)."""

    def draw(child: Column) -> Column:
        digest = F.md5(F.concat(key, F.lit("/"), child["path"]))
        u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
        return F.struct((-F.log(u) / child["weight"]).alias("draw"), child["path"].alias("path"))

    return F.array_min(F.transform(children, draw))["path"]


def place(key: Column, shards: list[Shard]) -> Column:
    """The shard of a key: one weighted hash draw per level of the tree."""
    weights: dict[str, dict[str, float]] = {}
    for s in shards:
        if s.weight > 0:
            for above, path in (("", f"{s.region}"), (f"{s.region}", f"{s.region}.{s.rack}"), (f"{s.region}.{s.rack}", f"{s.region}.{s.rack}.{s.shard}")):
                level = weights.setdefault(above, {})
                level[path] = level.get(path, 0.0) + s.weight
    if not weights:
        raise ValueError("a tree needs a positive weight")
    kind = "array<struct<path:string,weight:double>>"

    def children(level: dict[str, float]) -> Column:
        return F.array(*(F.struct(F.lit(p).alias("path"), F.lit(w).alias("weight")) for p, w in level.items())).cast(kind)

    nodes = F.create_map(*(x for above, level in weights.items() for x in (F.lit(above), children(level))))
    at = F.lit("")
    for _ in range(3):
        at = _descend(key, F.element_at(nodes, at))
    return F.substring_index(at, ".", -1).cast("int")


def assign_shards(docs: DataFrame, shards: list[Shard], grown: list[Shard] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its shard and its slot there.

    Returns doc_id, size (UTF-8 bytes plus 16; 16 for a null text), text_crc32,
    shard, slot (gapless from 0 in a shard) and grown_shard (under ``grown``).
    A null id has a place of its own like any other key; rows that repeat an id
    share its shard and get slots of their own; an empty table gives no rows.
    Only ids and numbers are shuffled, never texts.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    columns = [
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        place(key, shards).alias("shard"),
        (place(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.pmod(F.xxhash64(key, F.crc32(text)), F.lit(SLOT_GROUPS)).cast("int").alias("_group"),
    ]
    rows = store.table(docs.select(*columns), "placed")
    # first pass: rows of each group; at most shards * SLOT_GROUPS rows, whatever the input
    counts = rows.groupBy("shard", "_group").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # second pass: number the rows inside each group
    inside = Window.partitionBy("shard", "_group").orderBy("doc_id", "text_crc32", "size")
    out = rows.join(F.broadcast(starts), ["shard", "_group"])
    slot = (F.col("_start") + F.row_number().over(inside) - 1).cast("long").alias("slot")
    return out.select("doc_id", "size", "text_crc32", "shard", slot, "grown_shard")
