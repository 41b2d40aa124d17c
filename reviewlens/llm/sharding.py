"""Shard assignment by a hierarchical weighted hash tree.

A tree has regions, racks and shards; a node weighs what its shards weigh. A document descends level by
level: every child of the node it stands in draws an exponential variate ``-ln(u) / weight`` from a hash of
the document and the child, and the smallest draw wins. When one child's weight grows, documents move only
into it, when it shrinks only out of it; other subtrees draw as before. A new shard opens a region of its
own, so it takes rows only into itself.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from reviewlens.llm.names import unused
from reviewlens.sources.scratch import materialise

# Rows of a shard are numbered in this many parts, so that no shard is one task.
_PARTS = 64


@dataclass(frozen=True)
class HashTree:
    """``regions[r][k]`` maps the shards of rack ``k`` of region ``r`` to their weights."""

    regions: tuple[tuple[dict[int, float], ...], ...]

    @classmethod
    def even(cls, shards: int, per_rack: int = 5, racks: int = 4) -> HashTree:
        """Equal weights, filled in order. Shards beyond whole regions get a region each."""
        whole = per_rack * racks
        full = [
            tuple({r * whole + k * per_rack + s: 1.0 for s in range(per_rack)} for k in range(racks))
            for r in range(shards // whole)
        ]
        rest = [({s: 1.0},) for s in range(shards // whole * whole, shards)]
        return cls(tuple(full + rest))

    def grown(self, weight: float = 1.0) -> HashTree:
        """One more shard, numbered next, in a region of its own."""
        number = 1 + max((s for region in self.regions for rack in region for s in rack), default=-1)
        return HashTree((*self.regions, ({number: weight},)))


def _children(nodes: list[tuple[str, float]]) -> Column:
    named = [F.struct(F.lit(name).alias("name"), F.lit(float(w)).alias("weight"), F.lit(i).alias("i")) for i, (name, w) in enumerate(nodes)]
    return F.array(*named)


def _pick(key: Column, children: Column) -> Column:
    """Number of the child with the smallest draw; the first on a tie."""

    def draw(child: Column) -> Column:
        # 52 bits of the hash, never 0 or 1.
        uniform = (F.shiftrightunsigned(F.xxhash64(key, child["name"]), 12) + F.lit(0.5)) / F.lit(2.0**52)
        return F.struct((-F.log(uniform) / child["weight"]).alias("draw"), child["i"].alias("i"))

    return F.array_min(F.transform(children, draw))["i"]


def shard_of(key: Column, tree: HashTree) -> Column:
    """Shard of a key: one draw per child of each node passed. A null key draws like any value.

    Nodes without weight get nothing.
    """
    racks, shards, numbers, regions = [], [], [], []
    for r, region in enumerate(tree.regions):
        weighed = [(f"k{r}.{k}", sum(rack.values()), rack) for k, rack in enumerate(region) if sum(rack.values()) > 0]
        if not weighed:
            continue
        regions.append((f"r{r}", sum(w for _, w, _ in weighed)))
        racks.append(_children([(name, w) for name, w, _ in weighed]))
        shards.append(F.array(*[_children([(f"s{s}", w) for s, w in rack.items() if w > 0]) for _, _, rack in weighed]))
        numbers.append(F.array(*[F.array(*[F.lit(s) for s, w in rack.items() if w > 0]) for _, _, rack in weighed]))
    # The path is a value that later levels read: a one-element array binds it.
    path = F.array(F.struct(_pick(key, _children(regions)).alias("r")))
    path = F.transform(path, lambda p: F.struct(p["r"].alias("r"), _pick(key, F.get(F.array(*racks), p["r"])).alias("k")))
    leaf = F.transform(
        path,
        lambda p: F.get(
            F.get(F.get(F.array(*numbers), p["r"]), p["k"]),
            _pick(key, F.get(F.get(F.array(*shards), p["r"]), p["k"])),
        ),
    )
    return F.get(leaf, F.lit(0))


def assign_shards(df: DataFrame, tree: HashTree, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, one row per row of ``df``.

    ``size`` is UTF-8 bytes plus 16 (null text: 16, checksum of no bytes). ``slot`` numbers the rows of a
    shard from 0 without gaps, in order of a part of it, then id, checksum and size; equal rows
    share their shard and get different slots. The part is a hash of id, checksum and size, so rows of one id
    are many parts; copies of one row are one part. ``grown_shard`` is the shard with one more.
    """
    key = F.col(doc_id)
    body = F.coalesce(F.col(text), F.lit(""))
    size = (F.octet_length(body) + 16).cast("long").alias("size")
    crc = F.crc32(F.encode(body, "UTF-8")).alias("text_crc32")
    part = F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.lit("part")), F.lit(_PARTS)).cast("int")
    placed = df.select(key.alias("doc_id"), size, crc, shard_of(key, tree).alias("shard"), shard_of(key, tree.grown()).alias("grown_shard"))
    placed = materialise(placed.withColumn("part", part), "placed")
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"))
    offsets = materialise(offsets, "offsets")
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    ranked = placed.withColumn("rank", F.row_number().over(inside)).join(offsets, ["shard", "part"])
    slot = (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot, "grown_shard")


def write_shards(df: DataFrame, tree: HashTree, path: str, key: str = "doc_id", shuffle: int | None = None) -> str:
    """Write whole rows as one Parquet folder per shard; returns the tree as JSON for the record.

    Rows go to ``(shard, part)`` tasks, the part being a hash of all their columns of plain types, so neither a shard nor
    a key is one task. Existing folders at ``path`` stay an error.
    """
    shard = unused(df, "shard")
    plain = [F.col(f"`{f.name}`") for f in df.schema if isinstance(f.dataType, AtomicType)]
    part = F.pmod(F.xxhash64(*plain, F.lit("part")), F.lit(_PARTS))
    dealt = df.withColumn(shard, shard_of(F.col(key), tree))
    dealt = dealt.repartition(shuffle, shard, part) if shuffle else dealt.repartition(shard, part)
    dealt.write.partitionBy(shard).parquet(path)
    return json.dumps(tree.regions)
