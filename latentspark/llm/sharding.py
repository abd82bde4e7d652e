"""Shards by a hierarchical weighted hash tree: region, rack and shard levels, each chosen by weighted hash draws.

At a node every child draws ln(u) / weight, u a hash of key and child; the largest draw wins. So a child wins in proportion to its
weight, and a change of one child's weight moves keys only into or out of that child: movement stays in subtrees whose weights
change. growing by one shard appends a branch of its own (region, rack, shard), so that the new shard takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank, partitions_of, saved, whole

LAW = "key"


@dataclass(frozen=True)
class Tree:
    """regions[r][k] lists (shard, weight) of rack k of region r."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @staticmethod
    def even(shards: int, racks: int = 3, per_rack: int = 4) -> Tree:
        """Shards 0, 1, ... of equal weight, dealt in order to racks of per_rack and regions of `racks` racks."""
        all_racks = [tuple((s, 1.0) for s in range(a, min(a + per_rack, shards))) for a in range(0, shards, per_rack)]
        return Tree(tuple(tuple(all_racks[a : a + racks]) for a in range(0, len(all_racks), racks)))

    def grown(self, weight: float = 1.0) -> Tree:
        """This tree and one more shard, in a region of its own."""
        new = 1 + max(s for region in self.regions for rack in region for s, _ in rack)
        return Tree((*self.regions, (((new, weight),),)))


def _won(key: Column, level: str, children: list[tuple[str, float]]) -> Column:
    """The index of the child with the largest draw."""
    draws = []
    for i, (name, weight) in enumerate(children):
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{level}/{name}")), 11)
        draws.append(F.struct((F.log((bits.cast("double") + F.lit(1.0)) / F.lit(float(2**53))) / F.lit(weight)).alias("d"), F.lit(-i).alias("i")))
    return -F.greatest(*draws)["i"] if len(draws) > 1 else F.lit(0)


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard that the tree gives a key. A null key is a key like any other."""
    racks_weight = lambda region: sum(w for rack in region for _, w in rack)
    region = _won(key, "root", [(str(r), racks_weight(x)) for r, x in enumerate(tree.regions)])
    out = None
    for r, racks in enumerate(tree.regions):
        rack = _won(key, f"region {r}", [(str(k), sum(w for _, w in x)) for k, x in enumerate(racks)])
        inner = None
        for k, shards in enumerate(racks):
            at = _won(key, f"rack {r}.{k}", [(str(s), w) for s, w in shards])
            picked = F.element_at(F.array(*(F.lit(s) for s, _ in shards)), at + 1)
            inner = F.when(rack == k, picked) if inner is None else inner.when(rack == k, picked)
        out = F.when(region == r, inner) if out is None else out.when(region == r, inner)
    return out.cast("int")


@whole
def shard_documents(docs: DataFrame, tree: Tree) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs.

    size: UTF-8 bytes of the text (null: none) plus 8; text_crc32: of those bytes (null: of none, 0). Law `key`: doc_id and the
    shard count decide; equal doc_ids, null ones too, share a shard. slot numbers the rows of a shard from 0 without gaps, in any
    order; repeated rows have slots of their own. An empty table gives an empty one; other columns are not read.
    """
    raw = F.coalesce(F.encode(F.col("text").cast("string"), "utf-8"), F.lit(b""))
    placed = saved(
        docs.select(
            "doc_id",
            (F.octet_length(raw) + 8).cast("long").alias("size"),
            F.crc32(raw).cast("long").alias("text_crc32"),
            F.lit(LAW).alias("law"),
            shard_of(F.col("doc_id"), tree).alias("shard"),
            shard_of(F.col("doc_id"), tree.grown()).alias("grown_shard"),
        ).withColumn("__at", F.monotonically_increasing_id())
    )
    buckets = max(4 * partitions_of(docs.sparkSession), 64)
    return gapless_rank(placed, ["shard"], ["__at"], "__at", "slot", buckets).select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
