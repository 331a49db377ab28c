"""Placement of documents by a hierarchical weighted hash tree: region, rack, shard.

At each level every child draws ``-ln(u) / weight`` with ``u`` from a hash of the key and the child's name, and the smallest
draw wins. A child's draw does not depend on its siblings, so a changed weight moves keys only into or out of the subtree whose weight
changed. ``layout`` places the first shards in regions of two racks of four; every shard added beyond ``base`` opens a region of its
own, so that the weights of all other subtrees stay and growth moves keys only into the new shard.

A null key is a key like any other. A null text has no bytes. Rows with equal keys share a shard. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from toposcan.llm.common import numbered

Tree = Mapping[str, Mapping[str, Mapping[int, float]]]  # region -> rack -> shard -> weight


def layout(shards: int, base: int = 16, weights: Mapping[int, float] | None = None) -> Tree:
    """Tree of ``shards`` shards; ``weights`` (default 1.0 each) may set the share of single shards."""
    tree: dict[str, dict[str, dict[int, float]]] = {}
    for s in range(shards):
        region, rack = (f"r{s // 8}", f"r{s // 8}k{s % 8 // 4}") if s < base else (f"r+{s}", f"r+{s}k0")
        tree.setdefault(region, {}).setdefault(rack, {})[s] = float((weights or {}).get(s, 1.0))
    return tree


def _draw(key: Column, node: str, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.xxhash64(key), F.lit(node)), 11).cast("double")
    return -F.ln((bits + 0.5) / float(1 << 53)) / F.lit(weight)


def _winner(key: Column, nodes: dict[str, float]) -> Column:
    """Name of the node with the smallest draw; nodes without weight take no part."""
    live = [F.struct(_draw(key, n, w).alias("draw"), F.lit(n).alias("node")) for n, w in nodes.items() if w > 0]
    if not live:
        return F.lit(None).cast("string")
    return (F.least(*live) if len(live) > 1 else live[0])["node"]


def place(df: DataFrame, key: str, tree: Tree, out: str = "shard") -> DataFrame:
    """Add the shard (int) of ``key``; the descent is three projections, no shuffle."""
    total = lambda rack: sum(rack.values())
    col = F.col(key)
    df = df.withColumn("__region", _winner(col, {r: sum(map(total, racks.values())) for r, racks in tree.items()}))
    rack, shard = F.lit(None).cast("string"), F.lit(None).cast("string")
    for region, racks in tree.items():
        rack = F.when(F.col("__region") == region, _winner(col, {k: total(v) for k, v in racks.items()})).otherwise(rack)
        for name, leaves in racks.items():
            shard = F.when(F.col("__rack") == name, _winner(col, {f"s{s}": w for s, w in leaves.items()})).otherwise(shard)
    df = df.withColumn("__rack", rack).withColumn("__shard", shard)
    return df.withColumn(out, F.substring("__shard", 2, 10).cast("int")).drop("__region", "__rack", "__shard")


def shard_documents(docs: DataFrame, shards: int = 16, base: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``: the place of every row, also with one shard more."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"))
    rows = place(rows, "doc_id", layout(shards, base))
    rows = place(rows, "doc_id", layout(shards + 1, base), "grown_shard")
    return numbered(rows, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
