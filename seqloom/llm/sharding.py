"""Sharding by Karmarkar-Karp differencing: near equal bytes, equal texts together.

Groups of equal texts are indivisible. They are dealt by hash over chunks; in
each chunk the two partial partitions of largest spread are combined, one
ordered up and the other down, until one is left. The chunks' partial
partitions (a few numbers each) are combined in the same way, in rounds of
``fan``, so no task and not the driver sees more than a bounded share. A text
with millions of copies is one group with one row; its documents meet their
shard in a join that Spark may split.

Defined results: a null text has no bytes (size 1, crc 0) and forms a group
with other null texts, apart from empty ones; repeated rows get slots of their
own; groups of equal size are told apart by their keys, rows of equal id by their text's; very
long texts count by all their bytes; with fewer groups than shards some shards stay empty; an empty table
gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import Workspace, table


def difference(parts: list[list[tuple[int, object]]], shards: int) -> list[tuple[int, list]]:
    """Combine partial partitions (up to ``shards`` pairs of size and leaf each) into one of ``shards`` (size, leaves)."""
    heap = []
    for n, part in enumerate(parts):
        slots = sorted(((size, (leaf,)) for size, leaf in part), key=lambda s: -s[0])
        slots += [(0, ())] * (shards - len(slots))
        heap.append((slots[-1][0] - slots[0][0], n, slots))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, n, large = heapq.heappop(heap)
        _, _, other = heapq.heappop(heap)
        joined = [(a + b, (x, y) if x and y else x or y) for (a, x), (b, y) in zip(large, reversed(other))]
        joined.sort(key=lambda s: -s[0])
        heapq.heappush(heap, (joined[-1][0] - joined[0][0], n, joined))
    out = []
    for size, tree in heap[0][2] if heap else [(0, ())] * shards:
        leaves, stack = [], [tree]
        while stack:  # a tree of pairs over one-leaf tuples
            t = stack.pop()
            if len(t) == 2:
                stack += t
            elif t:
                leaves.append(t[0])
        out.append((size, leaves))
    return out


def _split_chunk(shards: int):
    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "key"], ascending=[False, True], ignore_index=True)
        slot = [0] * len(pdf)
        for s, (_, leaves) in enumerate(difference([[(int(b), i)] for i, b in enumerate(pdf["bytes"])], shards)):
            for i in leaves:
                slot[i] = s
        return pdf.assign(slot=slot)[["key", "node", "bytes", "slot"]]

    return split


def _combine(shards: int):
    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["node", "slot"], ignore_index=True)
        parts: dict[int, list] = {}
        for row in pdf.itertuples():
            parts.setdefault(row.node, []).append((int(row.bytes), (row.node, row.slot)))
        up = {leaf: s for s, (_, leaves) in enumerate(difference(list(parts.values()), shards)) for leaf in leaves}
        return pdf.assign(up_slot=[up[k] for k in zip(pdf["node"], pdf["slot"])])[["node", "slot", "up_node", "up_slot", "bytes"]]

    return combine


def shard_groups(groups: DataFrame, work: Workspace, *, shards: int, chunk: int = 20_000, fan: int = 1024) -> DataFrame:
    """``groups`` (key, bytes) with the shard of each key."""
    nodes = max(1, -(-groups.count() // chunk))
    dealt = groups.withColumn("node", F.pmod(F.xxhash64("key"), F.lit(nodes)).cast("long"))
    parted = work.save(dealt.groupBy("node").applyInPandas(_split_chunk(shards), "key binary, node long, bytes long, slot int"), "parted")
    placed = parted.select("key", "node", F.col("slot").alias("shard"))
    level = parted.groupBy("node", "slot").agg(F.sum("bytes").alias("bytes"))
    step = 0
    while nodes > 1:
        ups = level.withColumn("up_node", F.floor(F.col("node") / fan).cast("long"))
        up = work.save(ups.groupBy("up_node").applyInPandas(_combine(shards), "node long, slot int, up_node long, up_slot int, bytes long"), f"up{step}")
        moves = up.select(F.col("node").alias("n"), F.col("slot").alias("s"), "up_node", "up_slot")
        placed = placed.join(moves, (F.col("node") == F.col("n")) & (F.col("shard") == F.col("s"))).select("key", F.col("up_node").alias("node"), F.col("up_slot").alias("shard"))
        level = up.groupBy(F.col("up_node").alias("node"), F.col("up_slot").alias("slot")).agg(F.sum("bytes").alias("bytes"))
        nodes, step = -(-nodes // fan), step + 1
    return placed.select("key", "shard")


def shard(docs: DataFrame, *, shards: int = 8, id_col: str = "doc_id", text: str = "text", rows_per_range: int = 50_000) -> DataFrame:
    """One row a document: id, size, text_crc32, shard and slot (gapless in its shard)."""
    work = Workspace(docs.sparkSession, "sharding")
    octets = F.encode(F.col(text), "UTF-8")
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(octets), F.lit(0)).cast("long").alias("crc"),
        F.coalesce(F.unhex(F.md5(octets)), F.lit(b"null")).alias("key"),
    )
    rows = work.save(rows, "rows")
    groups = work.save(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    placed = work.save(shard_groups(groups, work, shards=shards), "placed")
    ranges = max(1, -(-rows.count() // rows_per_range))
    ranged = rows.join(placed, "key").withColumn("range", F.pmod(F.xxhash64("id", "key"), F.lit(ranges)))
    counts = ranged.groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = work.save(counts.select(F.col("shard").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    inside = Window.partitionBy("shard", "range").orderBy("id", "key")
    numbered = ranged.withColumn("n", F.row_number().over(inside) - 1)
    full = numbered.join(bases, (F.col("shard") == F.col("s")) & (F.col("range") == F.col("r")))
    return full.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("base") + F.col("n")).cast("long").alias("slot"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
