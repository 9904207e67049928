"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` cells; a row's cell comes from the MD5 of its id and text,
so that ids that are null or repeated spread as others do.  Each
shard has virtual nodes on the ring.  A row goes to the shard of the next node
clockwise; where that shard is full, it continues to the next node of another
shard, and so on.  Shards hold floor or ceil of rows / shards, so the law is
``rows``: counts are at most one apart.  Rows of a cell are taken in the order
of their hash, cells in clockwise order, first choices of all cells before any
second choice.  Only rows of full shards move on, so a change of the shard
count leaves most rows where they are.

The rows of a cell are ranked by a window over that cell; only the count of each
cell, at most ``CELLS`` numbers at any size of the input, goes to the driver,
and at most ``CELLS`` x shards intervals come back as a broadcast table.

Defined results: a null text has size 1 and the CRC of the empty text; a null id
is hashed as the empty string.  Repeated rows are counted together before the
shuffle and get slots of their own, laid out in blocks of ``BLOCK`` that are
dealt anew.  Ties are repeated rows and need no order.  Whole texts are read, of
any length.  An empty table gives an empty result.
Further columns are not read.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window as W, functions as F

from proofmill.session import stash

HEX_DIGITS = 3
CELLS = 16**HEX_DIGITS
VIRTUAL_NODES = 32
BLOCK = 1 << 14


def ring(n_shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes, clockwise."""
    at = lambda s, v: int(hashlib.md5(f"shard {s} node {v}".encode()).hexdigest()[:HEX_DIGITS], 16)
    return sorted((at(s, v), s) for s in range(n_shards) for v in range(virtual_nodes))


def choices(n_shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[list[int]]:
    """For each cell, the shards in the order in which its rows meet them clockwise."""
    nodes = ring(n_shards, virtual_nodes)
    found, first = [], 0
    for cell in range(CELLS):
        while first < len(nodes) and nodes[first][0] < cell:
            first += 1
        found.append(list(dict.fromkeys(s for _, s in nodes[first:] + nodes[:first])))
    return found


def allot(counts: dict[int, int], n_shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot): which ranks of each cell go where."""
    total = sum(counts.values())
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    slot, left, order, out = [0] * n_shards, dict(counts), choices(n_shards, virtual_nodes), []
    for turn in range(n_shards):
        for cell in sorted(c for c, n in left.items() if n):
            shard = order[cell][turn]
            n = min(left[cell], room[shard])
            if n:
                lo = counts[cell] - left[cell]
                out.append((cell, lo, lo + n, shard, slot[shard]))
                left[cell] -= n
                room[shard] -= n
                slot[shard] += n
    return out


def shard(docs: DataFrame, n_shards: int = 8, doc_id: str = "doc_id", text: str = "text", virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard and its slot in the shard."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    keyed = keyed.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    keyed = keyed.withColumn("h", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32"), F.col("size")).cast("binary")))
    keyed = stash(keyed.withColumn("cell", F.conv(F.substring("h", 1, HEX_DIGITS), 16, 10).cast("int")), "ring")
    counts = {r.cell: r.n for r in keyed.groupBy("cell").agg(F.sum("copies").alias("n")).collect()}
    rows = [dict(zip(("cell", "lo", "hi", "shard", "slot_lo"), x, strict=True)) for x in allot(counts, n_shards, virtual_nodes)]
    plan = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<cell int, lo long, hi long, shard int, slot_lo long>>")))
    before = W.partitionBy("cell").orderBy("h", "doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = keyed.withColumn("end", F.sum("copies").over(before))
    # The part of a row's copies that falls in an interval of the plan, as ranks from ``first`` to ``last``.
    first, last = F.greatest(F.col("end") - F.col("copies"), F.col("lo")), F.least(F.col("end"), F.col("hi")) - 1
    parts = ranked.join(F.broadcast(plan), "cell").withColumn("first", first).withColumn("last", last).filter("first <= last")
    slots = parts.select("doc_id", "size", "text_crc32", "shard", (F.col("slot_lo") + F.col("first") - F.col("lo")).alias("slot"), (F.col("last") - F.col("first") + 1).alias("n"))
    one = slots.filter("n = 1").select("doc_id", "size", "text_crc32", "shard", "slot")
    many = slots.filter("n > 1").withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BLOCK))))
    many = many.repartition("doc_id", "text_crc32", "block")
    spread = F.explode(F.sequence(F.lit(0), F.least(F.lit(BLOCK), F.col("n") - F.col("block") * BLOCK) - 1))
    many = many.select("doc_id", "size", "text_crc32", "shard", "slot", "block", spread.alias("i")).select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("block") * BLOCK + F.col("i")).alias("slot"))
    return one.unionByName(many)
