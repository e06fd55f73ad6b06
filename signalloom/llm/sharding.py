"""Consistent-hash ring with virtual nodes and bounded loads.

A document belongs to the next virtual node clockwise from its hash. Where that shard is full, the last of its documents
go on clockwise to the next shard with room. Full sizes differ by at most one row, so the counts do too, and a change
of the shard count moves little more than the rows that the ring itself moves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.common import dense_ranks, keep

SPAN = 1 << 48
CELLS = 1 << 12
BUCKETS = 1 << 14


def ring(shards: int, virtual: int) -> list[tuple[int, int]]:
    """Sorted (position, shard) of all virtual nodes."""
    return sorted(
        (int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:6], "big"), s) for s in range(shards) for v in range(virtual)
    )


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def cascade(counts: Sequence[int], owners: Sequence[int], room: Sequence[int]) -> list[tuple[int, int, int, int, int]]:
    """Pieces (arc, first rank, end rank, shard, first slot) when overflowing ranks walk on clockwise.

    Works on the number of rows per arc only.
    """
    load, pieces, over = [0] * len(room), [], []

    def take(arc: int, low: int, high: int, shard: int) -> int:
        n = min(high - low, room[shard] - load[shard])
        if n > 0:
            pieces.append((arc, low, low + n, shard, load[shard]))
            load[shard] += n
        return low + max(n, 0)

    for arc, count in enumerate(counts):
        low = take(arc, 0, count, owners[arc])
        if low < count:
            over.append((arc, low, count))
    for arc, low, high in over:
        step = 1
        while low < high:
            low = take(arc, low, high, owners[(arc + step) % len(owners)])
            step += 1
    return pieces


def assign(df: DataFrame, shards: int = 8, virtual: int = 64, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (doc_id, size, text_crc32, shard, slot) per document; slots count from 0 in each shard.

    The position on the ring hashes the id and the text's checksum, ties go by id, checksum and size, so repeated rows
    are interchangeable. Null and empty texts have size 1. An empty table gives no rows.
    """
    nodes = ring(shards, virtual)
    spark = df.sparkSession
    data = F.col(text).cast("binary")
    hashed = keep(
        df.select(
            F.col(doc_id).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(data, F.lit(b""))).alias("text_crc32"),
        ).withColumn("at", F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32"), 16)),
        "ring",
    )
    # The ring as pieces of cells of equal width: at most CELLS + nodes + 1 rows, whatever the data.
    width, cells, low = SPAN // CELLS, [], 0
    for arc, (high, _) in enumerate([*nodes, (SPAN - 1, 0)]):
        for cell in range(low // width, high // width + 1):
            cells.append((cell, max(low, cell * width), min(high, (cell + 1) * width - 1), arc % len(nodes)))
        low = high + 1
    lookup = spark.createDataFrame(cells, "cell long, low long, high long, arc int")
    placed = (
        hashed.withColumn("cell", F.floor(F.col("at") / width)).join(F.broadcast(lookup), "cell")
        .filter(F.col("at").between(F.col("low"), F.col("high")))
        # The first arc also holds what lies behind the last node: those come first on the ring.
        .withColumn("at", F.when((F.col("arc") == 0) & (F.col("at") > nodes[0][0]), F.col("at") - (nodes[-1][0] + 1))
                    .otherwise(F.col("at") + F.when(F.col("arc") == 0, SPAN - 1 - nodes[-1][0]).otherwise(0)))
        .select("doc_id", "size", "text_crc32", "at", "arc")
    )
    counted = {r["arc"]: r["count"] for r in placed.groupBy("arc").count().collect()}
    counts = [counted.get(a, 0) for a in range(len(nodes))]
    pieces = cascade(counts, [s for _, s in nodes], capacities(sum(counts), shards))
    # At most one piece per arc and one more for each shard that fills up, on either walk.
    table = spark.createDataFrame(pieces, "arc int, first long, end long, shard int, base long")
    ranked = dense_ranks(placed, "arc", F.col("at"), [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "rank", BUCKETS)
    return (
        ranked.join(F.broadcast(table), "arc").filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
        .select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("first")).alias("slot"))
    )
