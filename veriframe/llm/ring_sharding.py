"""Operator 8: consistent-hash ring with virtual nodes and bounded loads (native DataFrame code)."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import stage, table

#: The ring has 2**16 cells. A cell is the unit of counting and of ordering: however large the
#: table, the driver sees at most this many counts, and the segments sent back are bounded by it.
CELL_BITS = 16
CELLS = 1 << CELL_BITS
#: Rows of a cell that are ranked in one piece; a cell with more (one key repeated over and over) is ranked in parts.
HOT_ROWS = 1 << 16


def ring_owners(n_shards: int, vnodes: int) -> list[int]:
    """Owner of every cell: the shard of the first virtual node at or after it, clockwise."""
    at: dict[int, int] = {}
    for shard in range(n_shards):
        for v in range(vnodes):
            digest = hashlib.sha256(f"shard-{shard}/vnode-{v}".encode()).digest()
            place = int.from_bytes(digest[:8], "big") % CELLS
            at[place] = min(shard, at.get(place, shard))
    owners = [0] * CELLS
    owner = at[min(at)]
    for cell in range(CELLS - 1, -1, -1):
        owner = at.get(cell, owner)
        owners[cell] = owner
    return owners


def seat(counts: dict[int, int], n_shards: int, vnodes: int) -> list[tuple[int, int, int, int, int]]:
    """Segments (cell, first rank, past rank, shard, slot of the first) that seat all keys.

    Every shard first takes the keys of its own cells in ring order until its capacity
    (row count / shards, the first shards one more) is reached. Keys left over walk on clockwise,
    in ring order, and sit down at the next virtual node whose shard has room.
    """
    n = sum(counts.values())
    room = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    filled = [0] * n_shards
    owners = ring_owners(n_shards, vnodes)
    segments, waiting = [], []

    def take(cell: int, lo: int, hi: int, shard: int) -> int:
        got = min(hi - lo, room[shard])
        if got:
            segments.append((cell, lo, lo + got, shard, filled[shard]))
            room[shard] -= got
            filled[shard] += got
        return lo + got

    for cell in sorted(counts):
        rest = take(cell, 0, counts[cell], owners[cell])
        if rest < counts[cell]:
            waiting.append((cell, rest))
    starts = [c for c in range(CELLS) if owners[c] != owners[c - 1]]
    for cell, lo in waiting:
        first = next((i for i, c in enumerate(starts) if c > cell), 0)
        for step in range(len(starts)):
            if lo >= counts[cell]:
                break
            lo = take(cell, lo, counts[cell], owners[starts[(first + step) % len(starts)]])
    return segments


def listed(spark: SparkSession, rows: list[dict], fields: str) -> DataFrame:
    """A bounded table of the driver's as a literal of the plan."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")))


def parted(narrow: DataFrame, counts: dict[int, int]) -> DataFrame:
    """narrow with the part of its cell that a row is in, and the number of the cell's rows in parts before it."""
    most = max(HOT_ROWS, 4 * -(-sum(counts.values()) // CELLS))
    hot = [{"cell": c, "parts": -(-n // most)} for c, n in counts.items() if n > most]
    if not hot:
        return narrow.withColumns({"part": F.lit(0), "before": F.lit(0).cast("long")})
    spark = narrow.sparkSession
    cells = listed(spark, hot, "cell:int,parts:int")
    dealt = narrow.join(F.broadcast(cells), "cell", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    sizes = dealt.join(F.broadcast(cells.select("cell")), "cell", "left_semi").groupBy("cell", "part").agg(F.count("*").alias("n")).collect()
    before, so_far = [], {}
    for r in sorted(sizes, key=lambda r: (r["cell"], r["part"])):
        before.append({"cell": r["cell"], "part": r["part"], "before": so_far.get(r["cell"], 0)})
        so_far[r["cell"]] = so_far.get(r["cell"], 0) + r["n"]
    return dealt.join(F.broadcast(listed(spark, before, "cell:int,part:int,before:long")), ["cell", "part"], "left").fillna(0, ["before"])


def shard_documents(
    docs: DataFrame, n_shards: int = 16, vnodes: int = 64, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot, grown_shard.

    Law `rows`: the shards' row counts differ by one at most, by the bounded loads of the ring.
    size is the UTF-8 length of the text (null: 0) plus 1. A row without a key is placed by its
    text. Repeated rows are rows of their own; ties in the hash go by
    key, size and checksum. In a cell of over HOT_ROWS rows, which only repeated rows make, the rows are dealt into parts
    whose ranks follow each other, since any of its places is as good for a row. Very long texts are only
    measured. An empty table gives an empty result. Other columns are not read.

    Plan: one scan of the texts to a narrow staged table; counts of at most 2**16 cells to the
    driver, and of the parts of hot cells, at most as many again; one shuffle of narrow rows by cell and part for the rank inside
    it; a broadcast join with the bounded segment list.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    crc = F.crc32(body)
    placed = F.when(F.col(key).isNull(), F.xxhash64(crc, F.lit("text"))).otherwise(F.xxhash64(F.col(key)))
    narrow = stage(
        docs.select(
            F.col(key).alias("doc_id"),
            (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
            crc.cast("long").alias("text_crc32"),
            placed.alias("h"),
            F.monotonically_increasing_id().alias("row"),
        ).withColumn("cell", F.shiftrightunsigned("h", 64 - CELL_BITS).cast("int")),
        "ring",
    )
    counts = {r["cell"]: r["n"] for r in narrow.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    narrow = parted(narrow, counts)
    segments = [
        dict(zip(("cell", "lo", "hi", "shard", "base"), s)) for s in seat(counts, n_shards, vnodes)
    ]
    seats = listed(spark, segments, "cell:int,lo:long,hi:long,shard:int,base:long")
    order = Window.partitionBy("cell", "part").orderBy("h", "doc_id", "size", "text_crc32", "row")
    ranked = narrow.withColumn("r", F.row_number().over(order).cast("long") - 1 + F.col("before"))
    return ranked.join(F.broadcast(seats), ["cell"]).where("r >= lo AND r < hi").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("base") + F.col("r") - F.col("lo")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
