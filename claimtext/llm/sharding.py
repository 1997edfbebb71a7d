"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every row has a place on the ring, the hash of its key and text; every shard
has ``VNODES`` virtual nodes.  The ring is divided into 2**16 cells, and a row
belongs to the first virtual node at or after its cell.  No shard takes more
than its bound: with ``slack`` 0 the bounds add up to the number of rows, so
all shards are full and their counts are at most one apart (law ``rows``); with
``slack`` e a bound is (1 + e) times the mean, and fewer rows move when the
number of shards changes.  A cell's rows go to their own shard while it has
room; what overflows continues clockwise to the next shard with room.

Only the 2**16 counts of the cells reach the driver, which turns them into
pieces (cell, ranks, shard, first slot); the rows then need their rank inside
their cell, which spreads over 2**16 groups.  Slots are gapless in each shard,
and the bounds hold whatever the keys are.

Defined results: null ids and texts have a place like any other value; rows
with equal id and text share a place and are told apart by rank alone, in
any order, as they are alike.  Copies of a text under other ids spread over
the ring.  Fewer rows than shards leave shards empty; an empty table gives no
rows.  Result columns replace input columns of the same name.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimtext.llm.common import fresh, quoted, without

SHARDS = 24
VNODES = 64
CELL_BITS = 16


def ring(shards: int, vnodes: int = VNODES) -> tuple[np.ndarray, np.ndarray]:
    """(cell, shard) of the virtual nodes, clockwise."""
    nodes = []
    for shard in range(shards):
        for k in range(vnodes):
            digest = hashlib.blake2b(f"{shard}/{k}".encode(), digest_size=8).digest()
            nodes.append((int.from_bytes(digest, "big") >> (64 - CELL_BITS), digest, shard))
    nodes.sort()
    return np.array([n[0] for n in nodes]), np.array([n[2] for n in nodes])


def bounds(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    if slack:
        return [-(-int((1 + slack) * rows * 1000) // (1000 * shards)) + 1] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def pieces(counts: np.ndarray, shards: int, vnodes: int = VNODES, slack: float = 0.0) -> list[tuple]:
    """(cell, first rank, end rank, shard, slot of the first rank) that place every row."""
    place, owner = ring(shards, vnodes)
    room = bounds(int(counts.sum()), shards, slack)
    taken = [0] * shards
    out, over = [], {}
    arc = np.searchsorted(place, np.arange(len(counts))) % len(place)

    def put(cell: int, low: int, high: int, shard: int) -> int:
        n = min(high - low, room[shard])
        if n:
            out.append((cell, low, low + n, shard, taken[shard]))
            room[shard] -= n
            taken[shard] += n
        return low + n

    for cell in np.flatnonzero(counts).tolist():
        n = int(counts[cell])
        low = put(cell, 0, n, int(owner[arc[cell]]))
        if low < n:
            over.setdefault(int(arc[cell]), []).append((cell, low, n))
    for node in sorted(over):  # clockwise; an arc's overflow goes on together
        at = node
        for cell, low, high in over[node]:
            while low < high:
                low = put(cell, low, high, int(owner[at % len(owner)]))
                if low < high:
                    at += 1
    return out


def cell_counts(placed: DataFrame, cell: str) -> np.ndarray:
    counts = np.zeros(1 << CELL_BITS, np.int64)
    for r in placed.groupBy(F.col(cell).alias("cell")).count().collect():  # at most 2**16 rows
        counts[r["cell"]] = r["count"]
    return counts


def shard(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, slack: float = 0.0, id: str = "doc_id",
          text: str = "text") -> DataFrame:
    """docs with shard (0 to shards - 1) and slot (gapless from 0 in each shard)."""
    docs = without(docs, *[c for c in ("shard", "slot") if c not in (id, text)])
    place, cell, rank, dealt, own = fresh(docs, "place", "cell", "rank", "dealt", "own")
    placed = docs.withColumn(place, F.xxhash64(quoted(id), quoted(text)))
    placed = placed.withColumn(cell, F.shiftrightunsigned(place, 64 - CELL_BITS).cast("int"))
    of_cell: dict[int, list] = {}
    for c, low, high, s, first in pieces(cell_counts(placed, cell), shards, vnodes, slack):
        of_cell.setdefault(c, []).append((low, high, s, first))
    plan = docs.sparkSession.createDataFrame(
        [(c, sorted(p)) for c, p in of_cell.items()],
        f"{own} int, {dealt} array<struct<low:long,high:long,shard:int,first:long>>")
    ranked = placed.withColumn(rank, (F.row_number().over(Window.partitionBy(cell).orderBy(place)) - 1).cast("long"))
    # at most 2**16 rows, some 100 bytes each
    found = ranked.join(F.broadcast(plan), F.col(cell) == F.col(own))
    piece = F.filter(dealt, lambda p: (p["low"] <= F.col(rank)) & (F.col(rank) < p["high"]))[0]
    out = found.withColumn(dealt, piece)
    return out.select(*[quoted(c) for c in docs.columns], F.col(f"{dealt}.shard").alias("shard"),
                      (F.col(f"{dealt}.first") + F.col(rank) - F.col(f"{dealt}.low")).alias("slot"))


def write(sharded: DataFrame, folder: str) -> None:
    """One Parquet folder for each shard."""
    sharded.write.partitionBy("shard").parquet(folder)
