"""Operator 5: sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``replicas`` points of a ring of ``CELLS`` cells.  A key belongs to the first point clockwise of its
cell; where that point's shard is full, the key goes on clockwise to the next point whose shard has room.  No shard ever
holds more than its capacity, and a change of the shard count moves the keys of the changed arcs and their overflow only.

The walk is done for counts, not for keys: keys of one arc are alike, so an arc's rows are cut into runs, one for each shard
that takes some.  The number of arcs is a parameter (``shards * replicas``), so the counts that reach the driver do not grow
with the data.  Rows find their run by their rank in the arc, which comes from one range partitioning of narrow rows.

With ``slack=0`` the capacities are the even shares, so counts differ by at most one (law ``rows``).  Rows that share a key
(also null keys and repeated rows) are told apart by a salt and overflow like any others, however many they are.  An empty
table gives an empty result.  Null texts count as zero bytes.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm import common

#: Cells of the ring; a power of two, so that a cell is the top bits of a hash.
CELL_BITS = 15
CELLS = 1 << CELL_BITS


def ring(shards: int, replicas: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all points in ring order, and the shard that owns each."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for replica in range(replicas):
            cell = xxhash.xxh3_64_intdigest(f"{shard}/{replica}") >> (64 - CELL_BITS)
            while cell in taken:
                cell = (cell + 1) % CELLS
            taken[cell] = shard
    cells = np.array(sorted(taken))
    return cells, np.array([taken[c] for c in cells])


def arc_of_cell(cells: np.ndarray) -> np.ndarray:
    """The point that each cell of the ring belongs to: the first one at or after it, clockwise."""
    return np.searchsorted(cells, np.arange(CELLS)) % len(cells)


def capacities(total: int, shards: int, slack: float) -> list[int]:
    """Most rows of each shard: even shares, or ``1 + slack`` times them."""
    if slack <= 0:
        return [total // shards + (s < total % shards) for s in range(shards)]
    return [int(np.ceil(total * (1 + slack) / shards))] * shards


def walk(counts: dict[int, int], owners: np.ndarray, capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Runs (arc, first rank, end rank, shard, first slot): arcs step clockwise together until all rows have a shard."""
    left, start, room, filled, runs = dict(sorted(counts.items())), {}, list(capacity), [0] * len(capacity), []
    for step in range(len(owners)):
        for arc in list(left):
            shard = int(owners[(arc + step) % len(owners)])
            take = min(left[arc], room[shard])
            if take:
                at = start.get(arc, 0)
                runs.append((arc, at, at + take, shard, filled[shard]))
                start[arc], left[arc] = at + take, left[arc] - take
                room[shard] -= take
                filled[shard] += take
            if not left[arc]:
                del left[arc]
        if not left:
            return runs
    if left:
        raise ValueError("the shards have no room for all rows")
    return runs


def assign(df: DataFrame, key: str, shards: int, replicas: int = 64, slack: float = 0.0) -> DataFrame:
    """``df`` (narrow rows) with ``shard`` and the gapless ``slot`` in it."""
    spark = df.sparkSession
    if shards * replicas > CELLS // 4:
        raise ValueError("too many points for the ring")
    cells, owners = ring(shards, replicas)
    arcs = spark.createDataFrame(list(enumerate(arc_of_cell(cells).tolist())), "_cell int, _arc int")
    inner = df.columns
    placed = df.select(F.struct(*inner).alias("row"), F.xxhash64(key).alias("at"), common.salt().alias("salt"))
    placed = placed.withColumn("_cell", F.shiftrightunsigned("at", 64 - CELL_BITS).cast("int"))
    # One row for each cell of the ring: a fixed number.
    placed = placed.join(F.broadcast(arcs), "_cell")
    ranked = common.numbered(
        placed.repartitionByRange("_arc", "at", "salt").sortWithinPartitions("_arc", "at", "salt").select("row", "_arc"), "ring"
    )
    # A part is a range of the ring, so it has a few arcs; their counts are at most parts + arcs.
    pieces = sorted(
        tuple(r) for r in ranked.groupBy("_arc", "part").agg(F.min("idx"), F.count("*")).collect()
    )  # rows: (arc, part, first idx, rows)
    counts: dict[int, int] = {}
    before = []
    for arc, part, first, n in pieces:
        before.append((arc, part, counts.get(arc, 0) - first))
        counts[arc] = counts.get(arc, 0) + n
    total = sum(counts.values())
    runs = walk(counts, owners, capacities(total, shards, slack)) if total else []
    cut = []  # the runs of each (arc, part): rows of that part find theirs by idx alone
    by_arc: dict[int, list] = {}
    for run in runs:
        by_arc.setdefault(run[0], []).append(run)
    for (arc, part, shift), (_, _, first, n) in zip(before, pieces, strict=True):
        for _, low, high, shard, slot in by_arc.get(arc, ()):
            a, b = max(low - shift, first), min(high - shift, first + n)
            if a < b:
                cut.append((arc, part, a, b, shard, slot + shift - low))
    cut = spark.createDataFrame(cut, "_arc int, part long, low long, high long, shard int, slot0 long")
    inside = (
        (ranked["_arc"] == cut["_arc"]) & (ranked["part"] == cut["part"])
        & (ranked["idx"] >= cut["low"]) & (ranked["idx"] < cut["high"])
    )
    # At most arcs + parts + shards * arcs runs, in practice about twice the arcs.
    out = ranked.join(F.broadcast(cut), inside)
    return out.select(
        "row.*", "shard", (F.col("slot0") + ranked["idx"]).alias("slot")
    )


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Narrow rows (doc_id, size, text_crc32) of all documents with law, shard, slot and grown_shard."""
    text = F.col("text").cast("binary")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(b""))).cast("long").alias("text_crc32"),
    )
    return assign(rows, "doc_id", shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
