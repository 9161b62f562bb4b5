"""Shards by a consistent-hash ring with virtual nodes and bounded loads (DataFrame operators only).

A document's hash is a place on a ring; the next virtual node clockwise names
its shard.  Shards have bounds that add up to the number of rows (they differ
by one at most), and what overflows a full shard goes on clockwise, so counts
are at most one apart.  Keys arrive in ring order, which makes the result
independent of partitions and reruns.

The driver sees no documents: the ring is cut into cells (arcs between virtual
nodes and grid points, their number bounded by a parameter), rows are counted
by cell, and the pass around the ring runs over these counts.  It gives each
cell ranges of ranks with their shard; a document's rank in its cell comes
from a window over that cell alone.

Defined cases: a null text has no bytes; rows that repeat a doc_id share a
place and are dealt in the order of their checksums; null ids share one place;
an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import bisect
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Places on the ring are 62-bit numbers.
RING_BITS = 62
#: Grid points are 2 ** bits: enough that a cell has about CELL_ROWS rows, within these bounds.
GRID_BITS, CELL_ROWS = (10, 20), 200_000


def place(column):
    """A place on the ring: the upper bits of the 64-bit hash of the id."""
    return F.shiftrightunsigned(F.xxhash64(column, F.lit(0x5EED)), 64 - RING_BITS)


def ring_nodes(spark: SparkSession, n_shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes; a shard's nodes do not depend on the number of shards."""
    nodes = spark.range(n_shards * vnodes).select(F.floor(F.col("id") / vnodes).cast("int").alias("shard"), F.pmod("id", F.lit(vnodes)).alias("v"))
    return sorted((r.at, r.shard) for r in nodes.select("shard", F.shiftrightunsigned(F.xxhash64("shard", "v"), 64 - RING_BITS).alias("at")).collect())


def ring_cells(nodes: list[tuple[int, int]], bits: int) -> list[tuple[int, int, int]]:
    """(first, last, node) of each arc: arcs end at virtual nodes and at grid points; node: the next clockwise."""
    places = [p for p, _ in nodes]
    step = 1 << (RING_BITS - bits)
    starts = sorted({0, *range(0, 1 << RING_BITS, step), *(p + 1 for p in places if p + 1 < 1 << RING_BITS)})
    ends = [*(s - 1 for s in starts[1:]), (1 << RING_BITS) - 1]
    return [(a, b, bisect.bisect_left(places, a) % len(places)) for a, b in zip(starts, ends)]


def fill_ring(cells, counts: dict[int, int], nodes, capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(cell, from rank, to rank, shard, first slot): one pass clockwise, going on past full shards."""
    left, used, out = list(capacity), [0] * len(capacity), []
    skip = list(range(1, len(nodes))) + [0]  # next node whose shard may have room, shortened as shards fill
    for k, (_, _, node) in enumerate(cells):
        n, rank, at = counts.get(k, 0), 0, node
        while rank < n:
            seen = []
            while not left[nodes[at][1]]:
                seen.append(at)
                at = skip[at]
            for s in seen:
                skip[s] = at
            shard = nodes[at][1]
            take = min(left[shard], n - rank)
            out.append((k, rank, rank + take, shard, used[shard]))
            left[shard] -= take
            used[shard] += take
            rank += take
    return out


def _rows(spark: SparkSession, rows: list, names: list[str]) -> DataFrame:
    """A small table from a literal, without Python on the executors."""
    schema = "array<struct<" + ",".join(f"{n}:bigint" for n in names) + ">>"
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(text), schema)))


def ring_shards(docs: DataFrame, n_shards=24, vnodes=64, id_col="doc_id", text_col="text") -> DataFrame:
    """Per document: doc_id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), place(F.col(id_col)).alias("at"))
    places = docs.select(place(F.col(id_col)).alias("at"))  # reads the id column alone
    n = places.count()
    bits = min(max(GRID_BITS[0], (n // CELL_ROWS).bit_length()), GRID_BITS[1])
    nodes = ring_nodes(spark, n_shards, vnodes)
    cells = ring_cells(nodes, bits)
    shift = RING_BITS - bits
    # Bounded by n_shards * vnodes + 2 ** GRID_BITS[1] rows, whatever the input.
    ring = F.broadcast(_rows(spark, [(a >> shift, a, b, k) for k, (a, b, _) in enumerate(cells)], ["grid", "first", "last", "cell"]))
    inside = (F.shiftright("at", shift) == F.col("grid")) & F.col("at").between(F.col("first"), F.col("last"))
    counts = {r.cell: r.n for r in places.join(ring, inside).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    capacity = [n // n_shards + (i < n % n_shards) for i in range(n_shards)]
    ranges = F.broadcast(_rows(spark, fill_ring(cells, counts, nodes, capacity), ["in_cell", "lo", "hi", "shard", "base"]))
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("at", "doc_id", "text_crc32", "size")) - 1
    ranked = keyed.join(ring, inside).select("doc_id", "size", "text_crc32", "cell", rank.cast("long").alias("rank"))
    return ranked.join(ranges, (F.col("cell") == F.col("in_cell")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select(
        "doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("rank") - F.col("lo")).alias("slot")
    )


def sharding_query(spark, sf_dir) -> DataFrame:
    from .shared import table

    out = ring_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
