"""Packing token ids into sequences: bounded-space online best fit.

Each partition keeps a fixed number of open windows.  A document is cut into
full windows, which leave at once, and a rest, which goes into the open window
with the least room that still holds it; where none does, the fullest window
leaves and a new one opens.  Windows that are open at the end of a partition
are merged in groups of partitions, largest first, so no task sees more than
``open_windows * MERGE_GROUP`` of them.

Defined cases: a null text is empty and has the end id alone; rows that repeat
a doc_id are documents of their own; an empty table gives no sequence.  Other
columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, table, tidy
from .subwords import encoder, slices, vocabulary

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
MERGE_GROUP = 32
#: Units that a worker's encoder keeps: fewer than elsewhere, as packing runs behind other stages in the same workers.
CACHE_UNITS = 300_000
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class OpenWindows:
    """At most ``limit`` windows of ``size`` ids, ordered by how full they are; pieces are tuples that begin with start and length."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit = size, limit
        self.fill: list[int] = []
        self.held: list[list] = []

    def add(self, length: int, piece) -> list | None:
        """Place a piece; returns the window that left for it, if one did."""
        at = bisect.bisect_right(self.fill, self.size - length) - 1  # the fullest with room
        out = None
        if at >= 0:
            fill, held = self.fill.pop(at), self.held.pop(at)
        else:
            if len(self.fill) >= self.limit:
                self.fill.pop()
                out = self.held.pop()
            fill, held = 0, []
        held.append((piece, fill))
        fill += length
        if fill == self.size and out is None:
            return held
        at = bisect.bisect_left(self.fill, fill)
        self.fill.insert(at, fill)
        self.held.insert(at, held)
        return out


def _pack(path: str, end_id: int, size: int, limit: int):
    def run(batches):
        subwords, windows = encoder(path, CACHE_UNITS), OpenWindows(size, limit)
        first = TaskContext.get().partitionId() << 33
        sequences = iter(range(first, first + (1 << 33)))
        rows: list[tuple] = []

        def close(held, is_open=False):
            k = next(sequences)
            rows.extend((*piece, k, at, is_open) for piece, at in held)

        def flush():
            cols = list(zip(*rows)) or [()] * 8
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(cols[7], pa.bool_())], [*_NAMES, "open"])

        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                ids, offsets = subwords.encode(part.column("text"))
                for doc, a, b in zip(part.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                    own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    n = len(own)
                    for start in range(0, n, size):
                        piece = own[start : start + size]
                        row = (doc, start, len(piece), zlib.crc32(piece), n)
                        if len(piece) == size:
                            close([(row, 0)])
                        elif (out := windows.add(len(piece), row)) is not None:
                            close(out)
            yield flush()
        for held in windows.held:
            close(held, True)
        yield flush()

    return run


def _merge(size: int):
    def run(pdf):
        """Join open windows, fullest first into the fullest that has room; ids come from one of those joined."""
        fills = pdf.groupby("sequence_id")["length"].sum().sort_values(ascending=False, kind="stable")
        bins: list[tuple[int, int]] = []  # (fill, sequence), ascending
        moved = {}
        for sequence, fill in fills.items():
            at = bisect.bisect_right(bins, (size - fill, 1 << 62)) - 1
            base, into = bins.pop(at) if at >= 0 else (0, sequence)
            moved[sequence] = (into, base)
            bisect.insort(bins, (base + int(fill), into))
        pdf["offset"] += pdf["sequence_id"].map(lambda s: moved[s][1])
        pdf["sequence_id"] = pdf["sequence_id"].map(lambda s: moved[s][0])
        return pdf[_NAMES]

    return run


def pack(docs: DataFrame, vocabulary_path: str, end_id=1, size=2048, open_windows=64, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    placed = materialize(rows.mapInArrow(tidy(_pack(vocabulary_path, end_id, size, open_windows)), PIECES + ", open boolean"), "pieces")
    group = F.expr(f"shiftright(sequence_id, 33) div {MERGE_GROUP}")
    merged = placed.where("open").drop("open").groupBy(group.alias("part")).applyInPandas(_merge(size), PIECES)
    return placed.where("not open").drop("open").unionByName(merged)


def packing_query(spark, sf_dir) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
