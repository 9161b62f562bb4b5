"""Exact top-k search by inner product: columnar branch and bound.

Vectors lie in blocks of vertical layout (a row for each dimension, in the
narrowest integer type that holds the block's numbers).  A group of queries
meets a block of candidates: products are added up a few dimensions at a time,
and after each step a pair survives only if its partial sum plus the product
of the two remaining norms (what the other dimensions can add at most) reaches
the query's k-th best score so far.  Candidates and queries without a
surviving pair leave the block, and once few pairs are left these alone are
carried on, one by one; the last step leaves exact scores.

Thresholds are known before the search: the k-th best score among some
candidates is one that no answer can fall below.  A first pass takes one block
of each SEED, and within a task what was compared raises the thresholds for
what follows.  In the second pass every block of queries meets every block of
candidates once: pairs of blocks are joined by (query group, slot),
so a task holds bounded numbers of both, and gives at most k rows a query.

Defined cases: a vector that is null or holds a null or a non-finite component
takes no part, nor does a row with a null id; shorter vectors count as padded
by zeros, so an empty one scores 0; rows that repeat an id are candidates each,
but not for queries of that id; ties go to the smaller id; an empty table gives
no row.  Sums past 64 bits wrap.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, table

BLOCK_ROWS, QUERY_ROWS, STEP = 8192, 2048, 8
#: Candidate blocks and query blocks that a task holds at once.
SLOT_BLOCKS, GROUP_BLOCKS = 8, 16
#: One block of so many is searched first, for thresholds.
SEED = 32
#: Queries and candidates that are compared at once, and the share of pairs from which on they are carried one by one.
TOGETHER, FEW = (128, 1024), 0.25
_BLOCK = "block long, n int, dims int, width int, ids binary, data binary"


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * component) as long, null where the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _narrow(data: np.ndarray) -> np.ndarray:
    for kind in (np.int8, np.int16, np.int32):
        limits = np.iinfo(kind)
        if data.min(initial=0) >= limits.min and data.max(initial=0) <= limits.max:
            return data.astype(kind)
    return data


def _blocks(rows: int):
    """Rows (id, vector) to blocks: ids, and numbers with a row for each dimension."""

    def run(batches):
        ids, flat, lengths, have = [], [], [], 0
        # A block's number is its task and its place there: the blocks are written once and then read.
        numbers = iter(range(TaskContext.get().partitionId() << 32, 1 << 62))

        def pack():
            own, values, n = np.concatenate(ids), np.concatenate(flat), np.concatenate(lengths)
            dims = int(n.max(initial=0))
            data = np.zeros((len(own), dims), np.int64)
            data[np.repeat(np.arange(len(own)), n), np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)] = values
            data = _narrow(np.ascontiguousarray(data.T))
            columns = {"block": ([next(numbers)], pa.int64()), "n": ([len(own)], pa.int32()), "dims": ([dims], pa.int32()), "width": ([data.itemsize], pa.int32()), "ids": ([own.tobytes()], pa.binary()), "data": ([data.tobytes()], pa.binary())}
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                vectors = part.column("vector")
                ids.append(part.column("id").to_numpy())
                flat.append(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
                lengths.append(np.diff(np.asarray(vectors.offsets)).astype(np.int64))
                have += part.num_rows
                if have >= rows:
                    yield pack()
                    ids, flat, lengths, have = [], [], [], 0
        if have:
            yield pack()

    return run


def _load(row, dims: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(row.data, f"i{row.width}").reshape(row.dims, row.n)
    if row.dims < dims:
        data = np.vstack([data, np.zeros((dims - row.dims, row.n), data.dtype)])
    return np.frombuffer(row.ids, np.int64), data


def _kind(bound: float):
    """The fastest type in which sums up to ``bound`` are exact."""
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64


def _top(m: np.ndarray) -> float:
    return max(float(m.max(initial=0)), -float(m.min(initial=0)))


class BestRows:
    """The k best (score, id) of each query so far; thresholds may be known before."""

    def __init__(self, n: int, k: int, threshold: np.ndarray | None = None):
        self.k, self.q = k, np.zeros(0, np.int64)
        self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.threshold = np.full(n, -np.inf) if threshold is None else threshold.astype(np.float64)

    def add(self, q, score, ids) -> None:
        q, score, ids = np.concatenate([self.q, q]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        first = np.searchsorted(q, np.arange(len(self.threshold)))
        place = np.arange(len(q)) - first[q]
        keep = place < self.k
        self.q, self.score, self.id = q[keep], score[keep], ids[keep]
        full = place == self.k - 1
        self.threshold[q[full]] = np.maximum(self.threshold[q[full]], score[full].astype(np.float64))


class Vertical:
    """A block as numbers of one type, with the norms of what follows each dimension, rounded up."""

    def __init__(self, data: np.ndarray, kind, order: np.ndarray):
        self.data = data[order].astype(kind)
        tail = np.cumsum((self.data.astype(np.float64) ** 2)[::-1], 0)[::-1]
        self.rest = np.sqrt(np.vstack([tail, np.zeros((1, data.shape[1]))])) * (1 + 1e-6)


def search_block(q_ids, queries, c_ids, cands, best: BestRows, q_at: int, step: int = STEP, trace: list | None = None) -> None:
    """Branch and bound for one block of queries and one of candidates, both vertical (dims, n); ``q_at`` is the first query's place.

    ``trace`` takes the number of pairs that each step carried on.
    """
    dims = len(queries)
    kind = _kind(dims * _top(queries) * _top(cands))
    # Dimensions that carry most come first, so bounds close early.
    order = np.argsort(-(cands.astype(np.float64) ** 2).sum(1), kind="stable")
    every = Vertical(queries, kind, order)
    for first in range(0, len(c_ids), TOGETHER[1]):
        some = slice(first, first + TOGETHER[1])
        c = Vertical(cands[:, some], kind, order)
        for at in range(0, len(q_ids), TOGETHER[0]):
            _search_group(np.arange(at, min(at + TOGETHER[0], len(q_ids))), q_ids, every, c_ids[some], c, best, q_at, step, trace)


def _search_group(rows, q_ids, queries: Vertical, c_ids, cands: Vertical, best: BestRows, q_at: int, step: int, trace) -> None:
    dims = len(cands.data)
    cut = best.threshold[q_at + rows]
    columns = np.arange(len(c_ids))
    q, c, partial, done = queries.data[:, rows], cands.data, None, 0
    wide = np.result_type(c.dtype, np.float32)
    alive = q_ids[rows][:, None] != c_ids[None, :]
    while done < dims or partial is None:
        to = min(done + step, dims)
        gain = q[done:to].T @ c[done:to]
        partial = gain if partial is None else partial + gain
        if trace is not None:
            trace.append((to, int(partial.size)))
        done = to
        if done == dims and np.isfinite(cut).all():
            alive &= partial >= cut[:, None]
            break
        if done == dims:  # no threshold yet: keep what can be among the k best
            if partial.shape[1] > best.k:
                scores = np.where(alive, partial.astype(np.float64), -np.inf)
                alive &= scores >= np.partition(scores, -best.k, axis=1)[:, -best.k][:, None]
            alive &= partial >= cut[:, None]
            break
        bound = queries.rest[done][rows].astype(wide)[:, None] * cands.rest[done][columns].astype(wide)[None, :]
        bound += partial
        alive &= bound + 1 >= cut[:, None].astype(wide)
        # Compact: candidates that no query needs, then queries that need none.
        stay = alive.any(0)
        if not stay.all():
            columns, c, partial, alive = columns[stay], c[:, stay], partial[:, stay], alive[:, stay]
        stay = alive.any(1)
        if not stay.all():
            rows, cut, q, partial, alive = rows[stay], cut[stay], q[:, stay], partial[stay], alive[stay]
        if not len(rows):
            return
        if np.count_nonzero(alive) <= FEW * alive.size:
            break
    i, j = np.nonzero(alive)
    score = partial[i, j]
    while done < dims and len(i):  # pair by pair
        to = min(done + step, dims)
        score = score + np.einsum("dn,dn->n", q[done:to][:, i], c[done:to][:, j])
        if trace is not None:
            trace.append((to, len(i)))
        done = to
        stay = score + queries.rest[done][rows[i]] * cands.rest[done][columns[j]] + 1 >= cut[i]
        i, j, score = i[stay], j[stay], score[stay]
    stay = score >= cut[i]
    best.add(rows[i[stay]] + q_at, np.asarray(score[stay]).astype(np.int64), c_ids[columns[j[stay]]])


def _searched(left: pd.DataFrame, right: pd.DataFrame, k: int):
    """(query block, its ids, the best rows) for each query block, against all candidate blocks."""
    right = right.sort_values("block")
    for q in left.sort_values("block").itertuples():
        dims = max(int(q.dims), int(right["dims"].max()) if len(right) else 0)
        q_ids, queries = _load(q, dims)
        best = BestRows(len(q_ids), k, np.frombuffer(q.cut, np.float64) if q.cut is not None else None)
        for c in right.itertuples():
            c_ids, cands = _load(c, dims)
            search_block(q_ids, queries, c_ids, cands, best, 0)
        yield q, q_ids, best


def _search(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": ids[best.q], "vec_id": best.id, "score": best.score}) for _, ids, best in _searched(left, right, k)]
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    return run


def _seed(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [(q.block, best.threshold.tobytes()) for q, _, best in _searched(left, right, k)]
        return pd.DataFrame(found, columns=["block", "cut"])

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Both sides (id long, vector array<long>); returns query_id, rank, vec_id, score."""
    spark = candidates.sparkSession
    blocks = materialize(candidates.mapInArrow(_blocks(BLOCK_ROWS), _BLOCK), "blocks")
    asked = materialize(queries.mapInArrow(_blocks(QUERY_ROWS), _BLOCK), "asked")
    n = blocks.count()
    slots = max(-(-n // SLOT_BLOCKS), min(n, spark.sparkContext.defaultParallelism), 1)
    groups = max(1, -(-asked.count() // GROUP_BLOCKS))
    asked = asked.withColumn("q_key", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    # Each side is repeated for the groups of the other: whole blocks move, rows of pairs never do.
    dealt = blocks.withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int")).withColumn("q_key", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    if n > SEED:  # with fewer blocks, what each task finds by itself is enough
        first = dealt.where(F.pmod(F.xxhash64("block", F.lit(1)), F.lit(SEED)) == 0).groupBy("q_key")
        seeds = asked.withColumn("cut", F.lit(None).cast("binary")).groupBy("q_key").cogroup(first).applyInPandas(_seed(k), "block long, cut binary")
        asked = materialize(asked.join(seeds, "block", "left"), "seeded")
    else:
        asked = asked.withColumn("cut", F.lit(None).cast("binary"))
    left = asked.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    found = left.groupBy("q_key", "slot").cogroup(dealt.groupBy("q_key", "slot")).applyInPandas(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def topk_query(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), quantised(F.col("embedding")).alias("vector")).where("id is not null and vector is not null")
    return top_k(rows, rows.where("id % 20 = 0"))


ORACLE = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 20
"""
