import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import topk


def plain(rows, k=20):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % 20 == 0}):
        for mine in [v for i, v in ok if i == q]:
            scored = sorted(((-sum(a * b for a, b in zip(mine, v)), i) for i, v in ok if i != q))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def run(spark, rows, k=20):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("block", F.lit(2))
    v = df.select(F.col("vec_id").alias("id"), topk.quantised(F.col("embedding")).alias("vector")).where("id is not null and vector is not null")
    return sorted(map(tuple, topk.top_k(v.repartition(3), v.where("id % 20 = 0"), k).collect()))


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk, "QUERY_ROWS", 8)
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 0.3, (5, 24))
    rows = [(k, [float(np.float32(x)) for x in centres[k % 5] + rng.normal(0, 0.05, 24)]) for k in range(400)]
    assert run(spark, rows) == plain(rows)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [math.nan, 1.0]), (4, [math.inf, 0.0]), (5, []), (6, [1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, [-1.5, 0.25]), (9, [1.0, 2.0]), (10, [1.0, 2.0])]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == []


@pytest.mark.parametrize("scale", [1.0, 1e4, 1e7])
def test_sums_of_every_width(spark, scale):
    rng = np.random.default_rng(2)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(0, scale, 8)]) for k in range(60)]
    assert run(spark, rows, 5) == plain(rows, 5)


def test_seeds_over_many_blocks(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 16), ("QUERY_ROWS", 4), ("SEED", 3), ("GROUP_BLOCKS", 2), ("SLOT_BLOCKS", 4), ("TOGETHER", (3, 7))):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(5)
    rows = [(k // 2, [float(np.float32(x)) for x in rng.normal(0, 0.2, 12)]) for k in range(600)]
    rows = [(k, v) for k, (_, v) in enumerate(rows)]
    assert run(spark, rows, 4) == plain(rows, 4)


def exact(q, c, k):
    full = q.T.astype(np.int64) @ c
    return [sorted(row.tolist())[::-1][:k] for row in full]


def test_bounds_prune_and_lose_nothing():
    """Vectors around centres: once thresholds are known, pairs fall away step by step and few are left at the end."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 30, (40, 32)) * np.linspace(2, 0.1, 32)
    c = np.clip(centres[rng.integers(0, 40, 6000)] + rng.normal(0, 3, (6000, 32)), -127, 127).astype(np.int8).T
    q = c[:, :50]
    best, trace = topk.BestRows(50, 5), []
    topk.search_block(np.arange(-50, 0), q, np.arange(1000), c[:, :1000], best, 0, 8)
    topk.search_block(np.arange(-50, 0), q, np.arange(1000, 6000), c[:, 1000:], best, 0, 8, trace)
    want = exact(q, c, 5)
    assert all(best.score[best.q == k].tolist() == want[k] for k in range(50))
    carried = [sum(n for to, n in trace if to == step) for step in (8, 16, 24, 32)]
    assert carried[0] == 50 * 5000 and carried == sorted(carried, reverse=True) and carried[-1] < 0.05 * carried[0]


def test_no_step_is_skipped():
    """Where bounds prune little, pairs still go through every step with what the bounds leave."""
    rng = np.random.default_rng(4)
    q, c = rng.integers(-40, 40, (32, 10)), rng.integers(-3, 4, (32, 3000))
    c[:, ::50] *= 12
    best, trace = topk.BestRows(10, 5), []
    for at in (0, 1500):
        topk.search_block(np.arange(-10, 0), q, np.arange(at, at + 1500), c[:, at : at + 1500], best, 0, 8, trace)
    want = exact(q, c, 5)
    assert all(best.score[best.q == k].tolist() == want[k] for k in range(10))
    second = trace[-4:]
    assert [to for to, _ in second] == [8, 16, 24, 32] and second[0][1] == 10 * (1500 - 1024) and second[-1][1] < second[0][1] / 3


def test_narrow_blocks():
    for top, width in ((127, 1), (128, 2), (-128, 1), (40_000, 4), (2**40, 8)):
        assert topk._narrow(np.array([[0, top]])).itemsize == width
