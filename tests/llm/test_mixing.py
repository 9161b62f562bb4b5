import re
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import mixing


def fill(sizes, weights, epochs=3):
    """Targets by repeated sharing."""
    total, capped = sum(sizes), set()
    while True:
        left = total - sum(epochs * sizes[i] for i in capped)
        free = [i for i in range(len(sizes)) if i not in capped]
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if share[i] > epochs * sizes[i]]
        if not over:
            return [share.get(i, epochs * sizes[i]) for i in range(len(sizes))]
        capped.update(over)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=7))
def test_targets(spark, sizes):
    rows = [(f"s{i}", n) for i, n in enumerate(sizes)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    want = fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(want)


def test_whole_documents_near_targets(documents, spark):
    rows = [(k, "w " * (1 + k * 7919 % 40), f"s{k % 5}" if k % 3 else "hot") for k in range(3000)]
    out = mixing.mix(documents(rows)).collect()
    by = defaultdict(lambda: [0, 0, 0])
    for r in out:
        assert r.size == len(re.findall(r"\S+", rows[r.doc_id][1])) and 0 <= r.times <= 3
        by[r.source][0] += r.size * r.times
        by[r.source][1] = r.target
        by[r.source][2] = max(by[r.source][2], r.size)
    assert len(out) == len(rows) and sum(t for _, t, _ in by.values()) == pytest.approx(sum(r.size for r in out))
    assert all(abs(taken - target) <= largest for taken, target, largest in by.values())
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.mix(documents(rows)).collect()))


def test_odd_rows_and_sql(documents, odd_rows, spark, tmp_path):
    docs = documents(odd_rows)
    out = mixing.mix(docs).collect()
    assert len(out) == len(odd_rows)
    assert all(r.size == 0 for r in out if r.doc_id in (3, 4, 5))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"select doc_id, size, source_size, target, taken from ({mixing.ORACLE})").fetchall()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = sorted(((r.doc_id, r.size, r.source_size, r.target, r.size * r.times) for r in out), key=key)
    assert sorted(set(want), key=key) == sorted(set(got), key=key)


def test_no_document_beyond_its_cap(documents, spark):
    """A source at its cap takes no document, not even an empty one, a fourth time."""
    rows = [(k, "" if k % 3 == 0 else "w", "small") for k in range(40)] + [(100 + k, "w " * 50, "z") for k in range(40)]
    out = mixing.mix(documents(rows)).collect()
    assert max(r.times for r in out) == 3 and {r.times for r in out if r.source == "small"} == {3}


def test_rows_are_decided_each(documents):
    rows = [(1, "a b", "s"), (1, "c d e", "t"), (1, "a b", "s"), (None, "x", None), (2, "w " * 90, "s"), (3, "w " * 40, "t"), (3, None, "u")]
    docs = documents(rows)
    out = mixing.mixed_rows(docs)
    times = {(r.doc_id, r.source, r.size): r.times for r in mixing.mix(docs).collect()}
    want = Counter((d, t, s) for d, t, s in rows for _ in range(times[d, s, len((t or "").split())]))
    assert out.columns == docs.columns and Counter((r.doc_id, r.text, r.source) for r in out.collect()) == want


def test_empty(documents):
    assert mixing.mix(documents([])).count() == 0
