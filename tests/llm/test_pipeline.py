"""Every stage against a plain version on one table; the whole run at the smallest scale."""

import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest

import corpus_pipeline as p
from gridloom.llm import mixing

SF = "/root/testdata/sf0.001"


def test_names():
    assert [n for n, _ in p.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing", "packing"]


BASE = " ".join(f"w{k}" for k in range(60))
LONG = " ".join(f"word{k % 5003} x{k}" for k in range(30_000))
ROWS = [(1, "same", "a"), (2, " same", "a"), (3, "same", "a"), (4, BASE, "b"), (5, BASE + " more", "b"), (6, "alone here", None), (7, None, "a"), (8, "", "a"),
        (1, "same", "a"), (1, "aaa", "c"), (0, "aaa", "c"), (1, BASE + " most", "c"), (None, "aaa", "c"), (None, "nobody's", "b"), (None, "nobody's", "b"), (None, BASE + " of", None), (9, LONG, "b"), (10, LONG + " end", "b")]


def rows_of(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


def test_exact_dedup_stage(spark, documents):
    docs = documents(ROWS)
    out = p.drop_copies(spark, docs, SF)
    best = {}
    for d, t, s in ROWS:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        best[key] = min(best.get(key, (True, 0)), (d is None, d or 0))
    assert out.columns == docs.columns
    assert Counter((d is None, d or 0, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t, _ in rows_of(out).elements()) == Counter((*b, t) for t, b in best.items())


def test_jaccard_stage(spark, documents):
    docs = documents(ROWS)
    out = p.drop_near_copies(spark, docs, SF)
    got = rows_of(out)
    assert out.columns == docs.columns and max(got.values()) == 1
    words = Counter(((t or "").split() or [""])[0] for _, t, _ in got)
    assert words == Counter({"same": 1, "w0": 1, "alone": 1, "": 1, "aaa": 1, "nobody's": 1, "word0": 1})
    assert {(d, (t or "").split()[0]) for d, t, _ in got if t} == {(1, "same"), (1, "w0"), (6, "alone"), (0, "aaa"), (None, "nobody's"), (9, "word0")}


def test_mixing_stage(spark, documents):
    docs = documents(ROWS)
    mixed = p.mix_sources(spark, docs, SF)
    times = {(r.doc_id, r.source, r.size): r.times for r in mixing.mix(docs).collect()}
    want = Counter((d, t, s) for d, t, s in ROWS for _ in range(times[d, s, len((t or "").split())]))
    assert rows_of(mixed) == want and mixed.columns == docs.columns


def test_toxicity_and_packing_stages(spark, documents):
    docs = documents(ROWS)
    kept = p.drop_toxic(spark, docs, SF)
    assert kept.columns == docs.columns and not rows_of(kept) - rows_of(docs)
    pieces = p.pack_tokens(spark, docs, SF).collect()
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0) and sum(r.start == 0 for r in pieces) == len(ROWS)


def test_empty_table_through_all_stages(spark, documents):
    docs = documents([])
    for _, stage in p.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the generated tables")
def test_run(spark):
    out = p.run(spark, SF).collect()
    fill = defaultdict(int)
    for r in out:
        fill[r.sequence_id] += r.length
    assert out and max(fill.values()) <= 2048
