import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import components as cc
from gridloom.llm import jaccard_join as j


def sets_of(rows):
    out = {}
    for doc, text, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        out[doc] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def plain(rows):
    """For each row: (class, links, copy, copies) by comparing all pairs of different texts."""
    sets = [next(iter(sets_of([r]).values())) for r in rows]
    copy, copies = {}, Counter(sets)
    for (d, *_), t in zip(rows, sets):
        copy[t] = min([x for x in (copy.get(t), d) if x is not None], default=None)
    texts = list(copies)
    parent, links = list(range(len(texts))), Counter()

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in range(len(texts)):
        for b in range(a):
            if (n := len(texts[a] & texts[b])) and 9 * n >= 4 * (len(texts[a]) + len(texts[b])):
                links[texts[a]] += 1
                links[texts[b]] += 1
                parent[root(a)] = root(b)
    least = {}
    for k, t in enumerate(texts):
        least[root(k)] = min([x for x in (least.get(root(k)), copy[t]) if x is not None], default=None)
    label = {t: least[root(k)] for k, t in enumerate(texts)}
    return Counter((d, label[t], links[t], copy[t], copies[t]) for (d, *_), t in zip(rows, sets))


def near_copies(seed, groups=6, size=25):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice((30, 120, 400)))]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 3, 6))):
                own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own), "s"))
    return rows


@pytest.mark.parametrize("chunk, grams", [(1024, 4 << 20), (7, 4 << 20), (1024, 900)])
def test_against_all_pairs(documents, odd_rows, monkeypatch, chunk, grams):
    monkeypatch.setattr(j, "CHUNK", chunk)
    monkeypatch.setattr(j, "NODE_CHUNK", chunk)
    monkeypatch.setattr(j, "CHUNK_GRAMS", grams)
    rows = near_copies(1) + [(1000 + (d or 0) if d is not None else None, t, s) for d, t, s in odd_rows]
    assert Counter(map(tuple, j.jaccard_classes(documents(rows)).collect())) == plain(rows)


def test_repeated_and_null_ids(documents):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(1, "quite another text of more than five words", "s"), (1, base, "s"), (3, base + " more", "s"), (None, base + " and more", "t"), (None, "one two three four five six", "t"), (1, base, "s"), (None, "one two three four five  six", "u"), (5, None, "s"), (5, "", "s")]
    docs = documents(rows)
    assert Counter(map(tuple, j.jaccard_classes(docs).collect())) == plain(rows)
    left = j.one_of_each_class(docs)
    assert left.columns == docs.columns
    got = sorted(((r.doc_id, (r.text or "").split()) for r in left.collect()), key=str)
    assert got == sorted([(1, rows[0][1].split()), (1, base.split()), (5, []), (None, "one two three four five six".split())], key=str)


def test_empty(documents):
    assert j.jaccard_classes(documents([])).count() == 0
    assert j.one_of_each_class(documents([])).count() == 0


def test_prefixes_are_shortened_until_the_target():
    last = j.shortest_prefix(20, 6, 0.8, 0.9999)
    assert 1 < last < 6 and j.chance(0.8, 20, last) >= 0.9999 > j.chance(0.8, 20, last + 1)
    high, low = np.zeros(121), np.zeros(121)
    high[119], low[96] = 10**7, 10**7
    assert j.estimated_recall({6: high}, 20, 6, 0.8) >= 0.9999  # pairs that are all but equal: long prefixes find them
    assert j.estimated_recall({6: low}, 20, 6, 0.8) < 0.999
    assert j.estimated_recall({6: low, 5: low, 4: low}, 20, 4, 0.8) >= 0.9999
    assert j.estimated_recall({6: np.zeros(121)}, 20, 6, 0.8) < 0.9999  # nothing seen: go on


def test_depth_follows_the_data(spark):
    """Signatures of pairs that agree nearly everywhere need no short prefix; those of pairs at the threshold do."""
    rng = np.random.default_rng(3)

    def length_for(similarity, pairs):
        rows = []
        for k in range(pairs):
            own = rng.integers(0, 65536, 120).astype(">u2")
            other = np.where(rng.random(120) < similarity, own, rng.integers(0, 65536, 120)).astype(">u2")
            rows += [(2 * k, bytearray(own.tobytes())), (2 * k + 1, bytearray(other.tobytes()))]
        edges, length = j.candidate_edges(spark.createDataFrame(rows, "doc long, signature binary"), 20, 6, 0.8, 0.9999)
        found = {(r.u, r.v) for r in edges.collect()}
        return length, sum((2 * k, 2 * k + 1) in found for k in range(pairs)) / pairs

    assert length_for(0.99, 300)[0] == 6
    length, recall = length_for(0.82, 300)
    assert length == j.shortest_prefix(20, 6, 0.8, 0.9999) and recall >= 0.97


def test_recall_of_the_join(documents):
    """Pairs at the threshold are linked: recall against exact similarities, over the whole join."""
    rng, rows, want = random.Random(5), [], 0
    for k in range(300):
        base = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        other = base[: 204 - rng.choice((18, 20, 21, 22))] + [f"x{rng.randrange(10**6)}" for _ in range(20)]
        rows += [(2 * k, " ".join(base), "s"), (2 * k + 1, " ".join(other), "s")]
    want = plain(rows)
    got = Counter(map(tuple, j.jaccard_classes(documents(rows)).collect()))
    linked, found = sum(n for r, n in want.items() if r[2]), sum(n for r, n in (got & want).items() if r[2])
    assert linked > 200 and found >= 0.99 * linked and not any(r[2] for r in got - want)


def test_verify_with_rare_and_common_grams():
    rng = np.random.default_rng(0)
    common = rng.integers(0, 1 << 60, 60)
    sets = [np.unique(np.r_[rng.choice(common, rng.integers(30, 60), False), rng.integers(0, 200, 5)]).astype(np.uint64) for _ in range(150)]
    links, root = j.verify_cell(np.zeros(150, int), sets, 0.8, False)
    real = np.array([[len(np.intersect1d(a, b)) * 9 >= 4 * (len(a) + len(b)) for b in sets] for a in sets])
    np.fill_diagonal(real, False)
    assert (links == real.sum(1)).all()
    for a in range(150):
        assert all(root[a] == root[b] for b in np.flatnonzero(real[a]))
    side = (np.arange(150) >= 70).astype(int)
    links, _ = j.verify_cell(side, sets, 0.8, True)
    assert (links == np.where(side == 0, real[:, 70:].sum(1), real[:, :70].sum(1))).all()


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(500, 500)]
    got = {r.node: r.label for r in cc.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    groups = defaultdict(set)
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    for x in parent:
        groups[root(x)].add(x)
    assert all(got[x] == min(g) for g in groups.values() if len(g) > 1 for x in g)


def test_filter_before_exchanges_keeps_every_match(spark, monkeypatch):
    rows = spark.range(0, 60_000).selectExpr("id AS doc", "cast(id AS string) AS text")
    keys = spark.range(0, 60_000, 30).selectExpr("explode(array(id, id)) AS doc")
    found = {r.doc for r in j.may_match(rows, keys, "doc").collect()}
    assert found >= set(range(0, 60_000, 30)) and len(found) < 8000
    assert j.may_match(rows, keys.limit(0), "doc").count() == 0
    for most in (64, 1 << 12):  # fewer bits than keys: all rows, or more of them
        monkeypatch.setattr(j, "MOST_BITS", most)
        few = j.may_match(rows, keys, "doc")
        assert few.columns == ["doc", "text"] and few.join(keys.distinct(), "doc").count() == 2000


def test_exchanges_move_what_can_join(documents, spark):
    """Texts that are like no other pass one exchange of 20 keys, whatever the number of levels, and their signatures none."""

    def moved():
        sc = spark.sparkContext
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        found = [stages.apply(k) for k in range(stages.size())]
        return sum(s.shuffleWriteRecords() for s in found), sum(s.shuffleWriteBytes() for s in found)

    rng = random.Random(8)
    rows = [(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(40)), "s") for k in range(3000)]
    rows += [(3000 + k, rows[k][1] + " end", "s") for k in range(5)] + [(3005, rows[9][1], "s")]
    before = moved()
    got = Counter(map(tuple, j.jaccard_classes(documents(rows)).collect()))
    records, size = (b - a for a, b in zip(before, moved()))
    assert got == Counter({(k, k, 0, k, 1): 1 for k in range(3000) if k >= 5 and k != 9} | {(k, k % 3000, 1, k, 1): 1 for k in (*range(5), *range(3000, 3005))} | {(9, 9, 0, 9, 2): 1, (3005, 9, 0, 9, 2): 1})
    assert records < 40 * len(rows) and size < 500 * len(rows)


def test_flags_are_true_for_every_match(spark):
    rows = spark.range(0, 60_000).selectExpr("id AS doc")
    found = j.flagged(rows, spark.range(0, 60_000, 30).selectExpr("id AS doc"), "doc").collect()
    assert len(found) == 60_000 and all(r.may for r in found if r.doc % 30 == 0) and sum(r.may for r in found) < 3500
    assert not any(r.may for r in j.flagged(rows, rows.limit(0), "doc").limit(50).collect())
