import hashlib
import re
from collections import defaultdict

import pytest

from gridloom.llm import exact_dedup as e
from gridloom.llm.shared import fresh_path


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def plain(rows):
    """(doc_id, keep_id, group_size, digest) of each row; how many rows of each text stay is one."""
    groups = defaultdict(list)
    for doc, text, _ in rows:
        groups[norm(text)].append(doc)
    keep = {t: min((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    return sorted(((doc, keep[norm(text)], len(groups[norm(text)]), hashlib.sha256(norm(text).encode()).hexdigest()) for doc, text, _ in rows), key=str), keep


def check(rows, out):
    want, keep = plain(rows)
    out = [r.asDict() for r in out]
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["digest"].hex()) for r in out), key=str) == want
    kept = [r for r in out if r["kept"]]
    assert sorted(r["digest"].hex() for r in kept) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in keep)
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_against_plain(documents, odd_rows):
    rows = odd_rows + [(100 + k, "same text", "s") for k in range(50)] + [(None, "same text", "s"), (None, "only null", "s"), (None, "only null", "s")]
    check(rows, e.exact_duplicates(documents(rows).repartition(5)).collect())


def test_repeated_ids(documents):
    rows = [(1, "same text", "s"), (1, "same text", "s"), (1, "aaa", "s"), (1, "dup", "s"), (0, "dup", "s"), (2**62, "aaa", "s"), (-5, "dup", "t")]
    check(rows, e.exact_duplicates(documents(rows)).collect())
    docs = documents(rows)
    left = e.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(-5, "dup"), (1, "aaa"), (1, "same text")]


def test_empty(documents):
    assert e.exact_duplicates(documents([])).count() == 0
    assert e.drop_exact_duplicates(documents([])).count() == 0


def kept(df):
    return {(r.doc_id, r.keep_id, r.kept) for r in df.collect()}


def test_index_outlives_a_batch_and_a_session(spark, documents):
    folder = fresh_path(spark, "index")
    index = e.DigestIndex(spark, folder, 4)
    assert kept(index.deduplicate(documents([(5, "x", "s"), (6, "y", "s"), (4, "x", "s")]), "a")) == {(5, 4, False), (6, 6, True), (4, 4, True)}
    index.close()
    other = e.DigestIndex(spark.newSession(), folder, 4)  # only the folder is left
    assert kept(other.deduplicate(documents([(1, "x", "s"), (2, "z", "s"), (3, "z ", "s"), (7, "z\t", "s")]), "b'1")) == {(1, 4, False), (2, 2, True), (3, 3, True), (7, 3, False)}
    assert other.read().count() == 4 and {r.batch for r in other.read().collect()} == {"a", "b'1"}
    plan = other.read().join(other.read().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    other.close()


def test_a_batch_may_run_again(spark, documents):
    index = e.DigestIndex(spark, fresh_path(spark, "index"), 4)
    index.deduplicate(documents([(1, "old", "s")]), "first")
    batch = documents([(5, "x", "s"), (6, "old", "s"), (4, "x", "s"), (7, None, "s")])
    want = {(5, 4, False), (6, 1, False), (4, 4, True), (7, 7, True)}
    assert kept(index.deduplicate(batch, "second")) == want
    assert kept(index.deduplicate(batch, "second")) == want and index.read().count() == 3
    index.deduplicate(documents([(8, "x", "s"), (9, "new", "s")]), "third")
    assert kept(index.deduplicate(batch, "second")) == want and index.read().count() == 4
    index.close()


def test_a_failed_batch_leaves_the_index(spark, documents):
    from pyspark.sql import functions as F

    index = e.DigestIndex(spark, fresh_path(spark, "index"), 4)
    index.deduplicate(documents([(1, "x", "s")]), "first")
    broken = documents([(2, "y", "s"), (3, "z", "s")]).withColumn("text", F.when(F.col("doc_id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        index.deduplicate(broken, "second").collect()
    assert index.read().count() == 1
    assert kept(index.deduplicate(documents([(2, "y", "s"), (3, "z", "s")]), "second")) == {(2, 2, True), (3, 3, True)}
    index.close()
