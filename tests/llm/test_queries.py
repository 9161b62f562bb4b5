"""The registered queries give what their contracts name, and what their SQL gives."""

from pathlib import Path

import duckdb
import pytest

from gridloom.llm import queries as q

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op2_jaccard": "doc_id bigint, class_id bigint, n_links bigint, copy_id bigint, n_copies bigint",
    "op3_html": "page_id bigint, url string, text string, n_chars bigint",
    "op4_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op5_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op6_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op7_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op8_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op9_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op10_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
}


def test_all_are_here():
    assert set(q.QUERIES) == set(COLUMNS) and set(q.ORACLES) <= set(COLUMNS)


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the generated tables")
@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    out = q.QUERIES[name](spark, SF)
    assert ", ".join(f"{c} {t}" for c, t in out.dtypes) == COLUMNS[name]
    rows = out.toArrow()
    key = "page_id" if name == "op3_html" else "query_id" if name == "op1_topk" else "doc_id"
    table = {"page_id": "pages", "query_id": "embeddings"}.get(key, "documents")
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name in ("op1_topk", "op7_packing"):
        assert rows.num_rows >= n
    else:
        assert rows.num_rows == n
    if name in q.ORACLES:
        con = duckdb.connect()
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
        want = con.execute(q.ORACLES[name]).to_arrow_table()
        order = sorted(rows.column_names)
        plain = lambda t: sorted(map(str, zip(*[t[c].to_pylist() for c in order])))
        assert plain(rows) == plain(want)
