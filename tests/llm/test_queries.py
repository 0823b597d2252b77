"""The opN queries on the test tables: the contract's columns, one row per row, and the oracles."""

import os

import pytest

from gridloom.llm.oracles import ORACLES
from gridloom.llm.queries import QUERIES
from verify import compare, oracle_rows

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")

COLUMNS = {
    "op1_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op2_quality": "doc_id kept",
    "op3_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op4_simhash": "doc_id fingerprint component_id",
    "op5_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op6_topk": "query_id rank vec_id score",
    "op7_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op8_html": "page_id url text n_chars",
    "op9_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op10_mixing": "doc_id size source_size target taken",
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    got = [tuple(r) for r in df.collect()]
    if name in ORACLES:
        assert compare((df.columns, got), oracle_rows(ORACLES[name], SF_DIR)) == ""
    elif name != "op7_packing":
        table = "pages" if name == "op8_html" else "documents"
        assert len(got) == oracle_rows(f"SELECT count(*) FROM {table}", SF_DIR)[1][0][0]


def test_scores_do_not_depend_on_partitions(spark):
    from gridloom.llm import quality

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    a, b = ({r.id: r.score for r in quality.classify(d, quality.fit(d)).collect()} for d in (docs, docs.repartition(5)))
    assert a == b
