"""The registered queries: their SQL where there is one, their columns, and the plans of those that are DataFrame operations only."""

import os

import duckdb
import pytest

import __spark_entry__
from skylattice.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "op1_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op2_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op3_licenses": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op4_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op5_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op6_urls": ["page_id", "host", "path", "rule", "verdict"],
    "op7_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op8_jaccard": ["doc_id", "n_shingles", "component_id"],
    "op9_neighbours": ["query_id", "rank", "vec_id", "score"],
    "op10_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op11_pieces": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op12_prefixes": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    "op13_runs": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    connection = duckdb.connect()
    for file in os.listdir(SF_DIR):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'")
    found = QUERIES[name](spark, SF_DIR)
    cursor = connection.execute(ORACLES[name])
    columns = [entry[0] for entry in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(tuple, found.select(*columns).collect()), key=repr) == sorted(cursor.fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_plan(spark, name):
    found = QUERIES[name](spark, SF_DIR)
    assert found.columns[: len(COLUMNS[name])] == COLUMNS[name]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name in ("op2_mixing", "op7_fingerprints"):
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_registered():
    assert set(COLUMNS) == set(QUERIES) and set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())
