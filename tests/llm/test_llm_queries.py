"""The registered queries: SQL where it can say the same, else their columns and rows."""

import pytest

from compare import compare, connect
from llm.queries import ORACLES, QUERIES

COLUMNS = {
    "op1_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op2_line_dedup": ["doc_id", "n_lines", "n_removed", "kept_sha256"],
    "op4_suffix_arrays": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op5_lempel_ziv": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op6_main_text": ["page_id", "url", "text", "n_chars"],
    "op7_simhash": ["doc_id", "fingerprint", "component_id"],
    "op9_edit_decontamination": ["doc_id", "contaminated", "n_items", "item_ids", "distances"],
    "op10_language_id": ["doc_id", "held_out", "lang_pred", "score", "rejected"],
    "op11_dyadic_squares": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words"],
    "op13_order_join": ["doc_id", "n_shingles", "component_id"],
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf, name):
    _, problem = compare(spark, connect(sf), QUERIES[name], ORACLES[name], sf)
    assert not problem, problem


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_rows(spark, sf, name):
    table = "pages" if name == "op6_main_text" else "documents"
    out = QUERIES[name](spark, sf)
    assert out.columns == COLUMNS[name]
    assert out.count() == spark.read.parquet(f"{sf}/{table}.parquet").count()


def test_every_query_is_tested():
    assert set(QUERIES) == set(COLUMNS) | set(ORACLES) and len(QUERIES) == 13
