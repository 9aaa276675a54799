"""The registered queries: their SQL where there is any, and their columns."""

from __future__ import annotations

import pytest

from cubeloom.llm import queries

from .conftest import DATA

COLUMNS = {
    "op1_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op2_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_merkle_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op4_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op5_quality_trees": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op6_poisson_mixture": ["doc_id", "mix_copy"],
    "op7_histogram_sort": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op8_secret_links": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op9_partenum_join": ["doc_id", "n_shingles", "component_id"],
    "op10_ordinal_toxicity": ["doc_id", "toxic", "grade", "expected_severity"],
}


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    df = queries.QUERIES[name](spark, str(DATA))
    assert set(COLUMNS[name]) <= set(df.columns)
    rows = df.collect()
    assert rows
    if name in queries.ORACLES:
        import duckdb

        c = duckdb.connect()
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
        found = c.execute(queries.ORACLES[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(tuple(str(r[x]) for x in columns) for r in rows) == sorted(tuple(map(str, r)) for r in found.fetchall())


def test_all_are_registered():
    assert set(COLUMNS) == set(queries.QUERIES) and set(queries.ORACLES) <= set(COLUMNS)
