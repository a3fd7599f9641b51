"""The registered corpus queries: names and columns."""

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_extract_html": ["page_id", "url", "text", "n_chars"],
    "op2_sample_pieces": ["doc_id", "piece_ids", "n_pieces", "lossless"],
    "op3_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op4_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op5_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op6_minhash_forest": ["doc_id", "n_shingles", "component_id", "kept"],
    "op7_mix_sources": ["doc_id", "size", "source_size", "target", "taken"],
    "op8_lm_scores": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op9_token_tables": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op10_imatch": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
}


def test_names():
    assert set(COLUMNS) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(name, spark):
    got = entry.queries()[name](spark, DIR)
    table = "pages" if name.startswith("op1_") else "documents"
    assert got.columns[: len(COLUMNS[name])] == COLUMNS[name] and got.count() == spark.read.parquet(f"{DIR}/{table}.parquet").count()
