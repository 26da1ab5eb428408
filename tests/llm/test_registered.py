"""Every registered text query over tables with more, clashing columns, and over empty tables."""

import pytest
from pyspark.sql import functions as F

from cladeworks.llm import queries

from .conftest import SCHEMA, rows_of, tricky_texts

#: The columns of each result that its contract names.
COLUMNS = {
    "op1_warc_derivatives": "page_id warc_type warc_record_id refers_to block_digest content_length block",
    "op2_license_index": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op3_hilbert_shards": "doc_id size text_crc32 law shard slot grown_shard",
    "op4_adaptive_thresholds": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op5_fm_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op6_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op7_crf_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op8_attention_quality": "doc_id held_out score predicted",
    "op9_ngram_jaccard": "doc_id n_shingles component_id",
    "op10_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op11_filter_audit": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
    "op12_language_mixture": "doc_id held_out lang_pred score",
    "op13_merkle_manifest": "doc_id leaf subroot root proof_sha256 folded_root verified",
}
CLASH = ("n", "node", "hits", "spans", "label", "quality", "doc_id_", "text_hash", "score", "warc_type", "block")


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = {}
    for kind in ("clashing", "empty"):
        d = tmp_path_factory.mktemp(kind)
        rows = rows_of(tricky_texts())
        found = {
            "documents": spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in CLASH if c not in SCHEMA.replace(",", " ").split()}),
            "labels": spark.createDataFrame([(i, i % 2, 0, "x", "y") for i in range(40)], "doc_id bigint, quality int, toxic int, text string, label string"),
            "benchmark": spark.createDataFrame([(1, "one two three", "x"), (None, None, "x"), (2, "", None)], "item_id bigint, text string, doc_id string"),
            "pages": spark.createDataFrame([(1, "u", "<p>a</p>", "x", "y"), (None, None, None, None, None)], "page_id bigint, url string, html string, block string, warc_type string"),
        }
        for name, df in found.items():
            (df if kind == "clashing" else df.limit(0)).coalesce(2).write.parquet(str(d / f"{name}.parquet"))
        out[kind] = str(d)
    return out


def test_all_are_listed():
    assert COLUMNS.keys() == queries.queries().keys()


@pytest.mark.parametrize("name", list(COLUMNS))
def test_clashing_columns_and_empty_tables(spark, folders, name):
    n = len(tricky_texts())
    df = queries.queries()[name](spark, folders["clashing"])
    rows = df.collect()
    assert set(COLUMNS[name].split()) <= set(df.columns)
    if name == "op1_warc_derivatives":
        assert len(rows) == 4
    elif name == "op11_filter_audit":
        assert len(rows) % 600 == 0 and len(rows) >= 600
    elif name == "op10_best_fit_packing":
        assert sum(r["piece"] == 0 for r in rows) == n
    else:
        assert len(rows) == n
    empty = queries.queries()[name](spark, folders["empty"])
    assert empty.columns == [c for c in df.columns if c in empty.columns] and empty.collect() == []
