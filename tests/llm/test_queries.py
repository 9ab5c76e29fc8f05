import pytest

from rainframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
#: Columns that each query must return.
WANT = {
    "op1_warc_archive": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op2_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op3_mixture_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op4_simhash_dedup": "doc_id bigint, fingerprint string, component_id bigint",
    "op5_token_recount": "doc_id bigint, n_tokens_before bigint, n_tokens_after bigint",
    "op6_kd_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op7_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op8_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op9_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op10_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op11_page_differencing": "page_id bigint, url string, text string, n_chars bigint",
    "op12_filter_interaction": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint",
    "op13_pivot_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
}


def test_all_are_registered():
    assert set(QUERIES) == set(WANT)


@pytest.mark.parametrize("name", WANT)
def test_contract_columns_and_all_rows(spark, name):
    df = QUERIES[name](spark, SF)
    have = dict(df.dtypes)
    for column in WANT[name].split(", "):
        key, kind = column.split()
        assert have[key] == kind
    if name.startswith(("op12", "op13")):  # one row per part, order and step; rows for anchors only
        assert df.count() > 0
        return
    source = "pages" if "page_id" in have else "documents"
    key = "page_id" if source == "pages" else "doc_id"
    rows = spark.read.parquet(f"{SF}/{source}.parquet")
    assert df.select(key).distinct().count() == rows.select(key).distinct().count()
    if name != "op3_mixture_packing":
        assert df.count() == rows.count()
