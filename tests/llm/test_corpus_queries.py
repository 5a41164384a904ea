import duckdb
import pytest

from redactum.llm import queries as q

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_line_dedup": {"doc_id", "n_lines", "n_removed", "n_near", "text_sha256"}, "op2_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op3_decontamination": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"}, "op4_secrets": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op5_quality": {"doc_id", "held_out", "score", "predicted"}, "op6_language_id": {"doc_id", "held_out", "lang_pred", "score", "rejected"}, "op7_embedding_dedup": {"vec_id", "n_links", "component_id", "kept"},
    "op8_minhash": {"doc_id", "n_shingles", "component_id", "kept"}, "op9_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"}, "op10_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op11_resampling": {"doc_id", "n_features", "weight", "score", "rank"}, "op13_toxicity": {"doc_id", "held_out", "score", "predicted", "n_sentences", "n_offending", "worst_start", "worst_end"},
    "op12_filter_audit": {"part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"},
}


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    df = q.queries()[name](spark, SF)
    assert set(df.columns) == COLUMNS[name]
    got = df.collect()
    table = {"op7_embedding_dedup": "embeddings", "op10_warc": "pages"}.get(name, "documents")
    rows = spark.read.parquet(f"{SF}/{table}.parquet")
    assert len(got) == (600 * rows.select("source").distinct().count() if name == "op12_filter_audit" else rows.count())
    if name in q.oracle_sql():
        con = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "labels"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        out = con.execute(q.oracle_sql()[name])
        names = [d[0] for d in out.description]
        assert sorted(tuple(str(r[n]) for n in sorted(names)) for r in got) == sorted(tuple(str(r[names.index(n)]) for n in sorted(names)) for r in out.fetchall())
