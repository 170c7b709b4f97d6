"""Every registered query of the training-data operators: against its SQL, or for its rows and columns."""

import os

import duckdb
import pytest

from textloom.llm import queries
from textloom.llm.sql import ORACLES

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
COLUMNS = {
    "op1_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op2_url_filter": {"page_id", "host", "path", "rule", "verdict"},
    "op3_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op4_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op5_decontamination": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op6_spotsigs": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op7_near_dup": {"doc_id", "class_id", "class_size", "n_links"},
    "op8_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op9_secrets": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op10_line_dedup": {"page_id", "host", "n_lines", "n_dropped", "text_sha256"},
    "line_dedup_by_source": {"doc_id", "n_lines", "n_dropped", "text_sha256"},
    "op11_lexical_search": {"item_id", "rank", "doc_id", "score"},
    "op12_filter_audit": {"part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"},
    "op13_bit_sliced": {"query_id", "rank", "vec_id", "score"},
}


def test_all_are_known():
    assert set(COLUMNS) == set(queries.queries()) and set(ORACLES) <= set(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    if name == "op3_token_counts":
        pytest.importorskip("public_tokenizers")
    df = queries.queries()[name](spark, SF)
    assert COLUMNS[name] <= set(df.columns)
    got = df.collect()
    if name in ("op11_lexical_search", "op12_filter_audit", "op13_bit_sliced"):  # no row a document
        assert got
    key = "page_id" if "page_id" in df.columns else "doc_id"
    source = "pages" if key == "page_id" else "documents"
    assert not {"doc_id", "page_id"} & set(df.columns) or name == "op11_lexical_search" or sorted(r[key] for r in got) == sorted(r[0] for r in spark.read.parquet(f"{SF}/{source}.parquet").select(key).collect())
    if name in ORACLES:
        duck = duckdb.connect()
        for t in TABLES:
            duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        found = duck.execute(ORACLES[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        plain = lambda r, c: repr([round(float(r[k]), 6) if isinstance(r[k], float) else r[k] for k in c])
        order = sorted(columns)
        assert sorted(plain(r, order) for r in got) == sorted(plain(dict(zip(columns, r, strict=True)), order) for r in found.fetchall())
