"""The registered queries answer with their promised columns."""

import duckdb
import pytest

from logsieve.llm.oracle import SQL
from logsieve.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": {"page_id", "url", "text", "n_chars"},
    "op2": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op3": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op4": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op5": {"doc_id", "class_id"},
    "op6": {"doc_id", "item_id"},
    "op7": {"doc_id", "size", "source_size", "target", "taken"},
    "op8": {"doc_id", "held_out", "score", "predicted"},
    "op9": {"doc_id", "held_out", "lang_pred", "score"},
    "op10": {"page_id", "host", "path", "rule", "verdict"},
    "op11": {"doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"},
    "op12": {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"},
    "op13": {"doc_id", "n_words", "n_removed", "kept_sha256"},
}


def test_columns():
    assert {q.split("_")[0] for q in QUERIES} == set(COLUMNS)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    found = QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(cols) and COLUMNS[name.split("_")[0]] <= set(cols)
    assert sorted(map(str, (tuple(r) for r in found.select(cols).collect()))) == sorted(map(str, cur.fetchall()))
