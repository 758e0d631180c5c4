"""Every registered query: its columns, a row for each row of its table, and figures of the given tables."""

import pytest

from listing_watch.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_wavelet_tokens": ("documents", ["doc_id", "start", "n_tokens", "ids_crc32"]),
    "op2_pii_crf": ("documents", ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]),
    "op3_stable_kd": (None, ["query_id", "rank", "vec_id", "score"]),
    "op4_html_blocks": ("pages", ["page_id", "url", "text", "n_chars"]),
    "op5_weak_quality": ("documents", ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]),
    "op6_license_scan": ("documents", ["doc_id", "license", "dice", "n_matches"]),
    "op7_covering_simhash": ("documents", ["doc_id", "fingerprint", "component_id"]),
    "op8_source_mix": ("documents", ["doc_id", "size", "source_size", "target", "taken"]),
    "op9_bpe_automaton": ("documents", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]),
    "op10_lang_crf": ("documents", ["doc_id", "held_out", "lang_pred", "score"]),
    "op11_line_bloom": ("documents", ["doc_id", "n_lines", "n_dropped", "kept_sha256"]),
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, name):
    source, columns = COLUMNS[name]
    d = queries.QUERIES[name](spark, SF)
    assert d.columns[: len(columns)] == columns
    rows = d.collect()
    if source:
        key = columns[0]
        assert sorted(r[key] for r in rows) == sorted(r[0] for r in spark.read.parquet(f"{SF}/{source}.parquet").select(key).collect())
    else:
        assert [r["rank"] for r in rows if r["query_id"] == 0] and all(1 <= r["rank"] <= 20 for r in rows)


def test_whitened_vectors(spark):
    d = queries.op12_qd_whitening(spark, SF)
    assert d.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = d.collect()
    ids = [r[0] for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()]
    assert sorted((r["vec_id"], r["component"]) for r in rows) == sorted((i, k) for i in ids for k in range(1, 33))
    assert max(r["identity_error"] for r in rows) < 1e-9 and {r["n"] for r in rows} == {len(ids)}


@pytest.mark.parametrize("name", ["op11_line_bloom", "op13_bloom_rank"])
def test_against_sql(spark, name):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_held_out_languages(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in queries.op10_lang_crf(spark, sf).collect() if r["held_out"] and r["lang_pred"] != "und"]
    assert len(rows) > 100 and sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_recall_on_the_given_vectors(spark):
    import numpy as np

    v = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, x = v["vec_id"].to_numpy(), np.array(v["embedding"].tolist())
    found = {}
    for r in queries.op3_stable_kd(spark, SF).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = due = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        want = set(ids[np.lexsort((ids, -s))[:20]].tolist()) - {q}
        hit, due = hit + len(want & found[q]), due + len(want)
    assert hit >= 0.9 * due
