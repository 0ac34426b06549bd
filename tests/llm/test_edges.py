"""Each registered query, and the pipeline, over messy and over empty tables."""

import zlib

import pytest

from quillon.llm import decontaminate, registry

QUERIES = registry.queries()
N_DOCS = 14


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables_give_empty_results(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("op2_packing", "op8_neighbours")])
def test_a_row_for_each_document(spark, messy, name):
    assert QUERIES[name](spark, messy).count() == N_DOCS


def test_sharding(spark, messy):
    rows = QUERIES["op1_sharding"](spark, messy).collect()
    sizes = [sum(r.shard == s for r in rows) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id == 2} == {(1, 0)}
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id == 7} == {(len("é ß 漢字 👍🏽".encode()) + 1, zlib.crc32("é ß 漢字 👍🏽".encode()))}


def test_packing(spark, messy):
    rows = QUERIES["op2_packing"](spark, messy).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for pieces in by.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == [sum(q.length for q in pieces[:i]) for i in range(len(pieces))]
        assert sum(p.length for p in pieces) <= 2048
    assert {(r.start, r.length) for r in rows if r.doc_id in (2, 3, 4)} == {(0, 1)}


def test_language_model(spark, messy):
    rows = {r.doc_id: r for r in QUERIES["op3_lm_scoring"](spark, messy).collect()}
    assert rows[2].n_tokens == rows[3].n_tokens == rows[4].n_tokens == 1
    assert rows[2].score == rows[3].score < 0


def test_secrets(spark, messy):
    rows = {r.doc_id: r for r in QUERIES["op4_secrets"](spark, messy).collect()}
    assert (rows[8].n_assign, rows[8].n_access, rows[8].n_hex) == (1, 1, 0)
    assert rows[2].spans == rows[3].spans == ""


def test_decontamination(spark, messy):
    rows = {r.doc_id: r for r in QUERIES["op5_decontamination"](spark, messy).collect()}
    assert (rows[1].n_hit, rows[1].contaminated) == (12, True)
    found = decontaminate.matches(spark.read.parquet(f"{messy}/documents.parquet"), spark.read.parquet(f"{messy}/benchmark.parquet")).where("doc_id = 1").first()
    assert (found.longest, found.longest_item, found.longest_at, found.longest_item_at, found["items"]) == (12, "1", 1, 0, ["1", "4"][:1])
    assert (rows[9].n_hit, rows[9].n_items) == (1, 1)
    assert rows[2].n_words == rows[3].n_words == 0


def test_pseudonyms(spark, messy):
    rows = {r.doc_id: r for r in QUERIES["op6_pseudonyms"](spark, messy).collect()}
    assert rows[8].n_card == 1 and "4111111111111111" not in rows[8].text
    assert rows[2].text is None and rows[3].text == ""


def test_language(spark, messy):
    rows = {r.doc_id: r for r in QUERIES["op7_langid"](spark, messy).collect()}
    assert [rows[i].lang_pred for i in (2, 3, 4, 5)] == ["und"] * 4
    assert rows[9].lang_pred in ("en", "fr")


def test_neighbours(spark, messy):
    """Rows are queries and candidates one by one; a shorter vector counts as ending in zeros."""
    rows = QUERIES["op8_neighbours"](spark, messy).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in rows if r.query_id == 0) == [(1, 5, 1.0), (2, 20, 1.0), (3, 20, 1.0), (4, 1, 0.5), (5, 6, -1.0)]
    assert sorted((r["rank"], r.vec_id, r.score) for r in rows if r.query_id == 20) == sorted([(1, 0, 1.0), (2, 5, 1.0), (3, 20, 1.0), (4, 1, 0.5), (5, 6, -1.0)] * 2)
    assert {r.query_id for r in rows} == {0, 20}


def test_simhash(spark, messy):
    rows = QUERIES["op9_simhash"](spark, messy).collect()
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {2}
    assert {r.component_id for r in rows if r.doc_id in (9, 10)} == {9}


def test_toxicity(spark, messy):
    rows = QUERIES["op10_toxicity"](spark, messy).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
