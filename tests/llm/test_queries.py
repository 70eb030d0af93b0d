"""The registered queries on the smallest tables: their contracts' columns, and every row of their table."""

import hashlib

import pytest
from test_simhash import brute_print, components
from test_winnow import check as check_winnow

from arcweave.llm import queries

SF = "/root/testdata/sf0.001"
CONTRACTS = {
    "op1_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op2_html_extract": "page_id bigint, url string, text string, n_chars bigint",
    "op3_winnow": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op4_line_dedup": "doc_id bigint, text string, n_lines bigint, n_removed bigint",
    "op5_token_count": "doc_id bigint, n_chars bigint, n_tokens bigint",
    "op6_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op7_pii": "doc_id bigint, text string, n_replaced bigint",
    "op8_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op9_pack": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op10_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
}


@pytest.fixture(scope="module")
def results(spark):
    return {n: f(spark, SF).cache() for n, f in queries.queries().items()}


@pytest.mark.parametrize("name", CONTRACTS)
def test_contract(spark, results, name):
    df = results[name]
    wanted = dict(c.split() for c in CONTRACTS[name].split(", "))
    assert {c: t for c, t in df.dtypes if c in wanted} == wanted
    key, table = ("page_id", "pages") if name.startswith("op2_") else ("doc_id", "documents")
    ids = sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
    found = sorted(r[0] for r in df.select(key).collect())
    assert (sorted(set(found)) if name.startswith("op9_") else found) == ids


def test_brute_force(results, sample):
    prints = [brute_print(t, 4) for t in sample]
    groups = components(prints, 4)
    rows = sorted(results["op1_simhash"].collect(), key=lambda r: r["doc_id"])
    assert [(r["fingerprint"], r["component_id"]) for r in rows] == [(f"{p:016x}", g) for p, g in zip(prints, groups, strict=True)]
    rows = sorted(results["op3_winnow"].collect(), key=lambda r: r["doc_id"])
    check_winnow(rows, sample)
    assert all(len(r["edited_sha256"]) == len(hashlib.sha256().hexdigest()) for r in rows)


def test_sql(results):
    import duckdb

    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    for name, sql in queries.oracle_sql().items():
        wanted = db.execute(f"select doc_id, n_lines, n_removed, text from ({sql}) order by 1").fetchall()
        assert sorted(tuple(r) for r in results[name].select("doc_id", "n_lines", "n_removed", "text").collect()) == wanted


def test_mix_is_near_its_targets(results):
    taken, target, largest = {}, {}, {}
    for r in results["op6_mix"].collect():
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
        assert r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in taken)
