"""The registered queries against plain versions over the same table, and against SQL where there is some."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from rulemill.llm import katz
from rulemill.llm.queries import ORACLES, QUERIES
from rulemill.llm.tokens import tokenizer_path
from tests.llm.test_katz import plain as plain_katz
from tests.llm.test_simhash import plain, reachable
from tests.llm.test_substring_dedup import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def rows(spark, name, *columns):
    return sorted(tuple(r[c] for c in columns) for r in QUERIES[name](spark, SF).collect())


def test_op1(spark, docs):
    got = rows(spark, "op1_hypergeometric_shards", "doc_id", "size", "text_crc32", "law", "grown_shard")
    assert got == [(i, len(t.encode()) + 1, zlib.crc32(t.encode()), "rows", None) for i, t in docs]


def test_op2(spark, docs):
    prints = [plain(t) for _, t in docs]
    assert rows(spark, "op2_simhash_components", "doc_id", "fingerprint", "component_id") == [(i, f"{p:016x}", docs[r][0]) for (i, _), p, r in zip(docs, prints, reachable(prints, 4))]
    assert xxhash.xxh64_intdigest(b"", 42) == 0x98B1582B0977E704


def test_op4_changes_what_has_entities(spark, docs):
    got = dict(rows(spark, "op4_surrogate_entities", "doc_id", "text"))
    changed = {i for i, t in docs if got[i] != t}
    assert changed >= {i for i, t in docs if "@mail" in t or "token = " in t or "555-" in t or any(w.count(".") >= 3 and w[0].isdigit() for w in t.split())}


@pytest.mark.parametrize("name", list(ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for view in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{SF}/{view}.parquet'")
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    got = [tuple(r[c] for c in names) for r in QUERIES[name](spark, SF).collect()]
    assert sorted(got, key=str) == sorted(found.fetchall(), key=str)


def test_op12(spark, docs):
    training = {i: zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in docs}
    want, total, _, _ = plain_katz([(i, t, training[i]) for i, t in docs], katz.ORDER)
    got = rows(spark, "op12_katz_backoff", "doc_id", "n_tokens", "n_known", "base_score", "score", "held_out", "train_tokens")
    for found, plain_row in zip(got, sorted(want)):
        assert found[:3] == plain_row[:3] and found[3:5] == pytest.approx(plain_row[3:], rel=1e-9)
        assert found[5:] == (not training[found[0]], total)
    assert len(got) == len(want)


def test_op7(spark, docs):
    want = sorted((i, n, gone, hashlib.sha256(kept).hexdigest()) for i, n, gone, kept in brute(docs, 50).elements())
    assert rows(spark, "op7_debruijn_passages", "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_op9_and_op10(spark, docs):
    def encoded(name, end):
        tokenizer = Tokenizer.from_file(tokenizer_path(name))
        return [np.array(tokenizer.encode(t, add_special_tokens=False).ids + [end], "<u4") for _, t in docs]

    ids = encoded("byte_bpe_50k.json", 2)
    starts = np.cumsum([0, *map(len, ids)]).tolist()
    want = [(i, s, len(x), zlib.crc32(x.tobytes())) for (i, _), s, x in zip(docs, starts, ids)]
    assert rows(spark, "op9_repair_grammar", "doc_id", "start", "n_tokens", "ids_crc32") == want
    want = [
        (i, k // 2048, k, len(x[k : k + 2048]), zlib.crc32(x[k : k + 2048].tobytes()))
        for (i, _), x in zip(docs, encoded("word_bpe_49k.json", 0)) for k in range(0, len(x), 2048)
    ]
    assert rows(spark, "op10_grouping_genetic_packing", "doc_id", "piece", "start", "length", "ids_crc32") == want
