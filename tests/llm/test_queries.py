"""The registered queries on the smallest tables: with SQL against DuckDB, without against plain versions of their contracts."""

import hashlib
import zlib

import pytest

from loomwork.llm import pii
from loomwork.llm.queries import ORACLES, QUERIES
from tests.conftest import SF
from tests.test_queries import table


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(ORACLES[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([d[0] for d in result.description], result.fetchall())


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_ogg(spark, documents):
    rows = QUERIES["op5_ogg"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(documents)
    for r in rows:
        data = documents[r.doc_id].encode()
        data += b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(documents[r.doc_id].encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))


def test_pii(spark, documents):
    for r in QUERIES["op6_pii"](spark, SF).collect():
        base = pii.base_spans(documents[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[2] == k for s in base) for k in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(pii.listed(base).encode()).hexdigest()


@pytest.mark.parametrize(("name", "folds", "fold"), [("op2_toxicity", 4, 2), ("op3_quality", 5, 0)])
def test_scores(spark, documents, name, folds, fold):
    rows = QUERIES[name](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(documents)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_pseudo_likelihood(spark, documents):
    rows = QUERIES["op10_pseudo_likelihood"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(documents) and all(r.pseudo_log_likelihood <= 0 for r in rows)
