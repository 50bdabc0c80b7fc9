import hashlib
import random
import re
import zlib

import numpy as np

from loomwork.llm import periodic
from loomwork.llm.queries import QUERIES
from tests.conftest import SF
from tests.llm.helpers import awkward


def brute(words, least=12):
    """Every stretch with words q apart alike, as long as it can be; the smallest period of each."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q):
                best.setdefault((i, length), q)
            i = max(j, i + 1)
    return sorted(((a, k, q) for (a, k), q in best.items()), key=lambda r: (r[0], r[2]))


def expected(words):
    found = brute(words)
    gone = {k for a, n, q in found for k in range(a + q, a + n)}
    top = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    return (
        len(found), *((None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])),
        hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in found).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest(),
    )


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def symbols(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        size, letters = rng.randrange(0, 80), rng.randrange(1, 6)
        out = [rng.randrange(1, letters + 1) for _ in range(size)]
        if size > 20 and rng.random() < 0.5:
            p = rng.randrange(1, 25)
            out[10:] = [out[10 + k % p] for k in range(size - 10)]
        yield out


def test_runs_against_brute_force():
    for s in symbols(1, 1500):
        assert periodic.runs(s) == brute(s)


def test_stretches_hold_every_run():
    """Cutting out what may not be periodic changes nothing, many texts at once."""
    texts = [*symbols(2, 300)]
    rng = random.Random(4)
    texts += [[rng.randrange(1, 400) for _ in range(200)] + t + [rng.randrange(1, 400) for _ in range(50)] + t for t in texts[:60]]
    flat = np.array([x for t in texts for x in t], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    stretch = periodic.narrowed(flat, np.repeat(np.arange(len(texts)), [len(t) for t in texts]))
    at = 0
    for t in texts:
        assert periodic.document_runs([str(x).encode() for x in t], stretch[at : at + len(t)]) == brute(t)
        at += len(t)


def test_common_extensions():
    s = [1, 2, 1, 1, 2, 1, 2, 2, 1, 1, 2, 1, 0]
    tree = periodic.SuffixTree(s)
    assert tree.order.tolist() == sorted(range(len(s)), key=lambda k: s[k:])
    pairs = [(i, j) for i in range(len(s)) for j in range(len(s)) if i != j]
    common = tree.common(*np.array(pairs).T)
    for (i, j), n in zip(pairs, common.tolist(), strict=True):
        assert s[i : i + n] == s[j : j + n] and (i + n == len(s) or j + n == len(s) or s[i + n] != s[j + n])


def test_awkward_rows(spark):
    texts = [" ".join(f"w{x}" for x in s) for s in symbols(7, 60)] + ["a b " * 3000, "x\x1cy " * 20, " ".join(["é", "ü", "中"] * 9)]
    docs = awkward(spark, texts, clashing=True)
    got = periodic.run_digests(docs).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str((r.doc_id, *expected(words_of(r.text)))) for r in docs.collect())
    assert periodic.run_digests(docs.limit(0)).count() == 0
    kept = periodic.periodic_runs(docs)
    assert set(docs.columns) <= set(kept.columns) and {"n_words", "collapsed"} <= set(kept.columns)


def test_query(spark):
    """With the planted periods of the contract."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op11_periodic_runs"](spark, SF).collect()
    assert len(rows) == len(texts) and sum(r.n_runs > 0 for r in rows) > 10
    for r in rows:
        words = words_of(texts[r.doc_id])
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n < 1500:
            assert tuple(r)[1:] == expected(words)


def test_ids_without_periods(spark):
    docs = spark.createDataFrame([(None, "a b c"), (5, None), (6, "")], "doc_id long, text string")
    assert [tuple(r) for r in periodic.with_planted_periods(docs).collect()] == [tuple(r) for r in docs.collect()]
