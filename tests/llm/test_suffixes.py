import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from loomwork.llm import suffixes
from loomwork.llm.queries import QUERIES
from tests.conftest import SF
from tests.llm.helpers import awkward, sentences


def brute(texts, window=200):
    """Of each text the bytes, those removed, the stretches of these, and what stays."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + window] for d in data for k in range(len(d) - window + 1))
    out = []
    for d in data:
        gone, at, parts, spans = 0, 0, [], 0
        for k in range(len(d) - window + 1):
            if seen[d[k : k + window]] > 1:
                if not spans or k > at:
                    spans += 1
                    parts.append(d[at:k])
                at = k + window
        kept = b"".join([*parts, d[at:]])
        gone = len(d) - len(kept)
        out.append((len(d), gone, spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def cases(seed=1):
    """Texts that share passages, whole or with changes near their edges, with others and with themselves."""
    rng = random.Random(seed)
    passages = sentences(seed + 5, 6, 120)
    out = sentences(seed + 6, 10, 80)
    for k in range(40):
        w, p = sentences(100 + k, 1, 60)[0], passages[k % 6]
        a = rng.randrange(len(p) - 150)
        part = p[a : a + rng.randrange(150, 420)]
        cut = rng.randrange(len(part))
        out.append(w[:100] + (part if k % 3 else part[:cut] + "#" + part[cut:]) + w[100:])
    return [*out, out[0], out[0], out[3] + "\n" + out[3], "ab " * 300, "é中" * 200, "x" * 199, "x" * 200, "y" * 199, "y" * 199, "z" * 900]


def check(spark, docs, **options):
    rows = docs.collect()
    expected = [(str(r.doc_id), *v) for r, v in zip(rows, brute([r.text for r in rows], options.get("window", 200)), strict=True)]
    got = suffixes.suffix_dedup(docs, with_text=True, **options).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got) == sorted(expected)


def test_against_brute_force(spark):
    docs = awkward(spark, cases(), clashing=True)
    check(spark, docs)
    assert suffixes.suffix_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("most", [512, 2])
def test_short_windows_and_small_groups(spark, monkeypatch, most):
    """Many groups of many segments, held and sorted in small parts; and anchors that count as frequent, whose windows stand alone."""
    monkeypatch.setattr(suffixes, "MOST_SEGMENTS", most)
    monkeypatch.setattr(suffixes, "HELD_BYTES", 3000)
    monkeypatch.setattr(suffixes, "SORTED_BYTES", 2000)
    monkeypatch.setattr(suffixes, "PIECE_BYTES", 700)
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 90))) for _ in range(150)] + [t[:900] for t in cases(3)[:30]]
    docs = spark.createDataFrame([(k if k % 7 else None, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    check(spark, docs, window=24, gram=6)


def groups(seed):
    rng = random.Random(seed)
    texts, off, sizes = [], [], []
    for _ in range(120):
        n = rng.choice([2, 2, 3, 5, 9, 30])
        middle = "".join(rng.choice("ab") for _ in range(6))
        for _ in range(n):
            left, right = ("".join(rng.choice("ab") for _ in range(rng.randrange(0, most))) for most in (15, 9))
            texts.append((left + middle + right).encode())
            off.append(len(left))
        sizes.append(n)
    return texts, np.array(off, np.int64), np.array(sizes)


def test_sorted_and_outermost():
    for seed in range(3):
        texts, off, sizes = groups(seed)
        s = suffixes.Suffixes(texts, off)
        at = 0
        right, back = s.sorted(sizes, 1), s.sorted(sizes, -1)
        for n in sizes:
            assert [texts[k][off[k] :] for k in right[at : at + n]] == sorted(texts[k][off[k] :] for k in range(at, at + n))
            assert [texts[k][: off[k]][::-1] for k in back[at : at + n]] == sorted(texts[k][: off[k]][::-1] for k in range(at, at + n))
            at += n
        left, reach = suffixes.outermost(texts, off, sizes, 14)
        at = 0
        for n in sizes:
            some = range(at, at + n)
            assert list(zip(left[some].tolist(), reach[some].tolist(), strict=True)) == suffixes.plainly([texts[k] for k in some], off[some], 14)
            at += n
        assert (reach > 0).any() and (reach == 0).any()


def test_hashes_that_lie(monkeypatch):
    """Where hashes hold different bytes for equal, the bytes themselves show it, and the group is compared plainly."""
    texts, off, sizes = groups(9)
    expected = [x.tolist() for x in suffixes.outermost(texts, off, sizes, 14)]
    monkeypatch.setattr(suffixes.Suffixes, "_hash", lambda self, begin, size: (self._sums[begin + size] - self._sums[begin]) * self._down[begin] & np.uint64(1))
    assert [x.tolist() for x in suffixes.outermost(texts, off, sizes, 14)] == expected


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    expected = dict(zip(texts, brute(texts.values()), strict=True))
    rows = QUERIES["op13_suffix_dedup"](spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == {i: v[:4] for i, v in expected.items()}
    assert sum(r.n_removed > 0 for r in rows) > 10
