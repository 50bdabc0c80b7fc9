import itertools
import random
import zlib

import numpy as np

from loomwork.llm import quality
from tests.llm.helpers import awkward


def labelled(spark, n=500):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        lines = [" ".join(f"{'Word' if k == 0 else 'word'}{rng.randrange(300)}" for k in range(rng.randrange(4, 15))) + "." for _ in range(rng.randrange(1, 9))]
        if not good:
            lines = [x.upper().replace(" ", "!! ") if rng.random() < 0.7 else x for x in lines] + ["BUY NOW!! $$$"]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels)


def test_held_out_accuracy(spark):
    docs, labels, truth = labelled(spark)
    got = quality.quality(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out]
    assert sum(p == t for p, t in held) / len(held) > 0.95


def test_marginals_are_sums_over_all_labellings():
    rng = np.random.default_rng(1)
    node, step, first = rng.normal(size=9), rng.normal(size=(2, 2)), np.array([0, 4, 5, 9])
    good, pairs = quality.marginals(node, first, step)
    expected, seen = np.zeros(9), np.zeros((2, 2))
    for a, b in itertools.pairwise(first):
        total, hits, own = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(node[a + k] * y for k, y in enumerate(labels)) + sum(step[x, y] for x, y in itertools.pairwise(labels)))
            total += w
            hits += w * np.array(labels)
            for x, y in itertools.pairwise(labels):
                own[x, y] += w
        expected[a:b] = hits / total
        seen += own / total
    assert np.allclose(good, expected) and np.allclose(pairs, seen)


def test_awkward_rows(spark):
    docs, labels, _ = labelled(spark, 120)
    odd = awkward(spark, ["A line.\n\n\nAnother one.\n"], clashing=True)
    rows = quality.with_scores(odd, quality.fit(docs, labels), lines=True).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert next(len(r.line_scores) for r in rows if r.doc_id == 100) == 5
    assert len({r.score for r in rows if r.text in (None, "")}) == 1
    assert len({r.score for r in quality.quality(odd, labels.limit(0)).collect()}) == 1
    assert quality.quality(odd.limit(0), labels).count() == 0
