import math
import random
from collections import Counter

import numpy as np
import pytest

from loomwork.llm import ranking
from tests.llm.helpers import awkward, plain_words, sentences


def brute(documents, items, k):
    """documents: (id, text); items: (id, text). Null ids come last."""
    counted = [(i, Counter(plain_words(t))) for i, t in documents]
    sizes = [sum(c.values()) for _, c in counted]
    n, total = sum(x > 0 for x in sizes), sum(sizes)
    holding = Counter(t for _, c in counted for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(plain_words(t))
    out = []
    for item, terms in wanted.items():
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * holding[t] + 1))) for t in terms}
        found = []
        for (i, c), size in zip(counted, sizes, strict=True):
            if size:
                m = 50 + 50 * size * n // total
                if score := sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t]):
                    found.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return sorted(map(str, out))


def collected(df):
    return sorted(str(tuple(r)) for r in df.collect())


ITEMS = [(0, "W1 w2, w3! w2"), (1, "w4 w5 w6 w7 w8 w9 w10"), (2, None), (3, "..."), (4, "nowhere"), (5, "one"), (6, "é 中文 W20"), (6, "w21"), (None, "w30 w31")]


@pytest.mark.parametrize("most", [4096, 7])
def test_against_brute_force(spark, monkeypatch, most):
    """Many trees, ties and copies among them; items of one id, of none, without terms, and with terms that no document has."""
    monkeypatch.setattr(ranking, "TREE_DOCS", most)
    monkeypatch.setattr(ranking, "LEAF_DOCS", 2)
    texts = sentences(1, 80, 30, 60) + sentences(2, 10, 5, 40) * 4 + [" ".join(["w1 w2"] * 500)]
    docs = awkward(spark, texts, clashing=True)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k in (1, 6, 500):
        assert collected(ranking.lexical_search(docs, items, k)) == brute(rows, ITEMS, k)


def test_blocks_and_empty_tables(spark):
    docs = awkward(spark, sentences(1, 40, 30, 60))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert collected(ranking.lexical_search(docs, items, 5, block_bytes=16)) == brute(rows, ITEMS, 5)
    for a, b in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("text is null or doc_id = 2"), items)):
        assert ranking.lexical_search(a, b).collect() == []


def test_string_ids(spark):
    docs = spark.createDataFrame([(str(k) if k % 5 else None, "w1 w2") for k in range(30)] + [("z", "w1 w1 w9")], "doc_id string, text string")
    items = spark.createDataFrame([("a", "w1")], "item_id string, text string")
    got = [(r.rank, r.doc_id) for r in ranking.lexical_search(docs, items, 28).orderBy("rank").collect()]
    assert got == list(enumerate(["z", *sorted(str(k) for k in range(30) if k % 5), None, None, None], 1))


def test_bounds_and_pruning():
    """No score is above the bound of any node over it, however large the numbers; and documents of other terms are never opened."""
    rng = random.Random(3)
    rows = [sorted(rng.sample(range(0, 40) if k % 2 else range(40, 90), rng.randrange(1, 20))) for k in range(300)]
    cuts = np.r_[0, np.cumsum([len(r) for r in rows])]
    terms = np.array([t for r in rows for t in r], np.int32)
    value = np.array([rng.randrange(1, 1_000_000) for _ in terms], np.int64)
    tree = ranking.BallTree(cuts, terms, value, 90, leaf=4)
    assert sorted(tree.order.tolist()) == list(range(300))
    items = np.zeros((20, 90))
    for q in range(20):
        items[q, rng.sample(range(40), 8)] = [rng.randrange(1, 20_000) for _ in range(8)]
    bounds = tree.bounds(items)
    dense = np.zeros((300, 90), np.int64)
    dense[np.repeat(np.arange(300), np.diff(cuts)), terms] = value
    scores = dense @ items.astype(np.int64).T

    def below(node):
        if tree.leaves[node]:
            return tree.order[slice(*tree.leaves[node])].tolist()
        return [r for child in tree.below[node] for r in below(child)]

    for node in range(len(tree.radii)):
        assert (scores[below(node)].max(axis=0) <= bounds[:, node]).all()
    assert (bounds < 2).any()
    for q in range(20):
        rows, found = tree.best(items[q].astype(np.int64), bounds[q], 5, [])
        assert sorted(found.tolist())[-5:] == np.sort(scores[:, q])[-5:].tolist()
        assert (scores[rows, q] == found).all()
