import random
from collections import defaultdict

from loomwork.llm import near
from loomwork.llm.graph import components
from tests.llm.helpers import awkward, plain_words, sentences


def sets(text, n=5):
    w = plain_words(text)
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, threshold=0.8):
    own = [sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if own[a] and own[b] and len(own[a] & own[b]) >= threshold * len(own[a] | own[b]):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        groups[find(k)].append(i)
    return [(i, min([x for x in groups[find(k)] if x is not None], default=None), links[k]) for k, (i, _) in enumerate(rows)]


def noisy(rng, text, changes):
    w = text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
    return " ".join(w)


def cases():
    rng = random.Random(6)
    out = []
    for base in sentences(7, 12, 120):
        out += [base, base, base.upper(), *[noisy(rng, base, c) for c in (1, 2, 3, 5, 8)]]
    hot = sentences(8, 1, 150)[0]
    return [*out, *[noisy(rng, hot, 1) for _ in range(60)], "", "three words only", "three words only."]


def test_against_brute_force(spark, monkeypatch):
    docs = awkward(spark, cases(), clashing=True)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = sorted(brute(rows), key=str)
    for size in (near.BLOCK_DOCS, 24, 4):  # whole components, buckets, and pairs of a bucket's blocks
        monkeypatch.setattr(near, "BLOCK_DOCS", size)
        got = near.jaccard_join(docs).collect()
        assert sorted([(r.doc_id, r.class_id, r.n_links) for r in got], key=str) == expected
    assert near.jaccard_join(docs.limit(0)).count() == 0


def test_one_of_each(spark):
    docs = awkward(spark, cases())
    kept = near.one_of_each(docs)
    assert kept.schema == docs.schema
    whole = {r.doc_id: r for r in docs.collect()}
    expected = {i for i, c, _ in brute([(i, r.text) for i, r in whole.items()]) if i is None or c == i}
    assert sorted(map(str, [r.doc_id for r in kept.collect()])) == sorted(map(str, expected))


def test_one_of_each_with_rows_that_repeat(spark):
    """Rows without an id stay whatever else repeats; of rows that repeat an id and its text one stays."""
    none, some = [(None, "no id, some words of a text that stands twice")] * 2, (1, "another text, of other words than the first one")
    for rows, kept in (([*none, some], 3), ([*none, some, some], 3), ([*none, some, some, (2, some[1]), (3, None), (3, None), (4, "")], 5)):
        docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, own string")
        got = sorted(map(tuple, near.one_of_each(docs).collect()), key=str)
        assert len(got) == kept and sum(r[0] is None for r in got) == 2 and sum(r[0] == 1 for r in got) == 1
        assert near.one_of_each(docs).columns == docs.columns


def test_recall_just_above_the_threshold(spark):
    """Pairs of texts of which a few words differ, as many as leave 0.8 to 0.83 of the n-grams."""
    texts, links = [], 0
    for k in range(150):
        w = [f"w{k}x{n}" for n in range(100)]
        v = list(w)
        v[50] = v[51] = "changed"  # 6 of 96 n-grams, and 3 more at either end
        v = v[2:] + ["more"] * 2
        texts += [" ".join(w), " ".join(v)]
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (w, v))
        links += len(a & b) / len(a | b) >= 0.8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert links > 100 and sum(r.n_links for r in near.jaccard_join(docs).collect()) == 2 * links


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bands_reach_recall():
    for threshold in (0.5, 0.8, 0.95):
        bands, rows = near.bands_and_rows(threshold)
        assert bands * rows <= near.MOST_HASHES or rows == 1
        assert threshold < 0.6 or 1 - (1 - threshold**rows) ** bands >= near.RECALL


def test_classes_of_one_number_are_told_apart(spark):
    classes = spark.createDataFrame([(1, 5, "a"), (1, 6, "b"), (2, 5, "c")], "k1 long, k2 long, x string")
    got = {r.x: r.node for r in near.told_apart(classes).collect()}
    assert got["c"] == 2 and len(set(got.values())) == 3
    assert [r.node for r in near.told_apart(classes.where("x <> 'b'")).orderBy("k1").collect()] == [1, 2]


def test_chained_groups(spark, monkeypatch):
    """Texts that a sliding stretch of words chains into one component, of which neighbours alone are similar."""
    words = sentences(11, 1, 700)[0].split()
    rows = [(i, " ".join(words[i * 6 : i * 6 + 100])) for i in range(90)]
    monkeypatch.setattr(near, "BLOCK_DOCS", 16)
    got = near.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == sorted(brute(rows))
