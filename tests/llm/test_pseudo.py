import random

import numpy as np

from loomwork.llm import pseudo
from tests.llm.helpers import awkward


def grammar(n, seed):
    """Sentences in which a word's neighbours tell it."""
    rng = random.Random(seed)
    return [" ".join(x for _ in range(rng.randrange(5, 20)) for k in [rng.randrange(30)] for x in (f"a{k}", f"b{k}", f"c{k}")) for _ in range(n)]


def test_scores(spark):
    docs = spark.createDataFrame(list(enumerate(grammar(400, 1))), "doc_id long, text string")
    net = pseudo.fit(docs, steps=400)
    own = grammar(30, 2)
    rng = random.Random(3)
    mixed = [" ".join(rng.sample(t.split(), len(t.split()))) for t in own]
    test = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(own + mixed)], "doc_id long, text string, n_words string, per_word string")
    rows = {r.doc_id: r.per_word for r in pseudo.with_scores(test, net).collect()}
    assert np.mean([rows[i] for i in range(30)]) > np.mean([rows[30 + i] for i in range(30)]) + 0.5
    assert np.mean([rows[i] for i in range(30)]) > -np.log(90)  # better than the words' frequencies alone


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame(list(enumerate(grammar(50, 1))), "doc_id long, text string")
    net = pseudo.fit(docs, steps=20)
    n = len(net.class_of) - 1
    ids = np.array([[1, 2, k, 3, 4] for k in range(1, n + 1)]).ravel()
    p = net.log_probabilities(ids, np.repeat(np.arange(n), 5)).reshape(n, 5)[:, 2] + net.rest[1:]
    assert abs(np.exp(p).sum() - 1) < 1e-3


def test_awkward_rows(spark):
    docs = awkward(spark, grammar(20, 4), clashing=True)
    rows = pseudo.pseudo_likelihood(docs).collect()
    assert len(rows) == docs.count()
    assert {(r.n_words, r.pseudo_log_likelihood, r.per_word) for r in rows if r.doc_id in (1, 2, 3)} == {(0, 0.0, None)}
    assert len({r.pseudo_log_likelihood for r in rows if r.doc_id in (None, 4, 7)}) == 1
    assert pseudo.pseudo_likelihood(docs.limit(0)).count() == 0


def test_windows_of_whole_texts_in_growing_number(spark):
    texts = [" ".join(["head"] * 900 + ["tail"] * 900)] * 40
    counted = {}
    for copies in (40, 80):
        docs = spark.createDataFrame(list(enumerate((texts * 2)[:copies])), "doc_id long, text string")
        counts = {r.word: r.n for r in pseudo.word_counts(docs).collect()}
        namer = pseudo.untrained(np.array(sorted(counts), np.int64).view(np.uint64), np.ones(len(counts) + 1 + pseudo.SHAPES), np.zeros(len(counts) + 1 + pseudo.SHAPES), np.zeros(0, np.uint64), np.zeros(0))
        rows = pseudo.windows_of(docs, namer, 1000 / (1800 * copies), 1 / 16, 4).collect()
        words = np.concatenate([pseudo.unpacked([r.ids])[:, 0] for r in rows])
        assert {r["round"] for r in rows} == {-1, 0, 1, 2, 3} and abs(np.mean(words == 1) - 0.5) < 0.1
        counted[copies] = len(words)
    assert counted[80] > counted[40] + 3000


def test_rest_words_by_their_counts(spark, monkeypatch):
    monkeypatch.setattr(pseudo, "VOCABULARY", 20)
    texts = [" ".join(f"w{k:02d}" for k in range(20)) for _ in range(50)] + ["often1"] * 40 + [f"once{k:02d}" for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = []
    for known in (1 << 20, 1, 0):
        net = pseudo.fit(docs, steps=5, known=known)
        test = spark.createDataFrame([(0, "often1"), (1, "once07"), (2, "new123")], "doc_id long, text string")
        rows = {r.doc_id: r.pseudo_log_likelihood for r in pseudo.with_scores(test, net).collect()}
        assert abs(rows[0] - rows[1] - np.log(40)) < 1e-6 and rows[1] == rows[2]
        got.append([rows[k] for k in range(3)])
    assert np.allclose(got[0], got[1], atol=1e-8) and np.allclose(got[0], got[2], atol=1e-8)


def test_gradients_of_tasks(spark):
    docs = spark.createDataFrame(list(enumerate(grammar(400, 1))), "doc_id long, text string")
    few = [pseudo.fit(docs, first=500, one_in=1, steps=5, rounds=r) for r in (1, 12)]
    own = spark.createDataFrame(list(enumerate(grammar(30, 2))), "doc_id long, text string")
    means = [np.mean([r.per_word for r in pseudo.with_scores(own, net).collect()]) for net in few]
    assert means[1] > means[0]


def test_scores_against_a_plain_loop(spark):
    texts = [*grammar(60, 1), "a1 b1 new c1", "a2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    net = pseudo.fit(docs, steps=30)
    counts = {r.word: r.n for r in net.counts.collect()}
    size = len(net.words)
    for r in pseudo.with_scores(docs, net).where("doc_id >= 50").collect():
        data = r.text.encode() + b" "
        w = pseudo.Words(data, np.array([0, len(data)]), pseudo._SPACE)
        ids, total = net.ids(w).tolist(), 0.0
        for k, i in enumerate(ids):
            h = net.bias.astype(float)
            for place, d in enumerate([*range(-pseudo.SIDE, 0), *range(1, pseudo.SIDE + 1)]):
                h = h + net.inputs[place][ids[k + d] if 0 <= k + d < len(ids) else 0]
            h = np.tanh(h)
            kind = net.class_of[i]
            for scores, at in ((h @ net.classes + net.class_bias, kind), (h @ net.outputs[kind] + net.output_bias[kind], net.place_of[i])):
                total += scores[at] - np.log(np.exp(scores - scores.max()).sum()) - scores.max()
            if i > size:
                total += np.log(counts.get(int(w.hashes[k].astype(np.int64)), 1)) - net.rest[i]
        assert abs(total - r.pseudo_log_likelihood) < 1e-3 * max(1, len(ids))


def test_every_window_is_learned_from(spark, monkeypatch):
    texts = grammar(400, 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    chosen, windows_of = [], pseudo.windows_of
    monkeypatch.setattr(pseudo, "windows_of", lambda *args: chosen.append(windows_of(*args)) or chosen[-1])
    net = pseudo.fit(docs, first=500, steps=5)
    found = pseudo.unpacked(r.ids for r in chosen[0].collect())
    assert len(found) == sum(len(t.split()) for t in texts)
    own = spark.createDataFrame(list(enumerate(grammar(30, 2))), "doc_id long, text string")
    assert np.mean([r.per_word for r in pseudo.with_scores(own, net).collect()]) > -0.16


def test_weights_of_tasks(spark):
    words = np.arange(1, 41).astype(np.uint64)
    few = np.array([[1, 2, 3, 4, 5]] * 50, np.int16).tobytes(), np.array([[6, 7, 8, 9, 10]] * 80, np.int16).tobytes()
    got = []
    for rows in (few[:1], few[1:], few):
        net = pseudo.untrained(words, np.ones(len(words) + 1 + pseudo.SHAPES), np.zeros(len(words) + 1 + pseudo.SHAPES), np.zeros(0, np.uint64), np.zeros(0))
        scale = {n: np.full_like(getattr(net, n), 1e-6) for n in pseudo.LEARNED}
        begin = net.inputs
        pseudo.learned(spark.createDataFrame(spark.sparkContext.parallelize([(bytearray(x),) for x in rows], len(rows)), "ids binary"), net, scale, 0.1, len(rows))
        got.append((net, scale))
    (a, _), (b, _), (both, squares) = got
    # what one task alone has windows for is as that task has it, what none has stays
    assert np.allclose(both.inputs[0][2], a.inputs[0][2]) and np.allclose(both.inputs[0][7], b.inputs[0][7])
    assert not np.allclose(both.inputs[0][2], begin[0][2]) and np.array_equal(both.inputs[0][11], begin[0][11])
    low, high = np.minimum(a.classes, b.classes), np.maximum(a.classes, b.classes)
    assert ((both.classes >= low - 1e-6) & (both.classes <= high + 1e-6)).all() and (squares["classes"] > 1e-6).any()
