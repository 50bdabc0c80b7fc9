import math
import random
import zlib

from loomwork.llm import toxicity
from loomwork.llm.training import sampled
from tests.llm.helpers import awkward


def labelled(spark, n=900, seed=1):
    """Texts of which a tenth hold some of eight toxic words."""
    rng = random.Random(seed)
    bad = [f"vile{k}" for k in range(8)]
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 120))]
        toxic = rng.random() < 0.1
        for _ in range(rng.randrange(2, 6) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "!", ","]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy(spark):
    docs, labels, truth = labelled(spark)
    got = toxicity.toxicity(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out]
    assert sum(p == t for p, t in held) / len(held) > 0.97


def test_either_label_may_be_the_marked_one(spark):
    """Labels turned around: what marks label 0 speaks against label 1, and held-out rows are ranked as well."""
    docs, labels, truth = labelled(spark)
    got = [r for r in toxicity.toxicity(docs, labels.selectExpr("doc_id", "1 - toxic AS toxic")).collect() if r.held_out]
    one, other = ([r.score for r in got if truth[r.doc_id] == k] for k in (0, 1))
    assert sum((a > b) + (a == b) / 2 for a in one for b in other) / (len(one) * len(other)) > 0.97


def test_held_out_labels_are_not_read(spark):
    docs, labels, _ = labelled(spark, 300)
    turned = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 4 = 2, 1 - toxic, toxic) AS toxic")
    a, b = (sorted(map(tuple, toxicity.toxicity(docs, x).collect())) for x in (labels, turned))
    assert a == b


def test_segments_are_maximal():
    rng = random.Random(2)

    def brute(scores):
        """The best segment (the first and shortest of equals), then those left and right of it."""
        best = max(((sum(scores[a:b]), -a, -(b - a)) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        a, b = -best[1], -best[1] - best[2]
        return brute(scores[:a]) + [(a, b, best[0])] + [(x + b, y + b, s) for x, y, s in brute(scores[b:])]

    for _ in range(200):
        scores = [rng.choice([-3, -2, -1, 1, 2, 5]) + rng.random() / 7 for _ in range(rng.randrange(12))]
        got = toxicity.segments(scores)
        assert [g[:2] for g in got] == [e[:2] for e in brute(scores)]


def test_awkward_rows(spark):
    docs, labels, _ = labelled(spark, 200)
    odd = awkward(spark, ["vile1 vile2 vile3", "w1 w2"], clashing=True)
    model = toxicity.fit(docs, labels)
    rows = toxicity.with_scores(odd, model, passages=True).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.text in (None, "")}) == 1
    kept = toxicity.without_toxic(docs, labels)
    assert kept.schema == docs.schema
    nothing = labels.limit(0)
    assert len({r.score for r in toxicity.toxicity(odd, nothing).collect()}) == 1
    assert toxicity.toxicity(odd.limit(0), labels).count() == 0


def test_sample_is_bounded(spark):
    rows = spark.range(10_000).withColumnRenamed("id", "doc_id")
    got = [r.doc_id for r in sampled(rows, 50, "doc_id").collect()]
    assert len(set(got)) == 50 == len(got) and got == [r.doc_id for r in sampled(rows.repartition(7), 50, "doc_id").collect()]


def test_odds_and_decay_against_plain_versions(spark):
    docs, labels, truth = labelled(spark, 400)
    model = toxicity.fit(docs, labels)
    seen = {}
    for r in docs.collect():
        if zlib.crc32(str(r.doc_id).encode()) % 4 == 2:
            continue
        words = toxicity.tokens(r.text.encode())
        for k, w in enumerate(words):
            around = tuple(words[k - 1 : k + 2]) if 0 < k < len(words) - 1 else None
            seen.setdefault((w, truth[r.doc_id]), set()).add(around)
    t, c = ({w: len(x) for (w, y), x in seen.items() if y == label} for label in (1, 0))
    total_t, total_c, prior = sum(t.values()), sum(c.values()), toxicity.PRIOR
    odds = lambda k, a, total: math.log((k + a) / (total + prior * (total_t + total_c) + 1 - k - a))
    assert len(model.terms) >= 8
    for w, s in model.terms.items():
        a = prior * (t.get(w, 0) + c.get(w, 0))
        assert abs(s - odds(t.get(w, 0), a, total_t) + odds(c.get(w, 0), a, total_c)) < 1e-9
    weights = {w: c.get(w, 0) + prior * (t.get(w, 0) + c.get(w, 0)) for w in model.terms}
    rest = max(total_c - sum(c.get(w, 0) for w in model.terms), 1.0)
    expected = sum(p * math.exp(model.decay * model.terms[w]) for w, p in weights.items()) + rest * math.exp(model.decay * model.other)
    assert abs(expected / (sum(weights.values()) + rest) - 1) < 1e-3
