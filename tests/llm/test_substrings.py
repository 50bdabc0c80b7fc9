import hashlib
import random
import re

from loomwork.llm import substrings
from tests.llm.helpers import awkward, sentences


def brute(rows, window=20):
    """rows: (id, hash, text), smallest id first and null last, then by hash; rows of one id and text are one document."""
    seen, out = {}, []
    for i, tie, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if key in seen and seen[key] != (i, tie, k):
                gone[k : k + window] = [True] * window
            seen.setdefault(key, (i, tie, k))
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append(((i, text), (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)))
    return dict(out)


def hashed(docs):
    return [tuple(r) for r in docs.selectExpr("doc_id", "xxhash64(coalesce(text, ''))", "text").collect()]


def cases():
    rng = random.Random(11)
    out = sentences(12, 25, 90)
    passages = sentences(13, 4, 60)
    for k in range(25):
        w = sentences(200 + k, 1, 50)[0].split()
        p = passages[k % 4].split()
        a = rng.randrange(40)
        w[10:10] = p[a : a + rng.randrange(15, 60)]
        out.append(" ".join(w))
    return [*out, out[0], out[0], out[3] + "\n" + out[3], "a b " * 60, "\x1c ".join(out[5].split()), " ".join(out[6].split()[:19])]


def test_against_brute_force(spark):
    docs = awkward(spark, cases(), clashing=True)
    expected = brute(hashed(docs))
    got = substrings.substring_dedup(docs, with_text=True).collect()
    assert len(got) == docs.count()
    values = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got)
    assert values == sorted((str(r.doc_id), *expected[(r.doc_id, r.text)]) for r in docs.collect())
    assert substrings.substring_dedup(docs.limit(0)).count() == 0


def test_sketch_never_misses(spark, monkeypatch):
    monkeypatch.setattr(substrings, "LEAST_BITS", 12)
    monkeypatch.setattr(substrings, "MOST_BITS", 12)  # nearly every cell is hit twice: more to group, the same result
    docs = spark.createDataFrame(list(enumerate(cases())), "doc_id long, text string")
    expected = brute(hashed(docs))
    got = substrings.substring_dedup(docs).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted((i, *v[:3]) for (i, _), v in expected.items())


def test_ids_that_do_not_tell_texts_apart(spark, monkeypatch):
    """Null ids and one id over many texts, of different length; and windows that are settled in small parts."""
    monkeypatch.setattr(substrings, "HELD_WINDOWS", 50)
    texts = cases()
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, " ".join(t.split() + ["more"] * (k % 5))) for k, t in enumerate(texts)]
    shared = sentences(77, 1, 30)[0]
    rows += [(None, sentences(78, 1, 60)[0] + " " + shared), (None, sentences(79, 1, 900)[0] + " " + shared), (1, shared), (1, shared + " " + shared), (None, shared), (None, shared)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(hashed(docs))
    got = substrings.substring_dedup(docs, with_text=True).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got) == sorted((str(i), *expected[(i, t)]) for i, t in rows)


def test_string_ids(spark):
    rows = [(str(k) if k % 4 else None, t) for k, t in enumerate(cases())]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    keyed = [(None if i is None else i, h, t) for i, h, t in hashed(docs)]
    order = {i: n for n, i in enumerate(sorted({i for i, _, _ in keyed if i is not None}))}
    expected = brute([(None if i is None else order[i], h, t) for i, h, t in keyed])
    got = substrings.substring_dedup(docs).collect()
    assert sorted((str(order.get(r.doc_id)), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted((str(order.get(i)), *expected[(order.get(i), t)][:3]) for i, t in rows)
