import random

import pytest

from loomwork.operators import memory, needles, quotes, search


def names(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abÀé 0") for _ in range(rng.randrange(1, 12))) for _ in range(n)]


def test_gram_hashes():
    rng = random.Random(1)
    data = bytes(rng.choice(b"ab") for _ in range(3000))
    for size in needles.SIZES:
        h = needles.gram_hashes(data, size).tolist()
        assert len(h) == 3000 - size + 1
        assert len(set(h)) == len({data[k : k + size] for k in range(3000 - size + 1)}) == len(set(zip(h, (data[k : k + size] for k in range(3000)), strict=False)))
    assert len(needles.gram_hashes(b"abc", 4)) == 0 and needles.size_of("äöü".encode()) == 4 and needles.size_of(b"abc") == 0


def test_many_needles_as_one_by_one(spark):
    """An index of postings finds for each needle what a scan finds, ties and limits too."""
    found = names(250, 3)
    e = spark.createDataFrame([(f"u{k}", n if k % 9 else None, n.lower()[::-1] if k % 4 else None, k % 3) for k, n in enumerate(found)], "uuid string, name string, normalised string, mention_count int")
    asked = [" A", "b", "é", "ab", "a b", "bà", "0a ", "abab", "zzz", "", " ", *[n[1:6] for n in found[:25]]]
    rows = needles.found(needles.postings(e, 4), spark.createDataFrame([(a,) for a in asked], "query string"), 5).collect()
    for a in {a.strip().lower() for a in asked} - {""}:
        want = [(r.uuid, r.matched_by, r.score) for r in search.lexical(e, a, 5).collect()]
        got = [(r.uuid, r.matched_by, r.score) for r in sorted(rows, key=lambda r: r.place) if r.needle == a]
        assert sorted(got) == sorted(want) and [s for *_, s in got] == [s for *_, s in want], a
    assert {r.needle for r in rows} <= {a.strip().lower() for a in asked}


@pytest.mark.parametrize("bits", [27, 6])
def test_names_in_posts(spark, monkeypatch, bits):
    """Names of all lengths, some that no post has, and grams that all posts have; a filter too small changes nothing."""
    monkeypatch.setattr(needles, "MOST_BITS", bits)
    monkeypatch.setattr(needles, "LEAST_BITS", 6)
    rng = random.Random(5)
    own = sorted({n for n in names(300, 6) if len(n) >= 4} | {"x" * k for k in (4, 7, 8, 9, 31, 32, 33, 40)} | {"nobody", "ann"})
    posts = [(k if k % 7 else None, None if k == 5 else "xxxx" + "".join(rng.choice([*own, "ab", " ", "é"]) for _ in range(rng.randrange(0, 6)))) for k in range(120)] + [(1, ""), (2, "x" * 50), (2, "x" * 50)]
    df, n = spark.createDataFrame(posts, "post_id long, normalised string"), spark.createDataFrame([(x,) for x in [*own, None, own[0]]], "normalised string")
    got = sorted(map(str, map(tuple, memory.mentioned(df, n).collect())))
    assert got == sorted(str((i, x)) for i, t in posts for x in own if t and len(x) >= 4 and x in t)
    assert memory.mentioned(df.limit(0), n).collect() == memory.mentioned(df, n.limit(0)).collect() == []


def test_quotes_in_documents(spark):
    items = [(1, "A  quote of\nSome words"), (2, "“another quote here”"), (3, "too short"), (4, None), (None, "a quote of some words"), (5, "a quote of some words"), (6, "nobody ever says this")]
    texts = ["He said: a QUOTE of   some words, twice: a quote of some words.", "\n another\tquote  here", "", None, "İ a quote of some words", "Ǆ another quote here İ"]
    docs, own = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in quotes.quoted(docs, own).collect())
    want = [(d, i, *at) for d, t in enumerate(texts) for i, q in items if i is not None and q and t and (at := quotes.find(t, q))]
    assert got == sorted(want) and len(got) == 6


def test_needles_meet_only_what_is_found(spark):
    """Names and needles that share all their short grams: as many rows meet as are found. Needles longer than what is looked up are told apart by their rarest stretch."""
    rng = random.Random(8)
    own = ["".join(rng.choice("01") for _ in range(14)) for _ in range(400)] + ["Customer#0000000" + f"{k:04d}" for k in range(50)]
    e = spark.createDataFrame([(f"u{k}", n, n.lower(), k % 5) for k, n in enumerate(own)], "uuid string, name string, normalised string, mention_count int")
    asked = sorted({n[:12] for n in own[:200]} | {own[-1], own[-7], "customer#00000009999"})
    index = needles.postings(e, 2)
    keys = spark.createDataFrame([(a,) for a in asked if len(a) == 12], "gram string")
    pairs = {(a, f"u{k}") for a in asked for k, n in enumerate(own) if a.lower() in n.lower()}
    assert index.pieces([12]).join(keys, "gram").count() == sum(len(a) == 12 for a, _ in pairs)
    got = {(r.needle, r.uuid) for r in needles.found(index, spark.createDataFrame([(a,) for a in asked], "query string"), 500).collect()}
    assert got == {(a.lower(), u) for a, u in pairs}
