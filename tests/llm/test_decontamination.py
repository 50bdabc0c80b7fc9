import hashlib
import random
import time

import numpy as np

from loomwork.llm import decontamination
from tests.llm.helpers import CLASHING, awkward, plain_words, sentences


def brute(text, items):
    words = plain_words(text)
    hit, found = set(), set()
    for item, t in items:
        own = plain_words(t)
        size = min(13, len(own))
        windows = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if size else set()
        for k in range(len(words) - size + 1):
            if size and tuple(words[k : k + size]) in windows:
                hit |= set(range(k, k + size))
                found.add(item)
    listed = ",".join(sorted(str(i) for i in found))
    return len(words), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(words)


def cases():
    rng = random.Random(4)
    items = [(k, t) for k, t in enumerate(sentences(9, 12, 30, 200))] + [(12, "Short, item!"), (13, "one"), (14, ""), (15, "!!"), (16, "w1 w2 w3 W4 w5 w6 w7 w8 w9 w10 w11 w12")]
    texts = []
    for k in range(40):
        base = sentences(100 + k, 1, rng.randrange(5, 200), 200)[0].split()
        own = items[k % 12][1].split()
        a = rng.randrange(len(own))
        base[k % len(base) : k % len(base)] = own[a : a + rng.randrange(1, 30)]
        texts.append(" ".join(base).upper() if k % 3 else ", ".join(base))
    return items, [*texts, "a short item b", items[0][1] * 3, "x w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 y"]


def test_against_brute_force(spark):
    items, texts = cases()
    docs = awkward(spark, texts, clashing=True)
    bench = spark.createDataFrame([*items, (17, None)], "item_id long, text string")
    expected = sorted((r.doc_id or -1, *brute(r.text, items)) for r in docs.collect())
    for block in (decontamination.BLOCK_BYTES, 400):
        got = decontamination.with_hits(docs, bench, block_bytes=block)
        assert sorted((r.doc_id or -1, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()) == expected
    assert decontamination.contamination(docs.limit(0), bench).count() == 0
    assert decontamination.contamination(docs, bench.limit(0)).where("n_hit > 0").isEmpty()


def test_stage_keeps_columns(spark):
    items, texts = cases()
    docs = awkward(spark, texts, clashing=True)
    kept = decontamination.decontaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.schema == docs.schema and len(CLASHING) > 0
    bad = sum(brute(r.text, items)[4] for r in docs.collect())
    assert kept.count() == docs.count() - bad


def test_an_index_of_items_that_share_a_window():
    begin, shared = time.time(), " ".join(f"s{k}" for k in range(13))
    index = decontamination.Index([(str(k), f"{shared} own{k}") for k in range(100_000)])
    assert time.time() - begin < 5
    data = f"before {shared} after ".encode()
    found = index.hits(decontamination.Words(data, np.array([0, len(data)]), decontamination._PLAIN))
    assert len(found) == 100_000 and {f[:2] for f in found} == {(1, 13)}


def test_an_index_takes_a_few_bytes_for_each_of_the_text():
    texts = [(str(k), t) for k, t in enumerate(sentences(5, 800, 400, 10**6))]
    index = decontamination.Index(texts)
    size = len(index.text) + sum(x.begin.nbytes + x.end.nbytes + x.item.nbytes + x.keys.values.nbytes for x in index.windows.values()) + index.prints.values.nbytes
    assert size < 5 * sum(len(t) for _, t in texts)
