"""The pipeline's stages, each held against a plain version on what the one before kept."""

import zlib
from collections import defaultdict

import numpy as np

import corpus_pipeline
from loomwork.llm import pii, toxicity
from loomwork.llm.common import table, written
from loomwork.llm.queries import tokenizer_path
from tests.conftest import SF
from tests.llm import test_decontamination, test_near


def test_stages(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    docs = table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    states = [docs]
    for _, stage in corpus_pipeline.STAGES:
        states.append(written(stage(spark, states[-1], SF), "stage"))
    rows = [sorted(map(tuple, s.collect()), key=str) for s in states]
    assert all(s.schema.simpleString() == docs.schema.simpleString() for s in states[1:-1])

    scored = toxicity.toxicity(docs, table(spark, SF, "labels")).collect()
    toxic = {r.doc_id for r in scored if r.predicted}
    assert rows[1] == [r for r in rows[0] if r[0] not in toxic] and toxic

    kept = {(i, g) for i, g, _ in test_near.brute([(r[0], r[1]) for r in rows[1]])}
    assert rows[2] == [r for r in rows[1] if (r[0], r[0]) in kept] and len(rows[2]) < len(rows[1])

    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    assert rows[3] == [r for r in rows[2] if not test_decontamination.brute(r[1], items)[4]] and len(rows[3]) < len(rows[2])

    model = pii.fit(states[3])
    masked = [(i, t and pii.masked(t, pii.all_spans(t, model)[1]), lang, source, n) for i, t, lang, source, n in rows[3]]
    assert rows[4] == sorted([(i, t, lang, source, t if t is None else len(t)) for i, t, lang, source, _ in masked], key=str) and [r[1] for r in rows[4]] != [r[1] for r in rows[3]]

    expected = []
    for i, t, *_ in rows[4]:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        expected += [(i, k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    assert sorted(r[:5] for r in rows[5]) == sorted(expected)
    places = defaultdict(list)
    for r in rows[5]:
        places[r[5]].append((r[6], r[3]))
    for parts in places.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [at for at, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 4096

    assert sorted(r[:5] for r in map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(expected)
