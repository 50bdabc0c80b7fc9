import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from loomwork.llm import packing
from loomwork.llm.queries import tokenizer_path
from tests.llm.helpers import awkward, sentences


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_ids_are_the_tokenizers(tokenizer):
    words = packing._WordIds(tokenizer_path())
    odd = ["İstanbul ﬁ \x1c x <|endoftext|>a <|start it's 'S ''s don'T 12three ½  中文字 \U0001f642 \x00\t\r\n ΑΣ ΣΑ'LL café Å ÀÉ ÿß×÷ it’s", "", " ", "'" * 5 + "re", "Déjà-vu!!! ***ÉÈ"]
    for text in odd + sentences(1, 5):
        assert np.frombuffer(packing.token_bytes(words, text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_best_fit_places():
    lengths = [random.Random(3).randrange(1, 4097) for _ in range(3000)]
    used, opened = defaultdict(int), set()
    for n, (b, offset) in zip(lengths, packing.best_fit(lengths, open_bins=50), strict=True):
        assert offset == used[b]
        used[b] += n
        opened.add(b)
        assert used[b] <= 4096
    assert len(opened) < 1.12 * sum(lengths) / 4096
    # The least free space that fits is taken: 10 goes to the bin with 10 left, though one with more is open.
    assert [b for b, _ in packing.best_fit([4000, 4086, 10, 96])] == [0, 1, 1, 0]
    # The fullest closes when too many are open, so nothing more goes there.
    assert [b for b, _ in packing.best_fit([3000, 2000, 1000, 96], open_bins=1)] == [0, 1, 1, 1]


def test_whole_documents(spark, tokenizer):
    texts = sentences(2, 30, 60) + sentences(3, 2, 9000)
    docs = awkward(spark, texts, clashing=True)
    rows = packing.best_fit_packing(docs, tokenizer_path()).collect()
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(r.piece == 0 for r in rows) == docs.count()
    for doc_id, text in ((100, texts[0]), (131, texts[31]), (1, "")):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        own = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == doc_id)
        assert own == [(k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    assert packing.best_fit_packing(docs.limit(0), tokenizer_path()).count() == 0


def test_rows_without_ids_are_spread(spark):
    docs = spark.createDataFrame([(None, "the same text " * 4)] * 4000, "doc_id long, text string")
    parts = packing.written(packing.pieces(docs, tokenizer_path()), "pieces")
    tokens = parts.agg({"length": "sum"}).first()[0]
    got = packing.packed(parts, task_tokens=tokens // 8).selectExpr("sequence_id >> 40 AS task").groupBy("task").count().collect()
    assert len(got) == 8 and max(r["count"] for r in got) < 800
