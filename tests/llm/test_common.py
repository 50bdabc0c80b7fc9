import tracemalloc

import numpy as np

from loomwork.llm import common
from loomwork.llm.common import Words, byte_class

SPACE = byte_class("nonspace")


def test_pieces_change_nothing(monkeypatch):
    """Words that cross pieces, one of several pieces, and grams over their ends."""
    rng = np.random.default_rng(1)
    data = rng.choice(np.frombuffer(b"abc  \n", np.uint8), 3000).tobytes() + b"x" * 500 + b" end  ab c"
    offsets = np.array([0, 1200, 2001, len(data)])
    whole = Words(data, offsets, SPACE)
    expected = [whole.starts, whole.ends, whole.first, whole.hashes, whole.grams(5), whole.grams(20, True)]
    for piece in (7, 64, 1001):
        monkeypatch.setattr(common, "PIECE", piece)
        w = Words(data, offsets, SPACE)
        for a, b in zip(expected, [w.starts, w.ends, w.first, w.hashes, w.grams(5), w.grams(20, True)], strict=True):
            assert (a == b).all()
    assert [data[a:b] for a, b in zip(whole.starts, whole.ends, strict=True)] == data.split()


def test_a_long_text_takes_bounded_memory():
    """Arrays of a number for each byte are made for a piece at a time: what stays is by word."""
    data = b"some words of a long text " * 400_000
    tracemalloc.start()
    w = Words(data, np.array([0, len(data)]), SPACE)
    w.grams(5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(w.hashes) == 2_400_000 and peak < 15 * len(data)
