"""Small tables with every awkward row, and plain versions of what operators do."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use for their own results.
_NAMES = (
    "_label label _id _tie _hash _row row text_hash score predicted n_words h1 h2 tie first place many start runs removed piece length ids_crc32 sequence_id offset deal hit_runs hit_items _runs _items "
    "n_hit contaminated spans masked base_sha256 k1 k2 copy_id class_id n_links grams bands set block blocks node root near open_text rare more word kept held_out line_scores passages item words count keep_rows"
).split()
CLASHING = "".join(f", {name} string" for name in _NAMES)


def awkward(spark, texts=(), clashing=False):
    """Nulls in every column, empty and long texts, ties, repeated rows, and the given texts after them."""
    word = random.Random(5)
    long = " ".join(word.choice(["alpha", "beta", "gamma", "delta", "x" * 300]) for _ in range(4000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "one"), (5, long), (6, "é ü \U0001f600 中文 a@b"), (7, "one")]
    rows += [(100 + i, t) for i, t in enumerate(texts)]
    data = [(i, t, None if k % 2 else "en", None, None if t is None else len(t), *(["x"] * len(_NAMES) if clashing else [])) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA + (CLASHING if clashing else ""))


def sentences(seed, n, words=40, vocabulary=3000):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words)) for _ in range(n)]


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
