"""Encodings told by what their decoding reads like: pairs of kinds of characters, weighed by tables that were encoded on purpose.

A text in the wrong encoding has letters with marks beside each other, capitals inside words, signs between letters and characters
that hardly anybody uses. What each such pair tells is learned from texts whose encoding is known: they are encoded in each way that can
hold them, and decoded in each way that goes. Kinds are the same for all scripts, so what Latin texts teach holds for others. Where a few
letters leave open what kinds they are, those that the known texts have too are likelier.
"""

from __future__ import annotations

import re
import string
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings that are looked for, the first of equals first (fixed values: candidates, and below how many bytes only a clear case counts).
CANDIDATES = ("cp1252", "latin_1", "iso8859_15", "mac_roman", "cp1251", "koi8_r", "gb18030", "big5", "shift_jis", "euc_jp", "euc_kr")
LEAST_BYTES = 128
#: Lead bytes of the characters that are in use every day, where an encoding has such a range, and the least second byte of these.
EVERYDAY = {"gb18030": (0xB0, 0xD7, 0xA1), "big5": (0xA4, 0xC6, 0x40), "shift_jis": (0x88, 0x97, 0x40), "euc_jp": (0xB0, 0xCF, 0xA1)}
#: A mean weight that is clear in a few bytes too, and texts to learn from, at most.
CLEAR, TEXTS = 1.0, 2_000
#: Small and capital letters, letters with marks of both sizes, letters without size, rare ones, digits, blanks, punctuation, other signs, controls.
KINDS = "aAéÉ字罕0 .§\0"

#: Pairs of rare letters that a word of two alphabets counts for.
MIXED = 3

BEYOND = re.compile(r"[^\x00-\x7F]")

#: Of which share of the known texts' characters beyond ASCII on one is familiar, and what being e times as frequent counts for, in pairs' weights.
LEAST_SHARE, FAMILIAR = 1e-6, 0.4
#: What a text counts for that has more letters with marks than without.
OTHERS = -1.5


class Weights(NamedTuple):
    """Of pairs of kinds, and of characters beyond ASCII that the known texts have; others have none."""

    pairs: np.ndarray
    characters: dict[str, float]


@lru_cache(1 << 16)
def kind(c: str, encoding: str) -> int:
    if c.isascii():
        return KINDS.index("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else " " if c.isspace() else "\0" if ord(c) < 32 else ".")
    category = unicodedata.category(c)
    if category[0] == "L":
        name = unicodedata.name(c, "")
        if category == "Lm" and not name.startswith("KATAKANA") or name.startswith("LATIN") and not (c < "\u0180" or "\u0218" <= c <= "\u021b" or "\u1e00" <= c <= "\u1eff"):
            return KINDS.index("罕")  # modifiers, ligatures and a florin are in no language's alphabet
        if name.startswith(("LATIN", "GREEK")):
            return KINDS.index("É" if c.isupper() else "é")
        if name.startswith("CYRILLIC"):
            everyday = "а" <= c.lower() <= "я" or c in "ёЁ"
            return KINDS.index("罕" if not everyday else "A" if c.isupper() else "a")
        if name.startswith(("HIRAGANA", "KATAKANA LETTER", "KATAKANA-HIRAGANA")):
            return KINDS.index("字") if encoding in ("shift_jis", "euc_jp") else KINDS.index("罕")
        if name.startswith("HANGUL SYLLABLE"):
            return KINDS.index("a" if encoding == "euc_kr" else "罕")  # syllables are words' letters, with blanks between
        low, high, second = EVERYDAY.get(encoding, (256, 256, 256))
        code = c.encode(encoding, "ignore")
        return KINDS.index("字" if len(code) == 2 and low <= code[0] <= high and code[1] >= second else "罕")
    return KINDS.index(" " if category[0] == "Z" else "0" if category[0] == "N" else "." if category in ("Pd", "Ps", "Pe", "Pi", "Pf", "Po") and c in "«»“”‘’„–—…、。「」（）！？：；，·¿¡" else "\0" if category[0] == "C" else "§")


def pairs(text: str, encoding: str) -> np.ndarray:
    """How often which kinds stand beside each other, where one of the two is not ASCII. A letter of another alphabet beside an ASCII one counts as MIXED pairs of rare letters, as no word has both. So does one that has none of its own beside it, if most letters are ASCII or one of these is beside it."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    unique, back = np.unique(codes, return_inverse=True)
    kinds = np.array([kind(chr(c), encoding) for c in unique.tolist()], np.int64)[back] if len(unique) else back
    beyond = codes > 127
    some = beyond[1:] | beyond[:-1]
    n = len(KINDS)
    letter = (kinds == KINDS.index("a")) | (kinds == KINDS.index("A"))
    mixed = letter[1:] & letter[:-1] & (beyond[1:] != beyond[:-1])
    own = letter & beyond | (kinds == KINDS.index("字"))
    around = np.concatenate([[False], own, [False]])
    alone = own & ~around[:-2] & ~around[2:]
    if own.sum() > (letter & ~beyond).sum():
        around = np.concatenate([[False], letter & ~beyond, [False]])
        alone &= around[:-2] | around[2:]
    mixed |= alone[1:] | alone[:-1]
    both = np.where(mixed, KINDS.index("罕") * (n + 1), kinds[:-1] * n + kinds[1:])
    return np.bincount(both[some], weights=np.where(mixed, MIXED, 1)[some], minlength=n * n).astype(np.int64)


def decoding(data: bytes, encoding: str) -> str | None:
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        return None


def learned(texts: DataFrame, text_col: str = "text", most: int = TEXTS) -> Weights:
    """Log-odds of pairs of kinds, right against wrong, and shares of characters beyond ASCII, from at most so many texts beyond ASCII, chosen by their hashes. Each task counts its own; only the sums leave it."""
    size = len(KINDS) ** 2

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size), np.int64)
        having: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                having.update(BEYOND.findall(text))
                for encoding in CANDIDATES[:4]:
                    try:
                        data = text.encode(encoding)
                    except UnicodeEncodeError:
                        continue
                    right = pairs(text, encoding)
                    total[0] += right
                    for other in CANDIDATES:
                        # Decodings of the same text are no worse.
                        if other != encoding and (wrong := decoding(data, other)) is not None and wrong != text:
                            total[1] += pairs(wrong, other)
        # Rows of pairs have a place, those of characters have none.
        places, characters = pa.array([*range(size), *[None] * len(having)], pa.int32()), pa.array([*[None] * size, *having], pa.string())
        yield pa.RecordBatch.from_arrays([places, characters, pa.array([*total[0].tolist(), *having.values()], pa.int64()), pa.array([*total[1].tolist(), *[0] * len(having)], pa.int64())], names=["place", "character", "n", "wrong"])

    some = texts.select(F.col(text_col).alias("text")).where(F.col("text").rlike("[^\\x00-\\x7F]")).distinct().orderBy(F.xxhash64("text")).limit(most)
    rows = some.mapInArrow(run, "place int, character string, n bigint, wrong bigint").groupBy("place", "character").agg(F.sum("n").alias("n"), F.sum("wrong").alias("wrong")).collect()
    counts = np.ones((2, size)) * 0.5
    for r in rows:
        if r["place"] is not None:
            counts[:, r["place"]] += r["n"], r["wrong"]
    share = counts / counts.sum(axis=1, keepdims=True)
    having = {r["character"]: r["n"] for r in rows if r["character"] is not None}
    least = LEAST_SHARE * sum(having.values())
    return Weights(_full(np.clip(np.log(share[0] / share[1]), -4, 4)), {c: FAMILIAR * float(np.log(n / least)) for c, n in having.items() if n > least})


def likely(data: bytes, weights: Weights) -> tuple[str, str] | None:
    """(text, encoding) of the candidate that reads best, or None: of a few bytes only if it is clear, and better than the first."""
    best: tuple[float, str, str] | None = None
    read: set[str] = set()
    for encoding in CANDIDATES:
        if (text := decoding(data, encoding)) is None or text in read:
            continue
        read.add(text)
        found = pairs(text, encoding)
        n = int(found.sum())
        score = (float(weights.pairs @ found) / n if n else 0.0) + _alphabet(text, encoding, weights)
        if best is None or score > best[0] + 1e-9:
            best = score, text, encoding
    if best is None or len(data) < LEAST_BYTES and (best[0] < CLEAR or best[2] not in CANDIDATES[:1]):
        return None
    return best[1], best[2]


def _alphabet(text: str, encoding: str, weights: Weights) -> float:
    """What the letters count for, whatever stands beside them: familiar ones for their share, in a text whose letters are ASCII mostly; in one whose letters are not, no Latin alphabet."""
    beyond = Counter(BEYOND.findall(text))
    if sum(m for c, m in beyond.items() if c.isalpha()) > sum(map(text.count, string.ascii_letters)):
        return OTHERS if encoding in CANDIDATES[:4] else 0.0
    return sum(weights.characters.get(c, 0.0) * m for c, m in beyond.items()) / max(beyond.total(), 1)


def _full(weights: np.ndarray) -> np.ndarray:
    """Weights of pairs with those of letters without size, and of everyday letters of other alphabets, beside each other and beside all else, as the texts learned from may have none: everyday letters are as good as small ones, rare ones as bad as it gets."""
    n = len(KINDS)
    out = weights.reshape(n, n).copy()
    own, rare = KINDS.index("字"), KINDS.index("罕")
    out[own, :], out[:, own] = 1.0, 1.0
    small, capital = KINDS.index("a"), KINDS.index("A")
    # Pairs of ASCII letters are never counted: these are of an alphabet of its own.
    out[small, small], out[capital, small], out[small, capital], out[capital, capital] = 2.0, 2.0, -4.0, 0.0
    blank, stop = KINDS.index(" "), KINDS.index(".")
    for beside in (blank, stop):
        out[small, beside] = out[beside, small] = out[beside, capital] = 1.0
    out[own, blank] = out[blank, own] = 0.0  # scripts without size have no blanks between words
    out[rare, :], out[:, rare] = -4.0, -4.0
    marked = [KINDS.index("é"), KINDS.index("É")]
    out[np.ix_(marked, marked)] = np.minimum(out[np.ix_(marked, marked)], -1.0)  # two in a row are rare in any language
    return out.ravel()
