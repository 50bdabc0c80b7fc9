"""Benchmark decontamination by winnowed fingerprints, whose hits are extended to whole windows of 13 words."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.common import LOWER, Words, byte_class, chunks, columns_added, utf8

WINDOW = 13
#: Words in a fingerprinted gram. Of each WINDOW - GRAM + 1 consecutive grams the least hash is kept, so every shared span of WINDOW words shares a fingerprint.
GRAM = 5
#: Items of up to about so many bytes of text are indexed at once; a larger benchmark is taken in blocks of this size. An item is never split.
BLOCK_BYTES = 32 << 20

_PLAIN = byte_class("plain")
RUN = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    if len(x) < w:
        return x[:0]
    out, done = x, 1
    while done < w:
        step = min(done, w - done)
        out, done = np.minimum(out[: len(out) - step], out[step:]), done + step
    return out


class Keys:
    """Sorted hashes, and which low bits they have: of most values these are no key's, so they need no search."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.bits = 16 if len(values) < 1 << 12 else 24
        self.low = np.zeros(1 << self.bits, bool)
        self.low[values & np.uint64((1 << self.bits) - 1)] = True

    def among(self, values: np.ndarray) -> np.ndarray:
        out = self.low[values & np.uint64((1 << self.bits) - 1)]
        maybe = np.flatnonzero(out)
        if len(maybe):
            at = np.minimum(np.searchsorted(self.values, values[maybe]), len(self.values) - 1)
            out[maybe] = self.values[at] == values[maybe]
        return out


class Windows:
    """Windows of one length, by hash: where each one's words stand in the index's text, and the item that has it."""

    def __init__(self, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray, text: bytes) -> None:
        order = np.lexsort((item, hashes))
        hashes, begin, end, item = hashes[order], begin[order], end[order], item[order]
        new = np.ones(len(hashes), bool)  # an item has each window once
        for k in (np.flatnonzero((hashes[1:] == hashes[:-1]) & (item[1:] == item[:-1])) + 1).tolist():
            new[k] = text[begin[k] : end[k]] != text[begin[k - 1] : end[k - 1]]
        self.keys = Keys(hashes[new])
        self.begin, self.end, self.item = begin[new].astype(np.int32), end[new].astype(np.int32), item[new].astype(np.int32)


class Index:
    """The windows of some benchmark items: fingerprints, then windows by hash, then their words and the items that hold them.

    Numbers in arrays and the items' words once: about four bytes for each byte of text, built in the time of a sort.
    """

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW, gram: int = GRAM) -> None:
        self.window, self.gram = window, gram
        self.items = sorted({item for item, _ in items})
        number = {item: k for k, item in enumerate(self.items)}
        own = np.array([number[item] for item, _ in items], np.int64)
        prints, texts, at = [np.zeros(0, np.uint64)], [], 0
        #: By length of the window (short items have shorter ones).
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for start, data, offsets in chunks([t.encode("utf-8", "surrogatepass").translate(LOWER) for _, t in items]):
            w = Words(data, offsets, _PLAIN)
            many = np.diff(w.first)
            length = w.ends - w.starts
            place = at + np.r_[0, np.cumsum(length + 1)]
            texts.append(w.text(0, len(length)))
            at += len(texts[-1]) + 1
            text = np.repeat(np.arange(len(many)), many)
            for size in np.unique(np.minimum(many[many > 0], window)).tolist():
                p = np.flatnonzero(w.within(size))
                p = p[many[text[p]] >= window] if size == window else p[many[text[p]] == size]
                found.setdefault(size, []).append((w.grams(size)[p], place[p], place[p + size - 1] + length[p + size - 1], own[start + text[p]]))
                if size == window:
                    prints.append(np.unique(least(w.grams(gram), window - gram + 1)[p]))
        self.text = b" ".join(texts)
        self.prints = Keys(np.unique(np.concatenate(prints)))
        self.windows = {size: Windows(*(np.concatenate(x) for x in zip(*parts, strict=True)), self.text) for size, parts in found.items()}

    def hits(self, w: Words) -> list[tuple[int, int, str]]:
        """(first word, words, item id) of every window that occurs, in any of the texts."""
        out = []
        for size, own in self.windows.items():
            places = np.arange(max(0, len(w.hashes) - size + 1))
            if size == self.window:  # fingerprints first, then the windows around them
                places = places[self.prints.among(least(w.grams(self.gram), self.window - self.gram + 1))]
            hashes = w.grams(size)
            places = places[w.within(size)[places]]
            places = places[own.keys.among(hashes[places])]
            first, last = (np.searchsorted(own.keys.values, hashes[places], side) for side in ("left", "right"))
            for p, a, b in zip(places.tolist(), first.tolist(), last.tolist(), strict=True):
                words = w.text(p, size)
                out += [(p, size, self.items[own.item[k]]) for k in range(a, b) if self.text[own.begin[k] : own.end[k]] == words]
        return out


def _apply(index: Index):
    def apply(column):
        texts = utf8(column)
        n_words, runs, items = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
        for start, data, offsets in chunks([t.translate(LOWER) for t in texts]):
            w = Words(data, offsets, _PLAIN)
            for i, n in enumerate(np.diff(w.first).tolist()):
                n_words[start + i] = n
            for p, size, item in sorted(index.hits(w)):
                i = int(np.searchsorted(w.first, p, "right")) - 1
                a, row = p - int(w.first[i]), runs[start + i]
                if row and row[-1]["b"] >= a:
                    row[-1]["b"] = max(row[-1]["b"], a + size)
                else:
                    row.append({"a": a, "b": a + size})
                items[start + i].add(item)
        return {"n_words": n_words, "hit_runs": runs, "hit_items": [sorted(x) for x in items]}

    return apply


_FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("hit_runs", T.ArrayType(RUN)), T.StructField("hit_items", T.ArrayType(T.StringType()))]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    items = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("null")).alias("item"), F.col(f"`{text_col}`").alias("words")).where("words is not null")
    size = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    return [items] if n == 1 else [items.where(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == k) for k in range(n)]


def _indexed(documents: DataFrame, block: DataFrame, text_col: str) -> DataFrame:
    """documents with n_words, hit_runs and hit_items for one block, whose size _blocks has bounded."""
    shared = documents.sparkSession.sparkContext.broadcast([tuple(r) for r in block.collect()])
    key = uuid.uuid4().hex
    return columns_added(documents, [text_col], _FIELDS, lambda: _apply(_built(key, shared)))


#: The index that this worker built last.
_INDEXES: dict[str, Index] = {}


def _built(key: str, shared) -> Index:
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = Index(shared.value)
    return _INDEXES[key]


def with_hits(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """documents with n_words, n_hit, n_items, items_sha256, contaminated, hit_runs (word ranges) and hit_items.

    Words are runs of 0-9, a-z and what is beyond ASCII, A-Z in lower case. A benchmark of several blocks takes one pass for
    each over what the last one returned, so no block's index grows with the benchmark. A null text has no words; an item
    with a null id is listed as null, one with a null text or no words is left out; items of one id are one item; repeated
    documents are treated one by one; empty tables give no rows or no hits. New columns replace documents' of their names.
    """
    out = documents
    for k, block in enumerate(_blocks(benchmark, item_col, item_text_col, block_bytes)):
        before = f"before {uuid.uuid4().hex}"  # a name that documents can't have
        out = _indexed(out.select("*", *[F.struct("hit_runs", "hit_items").alias(before)] * (k > 0)), block, text_col)
        if k:
            had = F.col(f"`{before}`")
            out = out.withColumns({"hit_runs": F.concat(had["hit_runs"], "hit_runs"), "hit_items": F.array_distinct(F.concat(had["hit_items"], "hit_items"))}).drop(before)
    # Words hit: the ranges by their begins, each counted from where those before it end.
    counted = F.aggregate(
        F.array_sort("hit_runs"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), r["b"] - F.greatest(s["end"], r["a"]))).alias("n"), F.greatest(s["end"], r["b"]).alias("end")),
        lambda s: s["n"],
    )
    out = out.withColumn("n_hit", counted).withColumn("n_items", F.size("hit_items").cast("long"))
    out = out.withColumn("items_sha256", F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


COLUMNS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def contamination(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: the id and COLUMNS; see with_hits."""
    return with_hits(documents.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), benchmark, "text", item_col, item_text_col).select("doc_id", *COLUMNS)


def decontaminated(documents: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that aren't contaminated, with the columns they had. Null texts and those without words stay; repeated rows are treated one by one; empty tables give no rows, or all."""
    return with_hits(documents.select(F.struct("*").alias("row"), F.col(f"`{text_col}`").alias("text")), benchmark).where("not contaminated").select("row.*")
