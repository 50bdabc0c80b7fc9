"""Periodic runs: maximal stretches of words that repeat with a period, by suffix trees and Lyndon roots.

Every run has a root that is a longest Lyndon word under the order of the words or under its reverse. So there are two candidates for
each word, and each is extended to both sides by the longest common extensions of two suffixes and of two prefixes. These come from
Ukkonen's trees of the document and of its reversal: an extension is the string depth of the lowest common ancestor, which
an Euler tour and a table of minima give in constant time.

Words of a run of LEAST words or more lie in grams of GRAM words that occur twice in the run. So what no such gram covers is cut
out first, and a separator that occurs once takes its place: the trees stand over what may be periodic, at its own places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.common import Words, byte_class, chunks, columns_added, mixed, utf8

#: A run has so many words at least, and two periods.
LEAST = 12
#: In such a run words GRAM apart or more agree with those one period before: LEAST words less a period of half as many, or one of two longer periods.
GRAM = LEAST // 2
_SPACE = byte_class("nonspace")

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


class SuffixTree:
    """Ukkonen's tree of a list of small numbers whose last one occurs once, with its leaves' order and extensions between suffixes."""

    def __init__(self, s: list[int]) -> None:
        self.size = len(s)
        self._grow(s)
        self._tour()

    def _grow(self, s: list[int]) -> None:
        n, width = len(s), max(s) + 1
        #: Node and first symbol, as one number, to the child there. An edge has the symbols from begin to end of its child.
        child: dict[int, int] = {}
        begin, end, link = [0], [0], [0]
        node = at = length = waiting = 0
        for i, symbol in enumerate(s):
            waiting, lonely = waiting + 1, 0
            while waiting:
                if not length:
                    at = i
                key = node * width + s[at]
                below = child.get(key)
                if below is None:
                    child[key] = len(begin)
                    begin.append(i)
                    end.append(n)
                    link.append(0)
                    top = node
                else:
                    start = begin[below]
                    span = end[below] - start
                    if length >= span:
                        node, at, length = below, at + span, length - span
                        continue
                    if s[start + length] == symbol:
                        length += 1
                        if lonely:
                            link[lonely] = node
                        break
                    top = child[key] = len(begin)
                    begin += (start, i)
                    end += (start + length, n)
                    link += (0, 0)
                    begin[below] = start + length
                    child[top * width + symbol] = top + 1
                    child[top * width + s[start + length]] = below
                if lonely:
                    link[lonely] = top
                lonely = top
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    at = i - waiting + 1
        count = len(child)
        keys, to = np.fromiter(child.keys(), np.int64, count), np.fromiter(child.values(), np.int64, count)
        order = np.argsort(keys)
        self._parents, self._children = keys[order] // width, to[order]
        self._spans = np.array(end, np.int64) - np.array(begin, np.int64)

    def _tour(self) -> None:
        """The Euler tour's first visits in the order of the symbols: at each the string depth of its parent, whose minima are the depths of common ancestors."""
        nodes = len(self._spans)
        cuts = np.searchsorted(self._parents, np.arange(nodes + 1)).tolist()
        children, span = self._children.tolist(), self._spans.tolist()
        depth, above, leaves, visit = [0] * nodes, [], [], []
        stack, pending = [0], [0]
        while stack:
            v = stack.pop()
            d = pending.pop()
            depth[v] = d + span[v]
            a, b = cuts[v], cuts[v + 1]
            if a == b:
                leaves.append(self.size - depth[v])
                visit.append(len(above))
            else:
                stack += children[a:b][::-1]
                pending += [depth[v]] * (b - a)
            above.append(d)
        #: Suffixes in order, each one's rank, and the place of its leaf in the tour.
        self.order = np.array(leaves, np.int64)
        self.rank = np.empty(self.size, np.int64)
        self.rank[self.order] = np.arange(self.size)
        self._visit = np.empty(self.size, np.int64)
        self._visit[self.order] = visit
        self._minima = [np.array(above, np.int32)]
        while (step := 1 << (len(self._minima) - 1)) * 2 <= len(above):
            low = self._minima[-1]
            self._minima.append(np.minimum(low[:-step], low[step:]))
        del self._parents, self._children, self._spans

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols that suffixes i and j, different ones, begin with alike."""
        u, v = self._visit[i], self._visit[j]
        a, b = np.minimum(u, v) + 1, np.maximum(u, v) + 1
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            some = np.flatnonzero(level == k)
            table = self._minima[k]
            out[some] = np.minimum(table[a[some]], table[b[some] - (1 << k)])
        return out


def _next_smaller(rank: list[int]) -> np.ndarray:
    out, stack = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out, np.int64)


def runs(symbols: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a list of numbers from 1 on: of two periods at least, and of least symbols; by start, then period."""
    n = len(symbols)
    if n < least:
        return []
    tree = SuffixTree([*symbols, 0])
    rank = tree.rank[:n]
    place = np.arange(n)
    # The longest Lyndon word at i ends where the next smaller suffix begins; in the reverse order, the next greater.
    ends = [_next_smaller(r.tolist()) for r in (rank, n - rank)]
    i, j = np.tile(place, 2), np.concatenate(ends)
    right = np.zeros(2 * n, np.int64)
    inside = np.flatnonzero(j < n)
    right[inside] = tree.common(i[inside], j[inside])
    del tree
    back = SuffixTree([*symbols[::-1], 0])
    left = np.zeros(2 * n, np.int64)
    inside = np.flatnonzero(i > 0)
    left[inside] = back.common(n - i[inside], n - j[inside])
    period = j - i
    start, length = i - left, left + period + right
    some = np.flatnonzero(length >= np.maximum(least, 2 * period))
    # Suffixes that end the text also give multiples of a run's period, for the same stretch: its smallest period counts.
    smallest: dict[tuple[int, int], int] = {}
    for a, k, q in zip(start[some].tolist(), length[some].tolist(), period[some].tolist(), strict=True):
        smallest[a, k] = min(q, smallest.get((a, k), q))
    return sorted(((a, k, q) for (a, k), q in smallest.items()), key=lambda r: (r[0], r[2]))


def narrowed(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Numbers of the stretches that may hold runs, -1 elsewhere. owner: the text of each word. Again and again, what no gram that a stretch has twice covers goes, and so do stretches that are too short."""
    owner = owner.copy()
    kept = -1
    while True:
        n = len(owner) - GRAM + 1
        at = np.flatnonzero((owner[:n] >= 0) & (owner[:n] == owner[GRAM - 1 :])) if n > 0 else np.zeros(0, np.int64)
        key = mixed(owner[at].astype(np.uint64))
        for k in range(GRAM):
            key = mixed(key ^ hashes[at + k])
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = at[order][np.r_[same, False] | np.r_[False, same]] if len(at) else at
        edge = np.zeros(len(owner) + 1, np.int32)
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + GRAM, -1)
        covered = np.cumsum(edge[:-1]) > 0
        begin = covered & np.r_[True, ~covered[:-1] | (owner[1:] != owner[:-1])]
        number = np.where(covered, np.cumsum(begin) - 1, -1)
        long = np.bincount(number[covered], minlength=1) >= LEAST
        owner = np.where(covered & long[number], number, -1)
        if (now := int((owner >= 0).sum())) == kept or not now:
            return owner
        kept = now


def document_runs(words: list[bytes], stretch: np.ndarray) -> list[tuple[int, int, int]]:
    """The runs of one text: words in stretches (from narrowed) become numbers, equal ones alike, and a number of its own stands between stretches."""
    places = np.flatnonzero(stretch >= 0)
    if not len(places):
        return []
    known: dict[bytes, int] = {}
    symbols, at, separator = [], [], -1
    before = int(stretch[places[0]])
    for p, s in zip(places.tolist(), stretch[places].tolist(), strict=True):
        if s != before:
            symbols.append(separator)
            at.append(-1)
            separator, before = separator - 1, s
        symbols.append(known.setdefault(words[p], len(known) + 1))
        at.append(p)
    symbols = [s if s > 0 else len(known) - s for s in symbols]
    return [(at[a], n, q) for a, n, q in runs(symbols)]


def _without_repeats(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by one space, without those that a run has after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    gone = np.cumsum(gone) > 0
    return b" ".join(w for w, g in zip(words, gone.tolist(), strict=False) if not g)


def _found(column: pa.Array) -> dict:
    texts = utf8(column)
    n_words, out, collapsed = [0] * len(texts), [[] for _ in texts], [b""] * len(texts)
    for first, data, offsets in chunks(texts):
        w = Words(data, offsets, _SPACE)
        many = np.diff(w.first)
        stretch = narrowed(w.hashes, np.repeat(np.arange(len(many)), many))
        for i, n in enumerate(many.tolist()):
            a = int(w.first[i])
            n_words[first + i] = n
            if n == 0 or stretch[a : a + n].max() < 0:
                collapsed[first + i] = w.text(a, n)
                continue
            words = [data[x:y] for x, y in zip(w.starts[a : a + n].tolist(), w.ends[a : a + n].tolist(), strict=True)]
            found = document_runs(words, stretch[a : a + n])
            out[first + i] = [{"start": s, "length": k, "period": q} for s, k, q in found]
            collapsed[first + i] = _without_repeats(words, found)
    return {"n_words": n_words, "runs": out, "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string())}


def periodic_runs(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """documents with n_words, runs (start, length, period; by start, then period) and collapsed, the text without what runs repeat.

    Words are whatever stands between spaces and the control characters 9 to 13, numbered from 0. A run is a stretch of words with
    smallest period q, of LEAST words and two periods at least, that no neighbouring word extends. Words that a run has
    after its first q words go from collapsed, whose words are joined by one space. Null and empty texts have no words and
    no runs. Rows, repeated ones and those without an id too, are treated one by one, and an empty table gives no rows; new
    columns replace documents' of their names. A task holds the trees of one document at a time: some 400 bytes for each word
    in stretches that may be periodic.
    """
    fields = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]
    return columns_added(documents, [text_col], fields, lambda: _found)


def run_digests(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_runs, its longest run (ties: the smallest start, then period) as start, length, period and exponent_milli, and digests of all runs and of what stays. See periodic_runs."""
    docs = documents.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = periodic_runs(docs).select("doc_id", "runs", "collapsed")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("less"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.withColumn("best", best).select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.before")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.less")).alias("period"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * length div period")
    return out.select("doc_id", "n_runs", "start", "length", "period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def _turned(ids: pa.Array, column: pa.Array) -> dict:
    """Of each tenth id by its checksum, the text with its later words turned into repeats of some of them."""
    import zlib

    texts: list[str | None] = column.to_pylist()
    for k, (i, text) in enumerate(zip(ids.to_pylist(), texts, strict=True)):
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and text:
            w = Words(data := text.encode("utf-8", "surrogatepass") + b" ", np.array([0, len(data)]), _SPACE)
            if n := len(w.starts):
                g = h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                order = np.r_[np.arange(a), a + np.arange(n - a) % p]
                texts[k] = b" ".join(data[x:y] for x, y in zip(w.starts[order].tolist(), w.ends[order].tolist(), strict=True)).decode("utf-8", "surrogatepass")
    return {"text": texts}


def with_planted_periods(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): documents of which a tenth, by a checksum of the id, has a periodic end, made of its own words. Null ids and texts without words stay as they are."""
    docs = documents.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return columns_added(docs, ["doc_id", "text"], [T.StructField("text", T.StringType())], lambda: _turned)
