"""Suffix-array dedup: what stands twice, to the byte, is found in sorted suffixes that are compared by hashes.

Of each window of WINDOW bytes the anchor, its least gram, is a place that equal windows share. Suffixes are sorted where anchors
stand: prefix hashes and a binary search give two suffixes' common extension, so a comparison takes the logarithm of its
length, in a mergesort that goes through many groups of equal anchors side by side. Neighbours are then compared byte by byte; a
group in which hashes lied is compared plainly. The extensions to the right, as a tree of merging groups, and those to the left, in
the order of the bytes before, show the outermost windows around each anchor that stand elsewhere too.

Only anchors that a count-min sketch holds for repeated leave their tasks, with the windows around them as one segment; equal segments
that a task holds leave it as one, and are settled. An anchor in too many different segments, as at the edges of a passage that all
documents share, is no group: its windows are told apart by their own hashes instead, in parts of bounded size, and once more across
these. Equal texts are one text.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm import common
from loomwork.llm.common import chunks, columns_added, discarded, mixed, rolling, sliced, utf8, written
from loomwork.llm.decontamination import least
from loomwork.llm.substrings import Sketch, _bits, _hashes, _one_of_each_text, _sketch, partition_sketches

WINDOW, GRAM = 200, 32
#: An anchor begins about every so many bytes.
APART = (WINDOW - GRAM + 2) // 2
#: Long texts are read in pieces of so many windows.
PIECE_BYTES = 1 << 19
#: Bytes of segments that a task holds at once to meet equal ones, and that it sorts at once.
HELD_BYTES, SORTED_BYTES = 1 << 25, 1 << 19
#: Different segments of a group at most, and anchors that may have more: where segments are many, groups may be as large as a share of them.
MOST_SEGMENTS, MOST_HOT = 512, 1 << 20
#: Segments whose single windows are compared at once.
HELD_SEGMENTS = 2048
_PLACE = np.uint64((1 << 28) - 1)

GONE = T.StructType([T.StructField(c, T.LongType()) for c in ("h1", "h2", "start", "end")])
SEGMENT = T.StructType([T.StructField("anchor", T.LongType()), *GONE.fields[:3], T.StructField("off", T.IntegerType()), T.StructField("many", T.IntegerType()), T.StructField("segment", T.BinaryType()), T.StructField("end", T.LongType())])


def pieces(texts: list[bytes], window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, bytes, np.ndarray]]:
    """Texts joined in groups, long ones in pieces that overlap so that each window is in one: of each piece its text and its place there, then the group's bytes, and where each piece begins."""
    parts = [(i, a) for i, t in enumerate(texts) for a in range(0, max(1, len(t) - window + 1), PIECE_BYTES)]
    number, shift = np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64)
    for first, data, offsets in chunks([texts[i][a : a + PIECE_BYTES + window - 1] for i, a in parts]):
        some = slice(first, first + len(offsets) - 1)
        yield number[some], shift[some], data, offsets


def anchors(data: bytes, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the windows inside pieces begin, where each one's anchor does (the least hash, leftmost among equals), and the hashes of all grams."""
    sizes = np.maximum(np.diff(offsets) - 1 - window + 1, 0)
    starts = np.repeat(offsets[:-1] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    hashes = rolling(common._TABLE[np.frombuffer(data, np.uint8)], gram, common._BYTES)
    low = least((hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64), window - gram + 1)
    return starts, (low[starts] & _PLACE).astype(np.int64), hashes


def segments(sketch: Sketch, data: bytes, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(hash, anchor, first window, last window) of each run of windows with one anchor that may stand elsewhere."""
    starts, at, hashes = anchors(data, offsets, window, gram)
    if not len(starts):
        return hashes, starts, starts, starts
    first = np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]
    begin = np.flatnonzero(first)
    last = np.r_[begin[1:], len(starts)] - 1
    own = hashes[at[begin]]
    may = sketch.may_repeat(own)
    return own[may], at[begin][may], starts[begin][may], starts[last][may]


# ---- sorting ---------------------------------------------------------------------------------------------------------


class Suffixes:
    """Segments of bytes, joined, each with a place in it (its anchor): what two have in common from there to the right or to the left, by prefix hashes."""

    def __init__(self, texts: list[bytes], off: np.ndarray) -> None:
        self.data = b"".join(texts)
        self.buffer = np.frombuffer(self.data, np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.at = np.r_[0, np.cumsum(sizes)[:-1]] + off
        #: Bytes there are to the left and to the right of the place.
        self.room = {-1: off.astype(np.int64), 1: sizes - off}
        self._at, self._room = self.at.tolist(), {side: x.tolist() for side, x in self.room.items()}
        up, self._down = common._BYTES.upto(len(self.buffer) + 1)
        self._sums = np.zeros(len(self.buffer) + 1, np.uint64)
        np.cumsum(common._TABLE[self.buffer] * up[:-1], out=self._sums[1:])

    def _hash(self, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self._sums[begin + size] - self._sums[begin]) * self._down[begin]

    def common(self, x: np.ndarray, y: np.ndarray, side: int) -> np.ndarray:
        """Bytes alike on that side of x's and y's places, by binary search."""
        low, high = np.zeros(len(x), np.int64), np.minimum(self.room[side][x], self.room[side][y])
        a, b = self.at[x], self.at[y]
        while (low < high).any():
            middle = (low + high + 1) >> 1
            back = middle if side < 0 else 0
            same = self._hash(a - back, middle) == self._hash(b - back, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def _byte(self, x: np.ndarray, n: np.ndarray, side: int) -> np.ndarray:
        """The n-th byte on that side, and -1 beyond the segment."""
        at = self.at[x] + n if side > 0 else self.at[x] - 1 - n
        inside = n < self.room[side][x]
        return np.where(inside, self.buffer[np.where(inside, at, 0)].astype(np.int64), -1)

    def less(self, x: np.ndarray, y: np.ndarray, side: int) -> np.ndarray:
        n = self.common(x, y, side)
        return self._byte(x, n, side) < self._byte(y, n, side)

    def sorted(self, sizes: np.ndarray, side: int) -> np.ndarray:
        """Places in order, within each of the groups of those sizes: runs double, and an element's rank in the other run is found by binary search."""
        base = np.repeat(np.r_[0, np.cumsum(sizes)[:-1]], sizes)
        size = np.repeat(sizes, sizes)
        order = np.arange(len(base))
        local = order - base
        run = 1
        while run < sizes.max(initial=0):
            own = local // run
            other = (own ^ 1) * run
            some = np.flatnonzero((size > run) & (other < size))
            x, low, high = order[some], other[some], np.minimum(other[some] + run, size[some])
            right = own[some] % 2 == 1  # equals of the left run come first
            while len(open_ := np.flatnonzero(low < high)):
                middle = (low[open_] + high[open_]) >> 1
                y, mine = order[base[some[open_]] + middle], x[open_]
                before = np.where(right[open_], ~self.less(mine, y, side), self.less(y, mine, side))
                low[open_], high[open_] = np.where(before, middle + 1, low[open_]), np.where(before, high[open_], middle)
            to = base[some] + np.minimum(own[some] * run, other[some]) + local[some] % run + low - other[some]
            order[to] = x
            run *= 2
        return order

    def holds(self, x: int, y: int, n: int, side: int) -> bool:
        """Whether y follows x, and n bytes are alike and no more: the bytes themselves."""
        a, b, data = self._at[x], self._at[y], self.data
        if side < 0 and data[a - n : a] != data[b - n : b] or side > 0 and data[a : a + n] != data[b : b + n]:
            return False
        one, other = (data[at + n if side > 0 else at - 1 - n] if n < self._room[side][z] else -1 for z, at in ((x, a), (y, b)))
        return one < other or one == other == -1


def outermost(texts: list[bytes], off: np.ndarray, sizes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For each segment, whose groups of two or more stand together: how far to the left and to the right of its place the windows reach that another one of its group has too; 0 and 0: none."""
    s = Suffixes(texts, off)
    left, right = np.zeros(len(off), np.int64), np.zeros(len(off), np.int64)

    def meet(x, y, l, r) -> None:  # noqa: E741
        np.maximum.at(left, np.r_[x, y], np.r_[l, l])
        np.maximum.at(right, np.r_[x, y], np.r_[r, r])

    order = s.sorted(sizes, 1)
    ends = np.cumsum(sizes)
    x, y = order[:-1], order[1:]
    r = s.common(x, y, 1)
    group = np.repeat(np.arange(len(sizes)), sizes)
    doubtful = {g for g, h, a, b, n in zip(group.tolist(), group[1:].tolist(), x.tolist(), y.tolist(), r.tolist(), strict=False) if g == h and not s.holds(a, b, n, 1)}
    # Where hashes lie, comparisons may contradict each other, and a place be taken twice.
    doubtful |= set(group[np.bincount(order, minlength=len(order)) != 1].tolist())
    pair = np.flatnonzero(sizes == 2)
    a, b = order[ends[pair] - 2], order[ends[pair] - 1]
    n = s.common(a, b, -1)
    wrong_left = [s.data[s.at[i] - k : s.at[i]] != s.data[s.at[j] - k : s.at[j]] for i, j, k in zip(a.tolist(), b.tolist(), n.tolist(), strict=True)]
    good = (n + r[ends[pair] - 2] >= window) & ~np.array(wrong_left, bool)
    meet(a[good], b[good], n[good], r[ends[pair] - 2][good])
    doubtful |= {int(p) for p, w in zip(pair, wrong_left, strict=True) if w}
    many = np.flatnonzero(sizes > 2)
    if len(many):
        inside = np.concatenate([np.arange(ends[g] - sizes[g], ends[g]) for g in many])
        part = Suffixes([texts[k] for k in inside], off[inside])
        back, at = part.sorted(sizes[many], -1), 0
        before = part.common(back[:-1], back[1:], -1)
        for g in many.tolist():
            m, lo = int(sizes[g]), int(ends[g] - sizes[g])
            leftward = (back[at : at + m] - at).tolist()
            rank = [0] * m
            for k, e in enumerate(leftward):
                rank[e] = k
            if g not in doubtful and len(set(leftward)) == m and all(part.holds(at + p, at + q, k, -1) for p, q, k in zip(leftward, leftward[1:], before[at : at + m - 1].tolist(), strict=False)):
                found = _merged([rank[e - lo] for e in order[lo : lo + m].tolist()], r[lo : lo + m - 1].tolist(), before[at : at + m - 1].tolist(), window)
                for k, (n_left, n_right) in enumerate(found):
                    left[lo + leftward[k]], right[lo + leftward[k]] = n_left, n_right
            else:
                doubtful.add(g)
            at += m
    for g in doubtful:
        some = range(int(ends[g] - sizes[g]), int(ends[g]))
        left[some], right[some] = np.array(plainly([texts[k] for k in some], off[some], window)).T
    return left, right


def _merged(ranks: list[int], right: list[int], before: list[int], window: int) -> list[tuple[int, int]]:
    """By the rank to the left: the furthest reach to the left and right. ranks: members in the order to the right; right and before: what neighbours have in common in the orders to the right and to the left.

    From the longest extension to the right down, groups merge, the smaller into the larger, which stands in the order to the
    left: so each meets the member that has most in common with it to the left among those that have as much to the right.
    """
    reach = [[0, 0] for _ in ranks]
    cluster = [[k] for k in ranks]
    where = list(range(len(ranks)))
    for i in sorted(range(len(right)), key=lambda k: -right[k]):
        a, b = _root(where, i), _root(where, i + 1)
        if len(cluster[a]) < len(cluster[b]):
            a, b = b, a
        large = cluster[a]
        for v in cluster[b]:
            k = bisect_left(large, v)
            for u in large[max(k - 1, 0) : k + 1]:
                n = min(before[min(u, v) : max(u, v)])
                if n + right[i] >= window:
                    for one in (reach[u], reach[v]):
                        one[0], one[1] = max(one[0], n), max(one[1], right[i])
            large.insert(k, v)
        cluster[b] = []
        where[b] = a
    return [tuple(x) for x in reach]


def _root(where: list[int], k: int) -> int:
    while where[k] != k:
        where[k] = where[where[k]]
        k = where[k]
    return k


def plainly(texts: list[bytes], off: np.ndarray, window: int) -> list[tuple[int, int]]:
    """The same as outermost for one group, by comparing all its windows."""
    seen: dict[tuple[int, bytes], int] = {}
    places = [(k, o) for k, t in enumerate(texts) for o in range(max(0, window - len(t) + int(off[k])), int(off[k]) + 1)]
    for k, o in places:
        key = (o, texts[k][off[k] - o : off[k] - o + window])
        seen[key] = seen.get(key, 0) + 1
    out = [(0, 0)] * len(texts)
    for k, o in places:
        if seen[o, texts[k][off[k] - o : off[k] - o + window]] > 1:
            out[k] = (max(out[k][0], o), max(out[k][1], window - o))
    return out


# ---- over the corpus -----------------------------------------------------------------------------------------------


def joined_runs(h1: np.ndarray, h2: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of bytes by text, those that meet as one."""
    order = np.lexsort((start, h2, h1))
    h1, h2, start, end = h1[order], h2[order], start[order], end[order]
    if not len(order):
        return h1, h2, start, end
    text = np.cumsum(np.r_[0, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
    # Ends so far in this text: texts are set apart by more than any end.
    apart = text * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + apart)
    begin = np.flatnonzero(np.r_[True, (start + apart)[1:] > reach[:-1]])
    return h1[begin], h2[begin], start[begin], reach[np.r_[begin[1:], len(order)] - 1] - apart[begin]


def _gone_batch(h1: np.ndarray, h2: np.ndarray, start: np.ndarray, end: np.ndarray, schema: T.StructType, key: str) -> pa.RecordBatch:
    """Ranges as rows of a schema that has more columns; key gets numbers that spread."""
    from pyspark.sql.pandas.types import to_arrow_schema

    h1, h2, start, end = joined_runs(h1, h2, start, end)
    given = {"h1": h1, "h2": h2, "start": start, "end": end, key: mixed(h1.view(np.uint64) ^ start.astype(np.uint64)).view(np.int64)}
    target = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(len(h1), f.type) for f in target], schema=target)


class _Segments:
    """Segments that a task holds until they are many: by their bytes and their anchor's place there, the texts and places that have them."""

    def __init__(self) -> None:
        self._clear()

    def _clear(self) -> None:
        self.found: dict[tuple[bytes, int], list[tuple[int, int, int, int]]] = {}
        self.bytes = 0

    def add(self, segment: bytes, off: int, anchor: int, h1: int, h2: int, start: int) -> None:
        own = self.found.setdefault((segment, off), [])
        own.append((anchor, h1, h2, start))
        self.bytes += 64 + (len(segment) + 200 if len(own) == 1 else 0)

    def judged(self) -> Iterator[pa.RecordBatch]:
        """A row for each segment, with its text and place if it stands once; and what stands twice here as gone."""
        from pyspark.sql.pandas.types import to_arrow_schema

        rows, gone = [], []
        for (segment, off), own in self.found.items():
            anchor, h1, h2, start = own[0]
            if len(own) > 1:
                gone += [(b, c, d, d + len(segment)) for _, b, c, d in own]
                h1 = h2 = start = None
            rows.append((anchor, h1, h2, start, off, min(len(own), 2), segment, None))
        self._clear()
        target = to_arrow_schema(SEGMENT)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(target)], schema=target)
        if gone:
            yield _gone_batch(*np.array(gone, np.int64).T, SEGMENT, "anchor")


def _sorted_groups(window: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From segments in the order of their anchors, whole groups together: ranges that stand elsewhere too."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # bounded parts, each cut where an anchor ends
                sizes = np.cumsum(batch.column(4)[at:].to_numpy())
                stop = at + max(1, int(np.searchsorted(sizes, SORTED_BYTES - size, "right")))
                held.append(batch.slice(at, stop - at))
                size += int(sizes[min(stop, batch.num_rows) - at - 1])
                at = stop
                if size >= SORTED_BYTES:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    keys = whole.column(0).to_numpy()
                    cut = int(np.searchsorted(keys, keys[-1]))
                    if cut:
                        yield from _outermost_rows(whole.slice(0, cut), window)
                    held = whole.slice(cut).to_batches()
                    size = int(whole.slice(cut).column(4).to_numpy().sum())
        if held:
            yield from _outermost_rows(pa.Table.from_batches(held), window)

    return run


def _outermost_rows(rows: pa.Table, window: int) -> Iterator[pa.RecordBatch]:
    keys = rows.column(0).to_numpy()
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[begin, len(keys)])
    some = np.flatnonzero(np.repeat(sizes > 1, sizes))
    if not len(some):
        return
    rows = rows.take(pa.array(some))
    off = rows.column("off").to_numpy().astype(np.int64)
    left, right = outermost(rows.column("segment").to_pylist(), off, sizes[sizes > 1], window)
    good = np.flatnonzero((right > 0) & (rows.column("many").to_numpy() == 1))
    own = rows.take(pa.array(good))
    h1, h2, start = (own.column(c).to_numpy() for c in ("h1", "h2", "start"))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in joined_runs(h1, h2, start + (off - left)[good], start + (off + right)[good])], names=GONE.names)


WINDOWS = T.StructType([T.StructField("w1", T.LongType()), T.StructField("w2", T.LongType()), *GONE.fields, T.StructField("many", T.IntegerType())])


def _windows_of(batch: pa.RecordBatch, window: int) -> tuple[np.ndarray, ...]:
    """Two hashes of each window of the batch's segments, its segment, and its place there."""
    texts = batch.column(batch.schema.get_field_index("segment")).to_pylist()
    sizes = np.array([len(t) for t in texts], np.int64)
    count = sizes - window + 1
    values = common._TABLE[np.frombuffer(b"".join(texts), np.uint8)]
    own = np.repeat(np.arange(len(texts)), count)
    at = np.arange(len(own)) - np.r_[0, np.cumsum(count)[:-1]][own]
    place = np.r_[0, np.cumsum(sizes)[:-1]][own] + at
    return rolling(values, window, common._BYTES)[place], rolling(values, window, common._GRAMS, mixed)[place], own, at


def _single_windows(window: int, sketch) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Windows of segments: those that stand twice among some thousand segments are gone; and once each those that others may have too."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, HELD_SEGMENTS):
            h1, h2, start, many = (batch.column(batch.schema.get_field_index(c)).fill_null(0).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "start", "many"))
            w1, w2, own, at = _windows_of(batch, window)
            order = np.lexsort((w2, w1))
            new = np.r_[True, (w1[order][1:] != w1[order][:-1]) | (w2[order][1:] != w2[order][:-1])]
            group = np.cumsum(new) - 1
            total = np.bincount(group, many[own[order]])
            lost = order[(total[group] > 1) & (many[own[order]] == 1)]
            p = start[own[lost]] + at[lost]
            yield _gone_batch(h1[own[lost]], h2[own[lost]], p, p + window, WINDOWS, "w1")
            one = order[new]
            may = sketch.value.may_repeat(w1[one])
            one, twice = one[may], total[may] > 1
            owner = own[one]
            p = start[owner] + at[one]
            columns = [pa.array(w1[one].view(np.int64)), pa.array(w2[one].view(np.int64)), *[pa.array(x, mask=twice) for x in (h1[owner], h2[owner], p, p + window)], pa.array(np.where(twice, 2, 1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=WINDOWS.names)

    return run


def _gone_singly(segments_: DataFrame, hot: DataFrame, window: int) -> DataFrame:
    """(h1, h2, start, end) of windows that stand elsewhere too, of the segments of frequent anchors. Segments are dealt by anchor in parts of bounded size, so that few parts have a window; a sketch of each slice's windows holds back what no other slice has."""
    salt = F.pmod(F.xxhash64("segment"), F.ceil(F.col("count") / MOST_SEGMENTS))
    dealt = segments_.join(F.broadcast(hot), "anchor").withColumn("salt", salt).repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    dealt = written(dealt.select("h1", "h2", "start", "many", "segment"), "frequent")
    bits = _bits(dealt.agg(F.sum(F.length("segment") - window + 1)).first()[0] or 0)
    # Both passes read the same files in the same slices, so what two slices have is counted twice.
    values = lambda batch: (np.unique(_windows_of(batch.slice(a, HELD_SEGMENTS), window)[0]) for a in range(0, batch.num_rows, HELD_SEGMENTS))
    sketch = dealt.sparkSession.sparkContext.broadcast(_sketch(partition_sketches(dealt, bits, lambda: values), bits))
    found = dealt.mapInArrow(_single_windows(window, sketch), WINDOWS)
    found = found.withColumn("total", F.sum("many").over(Window.partitionBy("w1", "w2")))
    return found.where("many is null or many = 1 and total > 1").select(*GONE.names)


def _gone(found: DataFrame, window: int) -> DataFrame:
    """(h1, h2, start, end) of what stands elsewhere too, from a table of segments."""
    whole = found.where("segment is not null")
    counts = whole.groupBy("anchor").count()
    rows = counts.agg(F.sum("count")).first()[0] or 0
    # No more than MOST_HOT anchors can have more rows than this, so their broadcast is bounded.
    hot = written(counts.where(F.col("count") > max(MOST_SEGMENTS, rows // MOST_HOT)), "anchors")
    groups = whole.join(F.broadcast(hot), "anchor", "left_anti").select("anchor", "h1", "h2", "start", F.length("segment").alias("size"), "off", "many", "segment")
    sorted_ = groups.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sorted_groups(window), GONE)
    here = found.where("segment is null").select(*GONE.names)
    both = here.unionByName(sorted_)
    return both if hot.limit(1).isEmpty() else both.unionByName(_gone_singly(whole, hot, window))


def suffix_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and on request kept, the bytes that stay).

    Texts are UTF-8. A byte goes if a string of window bytes that covers it also starts anywhere else, in any document or
    in the same one; overlaps count, and all is judged on the input. n_spans counts the stretches that went. Every row is
    a document, whatever its id: rows that repeat a text of a window or more lose all of it, and shorter texts, empty and null
    ones lose nothing. Other columns are left out. Texts and single windows are told apart by 128 bits, segments by
    their bytes. Beyond about 2**MOST_BITS / 4 anchors (5 GB of text) the sketch lets more segments through, which are then sorted.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    docs = documents.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), F.lit(0).alias("tie"))
    broadcast = docs.sparkSession.sparkContext.broadcast
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()

    bits = _bits(size.n)
    texts = broadcast(_sketch(partition_sketches(docs.select("h1"), bits, lambda: lambda batch: iter([_hashes(batch.column(0))])), bits))
    reps = written(_one_of_each_text(docs, texts), "texts")

    def rows_of(batch: pa.RecordBatch) -> np.ndarray:
        """Rows that stand for themselves: of one column less those whose texts may have copies."""
        return np.flatnonzero(~texts.value.may_repeat(_hashes(batch.column(0)))) if "doc_id" in batch.schema.names else np.arange(batch.num_rows)

    def texts_in(batch: pa.RecordBatch) -> tuple[np.ndarray, list[bytes]]:
        rows = rows_of(batch)
        return rows, utf8(batch.column(2).take(pa.array(rows)))

    def anchors_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, data, offsets in pieces(texts_in(batch)[1], window):
            _, at, hashes = anchors(data, offsets, window, gram)
            yield hashes[np.unique(at)]

    own, kinds = docs.select("h1", "h2", "text", "doc_id"), reps.select("h1", "h2", "text")
    bits = _bits((size.bytes or 0) / APART)
    sketches = [partition_sketches(df, bits, lambda: anchors_of) for df in (own, kinds)]
    shared = broadcast(_sketch(sketches[0].unionByName(sketches[1]), bits))

    def segments_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Segments()
        for batch in sliced(batches, 512):
            rows, bodies = texts_in(batch)
            h1, h2 = (batch.column(k).to_numpy()[rows].tolist() for k in (0, 1))
            for number, shift, data, offsets in pieces(bodies, window):
                hashes, at, first, last = segments(shared.value, data, offsets, window, gram)
                piece = np.searchsorted(offsets, first, "right") - 1
                place = first - offsets[piece] + shift[piece]
                for k, a, lo, hi, i, p in zip(hashes.view(np.int64).tolist(), at.tolist(), first.tolist(), last.tolist(), number[piece].tolist(), place.tolist(), strict=True):
                    held.add(data[lo : hi + window], a - lo, k, h1[i], h2[i], p)
                if held.bytes > HELD_BYTES:
                    yield from held.judged()
        yield from held.judged()

    found = written(own.mapInArrow(segments_of, SEGMENT).unionByName(kinds.mapInArrow(segments_of, SEGMENT)), "segments")
    removed = _gone(found, window).groupBy("h1", "h2").agg(F.collect_list(F.struct("start", "end")).alias("runs"))

    kept_fields = [T.StructField("kept_sha256", T.StringType()), *[T.StructField("kept", T.BinaryType())] * with_text]
    judged_schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("h1", "h2", "n_bytes")], T.StructField("open_text", T.StringType()), *kept_fields])

    def judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts without a segment that may stand elsewhere keep all; the others' texts go on."""
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(judged_schema)
        for batch in sliced(batches, 512):
            rows, bodies = texts_in(batch)
            may = np.zeros(len(rows), bool)
            for number, _, data, offsets in pieces(bodies, window):
                first = segments(shared.value, data, offsets, window, gram)[2]
                may[number[np.searchsorted(offsets, first, "right") - 1]] = True
            at = pa.array(rows)
            ids = batch.column(3).take(at) if batch.num_columns > 3 else pa.nulls(len(rows), target.field(0).type)
            open_text = pc.if_else(pa.array(may), batch.column(2).take(at), pa.scalar(None, pa.string()))
            sha = [None if m else hashlib.sha256(t).hexdigest() for t, m in zip(bodies, may.tolist(), strict=True)]
            kept = [pa.array([None if m else t for t, m in zip(bodies, may.tolist(), strict=True)], pa.binary())] * with_text
            columns = [ids, batch.column(0).take(at), batch.column(1).take(at), pa.array([len(t) for t in bodies], pa.int64()), open_text, pa.array(sha, pa.string()), *kept]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    both = own.mapInArrow(judged, judged_schema).withColumn("copies", F.lit(False)).unionByName(kinds.mapInArrow(judged, judged_schema).withColumn("copies", F.lit(True)))
    both = both.join(removed, ["h1", "h2"], "left")
    fields = [T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), *kept_fields]
    done = written(columns_added(both, ["open_text", "runs", *[f.name for f in kept_fields]], fields, lambda: _without, keep=["doc_id", "h1", "h2", "copies", "n_bytes"]), "kept")
    discarded(found, reps)
    return _with_copies(docs, texts, done, window, with_text)


def _without(column: pa.Array, runs: pa.Array, sha_before: pa.Array, *kept_before: pa.Array) -> dict:
    """What stays of texts without the ranges."""
    texts, gone, sha = column.to_pylist(), runs.to_pylist(), sha_before.to_pylist()
    kept = kept_before[0].to_pylist() if kept_before else [None] * len(texts)
    removed, spans = [0] * len(texts), [0] * len(texts)
    for i, text in enumerate(texts):
        if text is None:
            continue
        data, parts, at = text.encode("utf-8", "surrogatepass"), [], 0
        for a, b in sorted((r["start"], r["end"]) for r in gone[i] or ()):
            if not spans[i] or a > at:
                spans[i] += 1
                parts.append(data[at:a])
            at = max(at, b)
        parts.append(data[at:])
        own = b"".join(parts)
        removed[i], sha[i], kept[i] = len(data) - len(own), hashlib.sha256(own).hexdigest(), own if kept_before else None
    return {"n_removed": removed, "n_spans": spans, "kept_sha256": sha} | ({"kept": pa.array(kept, pa.binary())} if kept_before else {})


def _with_copies(docs: DataFrame, texts, done: DataFrame, window: int, with_text: bool) -> DataFrame:
    """done's rows that stand for themselves, and for every row of a kind of text its own: all of it gone if the text has a window and stands twice."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(texts.value.may_repeat(_hashes(batch.column(1)))))

    slim = docs.select("doc_id", "h1", "h2")
    slim = slim.mapInArrow(run, slim.schema)
    columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text]
    kinds = done.where("copies").drop("doc_id").join(slim.groupBy("h1", "h2").agg(F.count("*").alias("rows")), ["h1", "h2"])
    all_gone = F.expr(f"rows > 1 and n_bytes >= {window}")
    whole = {"n_removed": F.col("n_bytes"), "n_spans": F.lit(1).cast("long"), "kept_sha256": F.sha2(F.lit(""), 256), "kept": F.lit(b"")}
    kinds = kinds.select("h1", "h2", *[F.when(all_gone, whole[c]).otherwise(F.col(c)).alias(c) if c in whole else F.col(c) for c in columns])
    joined = slim.join(kinds, ["h1", "h2"])
    return done.where("not copies").select("doc_id", *columns).unionByName(joined.select("doc_id", *columns))
