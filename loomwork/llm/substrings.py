"""Substring dedup: a count-min sketch picks the windows that may repeat, and only those are grouped exactly.

In the sketch a window stands for its anchor: the least of its grams of GRAM words. Equal windows have equal anchors at equal
places, so an anchor's count is no less than its windows' counts, and the sketch only adds to that; yet there are eight times
fewer anchors than windows. Each partition's sketch leaves its task as sorted cells, by range of cells; ranges are merged as
they stream in; what remains is a bit for each cell that was counted twice or more, whose number is bounded.

Windows that may repeat are computed once: a task settles those that it holds, so a window that all documents share leaves it once,
and the first of each in the corpus is found by a sort. Equal texts are one document to the windows: a first sketch, of whole
texts, picks those that may have copies, and one of each kind is kept. Its copies lose all their words, or none if they are
shorter than a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.common import Words, byte_class, chunks, columns_added, mixed, sliced, utf8, written
from loomwork.llm.decontamination import least

WINDOW, GRAM = 20, 5
#: Rows of the sketch; cells of a row as a power of two, from the input's size, between these.
ROWS, LEAST_BITS, MOST_BITS = 3, 20, 28
#: Ranges of cells that a sketch is cut into.
RANGES = 512
#: Windows that a task holds at once to meet equal ones.
HELD_WINDOWS = 1 << 20
_PLACE = np.uint64((1 << 28) - 1)
_SPACE = byte_class("nonspace")


def anchors(w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows' first words, and the word where each one's anchor begins: the least hash, leftmost among equals."""
    starts = np.flatnonzero(w.within(window))
    hashes = w.grams(gram)
    if not len(starts):
        return starts, starts
    low = least((hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64), window - gram + 1)
    return starts, (low[starts] & _PLACE).astype(np.int64)


def cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mixed(hashes + np.uint64(row + 1)) >> np.uint64(64 - bits)).astype(np.int64)


def partition_sketches(rows: DataFrame, bits: int, make: Callable[[], Callable[[pa.RecordBatch], Iterator[np.ndarray]]]) -> DataFrame:
    """(part, once, twice) rows of each task's sketch of the values that make's function finds in rows: a part is a range of a row; cells are sorted offsets, as differences."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = make()
        found = [x for batch in sliced(batches) for x in values(batch)]
        hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
        size = max(1, (1 << bits) // RANGES)
        for row in range(ROWS):
            cell, count = np.unique(cells(hashes, row, bits), return_counts=True)
            cuts = np.searchsorted(cell, np.arange(0, RANGES + 1) * size)
            parts, ones, twos = [], [], []
            for k in range(RANGES):
                a, b = cuts[k], cuts[k + 1]
                if a < b:
                    offset, many = cell[a:b] - k * size, count[a:b] > 1
                    parts.append(row * RANGES + k)
                    for out, x in ((ones, offset[~many]), (twos, offset[many])):
                        steps = np.diff(x, prepend=0)
                        out.append((b"s" + steps.astype("<u2").tobytes()) if steps.max(initial=0) < 1 << 16 else (b"l" + steps.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(ones, pa.binary()), pa.array(twos, pa.binary())], names=["part", "once", "twice"])

    return rows.mapInArrow(run, "part int, once binary, twice binary")


def _offsets(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, "<u2" if blob[:1] == b"s" else "<u4", offset=1), dtype=np.int64)


def merged(sketches: DataFrame, bits: int) -> DataFrame:
    """(part, repeated): for each range a bit for each cell whose count, over all sketches, is two or more."""
    size = max(1, (1 << bits) // RANGES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, once, twice in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                count = state.get(part)
                if count is None:
                    count = state[part] = np.zeros(size, np.uint8)
                for blob, n in ((once, 1), (twice, 2)):
                    at = _offsets(blob)  # different cells, as each was counted once in its task
                    count[at] = np.minimum(count[at] + n, 2)
        for part, count in state.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(count > 1).tobytes()], pa.binary())], names=["part", "repeated"])

    return sketches.repartition("part").mapInArrow(run, "part int, repeated binary")


class Sketch:
    """The merged sketch, as a bit for each cell."""

    def __init__(self, parts: list[tuple[int, bytes]], bits: int) -> None:
        self.bits = bits
        size = max(1, (1 << bits) // RANGES)
        self.rows = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(ROWS)]
        for part, blob in parts:
            row, k = divmod(part, RANGES)
            self.rows[row][k * size // 8 : (k + 1) * size // 8] = np.frombuffer(blob, np.uint8)

    def may_repeat(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for row, table in enumerate(self.rows):
            some = np.flatnonzero(out)
            cell = cells(hashes[some], row, self.bits)
            out[some] = (table[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
        return out


def _candidates(w: Words, sketch: Sketch, window: int, gram: int) -> np.ndarray:
    """First words of the windows that may repeat."""
    starts, at = anchors(w, window, gram)
    if not len(starts):
        return starts
    places, back = np.unique(at, return_inverse=True)
    return starts[sketch.may_repeat(w.grams(gram)[places])[back]]


def _keys(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits for each window."""
    return w.grams(window).view(np.int64), (w.grams(window, second=True) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _first_here(w: Words, starts: np.ndarray, keys: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each window: whether it is the first of its words in its text."""
    text = np.searchsorted(w.first, starts, "right")
    order = np.lexsort((starts, keys[1][starts], keys[0][starts], text))
    s = starts[order]
    new = np.ones(len(s), bool)
    new[1:] = (text[order][1:] != text[order][:-1]) | (keys[0][s][1:] != keys[0][s][:-1]) | (keys[1][s][1:] != keys[1][s][:-1])
    out = np.empty(len(s), bool)
    out[order] = new
    return out


def _bits(values: float) -> int:
    """Four to eight cells for each value, within bounds."""
    return min(MOST_BITS, max(LEAST_BITS, int(4 * values).bit_length()))


def _sketch(sketches: DataFrame, bits: int) -> Sketch:
    """Merged, as ROWS * 2**MOST_BITS bits at most."""
    return Sketch([(r.part, bytes(r.repeated)) for r in merged(sketches, bits).collect()], bits)


def _hashes(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def substring_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (and on request kept, the words that stay, joined by one space).

    Words are whatever stands between spaces and the control characters 9 to 13. A word goes if a window that covers it
    also starts earlier: in a document with a smaller id, or before in the same one. Windows are judged on the input. Null
    and empty texts, and those with fewer words than a window, lose nothing. Null ids come last. Different texts of one id,
    or without an id, are documents of their own, in the order of their hashes; rows that repeat an id and its text are one
    document, and each is returned. Other columns are left out. Beyond about 2**MOST_BITS / 4 anchors (about 3 GB of text)
    the sketch lets more windows through, which the exact step then groups.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    docs = documents.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    broadcast = docs.sparkSession.sparkContext.broadcast
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    # What tells texts of one id apart travels with every window, so it is nothing where ids tell enough.
    unique = docs.select("doc_id", "h1").distinct().groupBy("doc_id").count().where("count > 1").limit(1).isEmpty()
    docs = docs.withColumn("tie", F.lit(0).cast("long") if unique else F.col("h1"))

    bits = _bits(size.n)
    texts = broadcast(_sketch(partition_sketches(docs.select("h1"), bits, lambda: lambda batch: iter([_hashes(batch.column(0))])), bits))
    reps = written(_one_of_each_text(docs, texts), "texts")

    def words_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, Words]]:
        """Rows, and the words of their texts: of rows that stand for themselves."""
        rows = np.flatnonzero(~texts.value.may_repeat(_hashes(batch.column(3)))) if batch.num_columns > 3 else np.arange(batch.num_rows)
        column = batch.column(1).take(pa.array(rows)) if len(rows) < batch.num_rows else batch.column(1)
        for first, data, offsets in chunks(utf8(column)):
            yield rows[first : first + len(offsets) - 1], Words(data, offsets, _SPACE)

    def anchors_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, w in words_of(batch):
            yield w.grams(gram)[np.unique(anchors(w, window, gram)[1])]

    own, kinds = docs.select("doc_id", "text", "tie", "h1"), reps.select("doc_id", "text", "tie")
    bits = _bits((size.bytes or 0) / 45)  # an anchor begins about every 45 bytes
    sketches = [partition_sketches(df, bits, lambda: anchors_of) for df in (own, kinds)]
    shared = broadcast(_sketch(sketches[0].unionByName(sketches[1]), bits))

    schema = T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.IntegerType()), docs.schema["doc_id"], T.StructField("tie", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("many", T.IntegerType())])

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows that may repeat, the first of its words in its text: many is 0 for the first among those held together, whose place in the corpus is to be found; others are lost, as runs of many."""
        held = _Held(schema.names)
        for batch in sliced(batches):
            for rows, w in words_of(batch):
                starts = _candidates(w, shared.value, window, gram)
                if len(starts):
                    k1, k2 = _keys(w, window)
                    starts = starts[_first_here(w, starts, (k1, k2))]
                    at = np.searchsorted(w.first, starts, "right") - 1
                    held.add(k1[starts], k2[starts], at, starts - w.first[at], batch.column(0).take(pa.array(rows)), batch.column(2).take(pa.array(rows)))
                    if held.size > HELD_WINDOWS:
                        yield held.judged()
        if held.size:
            yield held.judged()

    found = own.mapInArrow(windows, schema).unionByName(kinds.mapInArrow(windows, schema))
    # A passage that all documents share comes once from every HELD_WINDOWS windows: lost ones are spread by keys of their own.
    place = F.row_number().over(Window.partitionBy("k1", "k2", F.col("many") > 0).orderBy(F.asc_nulls_last("doc_id"), "tie"))
    later = found.withColumn("place", place).where("many > 0 or place > 1")
    run = (F.col("start").cast("long") * F.lit(1 << 32) + F.greatest("many", F.lit(1))).alias("run")
    removed = later.select("doc_id", "tie", run).groupBy("doc_id", "tie").agg(F.collect_list("run").alias("runs")).select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "runs")

    kept_fields = [T.StructField("kept_sha256", T.StringType()), *[T.StructField("kept", T.StringType())] * with_text]
    judged_schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("tie", "h1", "h2", "n_words")], T.StructField("open_text", T.StringType()), *kept_fields])

    def judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts without a window that may repeat keep all; the others' texts go on. Kinds of texts carry their hashes."""
        for batch in sliced(batches):
            is_kind = "h2" in batch.schema.names
            out: list[tuple] = []
            for rows, w in words_of(batch.select(["doc_id", "text", "tie"]) if is_kind else batch):
                may = set((np.searchsorted(w.first, _candidates(w, shared.value, window, gram), "right") - 1).tolist())
                for i, count in enumerate(np.diff(w.first).tolist()):
                    row = int(rows[i])
                    if i in may:
                        out.append((row, count, batch.column(1)[row].as_py(), None, None))
                    else:
                        words = w.text(int(w.first[i]), count)
                        out.append((row, count, None, hashlib.sha256(words).hexdigest(), words.decode("utf-8", "surrogatepass") if with_text else None))
            at = pa.array([r[0] for r in out], pa.int64())
            hashes = [batch.column(k).take(at) if is_kind else pa.nulls(len(out), pa.int64()) for k in (3, 4)]
            rest = [pa.array([r[k] for r in out], kind) for k, kind in ((1, pa.int64()), (2, pa.string()), (3, pa.string()), *[(4, pa.string())] * with_text)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), *hashes, *rest], names=judged_schema.names)

    both = own.mapInArrow(judged, judged_schema).unionByName(reps.select("doc_id", "text", "tie", "h1", "h2").mapInArrow(judged, judged_schema))
    both = both.join(removed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), "left").drop("_id", "_tie")
    inputs = ["open_text", "runs", *[f.name for f in kept_fields]]
    done = columns_added(both, inputs, [T.StructField("n_removed", T.LongType()), *kept_fields], lambda: lambda *c: _without(*c, window=window), keep=["doc_id", "tie", "h1", "h2", "n_words"])
    return _with_copies(docs, texts, written(done, "kept"), window, with_text)


class _Held:
    """Windows that a task holds until they are many, so that those of equal words leave it as one that may be the first, and as lost ones."""

    def __init__(self, names: list[str]) -> None:
        self.names = names
        self._clear()

    def _clear(self) -> None:
        self.parts, self.ids, self.ties, self.documents, self.size = [], [], [], 0, 0

    def add(self, k1: np.ndarray, k2: np.ndarray, document: np.ndarray, start: np.ndarray, ids: pa.Array, ties: pa.Array) -> None:
        self.parts.append((k1, k2, document + self.documents, start))
        self.ids.append(ids)
        self.ties.append(ties)
        self.documents, self.size = self.documents + len(ids), self.size + len(k1)

    def judged(self) -> pa.RecordBatch:
        k1, k2, document, start = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        ids, ties = pa.concat_arrays(self.ids), pa.concat_arrays(self.ties)
        rank = np.empty(len(ids), np.int64)
        rank[pc.sort_indices(pa.table([ids, ties], names=["id", "tie"]), sort_keys=[("id", "ascending"), ("tie", "ascending")], null_placement="at_end").to_numpy()] = np.arange(len(ids))
        order = np.lexsort((rank[document], k2, k1))
        first = np.ones(len(order), bool)
        first[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
        chosen, lost = order[first], np.sort(order[~first])
        begins = np.flatnonzero(np.r_[True, (document[lost][1:] != document[lost][:-1]) | (start[lost][1:] != start[lost][:-1] + 1)]) if len(lost) else np.zeros(0, np.int64)
        runs = lost[begins]
        many = np.r_[np.zeros(len(chosen), np.int32), np.diff(np.r_[begins, len(lost)]).astype(np.int32)]
        spread = mixed(mixed(k1[runs].view(np.uint64)) + rank[document[runs]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start[runs].astype(np.uint64)).view(np.int64)
        who = pa.array(np.r_[document[chosen], document[runs]])
        columns = [pa.array(np.r_[k1[chosen], spread]), pa.array(np.r_[k2[chosen], k2[runs]]), ids.take(who), ties.take(who), pa.array(np.r_[start[chosen], start[runs]].astype(np.int32)), pa.array(many)]
        self._clear()
        return pa.RecordBatch.from_arrays(columns, names=self.names)


def _one_of_each_text(docs: DataFrame, texts) -> DataFrame:
    """(h1, h2, doc_id, text): each text that may have copies once, with the smallest id. A task sends each text once for every batch, so copies meet as few rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, first = batch.column(0).to_pylist(), {}
            for i in np.flatnonzero(texts.value.may_repeat(_hashes(batch.column(2)))).tolist():
                key = (batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
                if key not in first or ids[i] is not None and (ids[first[key]] is None or ids[i] < ids[first[key]]):
                    first[key] = i
            yield batch.take(pa.array(list(first.values()), pa.int64()))

    some = docs.select("doc_id", "text", "h1", "h2", "tie")
    return some.mapInArrow(run, some.schema).groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("tie").alias("tie"))


def _without(column: pa.Array, runs: pa.Array, sha_before: pa.Array, *kept_before: pa.Array, window: int) -> dict:
    """What stays of texts without the runs of windows (first * 2**32 + number), and without windows that the text itself has before."""
    texts, sha = column.to_pylist(), sha_before.to_pylist()
    kept = kept_before[0].to_pylist() if kept_before else [None] * len(texts)
    gone, cuts = runs.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum([0, *[n or 0 for n in pc.list_value_length(runs).to_pylist()]])
    removed = [0] * len(texts)
    for i, text in enumerate(texts):
        if text is None:
            continue
        data = text.encode("utf-8", "surrogatepass")
        w = Words(data + b" ", np.array([0, len(data) + 1]), _SPACE)
        again = np.flatnonzero(w.within(window))
        again = again[~_first_here(w, again, _keys(w, window))] if len(again) else again
        own = gone[cuts[i] : cuts[i + 1]]
        edge = np.zeros(len(w.hashes) + 1, np.int64)
        np.add.at(edge, np.r_[again, own >> 32], 1)
        np.add.at(edge, np.r_[again + window, (own >> 32) + (own & 0xFFFFFFFF) + window - 1], -1)
        out = np.cumsum(edge[:-1]) > 0
        words = b" ".join(data[a:b] for a, b, x in zip(w.starts.tolist(), w.ends.tolist(), out.tolist(), strict=True) if not x)
        removed[i], sha[i], kept[i] = int(out.sum()), hashlib.sha256(words).hexdigest(), words.decode("utf-8", "surrogatepass") if kept_before else None
    return {"n_removed": removed, "kept_sha256": sha} | ({"kept": kept} if kept_before else {})


def _with_copies(docs: DataFrame, texts, done: DataFrame, window: int, with_text: bool) -> DataFrame:
    """done's rows that stand for themselves, and for every row of a kind of text its own: the first document's, or a copy's."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(texts.value.may_repeat(_hashes(batch.column(1)))))

    slim = docs.select("doc_id", "h1", "h2")
    columns = ["n_words", "n_removed", "kept_sha256", *["kept"] * with_text]
    kinds = done.where("h1 is not null").withColumnRenamed("doc_id", "first")
    joined = slim.mapInArrow(run, slim.schema).join(kinds, ["h1", "h2"])
    # Copies share a text, so those with the first one's id, or like it without any, are the same document.
    copy = F.expr(f"not (doc_id <=> first) and n_words >= {window}")
    nothing = {"n_removed": F.col("n_words"), "kept_sha256": F.sha2(F.lit(""), 256), "kept": F.lit("")}
    joined = joined.select("doc_id", *[F.when(copy, nothing[c]).otherwise(F.col(c)).alias(c) if c in nothing else F.col(c) for c in columns])
    return done.where("h1 is null").select("doc_id", *columns).unionByName(joined)
