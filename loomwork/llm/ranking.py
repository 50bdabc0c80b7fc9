"""Ranked lexical search: sparse documents in ball trees, searched best-first for the largest inner products with each item.

A document is a vector over the items' terms, of whole numbers that grow with a term's occurrences and fall with the document's
length; an item is a vector of the terms' weights. A task puts its documents into trees: a node has the centroid of what is
below it and the radius around, so no score there is above centroid times item plus radius times the item's length, counted
over the terms that occur below the node, as the others add nothing. Bounds are in doubles, rounded up by more than they can
err; scores are exact, in 64-bit integers, and made at leaves only. What a task has found so far is the bar that a node must
reach to be opened, from tree to tree.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.common import LOWER, Words, byte_class, chunks, columns_added, discarded, utf8, written
from loomwork.llm.decontamination import BLOCK_BYTES, Keys

#: Best documents of each item.
BEST = 50
#: Documents of a tree and of a leaf, at most; entries of a tree, about.
TREE_DOCS, LEAF_DOCS, TREE_ENTRIES = 4096, 16, 1 << 21
#: Numbers in a tree's centroids, and in the items' vectors that meet them at once, at most.
CELLS = 1 << 24
#: Bounds are enlarged by this share and by one: sums of doubles over CELLS terms err by far less.
SAFE = 1e-8
#: Parts in which each item's best are first chosen among what tasks have found.
PARTS = 16
_PLAIN = byte_class("plain")


@dataclass
class Items:
    """Items as sparse vectors over a vocabulary, whose terms are known by their hashes, in order."""

    ids: list
    vocabulary: np.ndarray
    terms: list[np.ndarray]
    weights: list[np.ndarray]

    def weighted(self, of_term: np.ndarray) -> Items:
        return Items(self.ids, self.vocabulary, self.terms, [of_term[t] for t in self.terms])


def items_of(rows: list[tuple[object, str]]) -> Items:
    """Rows of one id are one item. A term counts once; those without terms find nothing."""
    found: dict[object, list[np.ndarray]] = {}
    for start, data, offsets in chunks([(t or "").encode("utf-8", "surrogatepass").translate(LOWER) for _, t in rows]):
        w = Words(data, offsets, _PLAIN)
        for k, own in enumerate(np.split(w.hashes, w.first[1:-1])):
            found.setdefault(rows[start + k][0], []).append(own)
    ids = [i for i, own in found.items() if sum(map(len, own))]
    terms = [np.unique(np.concatenate(found[i])) for i in ids]
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *terms]))
    return Items(ids, vocabulary, [np.searchsorted(vocabulary, t) for t in terms], [])


def _counted(vocabulary: np.ndarray):
    """Of each text its number of terms, and which terms of the vocabulary it has how often."""
    keys = Keys(vocabulary)

    def apply(column: pa.Array) -> dict:
        n, terms, often, sizes = [], [], [], []
        for _, data, offsets in chunks([t.translate(LOWER) for t in utf8(column)]):
            w = Words(data, offsets, _PLAIN)
            many = np.diff(w.first)
            at = np.flatnonzero(keys.among(w.hashes))
            code = np.repeat(np.arange(len(many)), many)[at] * len(vocabulary) + np.searchsorted(vocabulary, w.hashes[at])
            code, count = np.unique(code, return_counts=True)
            text, term = np.divmod(code, max(1, len(vocabulary)))
            n.append(many)
            terms.append(term.astype(np.int32))
            often.append(count.astype(np.int64))
            sizes.append(np.bincount(text, minlength=len(many)))
        cuts = pa.array(np.r_[0, np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))].astype(np.int32))
        lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([np.zeros(0, kind), *x]))) for x, kind in ((terms, np.int32), (often, np.int64))]
        return {"n": pa.array(np.concatenate([np.zeros(0, np.int64), *n])), "terms": lists[0], "often": lists[1]}

    return apply


def values(often: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """A term's whole number in a document of n terms in which it occurs so often."""
    if documents * int(n.max(initial=0)) >= 1 << 56:
        m = 50 + np.array([50 * int(x) * documents // length for x in n], np.int64)
    else:
        m = 50 + 50 * n * documents // length
    return 1_000_000_000 * often // (1000 * often + 20 * m)


class BallTree:
    """Rows of a sparse matrix (each with an entry at least), halved along a far pair until leaves are small; a leaf's rows stand together."""

    def __init__(self, cuts: np.ndarray, terms: np.ndarray, value: np.ndarray, width: int, leaf: int = LEAF_DOCS) -> None:
        self.width = width
        self._cuts, self._terms, self._value = cuts, terms, value.astype(np.float64)
        self._norms = np.add.reduceat(self._value**2, cuts[:-1])
        self.leaves: list[tuple[int, int] | None] = []
        self.below: list[tuple[int, int] | None] = []
        centroids, radii, order, todo = [], [], [], [(np.arange(len(cuts) - 1), -1, 0)]
        while todo:
            rows, above, side = todo.pop()
            number = len(radii)
            if above >= 0:
                self.below[above] = (number, 0) if side == 0 else (self.below[above][0], number)
            entries, begins = self._entries(rows)
            centroid = np.bincount(terms[entries], self._value[entries], width) / len(rows)
            apart = self._norms[rows] - 2 * self._dot(entries, begins, centroid) + centroid @ centroid
            centroids.append(centroid)
            # Differences of squares lose digits of the squares: what they may lose is added.
            radii.append(math.sqrt(max(float(apart.max()), 0.0) + SAFE * float(self._norms[rows].max())) * (1 + SAFE) + 1)
            self.below.append(None)
            self.leaves.append(None)
            if len(rows) <= leaf:
                self.leaves[number] = (len(order), len(order) + len(rows))
                order += rows.tolist()
                continue
            one = self._dense(rows[int(apart.argmax())])
            near = self._dot(entries, begins, one)
            other = self._dense(rows[int((self._norms[rows] - 2 * near).argmax())])
            along = np.argsort(self._dot(entries, begins, other) - near, kind="stable")
            half = len(rows) // 2
            todo += [(rows[along[half:]], number, 1), (rows[along[:half]], number, 0)]
        self.centroids, self.radii, self.order = np.array(centroids), np.array(radii), np.array(order, np.int64)
        entries, begins = self._entries(self.order)
        self._present = (self.centroids > 0).astype(np.float64)
        self.terms, self.value, self.cuts = terms[entries], value[entries], np.r_[begins, len(entries)]
        del self._cuts, self._terms, self._value, self._norms

    def _entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows' entries, and where each row's begin among them."""
        size = self._cuts[rows + 1] - self._cuts[rows]
        begins = np.r_[0, np.cumsum(size)[:-1]]
        return np.repeat(self._cuts[rows] - begins, size) + np.arange(size.sum()), begins

    def _dot(self, entries: np.ndarray, begins: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self._value[entries] * dense[self._terms[entries]], begins)

    def _dense(self, row: int) -> np.ndarray:
        out = np.zeros(self.width)
        some = slice(self._cuts[row], self._cuts[row + 1])
        out[self._terms[some]] = self._value[some]
        return out

    def bounds(self, items: np.ndarray) -> np.ndarray:
        """For each item (a row) and node: no score below the node is larger."""
        lengths = np.sqrt((items**2) @ self._present.T)
        return (items @ self.centroids.T + lengths * self.radii) * (1 + SAFE) + 1

    def best(self, weights: np.ndarray, bounds: np.ndarray, k: int, bar: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Rows, and their scores, that may be among the k best beside those whose scores bar has: all that reach the k-th."""
        scores, rows = np.array(bar, np.int64), np.full(len(bar), -1)
        least = int(np.partition(scores, -k)[-k]) if len(scores) >= k else 1
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < least:
                break
            if self.leaves[node] is None:
                for child in self.below[node]:
                    if bounds[child] >= least:
                        heapq.heappush(heap, (-min(bounds[child], -bound), child))
                continue
            a, b = self.leaves[node]
            some = slice(self.cuts[a], self.cuts[b])
            own = np.add.reduceat(self.value[some] * weights[self.terms[some]], self.cuts[a:b] - self.cuts[a])
            good = np.flatnonzero(own >= least)
            if len(good):
                scores, rows = np.concatenate([scores, own[good]]), np.concatenate([rows, self.order[a + good]])
                if len(scores) >= k:
                    least = max(least, int(np.partition(scores, -k)[-k]))
                    keep = scores >= least
                    scores, rows = scores[keep], rows[keep]
        return rows[rows >= 0], scores[rows >= 0]


def _order(entry: tuple[int, object]) -> tuple:
    """Highest scores first, then ids in order, null last."""
    return -entry[0], entry[1] is None, 0 if entry[1] is None else entry[1]


class _Best:
    """The best of each item among the documents that a task has seen."""

    def __init__(self, items: Items, k: int) -> None:
        self.items, self.k = items, k
        self.found: list[list[tuple[int, object]]] = [[] for _ in items.ids]

    def see(self, tree: BallTree, ids: pa.Array) -> None:
        rank = np.empty(len(ids), np.int64)
        rank[pc.sort_indices(pa.table([ids], names=["id"]), sort_keys=[("id", "ascending")], null_placement="at_end").to_numpy()] = np.arange(len(ids))
        step = max(1, CELLS // tree.width // 4)
        for begin in range(0, len(self.found), step):
            end = min(begin + step, len(self.found))
            dense = np.zeros((end - begin, tree.width))
            for q in range(begin, end):
                dense[q - begin, self.items.terms[q]] = self.items.weights[q]
            bounds = tree.bounds(dense)
            for q in range(begin, end):
                had = self.found[q]
                rows, scores = tree.best(dense[q - begin].astype(np.int64), bounds[q - begin], self.k, [s for s, _ in had])
                if len(rows):
                    top = np.lexsort((rank[rows], -scores))[: self.k]
                    new = zip(scores[top].tolist(), ids.take(pa.array(rows[top])).to_pylist(), strict=True)
                    self.found[q] = sorted([*had, *new], key=_order)[: self.k]


def _searched(vectors: DataFrame, items: Items, documents: int, length: int, k: int) -> DataFrame:
    """(item, doc_id, score): each task's best of each item, by the item's number."""
    shared = vectors.sparkSession.sparkContext.broadcast(items)
    schema = T.StructType([T.StructField("item", T.IntegerType()), vectors.schema["doc_id"], T.StructField("score", T.LongType())])
    width = len(items.vocabulary)
    most = min(TREE_DOCS, max(LEAF_DOCS, CELLS // width * LEAF_DOCS // 8))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        best, held, entries = _Best(shared.value, k), [], 0

        def seen() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            ids, n, terms, often = (table.column(c).chunk(0) for c in ("doc_id", "n", "terms", "often"))
            cuts = terms.offsets.to_numpy().astype(np.int64)
            sizes = np.diff(cuts)
            value = values(often.flatten().to_numpy(), np.repeat(n.to_numpy(), sizes), documents, length)
            best.see(BallTree(cuts - cuts[0], terms.flatten().to_numpy(), value, width), ids)

        for batch in batches:
            for a in range(0, batch.num_rows, most):
                part = batch.slice(a, most)
                part = part.filter(pc.greater(pc.list_value_length(part.column(2)), 0))  # others have no score
                size = pc.sum(pc.list_value_length(part.column(2))).as_py() or 0
                if held and (sum(x.num_rows for x in held) + part.num_rows > most or entries + size > TREE_ENTRIES):
                    seen()
                    held, entries = [], 0
                if part.num_rows:
                    held.append(part)
                    entries += size
        if held:
            seen()
        rows = [(q, i, s) for q, own in enumerate(best.found) for s, i in own]
        target = to_arrow_schema(schema)
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], target.field(c).type) for c in range(3)], schema=target)

    return vectors.select("doc_id", "n", "terms", "often").mapInArrow(run, schema)


def _blocks(items: DataFrame, block_bytes: int) -> list[DataFrame]:
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    return [items] if n == 1 else [items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) for k in range(n)]


def lexical_search(
    documents: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per item its k documents of the highest score above 0: item_id, rank (from 1), doc_id, score; equal scores by ascending doc_id, null ids last.

    Terms are runs of 0-9, a-z (A-Z in lower case) and what is beyond ASCII, in whole texts; null and empty texts have none. An
    item's terms count once each. With N the documents that have terms, L all their terms and df those that have a term, it weighs
    floor(1000 ln((2 N + 2) / (2 df + 1))); where it occurs tf times in a document of n terms it gives that weight times
    1000000000 tf div (1000 tf + 20 m), m being 50 + 50 n N div L. Repeated rows are documents of their own, and each may be listed. Rows
    of one item id, or of none, are one item; an item without terms, or that no document shares a term with, has no rows. Items
    are taken in blocks of so many bytes, each of which reads the documents; what a block broadcasts is bounded by that. Terms
    are told apart by 64 bits.
    """
    docs = documents.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    wanted = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("text")).where("text is not null")
    out = docs.join(wanted.select("item_id"), F.lit(False)).selectExpr("item_id", "1 as rank", "doc_id", "0L as score")
    parts = [_block(docs, items_of([(r.item_id, r.text) for r in block.collect()]), wanted.schema["item_id"], k) for block in _blocks(wanted, block_bytes)]
    for part in filter(None, parts):
        out = out.unionByName(part)
    return out


def _block(docs: DataFrame, items: Items, item: T.StructField, k: int) -> DataFrame | None:
    if not items.ids:
        return None
    fields = [T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("often", T.ArrayType(T.LongType()))]
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(items.vocabulary)
    vectors = written(columns_added(docs, ["text"], fields, lambda: _counted(vocabulary.value), keep=["doc_id"]), "vectors")
    size = vectors.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("length")).first()
    if not size.documents:
        discarded(vectors)
        return None
    # As many rows as the block's vocabulary has terms, at most.
    holding = np.zeros(len(items.vocabulary), np.int64)
    for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        holding[r.term] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * size.documents + 2) / (2 * df + 1))) for df in holding.tolist()], np.int64)
    found = _searched(vectors, items.weighted(weights), size.documents, size.length, k)
    highest = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # What tasks found is thinned in parts, so that no item's rows of all tasks meet in one.
    found = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*highest))).where(F.col("rank") <= k)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*highest))).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(items.ids)), T.StructType([T.StructField("item", T.IntegerType()), item]))
    return found.join(names, "item").select("item_id", "rank", "doc_id", "score")
