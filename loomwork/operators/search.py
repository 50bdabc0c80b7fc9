"""Search: by words, by vectors, and both."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.text import match_kind, match_score
from loomwork.operators.cells import cells_of, compared, nearest_cell, units, visiting
from loomwork.sources.shared import written

#: Query vectors that go to all tasks at once.
BLOCK = 4096
#: Rows, and queries, whose similarities a task has at once: its memory grows with neither.
AT_ONCE = 1024


def lexical(entities: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Entities whose name holds the query. The most mentioned are taken first and ranked then, so a rare exact match may be lost: that is how it is defined."""
    needle = query.strip().lower()
    hits = entities.where(F.contains(F.lower("name"), F.lit(needle)) | F.contains("normalised", F.lit(needle)))
    hits = hits.orderBy(F.desc("mention_count"), "name", "uuid").limit(limit)
    hits = hits.withColumn("matched_by", match_kind(needle, F.col("name"), F.col("normalised")))
    return hits.withColumn("score", match_score(F.col("matched_by"))).orderBy(F.desc("score"), F.desc("mention_count"), "name")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, id, similarity, place): for each query (id, vector) the k most similar rows of vectors (id, vector) by cosine, ties by id.

    Exact. Queries of one block go to all tasks, and a task keeps the k best of its rows for each of them. More queries
    visit cells of rows around pivots, and only those that can hold rows nearer than k that are known; the plan is the same for
    any number of queries. Zero vectors have similarity 0; null vectors aren't compared. Null and repeated ids are spread as others
    are; queries of one id are one query.
    """
    some, asked = (df.where("vector is not null").select("id", "vector") for df in (vectors, queries))
    kinds = queries.schema["id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    found = _by_task(some, [tuple(r) for r in asked.collect()], kinds, k) if asked.count() <= block else _by_cell(some, asked, kinds, k)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc_nulls_last("id")))
    return found.withColumn("place", place).where(F.col("place") <= k)


class _Best:
    """The k most similar rows so far for each of some queries."""

    def __init__(self, queries: list[tuple], k: int) -> None:
        self.ids, self.k = [q for q, _ in queries], k
        self.units = units(v for _, v in queries)
        #: Similarities below zero, so that they sort, whether the id is null, and the id.
        self.rows: list[list[tuple[float, bool, object]]] = [[] for _ in queries]

    def add(self, own: list, x: list) -> None:
        if not own or not self.ids:
            return
        for a in range(0, len(own), AT_ONCE):
            ids, part = own[a : a + AT_ONCE], units(x[a : a + AT_ONCE])
            for b in range(0, len(self.ids), AT_ONCE):
                self._add(b, ids, self.units[b : b + AT_ONCE] @ part.T)

    def _add(self, first: int, own: list, similar: np.ndarray) -> None:
        kept = min(self.k, len(own))
        floor = -np.partition(-similar, kept - 1, axis=1)[:, kept - 1]
        top = similar.max(axis=1)
        for i in range(len(similar)):
            rows = self.rows[first + i]
            if len(rows) == self.k and top[i] < -rows[-1][0]:
                continue
            at = np.flatnonzero(similar[i] >= floor[i])  # with ties, which the id decides
            self.rows[first + i] = sorted([*rows, *((-float(similar[i, j]), own[j] is None, 0 if own[j] is None else own[j]) for j in at)])[: self.k]

    def columns(self) -> tuple[list, list, list]:
        flat = [(q, None if none else j, -s) for q, rows in zip(self.ids, self.rows, strict=True) for s, none, j in rows]
        return tuple(map(list, zip(*flat, strict=True))) if flat else ([], [], [])


def _by_task(vectors: DataFrame, queries: list[tuple], kinds: tuple[str, str], k: int) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(queries)
    target = pa.schema([("query_id", _arrow(kinds[0])), ("id", _arrow(kinds[1])), ("similarity", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(shared.value, k)
        for batch in batches:
            for part in (batch.slice(a, AT_ONCE) for a in range(0, batch.num_rows, AT_ONCE)):
                best.add(part.column(0).to_pylist(), part.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(best.columns(), target, strict=True)], schema=target)

    return vectors.mapInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, similarity double")


def _by_cell(vectors: DataFrame, queries: DataFrame, kinds: tuple[str, str], k: int) -> DataFrame:
    """Each query's own cell gives k rows that are near, and so an angle within which all that it needs is; then it visits the cells that reach into that angle."""
    rows = written(vectors.withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = written(queries.withColumn("row", F.monotonically_increasing_id()), "queries")
    cells, placed = cells_of(rows, rows.count())
    placed = written(placed.drop("angle"), "placed")

    def best(x: pa.Table, q: pa.Table) -> pa.Table:
        best = _Best(list(zip(zip(q["row"].to_pylist(), q["id"].to_pylist(), strict=True), q["vector"].to_pylist(), strict=True)), k)
        best.add(x["id"].to_pylist(), x["vector"].to_pylist())
        keys, ids, similar = best.columns()
        columns = [r for r, _ in keys], [i for _, i in keys], ids, similar
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), *map(_arrow, kinds), pa.float64()), strict=True)], names=["row", "query_id", "id", "similarity"])

    schema = f"row long, query_id {kinds[0]}, id {kinds[1]}, similarity double"
    at_home = nearest_cell(asked, cells).withColumn("visits", F.array("cell")).drop("cell", "angle")
    near = compared(placed, at_home, cells, best, schema)
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("similarity")))).where(F.col("r") == k)
    reach = asked.join(ranked.select("row", F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), "similarity"))).alias("reach")), "row", "left")
    return compared(placed, visiting(reach, cells, "reach").drop("reach"), cells, best, schema).drop("row")


def _arrow(name: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[name]


def embedded(texts: DataFrame, embed: Callable[[list[str]], np.ndarray], dim: int, batch: int = 32) -> DataFrame:
    """(text, vector) of each different text, by a function that takes a batch of them at once; vectors of another width are an error, and all are single precision."""

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            column = frame.column(0)
            for part in (column.slice(k, batch) for k in range(0, len(column), batch)):
                x = np.asarray(embed(part.to_pylist()), np.float32)
                if x.shape != (len(part), dim):
                    raise ValueError(f"vectors of shape {x.shape}, not of {(len(part), dim)}")
                yield pa.RecordBatch.from_arrays([part, pa.array(list(x), pa.list_(pa.float32()))], names=["text", "vector"])

    return texts.where("text is not null").select("text").distinct().mapInArrow(run, "text string, vector array<float>")


def in_scope(vectors: DataFrame, members: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of one scope: the scope (id) is taken first, so nothing is fetched beyond what is asked for."""
    return nearest(vectors.join(members.select("id"), "id", "left_semi"), queries, k)


def first_of_both(first: DataFrame, second: DataFrame, key: str, limit: int) -> DataFrame:
    """Two lists of hits (key, place) as one: the first list's in their order, then those of the second that aren't among them."""
    more = second.join(first.select(key), key, "left_anti")
    return first.withColumn("arm", F.lit(0)).unionByName(more.withColumn("arm", F.lit(1))).orderBy("arm", "place", key).limit(limit)


def hybrid(words: DataFrame, vectors: DataFrame, limit: int = 10) -> DataFrame:
    """Hits by words (uuid, score, place) first, then those by vectors that aren't among them, limit in all."""
    both = words.select("uuid", "score", "place", F.lit(0).alias("arm")).unionByName(vectors.select("uuid", "score", "place", F.lit(1).alias("arm")))
    first = both.withColumn("r", F.row_number().over(Window.partitionBy("uuid").orderBy("arm", "place"))).where("r = 1")
    return first.drop("r").orderBy("arm", "place").limit(limit)
