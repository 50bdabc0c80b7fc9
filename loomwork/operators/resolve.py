"""Entity resolution: mentions merged by name, then by alias, then by similarity, and relationships onto what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.text import grounded_in, tokens
from loomwork.operators.cells import cells_of, compared, units, visiting
from loomwork.operators.profiles import indexed
from loomwork.sources.shared import written

LEAST_OVERLAP, LEAST_COSINE = 0.5, 0.90
#: Parts of a cell by type.
TYPE_PARTS = 64


def by_name(mentions: DataFrame) -> DataFrame:
    """Entities (type, normalised) from mentions (type, normalised, surface, chunk, start, attributes?): the first surface names it. Mentions without a normal form are dropped."""
    order = F.struct("chunk", "start", "surface")
    return mentions.where("normalised <> ''").groupBy("type", "normalised").agg(
        F.min_by("surface", order).alias("name"), F.sort_array(F.collect_set("surface")).alias("aliases"), F.count("*").alias("mention_count"),
        F.min(F.struct("chunk", "start")).alias("first"), F.bool_and(F.coalesce("inferred", F.lit(False)) if "inferred" in mentions.columns else F.lit(False)).alias("inferred"),
    )


#: Values of a list that is shown; all of them are rows.
SHOWN = 100


def attribute_values(values: DataFrame) -> DataFrame:
    """(type, normalised, key, place, value, chunk) from (type, normalised, key, value, chunk): each value once, with the chunk where it came first, in that order; the one in place 1 holds."""
    firsts = values.groupBy("type", "normalised", "key", "value").agg(F.min("chunk").alias("chunk"))
    own = Window.partitionBy("type", "normalised", "key").orderBy("chunk", "value")
    return firsts.withColumn("place", F.row_number().over(own)).select("type", "normalised", "key", "place", "value", "chunk")


def attributes_folded(values: DataFrame) -> DataFrame:
    """(type, normalised, key, value, n_conflicts, conflicts) from (type, normalised, key, value, chunk): the first value stays, of the others the first SHOWN are listed with the chunk where each came first. attribute_values has all of them as rows, so no row grows with an entity's values."""
    ranked = attribute_values(values)
    listed = F.when(F.col("place").between(2, SHOWN + 1), F.struct("place", "value", "chunk"))
    others = F.transform(F.array_sort(F.collect_list(listed)), lambda x: F.struct(x["value"].alias("value"), x["chunk"].alias("chunk")))
    first = F.max(F.when(F.col("place") == 1, F.col("value"))).alias("value")
    return ranked.groupBy("type", "normalised", "key").agg(first, (F.count("*") - 1).alias("n_conflicts"), others.alias("conflicts"))


def aliases_merged(entities: DataFrame) -> DataFrame:
    """(type, normalised, keeper): greedily, names of more tokens first, then by first mention; a name goes to the first survivor of which it is the end, with two tokens or more.

    The first name with a given end survives: whatever it went to would come before it and have that end too. So each
    name's keeper is the first of all names that end with it, which an aggregation finds, however many share an end.
    """
    parts = tokens(F.col("normalised"))
    keyed = entities.select("type", "normalised", "first", parts.alias("parts")).where(F.size("parts") > 0)
    chunk, start = F.col("first.chunk"), F.col("first.start")
    order = F.struct((-F.size("parts")).alias("n"), chunk.isNull().alias("c"), chunk.alias("chunk"), start.isNull().alias("s"), start.alias("start"), F.col("normalised").alias("name"))
    ends = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda k: F.concat_ws(" ", F.slice("parts", k, F.size("parts"))))
    firsts = keyed.where(F.size("parts") >= 2).select(F.col("type").alias("_type"), F.explode(ends).alias("_end"), order.alias("order"))
    firsts = firsts.groupBy("_type", "_end").agg(F.min("order").alias("order"))
    found = keyed.select("type", "normalised").join(firsts, F.col("type").eqNullSafe(F.col("_type")) & (F.col("normalised") == F.col("_end")), "left")
    return found.select("type", "normalised", F.coalesce("order.name", "normalised").alias("keeper"))


def _alike(tokens_: list[set[str]], other: list[set[str]], x: np.ndarray, y: np.ndarray, kinds: tuple[list, list], order: tuple[np.ndarray, np.ndarray], least_overlap: float, least_cosine: float) -> Iterator[tuple[int, int]]:
    """(i, j) where j comes before i, is of its type, shares a token, and is as like as must be in tokens and in direction."""
    number: dict[object, int] = {}
    of_x, of_y = (np.array([number.setdefault(k, len(number)) for k in some]) for some in kinds)
    near = (x @ y.T >= least_cosine) & (of_x[:, None] == of_y[None, :]) & (order[1][None, :] < order[0][:, None])
    for i, j in zip(*(k.tolist() for k in np.nonzero(near)), strict=True):
        a, b = tokens_[i], other[j]
        both = len(a & b)
        if both and (both == min(len(a), len(b)) or both / (len(a) + len(b) - both) >= least_overlap):
            yield i, j


def similar_merged(entities: DataFrame, least_overlap: float = LEAST_OVERLAP, least_cosine: float = LEAST_COSINE) -> DataFrame:
    """(type, normalised, keeper) of entities (type, normalised, position, embedding): in order of position, then name, each goes to the first survivor of its type that shares enough tokens and points the same way.

    Exact, in rounds: a row that no undecided earlier row is like survives, and rows that are like a new survivor are merged; so
    of many rows alike all but one go in one round. What is compared are rows in the cells of their directions (see cells)
    and those that visit these, in blocks: no pair is a row, nothing is settled on the driver, and no task has all of a type. Rounds are
    as many as the longest chain in which each row is like one before it that is merged only for one before that: few,
    unless names are made for it. Null positions come last; null or zero embeddings, and names without tokens, are like none.
    """
    place = F.struct(F.col("position").isNull(), "position", "normalised", "row")
    rows = written(entities.select("type", "normalised", "position", "embedding").withColumn("row", F.monotonically_increasing_id()), "similar")
    rows = written(indexed(rows.withColumn("place", place), "place", index="order").drop("place", "position"), "similar")
    some = rows.where("embedding is not null and normalised <> ''")
    # Rows of a type meet only each other, so a cell is parted by types, and there are as many as its largest part needs.
    some = some.withColumn("part", F.pmod(F.xxhash64("type"), F.lit(TYPE_PARTS)).cast("int"))
    most = some.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    cells, placed = cells_of(some, most, "embedding")
    placed = visiting(placed.drop("angle"), cells, float(np.arccos(min(1.0, least_cosine))), "embedding")
    own = lambda cell: cell * F.lit(TYPE_PARTS) + F.col("part")
    placed = written(placed.withColumns({"cell": own(F.col("cell")), "visits": F.transform("visits", own)}).drop("part"), "similar")

    def against(members: DataFrame, visitors: DataFrame, found: str) -> DataFrame:
        """(row, order, keeper): for visitors the first of the members before them that they are like, in each block."""

        def run(own: pa.Table, new: pa.Table) -> pa.Table:
            one, other = ([set((t or "").split()) for t in x["normalised"].to_pylist()] for x in (new, own))
            order = tuple(x["order"].to_numpy() for x in (new, own))
            first: dict[int, int] = {}
            kinds = new["type"].to_pylist(), own["type"].to_pylist()
            for i, j in _alike(one, other, units(new["embedding"].to_pylist()), units(own["embedding"].to_pylist()), kinds, order, least_overlap, least_cosine) if len(new) and len(own) else ():
                if i not in first or order[1][j] < order[1][first[i]]:
                    first[i] = j
            names, rows = own["normalised"].to_pylist(), new["row"].to_pylist()
            columns = [[rows[i] for i in first], [int(order[1][j]) for j in first.values()], [names[j] for j in first.values()]]
            return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["row", "before", found])

        return compared(members.drop("visits"), visitors.drop("cell"), cells, run, f"row long, before long, {found} string")

    undecided, survivors = placed, None
    while not undecided.limit(1).isEmpty():
        blocked = written(against(undecided, undecided, "like").select("row").distinct(), "similar")
        new, rest = (written(undecided.join(blocked, "row", how), "similar") for how in ("left_anti", "left_semi"))
        merged = against(new, rest, "like").select("row").distinct()
        left = written(rest.join(merged, "row", "left_anti"), "similar")
        survivors = new if survivors is None else survivors.unionByName(new)
        undecided = left
    if survivors is None:
        return rows.select("type", "normalised", F.coalesce("normalised", F.lit("")).alias("keeper"))
    keepers = against(survivors, placed.join(survivors.select("row"), "row", "left_anti"), "keeper").groupBy("row").agg(F.min_by("keeper", "before").alias("keeper"))
    return rows.join(keepers, "row", "left").select("type", "normalised", F.coalesce("keeper", "normalised", F.lit("")).alias("keeper"))


def folded(entities: DataFrame, keepers: DataFrame) -> DataFrame:
    """Entities joined into their keepers: names together, mentions summed, inferred only if all are."""
    joined = entities.join(keepers, ["type", "normalised"])
    is_keeper = F.col("normalised") == F.col("keeper")
    return joined.groupBy("type", "keeper").agg(
        F.max(F.when(is_keeper, F.col("name"))).alias("name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"),
        F.sum("mention_count").alias("mention_count"), F.min("first").alias("first"), F.bool_and("inferred").alias("inferred"), F.count("*").alias("merged"),
    )


def inferred_endpoints(relationships: DataFrame, entities: DataFrame, permitted: DataFrame, chunks: DataFrame) -> DataFrame:
    """Entities for ends (relation, side, normalised, chunk) that no entity has: only if one type is permitted for (relation, side), and every token is in the chunk's text. The first chunk counts."""
    unknown = relationships.join(entities.select("normalised").distinct(), "normalised", "left_anti").where("normalised <> ''")
    typed = unknown.join(permitted.where(F.size("types") == 1), ["relation", "side"])
    grounded = typed.join(chunks, "chunk").where(grounded_in(F.col("normalised"), F.col("text")))
    return grounded.groupBy("normalised").agg(F.min("chunk").alias("chunk"), F.min_by(F.col("types")[0], "chunk").alias("type"))
