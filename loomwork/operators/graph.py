"""Queries over a graph of entities and edges held as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.sources.shared import written

MOST_DEPTH, MOST_NODES = 5, 2000


def entity_types(entities: DataFrame) -> DataFrame:
    return entities.groupBy("type").agg(F.count("*").alias("n"))


def listed_entities(entities: DataFrame, *, types: Sequence[str] = (), search: str = "", limit: int = 50, offset: int = 0) -> DataFrame:
    """By mentions, then name, then uuid; the needle is lower-cased and may stand anywhere in the name or its normal form."""
    if types:
        entities = entities.where(F.col("type").isin(list(types)))
    if search:
        n = F.lit(search.lower())
        entities = entities.where(F.contains(F.lower("name"), n) | F.contains("normalised", n))
    return entities.orderBy(F.desc("mention_count"), "name", "uuid").offset(max(0, offset)).limit(min(max(1, limit), 500))


def listed_relationships(edges: DataFrame, *, uuid: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    if uuid is not None:
        edges = edges.where((F.col("src") == uuid) | (F.col("dst") == uuid))
    return edges.orderBy(F.desc("mention_count"), "type", "src", "dst").offset(max(0, offset)).limit(min(max(1, limit), 500))


def edges_between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (uuid)."""
    own = nodes.select("uuid").distinct()
    return edges.join(own.withColumnRenamed("uuid", "src"), "src", "left_semi").join(own.withColumnRenamed("uuid", "dst"), "dst", "left_semi")


#: Edges of a node that one task follows: those of a hub are dealt in parts of about so many.
HUB = 100_000


def neighbours(entities: DataFrame, edges: DataFrame, uuid: str, depth: int = 1) -> DataFrame:
    """(uuid, distance) within depth steps either way, the start included; nothing if there's no such entity.

    Each step follows the edges of what the step before reached first, and is written, so a plan has one step. The edges of a
    hub are in parts, and what is reached goes to each part of it, so that no task has all of them.
    """
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).where("a is not null and b is not null")
    hubs = written(both.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > HUB).select("a", F.ceil(F.col("n") / HUB).alias("parts")), "hubs")
    followed = both.join(hubs, "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1)))).select("a", "part", "b")
    reached = frontier = written(entities.where(F.col("uuid") == uuid).select("uuid", F.lit(0).alias("distance")).distinct(), "frontier")
    for step in range(1, min(max(1, depth), MOST_DEPTH) + 1):
        asked = frontier.select(F.col("uuid").alias("a")).join(hubs, "a", "left").select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        new = asked.join(followed, ["a", "part"]).select(F.col("b").alias("uuid")).distinct()
        frontier = written(new.join(reached.select("uuid"), "uuid", "left_anti").withColumn("distance", F.lit(step)), "frontier")
        reached = reached.unionByName(frontier)
    return reached


def subgraph(entities: DataFrame, edges: DataFrame, limit: int = MOST_NODES) -> tuple[DataFrame, DataFrame]:
    """The most mentioned entities and the edges between them."""
    nodes = entities.orderBy(F.desc("mention_count"), "name", "uuid").limit(min(max(1, limit), MOST_NODES))
    return nodes, edges_between(edges, nodes)


def degree(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(uuid, outgoing, incoming) of every entity: each side is summed up before it is joined."""
    out = edges.groupBy(F.col("src").alias("uuid")).agg(F.count("*").alias("outgoing"))
    into = edges.groupBy(F.col("dst").alias("uuid")).agg(F.count("*").alias("incoming"))
    return entities.select("uuid").join(out, "uuid", "left").join(into, "uuid", "left").fillna(0, ["outgoing", "incoming"])


def without_dangling(edges: DataFrame, entities: DataFrame, hidden_types: Sequence[str] = ()) -> DataFrame:
    return edges_between(edges, entities.where(~F.col("type").isin(list(hidden_types))) if hidden_types else entities)


def merged_edges(mentions: DataFrame) -> DataFrame:
    """(type, src, dst, mention_count, chunk_indices) from rows (type, src, dst, chunk); loops and unresolved ends left out."""
    whole = mentions.where("src is not null and dst is not null and src <> dst")
    return whole.groupBy("type", "src", "dst").agg(F.count("*").alias("mention_count"), F.sort_array(F.collect_set("chunk")).alias("chunk_indices"))


def linked_ontology(relationships: DataFrame, types: DataFrame) -> DataFrame:
    """Relationships (name, source_types, target_types) all of whose types are known; the first of a name, by position, stays."""
    ends = relationships.select("name", "position", F.explode(F.concat("source_types", "target_types")).alias("type"))
    broken = ends.join(types.select("type").distinct(), "type", "left_anti").select("name", "position").distinct()
    kept = relationships.join(broken, ["name", "position"], "left_anti")
    return kept.groupBy("name").agg(F.min("position").alias("position"), F.min_by("source_types", "position").alias("source_types"), F.min_by("target_types", "position").alias("target_types"))
