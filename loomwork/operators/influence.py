"""Who amplifies whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where an action's info may name the post that it amplifies, in order (fixed values).
AMPLIFIED_KEYS = ("reposted_id", "quoted_id", "original_post_id", "post_id")
AMPLIFYING = ("repost", "quote_post")


def amplified_id(info: Column) -> Column:
    """The first of the keys that has a value; info that isn't JSON has none."""
    parsed = F.try_parse_json(info)
    return F.coalesce(*[F.try_variant_get(parsed, f"$.{k}", "bigint") for k in AMPLIFIED_KEYS])


def amplifications(actions: DataFrame, posts: DataFrame) -> DataFrame:
    """(source, post_id, target) of amplifying actions (user_id, post_id): target is null if the post isn't known."""
    authors = posts.select("post_id", F.col("user_id").alias("target"))
    return actions.where("post_id is not null").select(F.col("user_id").alias("source"), "post_id").join(authors, "post_id", "left")


def edges(found: DataFrame) -> DataFrame:
    """(source, target, weight), without those who amplify themselves."""
    return found.where("target is not null and source <> target").groupBy("source", "target").agg(F.count("*").alias("weight"))


def nodes(graph: DataFrame, highlighted: DataFrame) -> DataFrame:
    """(user_id, score, highlighted, isolated): ends of edges and who is highlighted, with what comes in. Isolated: highlighted without any edge."""
    zero = F.lit(0).cast("long")
    ends = graph.select(F.col("target").alias("user_id"), F.col("weight").alias("score")).union(graph.select("source", zero))
    ends = ends.withColumns({"mark": F.lit(False), "edge": F.lit(True)})
    named = highlighted.select(F.col("user_id"), zero.alias("score"), F.lit(True).alias("mark"), F.lit(False).alias("edge"))
    out = ends.unionByName(named).groupBy("user_id").agg(F.sum("score").alias("score"), F.max("mark").alias("highlighted"), F.max("edge").alias("_edge"))
    return out.select("user_id", "score", "highlighted", (F.col("highlighted") & ~F.col("_edge")).alias("isolated"))
