"""What each agent did and received."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SORTS = ("actions", "posts", "comments", "likes_given", "followers", "engagement_received", "user_id")


def agent_stats(who: DataFrame, counts: dict[str, tuple[DataFrame, str]], posts: DataFrame, population_only: bool = False) -> DataFrame:
    """Identities with seven kinds of counts and what their posts received.

    counts: metric -> (rows, key). All metrics are one union of (user, metric) that is summed up in one shuffle, not a
    chain of joins; null keys don't count. engagement_received is likes and reposts only.
    """
    names = [*counts, "likes_received", "reposts_received"]
    zero = F.lit(0).cast("long")
    parts = []
    for metric, (rows, key) in counts.items():
        one = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("user_id")).agg(F.count("*").alias(metric))
        parts.append(one.select("user_id", *[F.col(n) if n == metric else zero.alias(n) for n in names]))
    parts.append(received(posts).select("user_id", *[F.col(n) if n in ("likes_received", "reposts_received") else zero.alias(n) for n in names]))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    sums = union.groupBy("user_id").agg(*[F.sum(n).alias(n) for n in names])
    out = (who.where("population") if population_only else who).join(sums, "user_id", "left").fillna(0, names)
    return out.withColumn("engagement_received", F.col("likes_received") + F.col("reposts_received"))


def counts(metrics: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(user_id, metric, n) of rows by their key; null keys don't count."""
    out = None
    for metric, (rows, key) in metrics.items():
        one = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("user_id")).agg(F.count("*").alias("n")).select("user_id", F.lit(metric).alias("metric"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def received(posts: DataFrame) -> DataFrame:
    """(user_id, likes_received, reposts_received, engagement_received): likes and shares of their posts; dislikes don't count."""
    got = posts.where("user_id is not null").groupBy("user_id").agg(F.sum(F.coalesce("num_likes", F.lit(0))).alias("likes_received"), F.sum(F.coalesce("num_shares", F.lit(0))).alias("reposts_received"))
    return got.withColumn("engagement_received", F.col("likes_received") + F.col("reposts_received"))


def ranked(stats: DataFrame, sort: str = "actions", limit: int = 100) -> DataFrame:
    """The first agents by a metric, largest first, then by id; an unknown metric means actions."""
    key = sort if sort in SORTS else "actions"
    return stats.orderBy(*([F.asc("user_id")] if key == "user_id" else [F.desc(key), F.asc("user_id")])).limit(limit)


def active(stats: DataFrame) -> DataFrame:
    """Agents that did anything."""
    return stats.where("actions > 0")


def silent(stats: DataFrame) -> DataFrame:
    """(silent): members of the population without any action, over all rows."""
    return stats.where("population").agg(F.count_if(F.col("actions") == 0).alias("silent"))


def expected_calls(who: DataFrame) -> DataFrame:
    """(expected_calls): the sum of participation rates by activity level (fixed values)."""
    rate = F.when(F.col("activity_level") == "low", 0.20).when(F.col("activity_level") == "high", 0.90).otherwise(0.55)
    return who.agg(F.sum(rate).alias("expected_calls"))
