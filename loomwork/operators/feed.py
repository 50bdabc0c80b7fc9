"""Feeds of actions, posts and comments: filters that compose, identities, kinds, engagement and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Actions of the engine itself (fixed values).
ENGINE_ACTIONS = ("exit", "sign_up", "signup", "update_rec_table")
MOST_ROWS = 500


def identities(profiles: DataFrame, users: DataFrame) -> DataFrame:
    """Who is who: profiles are the population, and lend their user name where theirs is blank; users without a profile broadcast."""
    u = users.select("user_id", "user_name", F.col("name").alias("_name"))
    p = profiles.withColumn("_own", F.lit(True))
    both = p.join(u, "user_id", "full")
    return both.where("user_id >= 0").select(
        "user_id", F.coalesce(F.nullif(F.col("username"), F.lit("")), "user_name").alias("username"), F.coalesce("name", "_name").alias("name"),
        F.coalesce("provenance", F.lit("broadcaster")).alias("provenance"), F.coalesce("activity_level", F.lit("")).alias("activity_level"), F.coalesce("_own", F.lit(False)).alias("population"),
    )


def identified(rows: DataFrame, who: DataFrame) -> DataFrame:
    """rows with username, name and population; someone unknown has blanks and counts as population."""
    named = who.select("user_id", "username", "name", "population")
    out = rows.join(named, "user_id", "left")
    return out.fillna("", ["username", "name"]).fillna(True, ["population"])


def page(rows: DataFrame, limit: int = 100, offset: int = 0, order: str = "newest", key: str = "rid") -> DataFrame:
    """A page by key, newest first unless order is oldest; limits are held to 1 and MOST_ROWS. A top-k: no full sort."""
    by = F.asc(key) if order == "oldest" else F.desc(key)
    return rows.orderBy(by).offset(max(0, offset)).limit(min(max(1, limit), MOST_ROWS))


def envelope(rows: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """One row about a page: total, limit, offset, count, has_more, next_offset."""
    limit, offset = min(max(1, limit), MOST_ROWS), max(0, offset)
    out = rows.agg(F.count("*").alias("total")).withColumns({"limit": F.lit(limit), "offset": F.lit(offset)})
    out = out.withColumn("count", F.greatest(F.lit(0), F.least(F.lit(limit), F.col("total") - offset)))
    return out.withColumn("has_more", F.col("total") > offset + F.col("count")).withColumn("next_offset", F.expr(f"if(has_more, {offset} + count, null)"))


def actions(trace: DataFrame, *, agent: int | None = None, action_types: Sequence[str] = (), include_engine: bool = False) -> DataFrame:
    """Filtered actions. Engine actions are left out, and with them rows without an action; the types asked for are trimmed and lower-cased, the column isn't."""
    if not include_engine:
        trace = trace.where(~F.lower("action").isin(*ENGINE_ACTIONS))
    if wanted := [t.strip().lower() for t in action_types if t.strip()]:
        trace = trace.where(F.col("action").isin(wanted))
    return trace if agent is None else trace.where(F.col("user_id") == agent)


def kind() -> Column:
    """original, quote or repost; an empty quote is none."""
    return F.when(F.col("original_post_id").isNull(), "original").when(F.coalesce("quote_content", F.lit("")) != "", "quote").otherwise("repost")


def reactions() -> Column:
    """Likes, dislikes and shares: what the engagement filter counts, without comments."""
    return sum((F.coalesce(c, F.lit(0)) for c in ("num_likes", "num_dislikes", "num_shares")), F.lit(0))


def posts(rows: DataFrame, *, agent: int | None = None, min_engagement: int = 0, post_ids: Sequence[int] | None = None, population: DataFrame | None = None) -> DataFrame:
    """Filtered posts. An empty list of ids means none, not all; population keeps authors whose identity is of the population."""
    if post_ids is not None:
        rows = rows.where(F.col("post_id").isin(list(post_ids))) if post_ids else rows.where(F.lit(False))
    if agent is not None:
        rows = rows.where(F.col("user_id") == agent)
    if min_engagement > 0:
        rows = rows.where(reactions() >= min_engagement)
    return rows if population is None else rows.join(population.where("population").select("user_id"), "user_id", "left_semi")


def reply_counts(comments: DataFrame) -> DataFrame:
    return comments.where("post_id is not null").groupBy("post_id").agg(F.count("*").alias("n_comments"))


def with_engagement(rows: DataFrame, replies: DataFrame) -> DataFrame:
    """rows with kind, comments and engagement, which counts comments too."""
    out = rows.join(replies, "post_id", "left").withColumn("comments", F.coalesce("n_comments", F.lit(0))).drop("n_comments")
    return out.withColumn("kind", kind()).withColumn("engagement", reactions() + F.col("comments"))


def parsed_or_raw(text: Column) -> Column:
    """What is JSON as JSON, normalised, and all else as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def matching(rows: DataFrame, needle: str) -> DataFrame:
    """Rows with the needle, in lower case, in their username, name or action; a blank one keeps all."""
    needle = needle.strip().lower()
    return rows.where(F.contains(F.lower(F.concat_ws(" ", "username", "name", "action")), F.lit(needle))) if needle else rows


def on_platform(rows: DataFrame, own: str, asked: str | None) -> DataFrame:
    """rows, if the platform that is asked for is the run's own; another one is an error, as rows have no platform to filter by."""
    if asked and asked.strip().lower() != own:
        raise ValueError(f"this run is on {own}, not on {asked}")
    return rows


def interviews(trace: DataFrame, agent: int | None = None) -> DataFrame:
    """Interview rows with prompt and response from info; what isn't a JSON object is all response."""
    rows = trace.where(F.lower("action") == "interview")
    if agent is not None:
        rows = rows.where(F.col("user_id") == agent)
    parsed = F.try_parse_json("info")
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    return rows.select("rid", "user_id", F.when(is_object, F.coalesce(F.try_variant_get(parsed, "$.prompt", "string"), F.lit(""))).otherwise("").alias("prompt"), F.when(is_object, F.coalesce(F.try_variant_get(parsed, "$.response", "string"), F.lit(""))).otherwise(F.coalesce("info", F.lit(""))).alias("response"))
