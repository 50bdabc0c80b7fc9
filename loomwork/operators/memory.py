"""What a run remembers: entities mentioned in posts, the best of each round, and the last turns of a conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.operators.needles import held

SHORTEST_NAME = 4


def mentioned(posts: DataFrame, names: DataFrame) -> DataFrame:
    """(post_id, name) for every name (normalised, of four letters or more) that stands anywhere in a post's normalised content: names and posts meet by each name's rarest gram, see needles.held."""
    own = names.where(F.length("normalised") >= SHORTEST_NAME).select(F.col("normalised").alias("needle"))
    places = lambda text, some: [(n,) for n in sorted(some) if n in text]
    return held(posts, own, lambda text: text, places, [T.StructField("name", T.StringType())], "post_id", "normalised")


def remembered(posts: DataFrame, before_round: int, limit: int = 5) -> DataFrame:
    """The most engaging posts of earlier rounds only, later rounds first among equals."""
    return posts.where(F.col("round") < before_round).orderBy(F.desc("engagement"), F.desc("round"), "post_id").limit(limit)


def with_names(posts: DataFrame, about: DataFrame, before_round: int) -> DataFrame:
    """Posts of earlier rounds with the names (post_id, name) that each is about, sorted; none is an empty list."""
    names = about.groupBy("post_id").agg(F.sort_array(F.collect_set("name")).alias("names"))
    return posts.where(F.col("round") < before_round).join(names, "post_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))


def trimmed(messages: DataFrame, keep: int, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Each conversation's last user turns with what follows each, and its system messages; keep of 0 or less keeps all."""
    if keep <= 0:
        return messages
    by_turn = Window.partitionBy(conversation).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    counted = messages.withColumn("_n", F.count_if(F.col("role") == "user").over(by_turn))
    last = F.max("_n").over(Window.partitionBy(conversation))
    return counted.withColumn("_last", last).where(f"_n > _last - {int(keep)} or role = 'system'").drop("_n", "_last")


def idle_sessions(events: DataFrame, seconds: int) -> DataFrame:
    """(user_id, start, end, n): requests with no gap of so many seconds."""
    return events.groupBy("user_id", F.session_window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def grouped_interviews(interviews: DataFrame) -> DataFrame:
    """(prompt, answers, rounds) of interviews (prompt, response, round)."""
    return interviews.groupBy("prompt").agg(F.count("*").alias("answers"), F.sort_array(F.collect_set("round")).alias("rounds"))
