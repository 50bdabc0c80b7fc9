"""Scores of posts: inheritance by reposts, what is left to score, and trajectories."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def inherited(posts: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores of reposts without text of their own, from the post that they repeat. One step: a repost of a repost gets none."""
    blank = posts.where("trim(coalesce(content, '')) = '' and original_post_id is not null").join(scores.select("post_id"), "post_id", "left_anti")
    source = scores.select(F.col("post_id").alias("original_post_id"), "score", "stance")
    return blank.join(source, "original_post_id").select("post_id", "score", "stance", F.substring(F.concat(F.lit("inherited from post "), F.col("original_post_id")), 1, 200).alias("rationale"))


def outstanding(posts: DataFrame, scores: DataFrame) -> DataFrame:
    """Posts with text that have no score yet."""
    return posts.where("trim(coalesce(content, '')) <> ''").join(scores.select("post_id"), "post_id", "left_anti")


def asked(posts: DataFrame, scorer: Callable[[list[tuple[int, str]]], dict[int, tuple[float, str]]], batches: Sequence[int] = (12, 4)) -> DataFrame:
    """Scores (post_id, score, stance) of posts (post_id, content) by a scorer that takes some at once: scores beyond -1 to 1 and for posts that weren't asked for are dropped; what a failed batch held is asked again in smaller ones, and then stays unscored."""

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            todo = list(zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True))
            found: dict[int, tuple[float, str]] = {}
            for size in batches:
                for part in (todo[k : k + size] for k in range(0, len(todo), size)):
                    try:
                        got = scorer(part)
                    except Exception:  # noqa: BLE001 - whatever a scorer raises, its batch stays unscored
                        continue
                    asked_for = {i for i, _ in part}
                    found |= {i: s for i, s in got.items() if i in asked_for and -1 <= s[0] <= 1}
                todo = [p for p in todo if p[0] not in found]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([s for s, _ in found.values()], pa.float64()), pa.array([t for _, t in found.values()], pa.string())], names=["post_id", "score", "stance"])

    return posts.select(F.col("post_id").cast("long"), "content").mapInArrow(run, "post_id long, score double, stance string")


def of_asked(scores: DataFrame, asked_for: DataFrame) -> DataFrame:
    """Scores of the posts that were asked for (post_id); all others are dropped."""
    return scores.join(asked_for.select("post_id"), "post_id", "left_semi")


def trajectory(posts_by_round: DataFrame, scores: DataFrame) -> DataFrame:
    """Per round: posts, those with a score, the mean over these (null without any), and the number of each stance. Unscored isn't neutral."""
    joined = posts_by_round.join(scores, "post_id", "left")
    has = F.col("score").isNotNull()
    stance = F.when(has, F.coalesce(F.nullif(F.trim("stance"), F.lit("")), F.lit("unknown")))
    return joined.groupBy("round").agg(
        F.count("*").alias("posts"), F.count_if(has).alias("scored"), F.avg("score").alias("mean_score"),
        *[F.count_if(stance == s).alias(s) for s in ("supportive", "opposed", "neutral", "unknown")],
    )


def scored_runs(path: DataFrame) -> DataFrame:
    """(first_round, last_round, rounds): stretches of rounds that follow each other and have a mean, of more than one round."""
    some = path.where("mean_score is not null").select("round", (F.col("round") - F.row_number().over(Window.orderBy("round"))).alias("island"))
    return some.groupBy("island").agg(F.min("round").alias("first_round"), F.max("round").alias("last_round"), F.count("*").alias("rounds")).where("rounds > 1").drop("island")
