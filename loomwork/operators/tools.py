"""Five named questions about a run, each with a few arguments, for callers that ask by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators import feed, ledger

MOST_RESULTS = 25


@dataclass(frozen=True)
class Tables:
    """What the questions are asked of: posts with rid, comments, trace, and the bounds of the rounds of posts."""

    posts: DataFrame
    comments: DataFrame
    trace: DataFrame
    bounds: DataFrame


def posts_in_round(run: Tables, round_index: int, limit: int = 10) -> DataFrame:
    return feed.page(ledger.in_round(run.posts, run.bounds, round_index), min(limit, MOST_RESULTS))


def agent_history(run: Tables, agent: int, limit: int = 10) -> DataFrame:
    return feed.page(feed.actions(run.trace, agent=agent), min(limit, MOST_RESULTS))


def posts_by_agent(run: Tables, agent: int, limit: int = 10) -> DataFrame:
    return feed.page(feed.posts(run.posts, agent=agent), min(limit, MOST_RESULTS))


def comments_on(run: Tables, post_id: int, limit: int = 10) -> DataFrame:
    return feed.page(run.comments.where(F.col("post_id") == post_id), min(limit, MOST_RESULTS), key="comment_id")


def most_engaged(run: Tables, limit: int = 10) -> DataFrame:
    """The newest posts with any reaction: by definition not sorted by engagement."""
    return feed.page(feed.posts(run.posts, min_engagement=1), min(limit, MOST_RESULTS))


TOOLS: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (posts_in_round, agent_history, posts_by_agent, comments_on, most_engaged)}


def asked(run: Tables, name: str, **arguments) -> DataFrame:
    """A question by name; an unknown one, or one with arguments that it doesn't take, is a row that says so."""
    try:
        return TOOLS[name](run, **arguments)
    except (KeyError, TypeError) as problem:
        return run.posts.sparkSession.createDataFrame([(f"{name}: {problem}",)], "error string")
