"""Rounds: bounds from high-water marks, attribution of rows, progress, rollback and recounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bins that the key space is cut into to join rows with the rounds that they fall in.
BINS = 4096


def round_bounds(ledger: DataFrame, mark: str) -> DataFrame:
    """(round, lower, upper): rows of a table are in a round if lower < rid <= upper. A missing mark repeats the one before, so its round is empty.

    The window has one row for each round, so its single partition is as small as the ledger.
    """
    by_round = Window.orderBy("round")
    filled = ledger.select("round", F.coalesce(F.last(mark, ignorenulls=True).over(by_round), F.lit(0)).cast("long").alias("upper"))
    return filled.select("round", F.lag("upper", 1, 0).over(by_round).alias("lower"), "upper")


def decoded(stored: DataFrame) -> DataFrame:
    """The ledger as it is stored, with its JSON columns read: counts of actions, and what failed; a column that is no JSON is null."""
    return stored.withColumns({"action_counts": F.from_json("action_counts", "map<string, bigint>"), "failures": F.from_json("failures", "array<string>")}).orderBy("round")


def attributed(rows: DataFrame, bounds: DataFrame, rid: str = "rid") -> DataFrame:
    """rows with round, null in the open round after the last mark.

    An interval join by bins: every round is listed once for each bin that it meets, rows meet their bin's rounds by an
    equality, and the interval is tested there. Rounds don't overlap, so a row meets one at most.
    """
    step = bounds.agg(F.expr(f"coalesce(max(upper), 0) div {BINS} + 1")).scalar()
    spread = bounds.where("lower < upper").withColumn("_step", step)
    spread = spread.select("round", "lower", "upper", F.explode(F.expr("sequence((lower + 1) div _step, upper div _step)")).alias("_bin"))
    binned = rows.withColumn("_step", step).withColumn("_bin", F.expr(f"`{rid}` div _step")).drop("_step")
    inside = "r._bin = b._bin and r.`{0}` > b.lower and r.`{0}` <= b.upper".format(rid)
    return binned.alias("r").join(spread.alias("b"), F.expr(inside), "left").select(*[F.col(f"r.`{c}`") for c in rows.columns], "b.round")


def in_round(rows: DataFrame, bounds: DataFrame, number: int, rid: str = "rid") -> DataFrame:
    """The rows of one round. An unknown or open round has none; the bounds are scalars, so the filter reaches the scan."""
    own = bounds.where(F.col("round") == number)
    lower, upper = own.agg(F.coalesce(F.max("lower"), F.lit(-1))).scalar(), own.agg(F.coalesce(F.max("upper"), F.lit(-1))).scalar()
    return rows.where((F.col(rid) > lower) & (F.col(rid) <= upper))


def actions_since(trace: DataFrame, mark: int) -> DataFrame:
    """(action, n) of rows after a mark, engine actions included; null and blank actions don't count."""
    return trace.where((F.col("rid") > mark) & (F.col("action") != "")).groupBy("action").agg(F.count("*").alias("n"))


def high_water(tables: dict[str, DataFrame], rid: str = "rid") -> DataFrame:
    """(name, mark): the largest rid of each table, 0 if it is empty."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.coalesce(F.max(rid), F.lit(0)).cast("long").alias("mark")).select(F.lit(name).alias("name"), "mark")
        out = one if out is None else out.unionByName(one)
    return out


def action_counts_by_round(trace: DataFrame, bounds: DataFrame) -> DataFrame:
    """(round, action, n) of closed rounds, counted once for every round and action."""
    return attributed(trace.select("rid", "action"), bounds).where("round is not null and action <> ''").groupBy("round", "action").agg(F.count("*").alias("n"))


def progress(ledger: DataFrame, counts: DataFrame) -> DataFrame:
    """One row: rounds done (round 0 is the seed), all actions, failures and skips, the last round and its end."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("actions"), F.countDistinct("action").alias("kinds"))
    own = ledger.agg(
        F.greatest(F.lit(0), F.count("*") - 1).alias("rounds_completed"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"),
        F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"), F.max("round").alias("last_round"), F.max_by("ended_at", "round").alias("last_ended_at"),
    )
    return own.withColumns({"actions": total.select("actions").scalar(), "kinds": total.select("kinds").scalar()})


def action_distribution(counts: DataFrame) -> DataFrame:
    """(action, n, share): the rounds' counts merged, with the share of all."""
    merged = counts.groupBy("action").agg(F.sum("n").alias("n"))
    return merged.withColumn("share", F.col("n") / merged.agg(F.sum("n")).scalar())


def timeline(ledger: DataFrame, posts: DataFrame, comments_per_post: DataFrame, from_round: int | None = None, to_round: int | None = None) -> DataFrame:
    """Per round: what the ledger has, posts and comments on them, and whether it is the seed; both ends of the range are included."""
    if from_round is not None and to_round is not None and to_round < from_round:
        raise ValueError(f"the range ends at {to_round}, before it begins at {from_round}")
    bounds = round_bounds(ledger, "post_mark")
    made = attributed(posts.select("rid", "post_id"), bounds).where("round is not null").join(comments_per_post, "post_id", "left")
    made = made.groupBy("round").agg(F.count("*").alias("posts"), F.coalesce(F.sum("n_comments"), F.lit(0)).alias("comments"))
    out = ledger.join(made, "round", "left").select(
        "round", "acted", "failed", "skipped", F.coalesce("posts", F.lit(0)).alias("posts"), F.coalesce("comments", F.lit(0)).alias("comments"), (F.col("round") == 0).alias("seed")
    )
    if from_round is not None:
        out = out.where(F.col("round") >= from_round)
    return out if to_round is None else out.where(F.col("round") <= to_round)


def rows_by_round(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """(round, n, first_rid, last_rid) of closed rounds."""
    return attributed(rows.select("rid"), bounds).where("round is not null").groupBy("round").agg(F.count("*").alias("n"), F.min("rid").alias("first_rid"), F.max("rid").alias("last_rid"))


def seconds_per_round(ledger: DataFrame) -> DataFrame:
    """Seconds between the ends of rounds, those without an end left out."""
    ended = ledger.where("ended_at is not null").select("round", F.unix_micros(F.col("ended_at").cast("timestamp")).alias("t"))
    took = F.col("t") - F.lag("t").over(Window.orderBy("round"))
    return ended.select("round", (took / 1_000_000).alias("seconds")).where("seconds is not null")


def rolled_back(tables: dict[str, DataFrame], ledger: DataFrame, number: int, marks: dict[str, str], rid: str = "rid") -> dict[str, DataFrame]:
    """The tables without rows after a round's marks. Here a missing mark is 0: it clears the table."""
    out = {}
    for name, df in tables.items():
        mark = ledger.where(F.col("round") == number).agg(F.coalesce(F.max(marks[name]) if name in marks else F.lit(None), F.lit(0))).scalar()
        out[name] = df.where(F.col(rid) <= mark)
    return out


def removed_counts(tables: dict[str, DataFrame], kept: dict[str, DataFrame]) -> DataFrame:
    """(name, removed) of the tables that a rollback shortens."""
    out = None
    for name, df in tables.items():
        counts = df.agg(F.count("*").alias("a")).withColumn("b", kept[name].agg(F.count("*")).scalar())
        one = counts.select(F.lit(name).alias("name"), (F.col("a") - F.col("b")).alias("removed"))
        out = one if out is None else out.unionByName(one)
    return out.where("removed > 0")


def recounted(posts: DataFrame, likes: DataFrame, dislikes: DataFrame) -> DataFrame:
    """posts with likes, dislikes and shares counted anew from what is left: rows of likes and dislikes (post_id), and posts that repeat one."""
    count = lambda df, key, name: df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("post_id")).agg(F.count("*").alias(name))
    out = posts.drop("num_likes", "num_dislikes", "num_shares")
    for counts in (count(likes, "post_id", "num_likes"), count(dislikes, "post_id", "num_dislikes"), count(posts, "original_post_id", "num_shares")):
        out = out.join(counts, "post_id", "left")
    return out.fillna(0, ["num_likes", "num_dislikes", "num_shares"])
