"""Queries about a run: rounds, feeds, agents and sentiment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators import agents, feed, ledger, sentiment
from loomwork.plans.registry import query
from loomwork.plans.views import Run

_BOUNDS = """bounds AS (SELECT round, lag(upper, 1, 0) OVER (ORDER BY round) AS lower, upper FROM (SELECT round, coalesce(last_value(trace_mark IGNORE NULLS) OVER (ORDER BY round), 0) AS upper FROM ledger))"""
_POST_BOUNDS = """bounds AS (SELECT round, lag(upper, 1, 0) OVER (ORDER BY round) AS lower, upper FROM (SELECT round, coalesce(max(post_mark) OVER (ORDER BY round), 0) AS upper FROM ledger))"""
_ATTRIBUTED = """attributed AS (SELECT t.*, b.round FROM trace t LEFT JOIN bounds b ON t.rid > b.lower AND t.rid <= b.upper)"""
_ENGINE = "('exit', 'sign_up', 'signup', 'update_rec_table')"


def _with(views: list[str], rest: str) -> str:
    """Views of a query's own come first; those of the run are added in front of them."""
    return "SELECT * FROM (WITH " + ",\n".join(views) + "\n" + rest + ") q"


def trace_bounds(run: Run) -> DataFrame:
    return ledger.round_bounds(run.ledger, "trace_mark")


@query("SELECT round, lag(upper, 1, 0) OVER (ORDER BY round) AS lower, upper FROM (SELECT round, coalesce(max(post_mark) OVER (ORDER BY round), 0) AS upper FROM ledger) f")
def win1_round_bounds(run: Run) -> DataFrame:
    return ledger.round_bounds(run.ledger, "post_mark")


@query(_with([_BOUNDS, _ATTRIBUTED], "SELECT round, count(*) AS n, count(DISTINCT user_id) AS agents, min(rid) AS first_rid, max(rid) AS last_rid FROM attributed GROUP BY round"))
def join3_round_attribution(run: Run) -> DataFrame:
    rows = ledger.attributed(run.trace.select("rid", "user_id"), trace_bounds(run))
    return rows.groupBy("round").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("agents"), F.min("rid").alias("first_rid"), F.max("rid").alias("last_rid"))


@query(_with([_BOUNDS, _ATTRIBUTED], f"SELECT a.round, a.action, i.population, count(*) AS n, count(DISTINCT a.user_id) AS agents FROM attributed a JOIN identities i ON a.user_id = i.user_id WHERE lower(a.action) NOT IN {_ENGINE} AND a.round IS NOT NULL GROUP BY ALL"))
def m0_round_actions(run: Run) -> DataFrame:
    """Actions of each closed round by type and by kind of agent: the flagship query."""
    rows = ledger.attributed(feed.actions(run.trace).select("rid", "user_id", "action"), trace_bounds(run)).where("round is not null")
    who = feed.identities(run.profiles, run.users).select("user_id", "population")
    return rows.join(who, "user_id").groupBy("round", "action", "population").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("agents"))


@query(f"SELECT t.rid, t.user_id, t.action, coalesce(i.username, '') AS username, coalesce(i.population, true) AS population FROM (SELECT * FROM trace WHERE lower(action) NOT IN {_ENGINE} ORDER BY rid DESC LIMIT 100 OFFSET 20) t LEFT JOIN identities i ON t.user_id = i.user_id")
def flt1_actions_page(run: Run) -> DataFrame:
    rows = feed.page(feed.actions(run.trace.select("rid", "user_id", "action")), limit=100, offset=20)
    return feed.identified(rows, feed.identities(run.profiles, run.users)).select("rid", "user_id", "action", "username", "population")


@query("SELECT action, count(*) AS n FROM trace WHERE action IN ('click', 'purchase', 'signup') GROUP BY action")
def flt2_actions_by_type(run: Run) -> DataFrame:
    return feed.actions(run.trace, action_types=["click", " PURCHASE ", "signup"], include_engine=True).groupBy("action").agg(F.count("*").alias("n"))


@query(_with([_BOUNDS], "SELECT t.rid, t.user_id, t.action FROM trace t, bounds b WHERE b.round = 4 AND t.rid > b.lower AND t.rid <= b.upper"))
def flt4_actions_in_round(run: Run) -> DataFrame:
    return ledger.in_round(run.trace, trace_bounds(run), 4).select("rid", "user_id", "action")


@query("SELECT 0 AS n, 0 AS posts WHERE true")
def flt4_unknown_round(run: Run) -> DataFrame:
    """A round that isn't there, and an empty list of ids, have no rows, rather than all."""
    rows = ledger.in_round(run.trace, trace_bounds(run), 10_000)
    return rows.agg(F.count("*").cast("int").alias("n")).withColumn("posts", feed.posts(run.posts, post_ids=[]).agg(F.count("*").cast("int")).scalar())


@query("SELECT action, count(*) AS n FROM trace WHERE rid > (SELECT max(trace_mark) FROM ledger WHERE round = 5) AND action <> '' GROUP BY action")
def agg3_actions_since_mark(run: Run) -> DataFrame:
    mark = run.ledger.where("round = 5").agg(F.max("trace_mark")).scalar()
    return ledger.actions_since(run.trace.withColumn("_mark", mark).where("rid > _mark"), 0)


@query(_with([_BOUNDS, _ATTRIBUTED], """SELECT (SELECT greatest(0, count(*) - 1) FROM ledger) AS rounds_completed, (SELECT sum(failed) FROM ledger) AS failed, (SELECT sum(skipped) FROM ledger) AS skipped, (SELECT max(round) FROM ledger) AS last_round,
(SELECT max(ended_at) FROM ledger) AS last_ended_at, count(*) AS actions, count(DISTINCT action) AS kinds FROM attributed WHERE round IS NOT NULL AND action <> ''"""))
def agg4_progress(run: Run) -> DataFrame:
    return ledger.progress(run.ledger, ledger.action_counts_by_round(run.trace, trace_bounds(run)))


@query(_with([_BOUNDS, _ATTRIBUTED], "SELECT action, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM attributed WHERE round IS NOT NULL AND action <> '' GROUP BY action"))
def agg5_action_distribution(run: Run) -> DataFrame:
    return ledger.action_distribution(ledger.action_counts_by_round(run.trace, trace_bounds(run)))


@query(_with([_POST_BOUNDS], """SELECT l.round, l.acted, l.failed, l.skipped, coalesce(m.posts, 0) AS posts, coalesce(m.comments, 0) AS comments, l.round = 0 AS seed FROM ledger l LEFT JOIN
(SELECT b.round, count(*) AS posts, sum(coalesce(c.n, 0)) AS comments FROM messages m JOIN bounds b ON m.rid > b.lower AND m.rid <= b.upper LEFT JOIN (SELECT post_id, count(*) AS n FROM comments GROUP BY 1) c ON m.post_id = c.post_id GROUP BY 1) m ON l.round = m.round WHERE l.round BETWEEN 0 AND 20"""))
def agg6_timeline(run: Run) -> DataFrame:
    return ledger.timeline(run.ledger, run.messages, feed.reply_counts(run.comments), 0, 20).withColumn("comments", F.col("comments").cast("long"))


@query("SELECT 'trace' AS name, coalesce(max(rid), 0) AS mark FROM trace UNION ALL SELECT 'post', coalesce(max(rid), 0) FROM posts UNION ALL SELECT 'message', coalesce(max(rid), 0) FROM messages")
def agg11_high_water(run: Run) -> DataFrame:
    return ledger.high_water({"trace": run.trace, "post": run.posts, "message": run.messages})


def _likes(run: Run, disliked: bool) -> DataFrame:
    return run.table("lineitem").where((F.col("l_returnflag") == "R") == disliked).select(F.col("l_orderkey").alias("post_id"))


@query("""SELECT p.post_id, (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = p.post_id AND l_returnflag <> 'R') AS num_likes, (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = p.post_id AND l_returnflag = 'R') AS num_dislikes,
(SELECT count(*) FROM posts s WHERE s.original_post_id = p.post_id) AS num_shares FROM posts p""")
def agg12_recount(run: Run) -> DataFrame:
    """Counters of all posts, made anew from what is left of the reactions."""
    return ledger.recounted(run.posts, _likes(run, False), _likes(run, True)).select("post_id", "num_likes", "num_dislikes", "num_shares")


@query("SELECT * FROM (SELECT 'trace' AS name, count(*) AS removed FROM trace WHERE rid > (SELECT trace_mark FROM ledger WHERE round = 3) UNION ALL SELECT 'message', count(*) FROM messages) r WHERE removed > 0")
def snk10_rollback(run: Run) -> DataFrame:
    """What a return to round 3 removes: the posts' mark is missing there, which clears them."""
    tables = {"trace": run.trace, "message": run.messages}
    return ledger.removed_counts(tables, ledger.rolled_back(tables, run.ledger, 3, {"trace": "trace_mark", "message": "post_mark"}))


@query(_with([_POST_BOUNDS], "SELECT b.round, count(*) AS n, min(m.rid) AS first_rid, max(m.rid) AS last_rid FROM messages m JOIN bounds b ON m.rid > b.lower AND m.rid <= b.upper GROUP BY 1"))
def agg13_rows_by_round(run: Run) -> DataFrame:
    return ledger.rows_by_round(run.messages, ledger.round_bounds(run.ledger, "post_mark"))


@query("SELECT * FROM (SELECT round, (epoch_us(ended_at) - lag(epoch_us(ended_at)) OVER (ORDER BY round)) / 1000000 AS seconds FROM ledger) d WHERE seconds IS NOT NULL")
def win2_seconds_per_round(run: Run) -> DataFrame:
    return ledger.seconds_per_round(run.ledger)


@query("SELECT * FROM identities")
def join2_identities(run: Run) -> DataFrame:
    return feed.identities(run.profiles, run.users)


def _stats(run: Run, population_only: bool = False) -> DataFrame:
    trace = run.trace
    of = lambda *kinds: (trace.where(F.col("action").isin(*kinds)), "user_id")
    counts = {"actions": (trace, "user_id"), "posts": (run.posts, "user_id"), "comments": (run.comments, "user_id"), "likes_given": of("click"), "dislikes_given": of("error"), "following": of("signup"), "followers": of("purchase")}
    return agents.agent_stats(feed.identities(run.profiles, run.users), counts, run.posts, population_only)


_STATS = """stats AS (SELECT i.*, (SELECT count(*) FROM trace t WHERE t.user_id = i.user_id) AS actions, (SELECT count(*) FROM posts p WHERE p.user_id = i.user_id) AS posts, (SELECT count(*) FROM comments c WHERE c.user_id = i.user_id) AS comments,
(SELECT count(*) FROM trace t WHERE t.user_id = i.user_id AND action = 'click') AS likes_given, (SELECT count(*) FROM trace t WHERE t.user_id = i.user_id AND action = 'error') AS dislikes_given, (SELECT count(*) FROM trace t WHERE t.user_id = i.user_id AND action = 'signup') AS following,
(SELECT count(*) FROM trace t WHERE t.user_id = i.user_id AND action = 'purchase') AS followers, coalesce((SELECT sum(num_likes) FROM posts p WHERE p.user_id = i.user_id), 0) AS likes_received, coalesce((SELECT sum(num_shares) FROM posts p WHERE p.user_id = i.user_id), 0) AS reposts_received FROM identities i)"""


@query(_with([_STATS], "SELECT *, likes_received + reposts_received AS engagement_received FROM stats"))
def join5_agent_stats(run: Run) -> DataFrame:
    return _stats(run)


@query(_with([_STATS], "SELECT user_id, engagement_received FROM (SELECT *, likes_received + reposts_received AS engagement_received FROM stats) s ORDER BY engagement_received DESC, user_id LIMIT 25"))
def top2_agents_by_engagement(run: Run) -> DataFrame:
    return agents.ranked(_stats(run), "engagement_received", 25).select("user_id", "engagement_received")


@query(_with([_STATS], "SELECT count(*) AS silent FROM stats WHERE population AND actions = 0"))
def agg7_silent_agents(run: Run) -> DataFrame:
    return agents.silent(_stats(run, population_only=True))


@query("SELECT sum(CASE activity_level WHEN 'low' THEN 0.2::DOUBLE WHEN 'high' THEN 0.9::DOUBLE ELSE 0.55::DOUBLE END) > 0 AS some, count(*) AS agents FROM profiles")
def agg27_expected_calls(run: Run) -> DataFrame:
    return agents.expected_calls(run.profiles).select((F.col("expected_calls") > 0).alias("some"), run.profiles.agg(F.count("*")).scalar().alias("agents"))


@query("SELECT CASE WHEN original_post_id IS NULL THEN 'original' WHEN coalesce(quote_content, '') <> '' THEN 'quote' ELSE 'repost' END AS kind, count(*) AS n FROM posts GROUP BY 1")
def prj1_post_kinds(run: Run) -> DataFrame:
    return run.posts.groupBy(feed.kind().alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT post_id, user_id, num_likes, num_dislikes, num_shares FROM posts WHERE coalesce(num_likes, 0) + coalesce(num_dislikes, 0) + coalesce(num_shares, 0) >= 9")
def flt5_min_engagement(run: Run) -> DataFrame:
    return feed.posts(run.posts, min_engagement=9).select("post_id", "user_id", "num_likes", "num_dislikes", "num_shares")


@query("SELECT post_id, user_id FROM posts WHERE post_id IN (1, 7, 14, 700) UNION ALL SELECT post_id, user_id FROM posts WHERE user_id = 42")
def flt6_posts_by_id_and_agent(run: Run) -> DataFrame:
    some = feed.posts(run.posts, post_ids=[1, 7, 14, 700]).select("post_id", "user_id")
    return some.unionByName(feed.posts(run.posts, agent=42).select("post_id", "user_id"))


@query("SELECT p.post_id, p.user_id FROM posts p WHERE p.user_id IN (SELECT user_id FROM identities WHERE population)")
def flt7_population_posts(run: Run) -> DataFrame:
    return feed.posts(run.posts, population=feed.identities(run.profiles, run.users)).select("post_id", "user_id")


@query("SELECT m.post_id, coalesce(c.n, 0) AS comments, coalesce(c.n, 0) AS engagement FROM messages m LEFT JOIN (SELECT post_id, count(*) AS n FROM comments GROUP BY 1) c ON m.post_id = c.post_id")
def join4_reply_counts(run: Run) -> DataFrame:
    zero = F.lit(0).cast("long")
    rows = run.messages.withColumns({"num_likes": zero, "num_dislikes": zero, "num_shares": zero, "original_post_id": F.lit(None).cast("long"), "quote_content": F.lit(None).cast("string")})
    return feed.with_engagement(rows, feed.reply_counts(run.comments)).select("post_id", "comments", "engagement")


@query('SELECT count(*) AS total, 100 AS "limit", 250 AS "offset", greatest(0, least(100, count(*) - 250)) AS count, count(*) > 250 + greatest(0, least(100, count(*) - 250)) AS has_more, CASE WHEN count(*) > 250 + greatest(0, least(100, count(*) - 250)) THEN 250 + greatest(0, least(100, count(*) - 250)) END AS next_offset FROM posts')
def prj6_page_envelope(run: Run) -> DataFrame:
    return feed.envelope(run.posts, limit=100, offset=250)


@query("SELECT post_id, created_at, coalesce(username, '') AS username FROM (SELECT * FROM posts ORDER BY rid LIMIT 50) p LEFT JOIN identities i ON p.user_id = i.user_id")
def top1_oldest_posts(run: Run) -> DataFrame:
    rows = feed.page(run.posts.select("rid", "post_id", "user_id", "created_at"), 50, 0, "oldest")
    return feed.identified(rows, feed.identities(run.profiles, run.users)).select("post_id", "created_at", "username")


@query("SELECT CAST(day AS VARCHAR) AS day, post_id, engagement FROM (SELECT CAST(created_at AS DATE) AS day, post_id, num_likes + num_dislikes + num_shares AS engagement, row_number() OVER (PARTITION BY CAST(created_at AS DATE) ORDER BY num_likes + num_dislikes + num_shares DESC, post_id) AS r FROM posts WHERE num_likes + num_dislikes + num_shares >= 1) t WHERE r <= 3")
def win8_top_posts_per_day(run: Run) -> DataFrame:
    """The three most engaging posts of each day, above a threshold."""
    from pyspark.sql import Window

    rows = run.posts.select(F.to_date("created_at").alias("day"), "post_id", (F.col("num_likes") + F.col("num_dislikes") + F.col("num_shares")).alias("engagement")).where("engagement >= 1")
    place = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("engagement"), "post_id"))
    return rows.withColumn("r", place).where("r <= 3").select(F.col("day").cast("string").alias("day"), "post_id", "engagement")


_POST_SCORES = "pscores AS (SELECT post_id, score, stance FROM scores WHERE post_id % 3 <> 0)"


def _post_scores(run: Run) -> DataFrame:
    """Scores for some posts only, so that reposts of them can inherit."""
    return run.scores.where("post_id % 3 <> 0")


@query(_with([_POST_SCORES], "SELECT p.post_id, s.score, s.stance, 'inherited from post ' || p.original_post_id AS rationale FROM posts p JOIN pscores s ON p.original_post_id = s.post_id WHERE trim(coalesce(p.content, '')) = '' AND p.post_id NOT IN (SELECT post_id FROM pscores)"))
def join6_inherited_scores(run: Run) -> DataFrame:
    return sentiment.inherited(run.posts, _post_scores(run))


@query("SELECT count(*) AS n, min(post_id) AS first_post FROM posts WHERE trim(coalesce(content, '')) <> '' AND post_id NOT IN (SELECT post_id FROM scores)")
def join7_outstanding(run: Run) -> DataFrame:
    return sentiment.outstanding(run.posts, run.scores).agg(F.count("*").alias("n"), F.min("post_id").alias("first_post"))


def _trajectory(run: Run) -> DataFrame:
    return sentiment.trajectory(run.table("documents").select((F.col("doc_id") % 40).cast("int").alias("round"), F.col("doc_id").alias("post_id")), run.scores.where("post_id % 40 not in (7, 8, 20)"))


_TRAJECTORY = """path AS (SELECT CAST(d.doc_id % 40 AS INTEGER) AS round, count(*) AS posts, count(s.score) AS scored, avg(s.score) AS mean_score, count(*) FILTER (WHERE s.stance = 'supportive') AS supportive, count(*) FILTER (WHERE s.stance = 'opposed') AS opposed,
count(*) FILTER (WHERE s.stance = 'neutral') AS neutral, count(*) FILTER (WHERE s.score IS NOT NULL AND s.stance = '') AS unknown FROM documents d LEFT JOIN (SELECT * FROM scores WHERE post_id % 40 NOT IN (7, 8, 20)) s ON d.doc_id = s.post_id GROUP BY 1)"""


@query(_with([_TRAJECTORY], "SELECT * FROM path"))
def agg8_sentiment_trajectory(run: Run) -> DataFrame:
    return _trajectory(run)


@query(_with([_TRAJECTORY], "SELECT min(round) AS first_round, max(round) AS last_round, count(*) AS rounds FROM (SELECT round, round - row_number() OVER (ORDER BY round) AS island FROM path WHERE mean_score IS NOT NULL) i GROUP BY island HAVING count(*) > 1"))
def win6_scored_runs(run: Run) -> DataFrame:
    return sentiment.scored_runs(_trajectory(run))
