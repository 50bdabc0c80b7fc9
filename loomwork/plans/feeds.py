"""More queries about a run: filters that compose, projections, joins and counts; and texts and values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions import text as ft
from loomwork.functions import values as fv
from loomwork.operators import agents, feed, ledger, report, resolve, sentiment, tools
from loomwork.plans.monitoring import _ATTRIBUTED, _BOUNDS, _ENGINE, _POST_BOUNDS, _STATS, _stats, _with, trace_bounds
from loomwork.plans.registry import query
from loomwork.plans.views import Run
from loomwork.sources.shared import scratch


@query(f"SELECT rid, action FROM trace WHERE user_id = 7 AND lower(action) NOT IN {_ENGINE}")
def flt3_actions_of_agent(run: Run) -> DataFrame:
    return feed.actions(run.trace, agent=7).select("rid", "action")


@query(_with([_BOUNDS], "SELECT t.rid, t.user_id FROM trace t JOIN bounds b ON t.rid > b.lower AND t.rid <= b.upper WHERE b.round BETWEEN 2 AND 4 AND t.user_id % 5 = 0 AND t.action IN ('click', 'view')"))
def flt8_composed_filters(run: Run) -> DataFrame:
    """Rounds, agents and kinds of actions together."""
    rows = feed.actions(ledger.attributed(run.trace, trace_bounds(run)).where("round between 2 and 4"), action_types=["click", "view"])
    return rows.where("user_id % 5 = 0").select("rid", "user_id")


@query("SELECT round, acted FROM ledger WHERE round BETWEEN 3 AND 8 UNION ALL SELECT -1, 1")
def flt9_timeline_range(run: Run) -> DataFrame:
    """Both ends are included; a range that ends before it begins is refused, which the last row says."""
    bounded = lambda a, b: ledger.timeline(run.ledger, run.messages, feed.reply_counts(run.comments), a, b).select("round", "acted")
    try:
        bounded(8, 3)
        refused = 0
    except ValueError:
        refused = 1
    return bounded(3, 8).unionByName(run.ledger.where("round = 0").select(F.lit(-1).alias("round"), F.lit(refused).cast("long").alias("acted")))


@query(f"SELECT t.rid FROM trace t JOIN identities i ON t.user_id = i.user_id WHERE contains(lower(i.username || ' ' || i.name || ' ' || t.action), '_12') AND lower(t.action) NOT IN {_ENGINE}")
def flt14_feed_search(run: Run) -> DataFrame:
    rows = feed.identified(feed.actions(run.trace.select("rid", "user_id", "action")), feed.identities(run.profiles, run.users))
    return feed.matching(rows, "_12").select("rid")


@query(_with([_STATS], "SELECT user_id, actions FROM stats WHERE actions > 0"))
def flt16_active_agents(run: Run) -> DataFrame:
    return agents.active(_stats(run)).select("user_id", "actions")


@query("SELECT count(*) AS n, 1 AS refused FROM posts")
def flt21_platform(run: Run) -> DataFrame:
    """Rows for the run's own platform, all of them; for another one an error."""
    try:
        feed.on_platform(run.posts, "twitter", "reddit")
        refused = 0
    except ValueError:
        refused = 1
    return feed.on_platform(run.posts, "twitter", " Twitter ").agg(F.count("*").alias("n")).withColumn("refused", F.lit(refused))


_REPLIES = "replies AS (SELECT post_id, count(*) AS n FROM comments GROUP BY 1)"


@query(_with([_REPLIES], "SELECT p.post_id, coalesce(num_likes, 0) + coalesce(num_dislikes, 0) + coalesce(num_shares, 0) + coalesce(n, 0) AS engagement, CASE WHEN original_post_id IS NULL THEN 'original' WHEN coalesce(quote_content, '') <> '' THEN 'quote' ELSE 'repost' END AS kind FROM posts p LEFT JOIN replies r ON p.post_id = r.post_id"))
def prj2_engagement(run: Run) -> DataFrame:
    return feed.with_engagement(run.posts, feed.reply_counts(run.comments)).select("post_id", "engagement", "kind")


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '{\"n\":' || turn || '}' ELSE 'plain ' || role END AS info FROM conversations")
def prj3_parsed_or_raw(run: Run) -> DataFrame:
    info = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('{ "n" : '), F.col("turn"), F.lit("}"))).otherwise(F.concat(F.lit("plain "), F.col("role")))
    return run.table("conversations").select("conv_id", "turn", feed.parsed_or_raw(info).alias("info"))


@query("SELECT t.rid, coalesce(i.username, '') AS username, coalesce(i.population, true) AS population FROM trace t LEFT JOIN (SELECT * FROM identities WHERE user_id % 4 <> 1) i ON t.user_id = i.user_id")
def prj4_unknown_authors(run: Run) -> DataFrame:
    """A quarter of the agents are unknown: blank names, and counted as population."""
    who = feed.identities(run.profiles, run.users).where("user_id % 4 <> 1")
    return feed.identified(run.trace.select("rid", "user_id"), who).select("rid", "username", "population")


@query("SELECT round, CASE WHEN total = 0 THEN 0.0::DOUBLE ELSE least(round(100.0 * (round + 1) / total, 1), 100.0)::DOUBLE END AS percent, CASE WHEN round % 3 = 0 THEN 'writing' END AS live_stage, CASE WHEN round % 3 = 0 THEN false WHEN round % 3 = 1 THEN true END AS live_stale FROM (SELECT round, CASE WHEN round % 7 = 6 THEN 0 ELSE 20 END AS total FROM ledger) l")
def prj7_run_status(run: Run) -> DataFrame:
    """Rounds as runs that have got so far: with a live worker, one that can't be reached, or none."""
    done = run.ledger.select("round", F.col("round").alias("sim_id"), F.lit("running").alias("state"), (F.col("round") + 1).alias("rounds_completed"), F.expr("if(round % 7 = 6, 0, 20)").alias("total_rounds"))
    live = run.ledger.where("round % 3 < 2").select(F.col("round").alias("sim_id"), F.lit("writing").alias("stage"), F.expr("if(round % 3 = 1, 'timed out', null)").alias("unreachable"))
    return report.status(done, live).select("round", F.round("percent", 1).alias("percent"), "live_stage", "live_stale")


@query("SELECT o_orderkey, least(round(100.0 * (o_orderkey % 37) / 30, 1), 100.0)::DOUBLE AS percent FROM orders")
def fnm11_percent(run: Run) -> DataFrame:
    return run.table("orders").select("o_orderkey", report.percent_done(F.col("o_orderkey") % 37, F.lit(30)).alias("percent"))


@query("SELECT c.comment_id, i.username, i.provenance FROM comments c LEFT JOIN identities i ON c.user_id = i.user_id")
def join1_identified_comments(run: Run) -> DataFrame:
    who = feed.identities(run.profiles, run.users)
    return feed.identified(run.comments.select("comment_id", "user_id"), who).join(who.select("user_id", "provenance"), "user_id", "left").select("comment_id", F.nullif("username", F.lit("")).alias("username"), "provenance")


@query("SELECT user_id, 'posts' AS metric, count(*) AS n FROM posts WHERE user_id IS NOT NULL GROUP BY 1 UNION ALL SELECT user_id, 'comments', count(*) FROM comments WHERE user_id % 3 <> 0 GROUP BY 1 UNION ALL SELECT user_id, 'actions', count(*) FROM trace GROUP BY 1")
def agg1_counts_by_agent(run: Run) -> DataFrame:
    """Rows by agent and kind; comments without an author don't count."""
    comments = run.comments.withColumn("user_id", F.expr("if(user_id % 3 = 0, null, user_id)"))
    return agents.counts({"posts": (run.posts, "user_id"), "comments": (comments, "user_id"), "actions": (run.trace, "user_id")})


@query("SELECT user_id, sum(coalesce(num_likes, 0)) AS likes_received, sum(coalesce(num_shares, 0)) AS reposts_received, sum(coalesce(num_likes, 0)) + sum(coalesce(num_shares, 0)) AS engagement_received FROM posts WHERE user_id IS NOT NULL GROUP BY 1")
def agg2_engagement_received(run: Run) -> DataFrame:
    return agents.received(run.posts)


@query("SELECT count(*) AS interviews FROM conversations WHERE role = 'user'")
def agg24_interview_count(run: Run) -> DataFrame:
    rows = run.table("conversations").select((F.col("conv_id") * 64 + F.col("turn")).alias("rid"), F.col("conv_id").alias("user_id"), F.when(F.col("role") == "user", "INTERVIEW").otherwise("post").alias("action"), F.lit("x").alias("info"))
    return feed.interviews(rows).agg(F.count("*").alias("interviews"))


@query("SELECT s_nationkey AS run, sum(length(s_name) + 1) AS bytes, count(*) AS rows FROM supplier GROUP BY 1")
def agg26_bytes_by_run(run: Run) -> DataFrame:
    """Suppliers as lines of files in a folder for each nation: their bytes, and lines."""
    path = scratch(run.spark, "sizes")
    run.table("supplier").select(F.col("s_nationkey").alias("run"), F.col("s_name").alias("value")).write.partitionBy("run").text(path)
    sizes = report.bytes_by_folder(run.spark, path, "run")
    lines = run.table("supplier").groupBy(F.col("s_nationkey").alias("run")).agg(F.count("*").alias("rows"))
    return sizes.select(F.col("run").cast("int").alias("run"), "bytes").join(lines, "run")


@query("SELECT round, acted FROM ledger ORDER BY round DESC LIMIT 5")
def win9_last_rounds(run: Run) -> DataFrame:
    return feed.page(run.ledger.select("round", "acted"), 5, key="round")


@query(_with([_POST_BOUNDS], "SELECT 'posts_in_round' AS tool, least(25, count(*)) AS n FROM messages m JOIN bounds b ON m.rid > b.lower AND m.rid <= b.upper WHERE b.round = 5 UNION ALL SELECT 'agent_history', least(25, count(*)) FROM trace WHERE user_id = 11 AND action <> 'signup' UNION ALL SELECT 'posts_by_agent', least(10, count(*)) FROM posts WHERE user_id = 11"))
def top12_tool_limits(run: Run) -> DataFrame:
    """However many are asked for, a tool gives 25 at most, and 10 if nothing is said."""
    own = tools.Tables(run.posts, run.comments, run.trace, ledger.round_bounds(run.ledger, "post_mark"))
    of = tools.Tables(run.messages, run.comments, run.trace, own.bounds)
    counted = lambda tables, name, **asked: tools.asked(tables, name, **asked).agg(F.count("*").alias("n")).select(F.lit(name).alias("tool"), "n")
    return counted(of, "posts_in_round", round_index=5, limit=400).unionByName(counted(own, "agent_history", agent=11, limit=100)).unionByName(counted(own, "posts_by_agent", agent=11))


@query("SELECT doc_id AS post_id, (length(text) % 21 - 10) / 10.0::DOUBLE AS score, CASE WHEN length(text) % 2 = 0 THEN 'supportive' ELSE 'opposed' END AS stance FROM documents WHERE text IS NOT NULL AND length(text) % 50 <> 0")
def udf4_scored_in_batches(run: Run) -> DataFrame:
    """A plain scorer that also scores what wasn't asked for, and gives scores beyond 1, which are dropped."""

    def scorer(batch: list[tuple[int, str]]) -> dict[int, tuple[float, str]]:
        return {-5: (0.5, "supportive")} | {i: (2.0 if len(t) % 50 == 0 else (len(t) % 21 - 10) / 10, "supportive" if len(t) % 2 == 0 else "opposed") for i, t in batch}

    return sentiment.asked(run.table("documents").where("text is not null").select(F.col("doc_id").alias("post_id"), F.col("text").alias("content")), scorer)


@query("SELECT doc_id, score FROM (SELECT doc_id, quality - toxic AS score FROM labels) s WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def set3_asked_scores(run: Run) -> DataFrame:
    """Scores of those who were asked for alone."""
    asked = run.table("documents").where("lang = 'en'").select(F.col("doc_id").alias("post_id"))
    rows = run.table("labels").select(F.col("doc_id").alias("post_id"), (F.col("quality") - F.col("toxic")).alias("score"))
    return sentiment.of_asked(rows, asked).select(F.col("post_id").alias("doc_id"), "score")


# ---- texts ---------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, list_bool_and(list_transform(string_split(lower(lang || ' ' || source), ' '), lambda t: contains(lower(text), t))) AS grounded FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL")
def fnt6_grounded(run: Run) -> DataFrame:
    d = run.table("documents").where("text is not null and lang is not null and source is not null")
    return d.select("doc_id", ft.grounded_in(F.lower(F.concat_ws(" ", "lang", "source")), F.col("text")).alias("grounded"))


@query("SELECT p_partkey, array_to_string(list_distinct_ordered, ',') AS names FROM (SELECT p_partkey, list_filter([lower(replace(trim(regexp_replace(p_type, '[^0-9A-Za-z]+', ' ', 'g')), ' ', '_')), lower(replace(trim(regexp_replace(p_brand, '[^0-9A-Za-z]+', ' ', 'g')), ' ', '_'))], lambda x: x <> '') AS list_distinct_ordered FROM part) a")
def fnt14_attribute_names(run: Run) -> DataFrame:
    """Names as they come, one twice and some that don't begin with a letter."""
    names = F.array("p_type", F.lit("9 lives"), "p_brand", F.upper("p_type"), F.lit("--"))
    return run.table("part").select("p_partkey", F.array_join(ft.attribute_names(names), ",").alias("names"))


@query("SELECT p_partkey, p_partkey % 4 IN (0, 3) AS ok FROM part")
def fnt15_identifiers_guarded(run: Run) -> DataFrame:
    name = F.element_at(F.array(F.concat(F.lit("_a"), "p_partkey"), F.concat("p_partkey", F.lit("a")), F.concat(F.lit("a-"), "p_partkey"), F.repeat(F.lit("x"), F.lit(63))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return run.table("part").select("p_partkey", ft.is_identifier(name).alias("ok"))


#: White space as Unicode has it.
_WHITE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BLANKS = f"trim(regexp_replace(text, '{_WHITE}+', ' ', 'g'))"


@query(f"SELECT doc_id, length(flat) AS n, CASE WHEN length(flat) <= 160 THEN md5(flat) ELSE md5(rtrim(substr(flat, 1, 159)) || '…') END AS short, md5(substr(flat, 1, 600)) AS cleaned FROM (SELECT doc_id, {_BLANKS} AS flat FROM documents WHERE text IS NOT NULL) d")
def fnt17_shortened(run: Run) -> DataFrame:
    d = run.table("documents").where("text is not null")
    md5 = lambda c: F.md5(F.encode(c, "UTF-8"))
    return d.select("doc_id", F.length(ft.collapsed(F.col("text"), 1_000_000_000)).cast("long").alias("n"), md5(ft.shortened(F.col("text"), 160)).alias("short"), md5(ft.collapsed(F.col("text"), 600)).alias("cleaned"))


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 2 THEN NULL ELSE '{\"role\":\"' || role || '\",\"note\":\"a } b\"}' END AS found FROM conversations")
def fnt21_salvaged_json(run: Run) -> DataFrame:
    """Answers with JSON in fences, between words, and cut off; braces in strings don't count."""
    json = F.to_json(F.struct("role", F.lit("a } b").alias("note")))
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), json, F.lit("\n```"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("It is } "), json, F.lit(" and {more"))).otherwise(F.expr("substring(concat('so: ', to_json(struct(role))), 1, 10)"))
    return run.table("conversations").select("conv_id", "turn", ft.salvaged(text).alias("found"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE event_type END AS suggestion FROM events")
def fnt22_suggestions(run: Run) -> DataFrame:
    """Kinds of events without their last letter, doubled, and nothing like any."""
    t = F.col("event_type")
    word = F.when(F.col("event_id") % 3 == 0, F.expr("substring(event_type, 1, length(event_type) - 1)")).when(F.col("event_id") % 3 == 1, F.concat(F.substring(t, 1, 1), t)).otherwise("0000")
    known = [r[0] for r in run.table("events").select("event_type").distinct().collect()]  # a handful of kinds
    return run.table("events").select("event_id", ft.suggestion(word, known).alias("suggestion"))


_INVISIBLE = r"[\x{00AD}\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]"
_NORMAL_TEXT = rf"regexp_replace(regexp_replace(regexp_replace(nfc_normalize(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '{_INVISIBLE}', '', 'g')), '[ \t]+(\n|$)', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{_WHITE}+|{_WHITE}+$', '', 'g')"


_PLAIN_TEXT = r"regexp_replace(text, '[^\x00-\x7F]', '?', 'g')"


@query(f"SELECT doc_id, md5({_NORMAL_TEXT.replace('(text,', f'({_PLAIN_TEXT},')}) AS digest FROM documents")
def fnt1_normalised_ascii(run: Run) -> DataFrame:
    """All documents, with a question mark for each character beyond ASCII."""
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "?")
    return run.table("documents").select("doc_id", F.md5(F.encode(ft.normalised_text(plain), "UTF-8")).alias("digest"))


@query(f"SELECT doc_id, md5({_NORMAL_TEXT}) AS digest FROM documents")
def fnt1_normalised_documents(run: Run) -> DataFrame:
    """All documents. Normal form KC is C here, as the texts have no compatibility characters; tests hold these against Python's."""
    return run.table("documents").select("doc_id", F.md5(F.encode(ft.normalised_text(F.col("text")), "UTF-8")).alias("digest"))


@query("SELECT rid, CAST(round AS BIGINT) AS shown FROM (SELECT rid, round FROM (SELECT t.rid, b.round FROM trace t LEFT JOIN (SELECT round, lag(upper, 1, 0) OVER (ORDER BY round) AS lower, upper FROM (SELECT round, coalesce(last_value(trace_mark IGNORE NULLS) OVER (ORDER BY round), 0) AS upper FROM ledger)) b ON t.rid > b.lower AND t.rid <= b.upper) a WHERE round IS NULL) o")
def str4_open_rows(run: Run) -> DataFrame:
    """Rows above the high-water mark are in an open round."""
    rows = ledger.attributed(run.trace.select("rid"), trace_bounds(run))
    return rows.where("round is null").select("rid", F.col("round").cast("long").alias("shown"))


@query("SELECT user_id, user_id * 3 AS key, CAST(round(user_id / 7.0, 2) AS DOUBLE) AS value FROM users")
def win7_first_values(run: Run) -> DataFrame:
    """A value for each agent, once, whatever repeats: the first of its rows counts."""
    rows = run.users.select("user_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk"))
    values = rows.select(F.lit("User").alias("type"), F.col("user_id").cast("string").alias("normalised"), F.lit("value").alias("key"), F.round(F.col("user_id") / 7 + F.col("chunk"), 2).cast("string").alias("value"), "chunk")
    first = resolve.attributes_folded(values)
    return first.select(F.col("normalised").cast("long").alias("user_id"), (F.col("normalised").cast("long") * 3).alias("key"), F.col("value").cast("double").alias("value"))
