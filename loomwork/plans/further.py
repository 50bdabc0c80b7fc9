"""More queries: interviews, retention, comparisons, fingerprints, named questions and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions import text as ft
from loomwork.functions import values as fv
from loomwork.operators import feed, ledger, memory, population, report, tools
from loomwork.plans.registry import query
from loomwork.plans.views import Run
from loomwork.sources import buckets
from loomwork.sources.shared import scratch


def _interviews(run: Run) -> DataFrame:
    """Turns as interview rows: most as JSON, each third as plain text."""
    info = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("raw "), F.col("role"))).otherwise(F.to_json(F.struct(F.col("role").alias("prompt"), F.concat(F.lit("turn "), F.col("turn")).alias("response"))))
    return run.table("conversations").select((F.col("conv_id") * 64 + F.col("turn")).alias("rid"), F.col("conv_id").alias("user_id"), F.lit("Interview").alias("action"), info.alias("info"))


@query("SELECT conv_id * 64 + turn AS rid, conv_id AS user_id, CASE WHEN turn % 3 = 0 THEN '' ELSE role END AS prompt, CASE WHEN turn % 3 = 0 THEN 'raw ' || role ELSE 'turn ' || turn END AS response FROM conversations")
def flt18_interviews(run: Run) -> DataFrame:
    return feed.interviews(_interviews(run))


@query("SELECT CASE WHEN turn % 3 = 0 THEN '' ELSE role END AS prompt, count(*) AS answers, count(DISTINCT turn) AS n_rounds FROM conversations GROUP BY 1")
def agg23_interviews_by_question(run: Run) -> DataFrame:
    rows = feed.interviews(_interviews(run)).withColumn("round", F.col("rid") % 64)
    return memory.grouped_interviews(rows).select("prompt", "answers", F.size("rounds").cast("long").alias("n_rounds"))


@query("SELECT lang, count(*) AS n FROM documents WHERE length(text) > 280 GROUP BY lang")
def prj11_over_length(run: Run) -> DataFrame:
    return report.over_length(run.table("documents"), "twitter", "text").groupBy("lang").agg(F.count("*").alias("n"))


@query("""SELECT kept_because, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'reported' WHEN o_orderstatus = 'O' THEN 'running' WHEN o_orderkey % 11 = 0 THEN 'unfinished' WHEN o_orderdate >= TIMESTAMP '1997-01-01' THEN 'recent' END AS kept_because FROM orders) k GROUP BY 1""")
def join24_retention(run: Run) -> DataFrame:
    o = run.table("orders")
    runs = o.select(F.col("o_orderkey").alias("sim_id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("state"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate")).alias("finished_at"))
    reported = o.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("sim_id"))
    return report.retained(runs, reported, F.lit("1997-01-01").cast("timestamp_ntz")).groupBy("kept_because").agg(F.count("*").alias("n"))


@query("SELECT user_id FROM profiles WHERE provenance = 'synthetic' AND user_id IN (SELECT n_nationkey FROM nation)")
def join27_name_collisions(run: Run) -> DataFrame:
    people = run.profiles.withColumn("normalised", ft.normalised_name(F.concat(F.lit("Dr. User "), "user_id")))
    reserved = run.table("nation").select(ft.normalised_name(F.concat(F.lit("The user "), "n_nationkey")).alias("normalised"))
    return population.collisions(people, reserved).select("user_id")


@query("SELECT p_partkey, len(string_split(p_name, ' ')) >= 2 AS is_alias, 1.0::DOUBLE AS similarity, round(1.0::DOUBLE / (len(list_distinct(string_split(p_name, ' '))) + 1), 6) AS part_similarity FROM part")
def fnt4_aliases(run: Run) -> DataFrame:
    name, longer = F.col("p_name"), F.concat_ws(" ", F.lower("p_type"), F.col("p_name"))
    other = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" zzz"))
    return run.table("part").select("p_partkey", ft.is_alias(name, longer).alias("is_alias"), ft.token_similarity(name, longer).alias("similarity"), F.round(ft.token_similarity(name, other), 6).alias("part_similarity"))


@query("SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def fnm1_cosines(run: Run) -> DataFrame:
    a = run.table("embeddings").select("vec_id", F.col("embedding").alias("a"))
    b = run.table("embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", F.round(fv.cosine(F.col("a"), F.col("b")), 4).alias("similarity"))


@query("SELECT o_orderkey, epoch_us(o_orderdate) + CAST((o_orderkey % 24) * 1800000000 AS BIGINT) * 3 AS at FROM orders")
def fnd2_round_times(run: Run) -> DataFrame:
    at = fv.round_time(F.col("o_orderdate").cast("timestamp"), F.lit(0.5) * (F.col("o_orderkey") % 24), F.lit(3))
    return run.table("orders").select("o_orderkey", F.unix_micros(at).alias("at"))


@query("SELECT s_nationkey, substr(sha256(string_agg(s_suppkey || '|' || s_name, chr(10) ORDER BY s_suppkey)), 1, 16) AS fingerprint FROM supplier GROUP BY s_nationkey")
def fnh3_plan_fingerprints(run: Run) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct("s_suppkey", F.concat_ws("|", "s_suppkey", "s_name").alias("line"))))
    joined = F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
    return run.table("supplier").groupBy("s_nationkey").agg(F.substring(F.sha2(joined, 256), 1, 16).alias("fingerprint"))


@query("SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS unscored, (SELECT count(*) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')) AS asked, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')) AS not_asked")
def set2_scores_and_posts(run: Run) -> DataFrame:
    docs, scores = run.table("documents").select("doc_id", "lang"), run.table("labels").select("doc_id")
    english = docs.where("lang = 'en'")
    out = docs.join(scores, "doc_id", "left_anti").agg(F.count("*").alias("unscored"))
    return out.withColumns({"asked": scores.join(english, "doc_id", "left_semi").agg(F.count("*")).scalar(), "not_asked": scores.join(english, "doc_id", "left_anti").agg(F.count("*")).scalar()})


@query("SELECT p_type, min(p_partkey) AS p_partkey FROM part GROUP BY p_type")
def set8_first_of_each_type(run: Run) -> DataFrame:
    return run.table("part").groupBy("p_type").agg(F.min("p_partkey").alias("p_partkey"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def snk1_upserted(run: Run) -> DataFrame:
    o = run.table("orders").select("o_orderkey", "o_orderstatus")
    folder = scratch(run.spark, "checkpoints")
    buckets.merged(o.where("o_orderkey % 2 = 0"), folder, ["o_orderkey"])
    return buckets.merged(o.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("new")), folder, ["o_orderkey"])


@query("SELECT rid, user_id, action FROM trace ORDER BY rid DESC LIMIT 200")
def top11_recent_actions(run: Run) -> DataFrame:
    return feed.page(feed.actions(run.trace, include_engine=True), 200).select("rid", "user_id", "action")


@query("SELECT post_id, user_id FROM posts WHERE coalesce(num_likes, 0) + coalesce(num_dislikes, 0) + coalesce(num_shares, 0) >= 1 ORDER BY rid DESC LIMIT 12")
def top14_evidence_posts(run: Run) -> DataFrame:
    return report.bundle(run.posts, feed.reactions()).select("post_id", "user_id")


@query("SELECT d.doc_id AS post_id, string_agg(DISTINCT n.name, ',' ORDER BY n.name) AS names FROM documents d JOIN (SELECT DISTINCT lower(text) AS name FROM benchmark) n ON contains(lower(d.text), n.name) GROUP BY d.doc_id")
def agg25_names_per_post(run: Run) -> DataFrame:
    names = run.table("benchmark").select(F.lower("text").alias("normalised"))
    found = memory.mentioned(run.table("documents").select(F.col("doc_id").alias("post_id"), F.lower("text").alias("normalised")), names)
    return found.groupBy("post_id").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("names"))


@query("""SELECT 'agent_history' AS tool, count(*) AS n FROM (SELECT * FROM trace WHERE user_id = 7 AND action <> 'signup' ORDER BY rid DESC LIMIT 25) a UNION ALL SELECT 'posts_by_agent', count(*) FROM (SELECT * FROM posts WHERE user_id = 4 LIMIT 10) b
UNION ALL SELECT 'comments_on', count(*) FROM (SELECT * FROM comments WHERE post_id = 3 LIMIT 10) c UNION ALL SELECT 'most_engaged', count(*) FROM (SELECT * FROM posts WHERE coalesce(num_likes, 0) + coalesce(num_dislikes, 0) + coalesce(num_shares, 0) >= 1 LIMIT 10) d""")
def udf1_tools(run: Run) -> DataFrame:
    own = tools.Tables(run.posts, run.comments, run.trace, ledger.round_bounds(run.ledger, "post_mark"))
    asks = {"agent_history": {"agent": 7, "limit": 100}, "posts_by_agent": {"agent": 4}, "comments_on": {"post_id": 3}, "most_engaged": {}}
    out = None
    for name, arguments in asks.items():
        one = tools.asked(own, name, **arguments).agg(F.count("*").alias("n")).select(F.lit(name).alias("tool"), "n")
        out = one if out is None else out.unionByName(one)
    return out
