"""The supplied star-schema tables as the engine's domain tables: a run's trace, ledger, people, posts, comments, scores and graph.

Every view is lazy and column-pruned; none sorts or numbers rows globally. VIEWS_SQL gives the same views to DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Run:
    """The domain tables of one run, read from a folder of Parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def trace(self) -> DataFrame:
        """Actions in the order they happened: rid starts at 1, as marks are exclusive below."""
        return self.table("events").select((F.col("event_id") + 1).alias("rid"), "user_id", F.col("ts").alias("created_at"), F.col("event_type").alias("action"), F.col("props").alias("info"))

    @property
    def ledger(self) -> DataFrame:
        """A round for each calendar day but the last, which stays open; a mark is the last rid of a round, by table. Round 3 has no mark for posts."""
        days = self.trace.groupBy(F.to_date("created_at").alias("day")).agg(F.max("rid").alias("trace_mark"), F.min("created_at").alias("started_at"), F.max("created_at").alias("ended_at"), F.count("*").alias("acted"))
        ends = self.trace.agg(F.min(F.to_date("created_at")).alias("first"), F.max(F.to_date("created_at")).alias("last"))
        posts = self.table("conversations").agg(F.max("conv_id").alias("most"))
        first, last, most = ends.select("first").scalar(), ends.select("last").scalar(), posts.scalar()
        rounds = days.withColumns({"first": first, "last": last, "most": most}).where("day < last")
        rounds = rounds.withColumn("round", F.datediff("day", "first")).withColumn("total", F.datediff("last", "first"))
        return rounds.select(
            "round", "started_at", "ended_at", "acted", "trace_mark",
            F.expr("if(round = 3, null, cast(floor((most + 1) * (round + 1) / (total + 1)) as bigint))").alias("post_mark"),
            F.expr("acted % 7").alias("failed"), F.expr("acted % 5").alias("skipped"),
        )

    @property
    def users(self) -> DataFrame:
        return self.table("events").select("user_id").distinct().select("user_id", F.concat(F.lit("user_"), F.col("user_id")).alias("user_name"), F.concat(F.lit("User "), F.col("user_id")).alias("name"))

    @property
    def profiles(self) -> DataFrame:
        """Everyone but each tenth user, who is only in the user table; each seventh profile has a blank username."""
        people = self.users.where("user_id % 10 <> 0")
        return people.select(
            "user_id", F.expr("if(user_id % 7 = 0, '', concat('agent_', user_id))").alias("username"), F.concat(F.lit("Agent "), F.col("user_id")).alias("name"),
            F.expr("if(user_id % 4 = 0, 'named', 'synthetic')").alias("provenance"), F.expr("element_at(array('low', 'moderate', 'high'), cast(user_id % 3 as int) + 1)").alias("activity_level"),
        )

    @property
    def posts(self) -> DataFrame:
        """Orders as posts, of which each seventh repeats an earlier one, with or without a quote; line items as reactions."""
        lines = self.table("lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") != "R").alias("num_likes"), F.count_if(F.col("l_returnflag") == "R").alias("num_dislikes"), F.count_if(F.col("l_linestatus") == "O").alias("num_shares"))
        orders = self.table("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        return orders.select(
            F.col("o_orderkey").alias("rid"), F.col("o_orderkey").alias("post_id"), F.col("o_custkey").alias("user_id"),
            F.expr("if(o_orderkey % 7 = 0 and o_orderkey > 0, cast(o_orderkey div 7 as bigint), null)").alias("original_post_id"),
            F.expr("if(o_orderkey % 7 = 0, null, concat(o_orderpriority, ' order ', o_orderkey))").alias("content"),
            F.expr("case when o_orderkey % 21 = 0 then '' when o_orderkey % 14 = 0 then o_orderpriority end").alias("quote_content"),
            F.col("o_orderdate").alias("created_at"), "num_likes", "num_dislikes", "num_shares",
        )

    @property
    def messages(self) -> DataFrame:
        """First turns of conversations as posts."""
        return self.table("conversations").where("turn = 0").select((F.col("conv_id") + 1).alias("rid"), F.col("conv_id").alias("post_id"), F.expr("conv_id % 150").alias("user_id"), F.col("text").alias("content"), "role")

    @property
    def comments(self) -> DataFrame:
        """Later turns as comments on the first."""
        return self.table("conversations").where("turn > 0").select((F.col("conv_id") * 64 + F.col("turn")).alias("comment_id"), F.col("conv_id").alias("post_id"), F.expr("(conv_id + turn) % 150").alias("user_id"), F.col("text").alias("content"), "role")

    @property
    def scores(self) -> DataFrame:
        """Sentiment of documents: quality less toxicity; not every document has one."""
        return self.table("labels").select(F.col("doc_id").alias("post_id"), (F.col("quality") - F.col("toxic")).cast("double").alias("score"), F.expr("case when toxic = 1 then 'opposed' when quality = 1 then 'supportive' else '' end").alias("stance"))

    @property
    def entities(self) -> DataFrame:
        """Suppliers, customers, nations and regions as typed nodes."""
        part = lambda t, k, n, kind, m: self.table(t).select(F.concat(F.lit(f"{kind}:"), F.col(k)).alias("uuid"), F.col(n).alias("name"), F.lower(F.col(n)).alias("normalised"), F.lit(kind).alias("type"), m.cast("bigint").alias("mention_count"))
        return (
            part("supplier", "s_suppkey", "s_name", "Supplier", F.expr("s_suppkey % 17"))
            .unionByName(part("customer", "c_custkey", "c_name", "Customer", F.expr("c_custkey % 13")))
            .unionByName(part("nation", "n_nationkey", "n_name", "Nation", F.expr("n_nationkey % 5 + 20")))
            .unionByName(part("region", "r_regionkey", "r_name", "Region", F.expr("r_regionkey + 30")))
        )

    @property
    def edges(self) -> DataFrame:
        """Who is where, and what belongs to what."""
        part = lambda t, k, kind, fk, target, rel, m: self.table(t).select(F.concat(F.lit(f"{kind}:"), F.col(k)).alias("src"), F.concat(F.lit(f"{target}:"), F.col(fk)).alias("dst"), F.lit(rel).alias("type"), m.cast("bigint").alias("mention_count"))
        return (
            part("supplier", "s_suppkey", "Supplier", "s_nationkey", "Nation", "LOCATED_IN", F.expr("s_suppkey % 9 + 1"))
            .unionByName(part("customer", "c_custkey", "Customer", "c_nationkey", "Nation", "LIVES_IN", F.expr("c_custkey % 7 + 1")))
            .unionByName(part("nation", "n_nationkey", "Nation", "n_regionkey", "Region", "PART_OF", F.expr("n_nationkey % 3 + 1")))
        )


VIEWS_SQL = """
trace AS (SELECT event_id + 1 AS rid, user_id, ts AS created_at, event_type AS action, props AS info FROM events),
days AS (SELECT CAST(created_at AS DATE) AS day, max(rid) AS trace_mark, min(created_at) AS started_at, max(created_at) AS ended_at, count(*) AS acted FROM trace GROUP BY 1),
ends AS (SELECT min(CAST(created_at AS DATE)) AS first, max(CAST(created_at AS DATE)) AS last FROM trace),
ledger AS (SELECT CAST(date_diff('day', first, day) AS INTEGER) AS round, started_at, ended_at, acted, trace_mark,
  CASE WHEN date_diff('day', first, day) = 3 THEN NULL ELSE CAST(floor(((SELECT max(conv_id) FROM conversations) + 1) * (date_diff('day', first, day) + 1) / (date_diff('day', first, last) + 1)) AS BIGINT) END AS post_mark,
  acted % 7 AS failed, acted % 5 AS skipped FROM days, ends WHERE day < last),
users AS (SELECT DISTINCT user_id, 'user_' || user_id AS user_name, 'User ' || user_id AS name FROM events),
profiles AS (SELECT user_id, CASE WHEN user_id % 7 = 0 THEN '' ELSE 'agent_' || user_id END AS username, 'Agent ' || user_id AS name,
  CASE WHEN user_id % 4 = 0 THEN 'named' ELSE 'synthetic' END AS provenance, CASE user_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'moderate' ELSE 'high' END AS activity_level FROM users WHERE user_id % 10 <> 0),
reactions AS (SELECT l_orderkey, sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS num_likes, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS num_dislikes, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS num_shares FROM lineitem GROUP BY 1),
posts AS (SELECT o_orderkey AS rid, o_orderkey AS post_id, o_custkey AS user_id, CASE WHEN o_orderkey % 7 = 0 AND o_orderkey > 0 THEN CAST(o_orderkey // 7 AS BIGINT) END AS original_post_id,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority || ' order ' || o_orderkey END AS content, CASE WHEN o_orderkey % 21 = 0 THEN '' WHEN o_orderkey % 14 = 0 THEN o_orderpriority END AS quote_content,
  o_orderdate AS created_at, num_likes, num_dislikes, num_shares FROM orders LEFT JOIN reactions ON o_orderkey = l_orderkey),
messages AS (SELECT conv_id + 1 AS rid, conv_id AS post_id, conv_id % 150 AS user_id, text AS content, role FROM conversations WHERE turn = 0),
comments AS (SELECT conv_id * 64 + turn AS comment_id, conv_id AS post_id, (conv_id + turn) % 150 AS user_id, text AS content, role FROM conversations WHERE turn > 0),
scores AS (SELECT doc_id AS post_id, CAST(quality - toxic AS DOUBLE) AS score, CASE WHEN toxic = 1 THEN 'opposed' WHEN quality = 1 THEN 'supportive' ELSE '' END AS stance FROM labels),
identities AS (SELECT u.user_id, coalesce(nullif(p.username, ''), u.user_name) AS username, coalesce(p.name, u.name) AS name, coalesce(p.provenance, 'broadcaster') AS provenance, coalesce(p.activity_level, '') AS activity_level, p.user_id IS NOT NULL AS population FROM users u LEFT JOIN profiles p ON u.user_id = p.user_id),
entities AS (SELECT 'Supplier:' || s_suppkey AS uuid, s_name AS name, lower(s_name) AS normalised, 'Supplier' AS type, CAST(s_suppkey % 17 AS BIGINT) AS mention_count FROM supplier
  UNION ALL SELECT 'Customer:' || c_custkey, c_name, lower(c_name), 'Customer', CAST(c_custkey % 13 AS BIGINT) FROM customer
  UNION ALL SELECT 'Nation:' || n_nationkey, n_name, lower(n_name), 'Nation', CAST(n_nationkey % 5 + 20 AS BIGINT) FROM nation
  UNION ALL SELECT 'Region:' || r_regionkey, r_name, lower(r_name), 'Region', CAST(r_regionkey + 30 AS BIGINT) FROM region),
edges AS (SELECT 'Supplier:' || s_suppkey AS src, 'Nation:' || s_nationkey AS dst, 'LOCATED_IN' AS type, CAST(s_suppkey % 9 + 1 AS BIGINT) AS mention_count FROM supplier
  UNION ALL SELECT 'Customer:' || c_custkey, 'Nation:' || c_nationkey, 'LIVES_IN', CAST(c_custkey % 7 + 1 AS BIGINT) FROM customer
  UNION ALL SELECT 'Nation:' || n_nationkey, 'Region:' || n_regionkey, 'PART_OF', CAST(n_nationkey % 3 + 1 AS BIGINT) FROM nation)
"""


def sql(query: str) -> str:
    """A query over the views, for DuckDB: only the views that it needs come along."""
    import re

    views = re.split(r"(?m)^(?=\w+ AS \()", VIEWS_SQL.strip())
    named = {re.match(r"\w+", v)[0]: v.strip().rstrip(",") for v in views if v.strip()}
    text, needed = query, set()
    while more := {n for n in named if n not in needed and re.search(rf"\b{n}\b", text)}:
        needed |= more
        text += "".join(named[n] for n in more)
    return "WITH " + ",\n".join(v for n, v in named.items() if n in needed) + "\n" + query if needed else query
