"""Queries of streams: tables dealt into files, which a stream takes one by one, each as a micro-batch; the order in which files come changes no result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomwork.operators import report
from loomwork.plans.registry import query
from loomwork.plans.views import Run
from loomwork.sources import files
from loomwork.sources.shared import scratch
from loomwork.streaming import rounds

#: Micro-batches of a stream.
FILES = 4


def _fed(run: Run, rows: DataFrame, part: Column, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """rows as a stream of FILES micro-batches, by part: those of a part are written where they are read, in as many files as that takes, and start, with the checkpoint that it has, takes them before the next come. A part without rows is no batch."""
    folder = scratch(run.spark, "stream")
    for k in range(FILES):
        own = rows.where(part == k)
        if own.isEmpty():
            continue
        own.write.mode("append").parquet(f"{folder}/in")
        start(run.spark.readStream.schema(rows.schema).parquet(f"{folder}/in")).awaitTermination()


def _events(run: Run) -> tuple[DataFrame, Column]:
    """The events, and the part of each."""
    rows = run.trace.select("rid", "user_id", "created_at", "action", "info")
    most = rows.agg(F.max("rid")).first()[0] or 0
    return rows, F.floor(F.col("rid") * FILES / (most + 1))


_PARTS = f"SELECT rid, action, CAST(floor(rid * {FILES} / ((SELECT max(rid) FROM trace) + 1)) AS BIGINT) AS part FROM trace"


@query(f"SELECT max(rid) AS trace_mark, count(*) AS acted FROM ({_PARTS}) p GROUP BY part")
def str2_stream_rounds(run: Run) -> DataFrame:
    """The events as a stream: each micro-batch is a round with a ledger row."""
    folder = scratch(run.spark, "rounds")
    _fed(run, *_events(run), lambda stream: rounds.run_rounds(stream, folder, f"{folder}/checkpoint"))
    return run.spark.read.parquet(f"{folder}/ledger").select("trace_mark", "acted")


@query("SELECT rid FROM trace ORDER BY rid DESC LIMIT 400")
def str1_stream_feed(run: Run) -> DataFrame:
    """The last 400 events of a stream of several micro-batches."""
    folder = scratch(run.spark, "feed")
    _fed(run, *_events(run), lambda stream: rounds.feed(stream.select("rid"), f"{folder}/feed", f"{folder}/checkpoint"))
    return rounds.latest(run.spark, f"{folder}/feed")


@query("SELECT action, count(*) AS n FROM trace GROUP BY 1")
def str3_recovered(run: Run) -> DataFrame:
    """A batch that ended before its ledger row was written doesn't count: its rows go."""
    folder = scratch(run.spark, "rounds")
    _fed(run, *_events(run), lambda stream: rounds.run_rounds(stream, folder, f"{folder}/checkpoint"))
    run.trace.write.parquet(f"{folder}/trace/round={FILES}")  # all that a lost driver left of the next one
    return rounds.rolled_back(run.spark, folder).groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS rows, count(DISTINCT rid) AS different FROM trace")
def str5_recorded_again(run: Run) -> DataFrame:
    """A run that starts anew into the same folder: each round replaces what it had, so no row comes twice."""
    folder = scratch(run.spark, "rounds")
    for attempt in ("a", "b"):
        _fed(run, *_events(run), lambda stream, attempt=attempt: rounds.run_rounds(stream, folder, f"{folder}/checkpoint-{attempt}"))
    return run.spark.read.parquet(f"{folder}/trace").agg(F.count("*").alias("rows"), F.countDistinct("rid").alias("different"))


@query("SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) c WHERE r <= 3")
def str6_remembered_turns(run: Run) -> DataFrame:
    """The last three turns of each conversation, as state of a stream; turns come in any order."""
    rows = run.table("conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role")
    folder = scratch(run.spark, "turns")
    _fed(run, rows, F.pmod("turn", F.lit(FILES)), lambda stream: rounds.remembered_turns(stream, 3, f"{folder}/turns", f"{folder}/checkpoint"))
    return rounds.latest_turns(run.spark, f"{folder}/turns")


@query("SELECT rid, CASE WHEN user_id % 3 = 0 THEN 'busy' END AS live_stage, CASE WHEN user_id % 3 = 0 THEN false WHEN user_id % 3 = 1 THEN true END AS live_stale FROM trace")
def str8_live_enrichment(run: Run) -> DataFrame:
    """A stream joined with what is known of live workers: one that can't be reached leaves its rows, and says that they are stale."""
    folder = scratch(run.spark, "live")
    live = run.users.where("user_id % 3 < 2").select(F.col("user_id").alias("sim_id"), F.lit("busy").alias("stage"), F.expr("if(user_id % 3 = 1, 'gone', null)").alias("unreachable"))

    def start(stream: DataFrame) -> StreamingQuery:
        progress = stream.select("rid", F.col("user_id").alias("sim_id"), F.lit("running").alias("state"), F.lit(1).alias("rounds_completed"), F.lit(2).alias("total_rounds"))
        written = report.status(progress, live).select("rid", "live_stage", "live_stale").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        return written.trigger(availableNow=True).start()

    _fed(run, *_events(run), start)
    return run.spark.read.parquet(f"{folder}/out")


@query(f"SELECT CAST(0 AS BIGINT) AS round, action, count(*) AS n FROM ({_PARTS}) p WHERE part = 0 GROUP BY action UNION ALL SELECT 2, action, count(*) FROM ({_PARTS}) p WHERE part <= 2 GROUP BY action")
def str9_refreshed_once(run: Run) -> DataFrame:
    """Four micro-batches, of rounds 0, 0, 2 and 2: the counts are published when round 0 comes and when 2 does, and not in between."""
    folder = scratch(run.spark, "stream")
    rows = run.trace.select("rid", "action")
    most = rows.agg(F.max("rid")).first()[0] or 0
    part = F.floor(F.col("rid") * FILES / (most + 1)).cast("long")
    for k in range(FILES):
        own = rows.where(part == k).select("rid", "action", F.lit(k // 2 * 2).cast("long").alias("round"))
        own.write.mode("append").parquet(f"{folder}/in")
        rounds.refreshed(run.spark.readStream.schema(own.schema).parquet(f"{folder}/in"), folder, f"{folder}/checkpoint").awaitTermination()
    return run.spark.read.parquet(f"{folder}/counts").select(F.col("round").cast("long").alias("round"), "action", "n")


@query("SELECT doc_id AS post_id, CAST(length(text) AS DOUBLE) AS score FROM documents WHERE trim(text) <> '' AND doc_id % 10 <> 3")
def str11_scored_once(run: Run) -> DataFrame:
    """Posts that come twice are scored once, blank ones never, and what a scorer leaves out stays unscored; some it leaves out of large batches only."""
    d = run.table("documents").select(F.col("doc_id").alias("post_id"), F.col("text").alias("content"))
    folder = scratch(run.spark, "scored")

    def scorer(posts):
        some = posts[(posts["post_id"] % 10 != 3) & ((posts["post_id"] % 5 != 2) | (len(posts) <= rounds.AGAIN_AT_ONCE))]
        return some.assign(score=some["content"].str.len())[["post_id", "score"]]

    twice = d.unionByName(d.where("post_id % 4 = 1"))
    _fed(run, twice, F.pmod(F.xxhash64("post_id"), F.lit(FILES)), lambda stream: rounds.scored_once(stream, scorer, f"{folder}/scores", f"{folder}/checkpoint"))
    return run.spark.read.parquet(f"{folder}/scores").select("post_id", "score")


@query("""SELECT user_id, min(t) AS start, max(t) + 3600000000 AS "end", count(*) AS n FROM (SELECT user_id, t, sum(CASE WHEN t - before < 3600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) a) b GROUP BY user_id, session""")
def str7_stream_sessions(run: Run) -> DataFrame:
    """Sessions of a stream with a watermark, over three starts of it. A tenth of the first half's last hours comes with the second half, within the watermark, and joins its sessions; some requests of the first day come once more then, beyond it, and are dropped. Last comes one request of nobody, years on, so that all sessions close."""
    folder, spark = scratch(run.spark, "stream"), run.spark
    events = run.table("events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    ends = events.agg(F.min("ts").alias("first"), F.percentile_approx(F.unix_micros("ts"), 0.5).alias("middle")).first()
    middle = F.timestamp_micros(F.lit(ends.middle))
    held = (F.col("event_id") % 10 == 0) & (F.col("ts") > middle - F.expr("interval 2 hours"))
    first = events.where((F.col("ts") <= middle) & ~held)
    stale = events.where((F.col("ts") < F.lit(ends.first) + F.expr("interval 1 day")) & (F.col("ts") < middle - F.expr("interval 1 day")))
    second = events.where((F.col("ts") > middle) | held).unionByName(stale)
    last = spark.createDataFrame([(0, -1)], "event_id long, user_id long").withColumn("ts", F.lit("2200-01-01").cast("timestamp"))
    for rows in (first, second, last):
        rows.select("user_id", "ts").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("user_id long, ts timestamp").parquet(f"{folder}/in")
        rounds.idle_sessions(stream, 3600, f"{folder}/sessions", f"{folder}/checkpoint", "3 hours").awaitTermination()
    return spark.read.parquet(f"{folder}/sessions").where("user_id >= 0")


@query("SELECT user_id, username, provenance FROM profiles")
def snk7_appended_profiles(run: Run) -> DataFrame:
    """Profiles as a stream, appended as JSON lines; one that comes again replaces the line before."""
    people = run.profiles.select("user_id", "username", "provenance")
    folder = scratch(run.spark, "profiles")
    for attempt in ("a", "b"):
        _fed(run, people, F.pmod("user_id", F.lit(FILES)), lambda stream, attempt=attempt: rounds.appended(stream, f"{folder}/lines", f"{folder}/checkpoint-{attempt}"))
    return files.partial(run.spark, f"{folder}/lines/*/*.json", people.schema, "user_id")
