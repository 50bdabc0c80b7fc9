"""What a report rests on: evidence, caveats, and its lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.text import defanged, escaped


def evidence_line(post_ids: Column, agent_ids: Column, rounds: Column) -> Column:
    """posts 1, 2; agent 4; round 3"""
    part = lambda ids, word: F.when(F.size(ids) > 0, F.concat(F.lit(word), F.when(F.size(ids) > 1, "s ").otherwise(" "), F.array_join(F.transform(ids, lambda v: v.cast("string")), ", ")))
    return F.concat_ws("; ", part(post_ids, "post"), part(agent_ids, "agent"), part(rounds, "round"))


def scale_caveats(agents: Column, rounds: Column, posts: Column, silent: Column) -> Column:
    """What a small run can't show (bounds are fixed values)."""
    return F.array_compact(F.array(F.when(agents < 20, "few agents"), F.when(rounds < 5, "few rounds"), F.when(posts < 20, "few posts"), F.when(silent > 0, "silent agents")))


def grounding_caveats(dropped: Column, uncited: Column, unresolved: Column, sections: Column) -> Column:
    """What verification found, as sentences: claims removed, findings without evidence, and sections (sorted) whose prose refers to what isn't there."""
    where = F.array_join(F.array_sort(F.array_distinct(sections)), ", ")
    return F.array_compact(F.array(
        F.when(dropped > 0, F.concat(dropped.cast("string"), F.lit(" claims cite what does not exist in this run and were removed"))),
        F.when(uncited > 0, F.concat(uncited.cast("string"), F.lit(" findings cite no evidence"))),
        F.when(unresolved > 0, F.concat(where, F.lit(": "), unresolved.cast("string"), F.lit(" references to what does not exist in this run"))),
    ))


def markdown(title: Column, sections: Column) -> Column:
    """A report as Markdown, from sections [(heading, body)]; code fences in bodies are defanged, empty sections left out."""
    parts = F.transform(F.filter(sections, lambda s: F.trim(s["body"]) != ""), lambda s: F.concat(F.lit("## "), s["heading"], F.lit("\n\n"), defanged(F.trim(s["body"]))))
    return F.concat(F.lit("# "), F.array_join(F.concat(F.array(title), parts), "\n\n"), F.lit("\n"))


def html(title: Column, sections: Column) -> Column:
    """A report as HTML: whatever it holds is escaped."""
    parts = F.transform(F.filter(sections, lambda s: F.trim(s["body"]) != ""), lambda s: F.concat(F.lit("<h2>"), escaped(s["heading"]), F.lit("</h2><p>"), escaped(F.trim(s["body"])), F.lit("</p>")))
    return F.concat(F.lit("<h1>"), escaped(title), F.lit("</h1>"), F.array_join(parts, ""))


def by_run(reports: DataFrame) -> DataFrame:
    """(sim_id, report_ids) with the newest first; a run has few reports."""
    return reports.groupBy("sim_id").agg(F.sort_array(F.collect_list("report_id"), asc=False).alias("report_ids"))


def status(progress: DataFrame, live: DataFrame) -> DataFrame:
    """progress (sim_id, state, rounds_completed, total_rounds) with percent, and what is known of a live worker (sim_id, stage, unreachable): a worker that can't be reached leaves the stored state and says that it is stale."""
    known = live.select("sim_id", "stage", "unreachable", F.lit(True).alias("_live"))
    out = progress.join(known, "sim_id", "left")
    fresh = F.col("_live") & F.col("unreachable").isNull()
    out = out.withColumn("percent", percent_done(F.col("rounds_completed"), F.col("total_rounds"))).withColumn("live_stage", F.when(fresh, F.col("stage")))
    return out.withColumn("live_stale", F.when(F.col("_live"), F.col("unreachable").isNotNull())).drop("stage", "unreachable", "_live")


def bytes_by_folder(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, bytes): what the files of each folder key=value take; the files aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return found.groupBy(F.regexp_extract("path", rf"/{key}=([^/]+)/", 1).alias(key)).agg(F.sum("length").alias("bytes"))


def budget(concurrency: Column, reserve: Column, most_runs: Column, running: Column) -> Column:
    """(per_worker, in_flight_worst_case, capacity): calls that each of the runs at once may make, beside those held back."""
    share = F.greatest(F.lit(1), F.floor((concurrency - reserve) / most_runs)).cast("long")
    return F.struct(share.alias("per_worker"), (share * running + reserve).alias("in_flight_worst_case"), F.greatest(F.lit(0), most_runs - running).alias("capacity"))


def scheduled(events: Column, rounds: Column) -> Column:
    """Events [(round, enabled, ...)] that are enabled and fall inside a run of so many rounds."""
    return F.filter(events, lambda e: e["enabled"] & (e["round"] <= rounds))


def bundle(posts: DataFrame, engagement: Column, most: int = 12) -> DataFrame:
    """The newest posts with any engagement; if none has, the oldest."""
    lively = posts.where(engagement >= 1).orderBy(F.desc("rid")).limit(most)
    return lively.unionByName(posts.withColumn("_n", lively.agg(F.count("*")).scalar()).where("_n = 0").drop("_n").orderBy("rid").limit(most))


def retained(runs: DataFrame, reported: DataFrame, cutoff: Column) -> DataFrame:
    """Runs with why each is kept: reported, running, unfinished or recent; null: it may go."""
    out = runs.join(reported.select("sim_id").distinct().withColumn("_reported", F.lit(True)), "sim_id", "left")
    why = F.when(F.col("_reported"), "reported").when(F.col("state") == "running", "running").when(F.col("finished_at").isNull(), "unfinished").when(F.col("finished_at") >= cutoff, "recent")
    return out.withColumn("kept_because", why).drop("_reported")


def percent_done(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.round(100 * done / total, 1), F.lit(100.0))).otherwise(0.0)


def over_length(posts: DataFrame, platform: str, text: str = "content") -> DataFrame:
    from loomwork.functions.text import LONGEST_POST

    return posts.where(F.length(text) > LONGEST_POST[platform])
