"""Stored tables in buckets, and streams whose state goes on over restarts."""

import datetime
import os
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomwork.plans import streams
from loomwork.plans.views import Run
from loomwork.sources import buckets
from loomwork.streaming import rounds


def files(folder):
    return {os.path.join(d, n) for d, _, names in os.walk(folder) for n in names if n.startswith("part-")}


def test_a_load_rewrites_only_its_buckets(spark, tmp_path):
    folder = str(tmp_path / "table")
    rows = spark.range(200).select("id", F.lit("old").alias("x"))
    assert buckets.merged(rows, folder, ["id"]).count() == 200
    before = files(folder)
    ids = [3, 77, 500]
    touched = {r.b for r in spark.createDataFrame([(i,) for i in ids], "id long").select(buckets.bucket("id").alias("b")).collect()}
    out = buckets.merged(spark.createDataFrame([(i, "new") for i in ids], "id long, x string"), folder, ["id"])
    assert {(r.id, r.x) for r in out.collect()} == {(i, "new" if i in ids else "old") for i in [*range(200), 500]}
    gone = {int(f.split("bucket=")[1].split("/")[0]) for f in before - files(folder)}
    assert gone <= touched and len(touched) <= 3 < buckets.BUCKETS
    assert buckets.merged(out.limit(0), folder, ["id"]).count() == 201  # nothing is touched


def test_a_load_that_stopped_may_run_again(spark, tmp_path):
    folder = str(tmp_path / "table")
    rows = spark.range(50).select("id", F.lit(0).alias("x"))
    buckets.merged(rows, folder, ["id"])
    new = spark.range(40, 60).select("id", F.lit(1).alias("x"))

    def stop(step):
        if step == at:
            raise RuntimeError(step)

    for at in ("write", "done"):
        with pytest.raises(RuntimeError):
            buckets.merged(new, folder, ["id"], step=stop)
        rows = {r.id: r.x for r in buckets.stored(spark, folder, new.schema).collect()}
        assert rows == {i: int(i >= 40 and at == "done") for i in range(60 if at == "done" else 50)}
    # As if it had ended after some of the buckets: those are as before, the others are new.
    assert {r.id: r.x for r in buckets.merged(new, folder, ["id"]).collect()} == {i: int(i >= 40) for i in range(60)}


def test_rows_are_combined(spark, tmp_path):
    add = lambda old, new: old.unionByName(new).groupBy("bucket", "k").agg(F.max("n").alias("n"))
    for values in ([(1, 5), (2, 1), (None, 3)], [(1, 2), (2, 9), (None, 4)]):
        out = buckets.merged(spark.createDataFrame(values, "k long, n long"), str(tmp_path / "t"), ["k"], add)
    assert {(r.k, r.n) for r in out.collect()} == {(1, 5), (2, 9), (None, 4)}


def append(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_scores_over_restarts(spark, tmp_path):
    """A post that comes again is not scored again, one that failed is; large batches that fail are tried in small ones."""
    calls = str(tmp_path / "calls")
    os.mkdir(calls)

    def scorer(posts):
        open(f"{calls}/{uuid.uuid4().hex}-{'-'.join(map(str, posts['post_id']))}", "w").close()
        good = posts[(posts["content"] != "bad") & ((posts["content"] != "slow") | (len(posts) <= 4))]
        return pd.concat([good.assign(score=0.5)[["post_id", "score"]], pd.DataFrame({"post_id": [999], "score": [1.0]})])

    for rows in ([(1, "a"), (2, " "), (3, "bad"), (4, None), *[(k, "slow") for k in range(10, 16)]], [(1, "a"), (3, "bad"), (5, "c")], [(3, "better"), (1, "b")]):
        append(spark, rows, "post_id long, content string", str(tmp_path / "in"))
        stream = spark.readStream.schema("post_id long, content string").parquet(str(tmp_path / "in"))
        rounds.scored_once(stream, scorer, str(tmp_path / "scores"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.post_id for r in spark.read.parquet(str(tmp_path / "scores")).collect()) == [1, 3, 5, *range(10, 16)]
    asked = [i for name in os.listdir(calls) for i in name.split("-")[1:]]
    assert asked.count("1") == 1 and asked.count("3") >= 3 and "2" not in asked and "4" not in asked


def test_turns_are_kept_in_one_place(spark, tmp_path):
    for rows in ([(1, 1, "a"), (1, 2, "b"), (2, 1, "a")], [(1, 5, "e"), (1, 3, "c")], [(1, 4, "d"), (3, 1, "a")]):
        append(spark, rows, rounds.TURN, str(tmp_path / "in"))
        stream = spark.readStream.schema(rounds.TURN).parquet(str(tmp_path / "in"))
        rounds.remembered_turns(stream, 2, str(tmp_path / "turns"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(map(tuple, rounds.latest_turns(spark, str(tmp_path / "turns")).collect())) == [(1, 4, "d"), (1, 5, "e"), (2, 1, "a"), (3, 1, "a")]


def test_late_requests(spark, tmp_path):
    """Within the watermark they join, or join two sessions; beyond it they are dropped; a session comes once."""
    minute = 60_000_000
    day = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    at = lambda m: day + datetime.timedelta(minutes=m)
    for rows in ([(1, at(0)), (1, at(9)), (1, at(30)), (2, at(100))], [(1, at(95)), (1, at(107)), (2, at(5)), (1, at(150))], [(1, at(101)), (3, at(10)), (2, at(400))], [(9, at(9000))]):
        append(spark, rows, "user_id long, ts timestamp", str(tmp_path / "in"))
        stream = spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "in"))
        rounds.idle_sessions(stream, 600, str(tmp_path / "out"), str(tmp_path / "ck"), "60 minutes").awaitTermination()
    start = int(day.timestamp()) * 1_000_000
    got = sorted((r.user_id, (r.start - start) / minute, (r.end - start) / minute, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 0, 19, 2), (1, 30, 40, 1), (1, 95, 117, 3), (1, 150, 160, 1), (2, 100, 110, 1), (2, 400, 410, 1)]


def test_counts_are_published_when_the_round_moves(spark, tmp_path):
    for k, rows in enumerate(([(0, "a")], [(0, "b"), (0, "a")], [(1, "a")], [(1, "c")])):
        append(spark, rows, "round long, action string", str(tmp_path / "in"))
        stream = spark.readStream.schema("round long, action string").parquet(str(tmp_path / "in"))
        rounds.refreshed(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        got = {(r.round, r.action, r.n) for r in spark.read.parquet(str(tmp_path / "out/counts")).collect()}
        assert got == {(0, "a", 1)} | ({(1, "a", 3), (1, "b", 1)} if k > 1 else set())


def test_sessions_of_many_users_at_once():
    """Rows of all users in one call, against a plain loop."""
    rng = np.random.default_rng(3)
    for n in (0, 1, 500):
        start = rng.integers(0, 4000, n)
        rows = np.column_stack([rng.integers(0, 9, n), start, start + rng.integers(1, 60, n), rng.integers(1, 4, n)]).astype(np.int64)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        want = []
        for user, a, b, k in rows.tolist():
            if want and want[-1][0] == user and a < want[-1][2]:
                want[-1] = [user, want[-1][1], max(b, want[-1][2]), want[-1][3] + k]
            else:
                want.append([user, a, b, k])
        assert rounds.joined(rows).tolist() == want


def test_a_part_of_a_stream_is_in_many_files(spark):
    """Each batch is a part, written by all tasks that read it, and not by one."""
    seen = []
    folder = streams.scratch(spark, "seen")

    def start(stream):
        count = lambda batch, _: seen.append((batch.count(), batch.select(F.input_file_name()).distinct().count()))
        return stream.writeStream.foreachBatch(count).option("checkpointLocation", folder).trigger(availableNow=True).start()

    streams._fed(Run(spark, ""), spark.range(0, 4000, 1, 5), F.col("id") % 4, start)
    assert seen == [(1000, 5)] * 4
