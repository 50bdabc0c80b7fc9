"""A run as a stream: each micro-batch is a round, with a ledger row that is written only after its rows are.

The rows of a round and its ledger row carry the batch's number, and both are written by overwriting their own partition; so
a batch that runs again after a failure replaces what it left, and recovery needs no other log.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from loomwork.sources.buckets import merged, stored
from loomwork.sources.shared import exists, removed


def recorded(rows: DataFrame, number: int) -> DataFrame:
    """The ledger row of a batch: its mark, how many rows it has, and their actions."""
    counts = rows.where("action <> ''").groupBy("action").agg(F.count("*").alias("n"))
    entries = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", "n")))).alias("action_counts")).scalar()
    return rows.agg(F.max("rid").alias("trace_mark"), F.count("*").alias("acted"), F.min("created_at").alias("started_at"), F.max("created_at").alias("ended_at")).select(F.lit(number).alias("round"), "trace_mark", "acted", "started_at", "ended_at", entries.alias("action_counts"))


def run_rounds(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Takes what there is of a stream (rid, user_id, created_at, action, info), a round for each micro-batch, into folder/trace and folder/ledger."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = f"{folder}/trace/round={number}"
        batch.write.mode("overwrite").parquet(path)
        rows = spark.read.schema(batch.schema).parquet(path)
        recorded(rows, number).drop("round").write.mode("overwrite").parquet(f"{folder}/ledger/round={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rolled_back(spark: SparkSession, folder: str) -> DataFrame:
    """The trace of rounds that the ledger has: rows of a batch that ended before its ledger row don't count."""
    done = spark.read.parquet(f"{folder}/ledger").select("round")
    return spark.read.parquet(f"{folder}/trace").join(done, "round", "left_semi")


def feed(stream: DataFrame, folder: str, checkpoint: str, most: int = 400) -> StreamingQuery:
    """The last rows of a stream, by rid: each micro-batch writes those kept so far and its own, and then deletes what the one before the last wrote. latest reads them."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = f"{folder}/batch={number - 1}"
        rows = batch
        if number and exists(spark, last):
            rows = spark.read.schema(batch.schema).parquet(last).unionByName(batch)
        rows.orderBy(F.desc("rid")).limit(most).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        removed(spark, f"{folder}/batch={number - 2}")  # the last one stays, in case this batch runs again

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """What the newest micro-batch left of a feed."""
    kept = spark.read.parquet(folder)
    return kept.withColumn("_newest", kept.agg(F.max("batch")).scalar()).where("batch = _newest").drop("batch", "_newest")


@contextmanager
def _kept_by_key(spark: SparkSession) -> Iterator[None]:
    """State in a store that looks up single keys, for the query that starts inside: its work doesn't grow with what is stored."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: Keys by which posts are dealt to tasks, and posts that a scorer is given at once, and again those that it left out.
POST_KEYS, SCORED_AT_ONCE, AGAIN_AT_ONCE = 256, 12, 4

Scorer = Callable[[pd.DataFrame], pd.DataFrame]


class _Scores(StatefulProcessor):
    """Which posts have a score; others are given to the scorer, in batches, and what it leaves out once more in small ones."""

    def __init__(self, scorer: Scorer) -> None:
        self.scorer = scorer

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("scored", "post_id long", "score double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        todo: dict[int, str] = {}
        for frame in rows:
            for i, content in zip(frame["post_id"].tolist(), frame["content"].tolist(), strict=True):
                if content and content.strip() and i not in todo and not self.known.containsKey((i,)):
                    todo[i] = content
        for size in (SCORED_AT_ONCE, AGAIN_AT_ONCE):
            ids = list(todo)
            for a in range(0, len(ids), size):
                asked = ids[a : a + size]
                scores = self.scorer(pd.DataFrame({"post_id": asked, "content": [todo[i] for i in asked]})).dropna(subset="score")
                scores = scores[scores["post_id"].isin(asked)].drop_duplicates("post_id")
                for i, score in zip(scores["post_id"].tolist(), scores["score"].tolist(), strict=True):
                    self.known.updateValue((i,), (float(score),))
                    del todo[i]
                yield pd.DataFrame({"post_id": scores["post_id"].astype("int64"), "score": scores["score"].astype(float)})

    def close(self) -> None:
        pass


def scored_once(stream: DataFrame, scorer: Scorer, folder: str, checkpoint: str) -> StreamingQuery:
    """Scores (post_id, score) of posts (post_id, content) that have none yet, batch by batch, in folder/batch=n; blank posts are never scored, and scores for posts that weren't asked for are dropped.

    What has a score is state, looked up by post; a post that failed is asked for again when it comes again. scorer takes and gives pandas
    frames, SCORED_AT_ONCE posts at once, and in the same batch what it left out once more, AGAIN_AT_ONCE at once.
    """

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    dealt = stream.select("post_id", "content", F.pmod(F.xxhash64("post_id"), F.lit(POST_KEYS)).alias("key")).groupBy("key")
    scores = dealt.transformWithStateInPandas(_Scores(scorer), "post_id long, score double", "append", "none")
    with _kept_by_key(stream.sparkSession):
        return scores.writeStream.outputMode("append").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def appended(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Rows as JSON lines, each micro-batch in a folder of its own, which it replaces if it runs again."""

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


TURN = "conv_id long, turn long, role string"


class _Turns(StatefulProcessor):
    """The last turns of a conversation, by number."""

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getMapState("turns", "turn long", "role string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = {k[0]: v[0] for k, v in self.turns.iterator()}
        for frame in rows:
            for turn, role in zip(frame["turn"].tolist(), frame["role"].tolist(), strict=True):
                known.setdefault(turn, role)
        last = sorted(known)[-self.keep :]
        for turn in known.keys() - set(last):
            if self.turns.containsKey((turn,)):
                self.turns.removeKey((turn,))
        for turn in last:
            self.turns.updateValue((turn,), (known[turn],))
        yield pd.DataFrame({"conv_id": [key[0]] * len(last), "turn": last, "role": [known[t] for t in last]})

    def close(self) -> None:
        pass


def remembered_turns(stream: DataFrame, keep: int, folder: str, checkpoint: str) -> StreamingQuery:
    """The last so many turns of each conversation (conv_id, turn, role), kept as state from batch to batch, in whatever order turns come. What a batch changed replaces it in a table of buckets, which latest_turns reads: one set of turns for each conversation, however many batches there were."""

    def one(batch: DataFrame, number: int) -> None:
        merged(batch, folder, ["conv_id"])

    kept = stream.groupBy("conv_id").transformWithStateInPandas(_Turns(keep), TURN, "update", "none")
    with _kept_by_key(stream.sparkSession):
        return kept.writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_turns(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, folder, T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType())]))


def refreshed(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Counts of actions (round, action) that are published only when the highest round has moved: folder/counts/round=r is what there was when round r came. The counts themselves are the stream's state, so no batch reads what came before it."""

    def one(batch: DataFrame, number: int) -> None:
        counts = batch.persist()  # a row for each action
        newest = counts.agg(F.max("round")).first()[0]
        if newest is not None and not exists(batch.sparkSession, f"{folder}/counts/round={newest}/_SUCCESS"):
            counts.select("action", "n").write.mode("overwrite").parquet(f"{folder}/counts/round={newest}")
        counts.unpersist()

    counts = stream.groupBy("action").agg(F.count("*").alias("n"), F.max("round").alias("round"))
    return counts.writeStream.outputMode("complete").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Keys by which users are dealt to tasks: the open sessions of a key's users are one value of state.
USER_KEYS = 256


class _Sessions(StatefulProcessor):
    """The open sessions of many users as rows of user, begin, end (microseconds) and number of requests; one timer at the earliest end. A session is let go when the watermark has passed its end; none of its requests is let in then."""

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "rows binary")

    def _known(self) -> np.ndarray:
        return np.frombuffer(bytes(self.open.get()[0]), np.int64).reshape(-1, 4) if self.open.exists() else np.zeros((0, 4), np.int64)

    def _keep(self, rows: np.ndarray) -> None:
        if len(rows):
            self.open.update((np.ascontiguousarray(rows).tobytes(),))
            self.handle.registerTimer(-(-int(rows[:, 2].min()) // 1000))
        else:
            self.open.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = [self._known()]
        for frame in rows:
            user, at = frame["user_id"].to_numpy(np.int64), frame["at"].to_numpy(np.int64)
            found.append(np.column_stack([user, at, at + self.gap, np.ones(len(at), np.int64)]))
        every = np.concatenate(found)
        self._keep(joined(every[np.lexsort((every[:, 1], every[:, 0]))]))
        yield _session_frame(every[:0])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self._known()
        done = known[:, 2] <= timerValues.getCurrentWatermarkInMs() * 1000
        if done.any():
            self._keep(known[~done])
        yield _session_frame(known[done])

    def close(self) -> None:
        pass


def joined(rows: np.ndarray) -> np.ndarray:
    """Sessions (user, begin, end, n), sorted by user and begin, with those of a user that overlap as one."""
    if not len(rows):
        return rows
    user, start, end, n = rows.T
    first = np.flatnonzero(np.concatenate([[True], user[1:] != user[:-1]]))
    # The latest end so far of each user: ranks of ends, raised by user, so that one running maximum serves all.
    ranks, by_rank = np.unique(end, return_inverse=True)
    which = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rows))))
    reach = ranks[np.maximum.accumulate(by_rank + which * len(ranks)) - which * len(ranks)]
    opens = np.concatenate([[True], (user[1:] != user[:-1]) | (start[1:] >= reach[:-1])])
    at = np.flatnonzero(opens)
    return np.column_stack([user[at], start[at], np.maximum.reduceat(end, at), np.add.reduceat(n, at)])


def _session_frame(rows: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["user_id", "start", "end", "n"])


def idle_sessions(stream: DataFrame, seconds: int, folder: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """Sessions (user_id, start, end, n; microseconds) of a user's requests (user_id, ts) that no other of theirs is so near to, in folder: each once, when the watermark has passed its end. Requests that come later than late after newer ones are let in as long as the watermark isn't past them, and join sessions; then they are dropped."""
    key = F.pmod(F.xxhash64("user_id"), F.lit(USER_KEYS)).alias("key")
    rows = stream.withWatermark("ts", late).where("user_id is not null").select("user_id", "ts", F.unix_micros("ts").alias("at"), key).groupBy("key")
    found = rows.transformWithStateInPandas(_Sessions(seconds * 1_000_000), "user_id long, start long, end long, n long", "append", "eventTime")
    with _kept_by_key(stream.sparkSession):
        return found.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
