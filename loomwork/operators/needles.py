"""Substrings by n-grams: many needles in names by stretches of their lengths, and many needles in long texts by each one's rarest gram."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions.text import match_kind, match_score
from loomwork.sources.shared import written

#: Characters of a needle that are looked up as they are, and files of an index.
LONGEST, BUCKETS = 16, 32


def grams(text: Column, n: int | Column) -> Column:
    """The different stretches of n characters."""
    size = F.length(text)
    return F.when(size >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(text, i, n)))).otherwise(F.array().cast("array<string>"))


@dataclass
class Postings:
    """Entities with what a search asks of them."""

    entities: DataFrame

    def pieces(self, sizes: list[int]) -> DataFrame:
        """Entities with each different stretch (gram) of their names that has one of some lengths."""
        texts = (F.lower("name"), F.col("normalised"))
        own = F.array_union(*[F.flatten(F.array(*[grams(F.coalesce(t, F.lit("")), n) for n in sizes])) for t in texts])
        return self.entities.withColumn("gram", F.explode(own))


def postings(entities: DataFrame, buckets: int = BUCKETS) -> Postings:
    """Entities (uuid, name, normalised, mention_count, ...) written once, in so many files, and read by any number of searches."""
    return Postings(written(entities.select("uuid", "name", "normalised", "mention_count").repartition(buckets), "names"))


def found(index: Postings, needles: DataFrame, limit: int = 10) -> DataFrame:
    """(needle, uuid, matched_by, score, place) for each needle (query) as search.lexical finds it: of the entities whose name holds it the most mentioned, best match first.

    All needles in one join: names are cut into stretches of the lengths that needles have, and a stretch is a needle or isn't, so
    nothing meets but what is found, and work grows with names and finds. Of a needle of more than LONGEST characters the rarest stretch
    is looked up, and the names that have it are looked at. A blank needle finds nothing.
    """
    own = needles.select(F.lower(F.trim("query")).alias("needle")).where("needle <> ''").distinct()
    size = F.least(F.lit(LONGEST), F.length("needle"))
    asked = written(own.select("needle", size.alias("size"), F.explode(grams(F.col("needle"), size)).alias("gram")), "needles")
    sizes = sorted(r[0] for r in asked.select("size").distinct().collect())
    if sizes[-1:] == [LONGEST]:
        long = asked.where(F.length("needle") > LONGEST)
        counts = index.pieces([LONGEST]).select("gram").join(long.select("gram").distinct(), "gram").groupBy("gram").agg(F.count("*").alias("n"))
        rank = F.row_number().over(Window.partitionBy("needle").orderBy("n", "gram"))
        rarest = long.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("r", rank).where("r = 1 and n > 0")
        asked = written(asked.where(F.length("needle") <= LONGEST).select("needle", "gram").unionByName(rarest.select("needle", "gram")), "needles")
    held = index.pieces(sizes or [1]).join(asked.select("needle", "gram"), "gram").where(F.contains(F.lower("name"), F.col("needle")) | F.contains("normalised", F.col("needle")))
    most = Window.partitionBy("needle").orderBy(F.desc("mention_count"), "name", "uuid")
    hits = held.withColumn("r", F.row_number().over(most)).where(F.col("r") <= limit).withColumn("matched_by", match_kind(F.col("needle"), F.col("name"), F.col("normalised")))
    hits = hits.withColumn("score", match_score(F.col("matched_by")))
    place = F.row_number().over(Window.partitionBy("needle").orderBy(F.desc("score"), F.desc("mention_count"), "name", "uuid"))
    return hits.select("needle", "uuid", "matched_by", "score", place.alias("place"))


# ---- long texts ----------------------------------------------------------------------------------------------------

#: Lengths of grams in bytes: a needle has grams of the greatest that it reaches.
SIZES = (4, 8, 16, 32)
#: Bits of the filter that tells which grams any needle has, as a power of two, between these.
LEAST_BITS, MOST_BITS = 12, 27
_STEP = 0x9E3779B97F4A7C15


def gram_hashes(data: bytes, size: int) -> np.ndarray:
    """A hash of each size consecutive bytes; size is a power of two, and halves are put together."""
    h = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    done, step = 1, _STEP
    while done < size:
        if len(h) <= done:
            return h[:0]
        h = h[:-done] * np.uint64(step) + h[done:]
        h ^= h >> np.uint64(29)
        step, done = (step * step | 1) % (1 << 64), done * 2
    return h


def size_of(needle: bytes) -> int:
    """The size of a needle's grams: 0 if it is shorter than all."""
    return max((s for s in SIZES if s <= len(needle)), default=0)


class Filter:
    """A bit for each of some numbers; others may have theirs by chance."""

    def __init__(self, words: np.ndarray, bits: int) -> None:
        self.words, self.bits = words, bits

    def among(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - self.bits)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _filter(hashes: DataFrame, count: int) -> Filter:
    """A filter of a column gram: words of bits meet in Spark, as many at most as the filter has."""
    bits = min(MOST_BITS, max(LEAST_BITS, int(16 * count).bit_length()))
    at = F.shiftrightunsigned("gram", 64 - bits)
    rows = hashes.select(F.shiftright(at, 6).alias("word"), F.expr("1L").alias("one"), at.bitwiseAND(63).cast("int").alias("b")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, b)")).alias("bits"))
    words = np.zeros(1 << (bits - 6), np.uint64)
    got = rows.toArrow()
    words[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return Filter(words, bits)


def _mapped(df: DataFrame, schema: str, rows: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                yield pa.RecordBatch.from_arrays(rows(batch.slice(a, 1024)), names=names)

    return df.mapInArrow(run, schema)


def held(documents: DataFrame, needles: DataFrame, flat: Callable[[str], str], places: Callable[[str, list[str]], list[tuple]], fields: list[T.StructField], id_col: str, text_col: str) -> DataFrame:
    """(id, *fields) from places(text, needles that may be in it) of every document that may hold a needle.

    needles (needle) are looked for in flat(text). A needle is known by the rarest of its grams, which two passes find: one counts
    the grams that any needle has, one gives the texts that have a needle's own. Both meet by shuffles, so the plan is the same for any
    number of needles; candidates meet their text once, all of a text together. Needles of fewer bytes than the smallest gram
    can't be looked for, and are left out.
    """

    def own_grams(batch: pa.RecordBatch) -> list[pa.Array]:
        needles_, sizes, found_ = [], [], []
        for needle in batch.column(0).to_pylist():
            data = needle.encode("utf-8", "surrogatepass")
            if size := size_of(data):
                h = np.unique(gram_hashes(data, size)).view(np.int64).tolist()
                needles_ += [needle] * len(h)
                sizes += [size] * len(h)
                found_ += h
        return [pa.array(needles_, pa.string()), pa.array(sizes, pa.int32()), pa.array(found_, pa.int64())]

    spark = documents.sparkSession
    known = written(_mapped(needles.select("needle").where("needle is not null").distinct(), "needle string, size int, gram long", own_grams), "needles")
    sizes = sorted(r[0] for r in known.select("size").distinct().collect())
    texts = documents.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(text_col).alias("h1"), F.xxhash64(F.lit(1), text_col).alias("h2")).where("text is not null")
    schema = T.StructType([documents.schema[id_col], *fields])
    if not sizes:
        return spark.createDataFrame([], schema)

    def grams_of(shared) -> Callable[[pa.RecordBatch], Iterator[tuple[int, int, np.ndarray]]]:
        def grams_(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
            for row, text in enumerate(batch.column(0).to_pylist()):
                data = flat(text).encode("utf-8", "surrogatepass")
                for size in sizes:
                    h = gram_hashes(data, size)
                    if len(h := h[shared.value.among(h)]):
                        yield row, size, np.unique(h).view(np.int64)

        return grams_

    def counted(shared) -> Callable[[pa.RecordBatch], list[pa.Array]]:
        each = grams_of(shared)

        def rows(batch: pa.RecordBatch) -> list[pa.Array]:
            by_size: dict[int, list[np.ndarray]] = {}
            for _, size, h in each(batch):
                by_size.setdefault(size, []).append(h)
            got = [(size, *np.unique(np.concatenate(h), return_counts=True)) for size, h in by_size.items()]
            none = np.zeros(0, np.int64)
            return [pa.array(np.concatenate([none, *[np.full(len(h), s) for s, h, _ in got]]).astype(np.int32)), pa.array(np.concatenate([none, *[h for _, h, _ in got]])), pa.array(np.concatenate([none, *[n for *_, n in got]]))]

        return rows

    def placed(shared) -> Callable[[pa.RecordBatch], list[pa.Array]]:
        each = grams_of(shared)

        def rows(batch: pa.RecordBatch) -> list[pa.Array]:
            got = list(each(batch))
            at = np.concatenate([np.zeros(0, np.int64), *[np.full(len(h), row) for row, _, h in got]])
            return [batch.column(1).take(pa.array(at)), batch.column(2).take(pa.array(at)), pa.array(np.concatenate([np.zeros(0, np.int64), *[np.full(len(h), s) for _, s, h in got]]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *[h for *_, h in got]]))]

        return rows

    every = spark.sparkContext.broadcast(_filter(known, known.count()))
    counts = _mapped(texts.select("text"), "size int, gram long, n long", counted(every)).groupBy("size", "gram").agg(F.sum("n").alias("n"))
    best = F.row_number().over(Window.partitionBy("needle").orderBy("n", "gram"))
    ranked = known.join(counts, ["size", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    keys = written(ranked.withColumn("r", best).where("r = 1 and n > 0").select("needle", "size", "gram"), "keys")  # a gram that no text has: nor has any the needle
    chosen = spark.sparkContext.broadcast(_filter(keys, keys.count()))
    kinds = texts.select("text", "h1", "h2")
    near = _mapped(kinds, "h1 long, h2 long, size int, gram long", placed(chosen)).join(keys, ["size", "gram"]).select("h1", "h2", "needle").distinct()
    asked = near.groupBy("h1", "h2").agg(F.collect_list("needle").alias("needles"))
    both = texts.join(asked, ["h1", "h2"]).select("id", "text", "needles")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            rows = [(r, *p) for r, (text, some) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)) for p in places(text, some)]
            columns = [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), *[pa.array([r[k] for r in rows], f.type) for k, f in enumerate(list(target)[1:], 1)]]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return both.mapInArrow(run, schema)
