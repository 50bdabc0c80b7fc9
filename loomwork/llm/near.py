"""N-gram Jaccard join: MinHash bands find candidates, which are verified on their full sets of word n-grams.

Documents with equal sets are one class. Classes that share a band's hash are a bucket, and buckets that share classes a
component. A component that fits a block is compared in one task, so its sets are shuffled once. A larger one, which chains of
chance collisions may have joined, is compared bucket by bucket, and a pair counts in the first bucket that it shares. Pairs are
compared by counting what they share, in blocks of bounded size, so no pair is ever a row and a large bucket is spread over many
tasks. Each class returns with the number of documents it is linked to and one link to a root, whose components are the final groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.common import LOWER, Words, byte_class, chunks, columns_added, discarded, mixed, utf8, written
from loomwork.llm.graph import components

NGRAM, THRESHOLD = 5, 0.8
#: Share of the pairs at the threshold that bands must find, and hash functions at most.
RECALL, MOST_HASHES = 0.9999, 96
#: Documents and n-grams of a block, about.
BLOCK_DOCS, BLOCK_GRAMS = 1024, 1_000_000
#: N-grams that more documents of a block share are counted by a matrix product, the others pair by pair.
OFTEN = 24
PAIRS_AT_ONCE = 500_000


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """The largest number of rows (the fewest false candidates) for which bands of at most most hashes reach the recall at the threshold."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, Words, np.ndarray, np.ndarray]]:
    """Per chunk: the first text's number, the words, and the different n-grams of each text with the texts' numbers, in order."""
    for start, data, offsets in chunks([t.translate(LOWER) for t in utf8(column)]):
        w = Words(data, offsets, byte_class("plain"))
        counts = np.diff(w.first)
        text = np.repeat(np.arange(len(counts)), counts)
        inside = w.within(n)
        grams, owner = w.grams(n)[inside], text[: len(inside)][inside]
        for size in range(1, n):  # a shorter text is one gram: all of its words
            rows = np.flatnonzero(counts == size)
            if len(rows):
                grams, owner = np.concatenate([grams, w.grams(size)[w.first[rows]]]), np.concatenate([owner, rows])
        order = np.lexsort((grams, owner))
        grams, owner = grams[order], owner[order]
        first = np.ones(len(grams), bool)
        first[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        yield start, w, grams[first], owner[first]


def signatures(documents: DataFrame, n: int, threshold: float, recall: float) -> DataFrame:
    """(doc_id, text_hash, k1, k2, grams, bands) for each row: k1 and k2 identify its set, and are null if it has no words."""
    bands, rows = bands_and_rows(threshold, recall)
    fields = [*[T.StructField(c, T.LongType()) for c in ("k1", "k2", "grams")], T.StructField("bands", T.ArrayType(T.LongType()))]

    def make():
        seeds = mixed(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64))
        times, plus = seeds[::2] | np.uint64(1), seeds[1::2]

        def apply(column):
            total = len(column)
            k1, k2, count = [None] * total, [None] * total, [0] * total
            found = [None] * total
            for start, _, grams, owner in _sets(column, n):
                if not len(grams):
                    continue
                begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                texts = owner[begins]
                sums = [np.add.reduceat(x, begins) for x in (mixed(grams), mixed(grams ^ seeds[0]))]
                values = np.empty((bands, len(texts)), np.uint64)
                for b in range(bands):
                    h = np.full(len(texts), b + 1, np.uint64)
                    for r in range(b * rows, (b + 1) * rows):
                        h = mixed(h ^ np.minimum.reduceat(grams * times[r] + plus[r], begins))
                    values[b] = h
                values = values.view(np.int64).T.tolist()
                sizes = np.diff(np.r_[begins, len(grams)]).tolist()
                keys = [x.view(np.int64).tolist() for x in sums]
                for i, t in enumerate(texts.tolist()):
                    k1[start + t], k2[start + t], count[start + t], found[start + t] = keys[0][i], keys[1][i], sizes[i], values[i]
            return {"k1": k1, "k2": k2, "grams": count, "bands": found}

        return apply

    rows_in = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return columns_added(rows_in, ["text"], fields, make, keep=["doc_id", "text_hash"])


def _verified(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """For one block, or two of one group: each class's number of linked documents, and the smallest class it is linked to through links here. Classes that share one of the bands in before are left to that band's bucket."""
    frame = frame.drop_duplicates("node").sort_values("node", ignore_index=True)
    m = len(frame)
    sets = [np.frombuffer(x, np.uint64) for x in frame["set"]]
    size = np.array([len(x) for x in sets], np.int64)
    shared = np.zeros((m, m), np.float32)
    values, owner = np.concatenate(sets), np.repeat(np.arange(m), size)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    begins = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    often = np.diff(np.r_[begins, len(values)])
    for k in range(2, min(OFTEN, m) + 1):  # grams that k documents have: k documents in a row
        at = begins[often == k]
        some = max(1, PAIRS_AT_ONCE // (k * (k - 1) // 2))
        for lo in range(0, len(at), some):
            docs = owner[at[lo : lo + some, None] + np.arange(k)]
            x, y = np.triu_indices(k, 1)
            pairs = (docs[:, x].astype(np.int64) * m + docs[:, y]).ravel()
            if len(pairs) * 4 > m * m:
                shared += np.bincount(pairs, minlength=m * m).reshape(m, m).astype(np.float32)
            else:
                code, number = np.unique(pairs, return_counts=True)
                shared.ravel()[code] += number.astype(np.float32)
    shared += shared.T
    at, number = begins[often > OFTEN], often[often > OFTEN]
    for lo in range(0, len(at), 2048):
        a, c = at[lo : lo + 2048], number[lo : lo + 2048]
        table = np.zeros((m, len(a)), np.float32)
        rows = np.concatenate([owner[s : s + k] for s, k in zip(a, c, strict=True)])
        table[rows, np.repeat(np.arange(len(a)), c)] = 1
        shared += table @ table.T
    union = size[:, None] + size[None, :] - shared
    link = shared >= threshold * union - 1e-6
    np.fill_diagonal(link, False)
    blocks = frame["block"].to_numpy()
    first, last = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
    if first != last:  # links inside a block are counted where it stands alone
        link &= blocks[:, None] != blocks[None, :]
    if frame["band"].iloc[0] > 0:
        for values in np.stack(frame["before"].to_list()).T:
            link &= values[:, None] != values[None, :]
    links = link @ frame["n"].to_numpy(np.int64)
    root = np.arange(m)
    while True:  # the smallest in reach
        new = np.array([min(r, root[row].min(initial=r)) for r, row in zip(root, link, strict=True)])
        new = new[new]
        if (new == root).all():
            break
        root = new
    some = links > 0
    node = frame["node"].to_numpy()
    return pd.DataFrame({"node": node[some], "links": links[some], "root": node[root[some]]})


def told_apart(classes: DataFrame) -> DataFrame:
    """classes with a node of one number each: k1, or a hash of k1 and k2 where different classes share k1."""
    shared = classes.groupBy("k1").count().where("count > 1").select("k1", F.lit(True).alias("shared"))
    if shared.isEmpty():
        return classes.withColumn("node", F.col("k1"))
    return classes.join(shared, "k1", "left").withColumn("node", F.expr("if(shared, xxhash64(k1, k2), k1)")).drop("shared")


def jaccard_join(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, text_hash, copy_id, class_id, n_links.

    Two documents are linked if the Jaccard similarity of their sets of word n-grams is threshold or more; n_links is the
    number of other documents that one is linked to, class_id the smallest id that links lead to, copy_id the smallest id
    with the same set. Words are runs of 0-9, a-z (A-Z in lower case) and what is beyond ASCII; a text of fewer than n words
    is a single gram. Without words, or null: linked to none, class_id is its own id. Null ids count as documents, but no
    smallest id is null unless all are. Repeated rows are copies of each other. Whole texts count, however long.
    """
    docs = documents.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = written(signatures(docs, n, threshold, recall), "signatures")
    classes = rows.where("k1 is not null").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "text_hash")).alias("_all"), F.min(F.expr("if(doc_id is null, null, struct(doc_id, text_hash))")).alias("_id"), F.count("*").alias("n"), F.first("grams").alias("grams"), F.first("bands").alias("bands"))
    found = written(classes.select("k1", "k2", F.coalesce("_id", "_all").alias("rep"), "n", "grams", "bands"), "classes")
    classes = told_apart(found)
    # Buckets of more than one class: every member is linked to the smallest.
    members = classes.select("node", F.posexplode("bands").alias("band", "hash"))
    buckets = members.groupBy("band", "hash").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("band", "hash", "least")
    groups = components(members.join(buckets, ["band", "hash"]).select(F.col("node").alias("a"), F.col("least").alias("b")))
    chosen = written(groups.select("node", F.col("root").alias("group")).join(classes.select("node", "rep", "n", "grams", "bands"), "node"), "chosen")
    links = written(_links(docs, _dealt(chosen), n, threshold), "links")
    roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    joined = classes.join(roots, "node", "left").join(counted, "node", "left").select("k1", "k2", "n", F.col("rep.doc_id").alias("copy_id"), F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    # Only classes with more than one document or with links need to be looked up.
    joined = written(joined.where("n > 1 or links > 0"), "joined")
    discarded(found, chosen, links, groups, roots)
    ids = joined.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    final = joined.join(ids, "root").select("k1", "k2", "copy_id", "class_id", (F.col("n") - 1 + F.col("links")).alias("n_links"))
    out = rows.select("doc_id", "text_hash", "k1", "k2").join(final, ["k1", "k2"], "left")
    return out.select("doc_id", "text_hash", F.coalesce("copy_id", "doc_id").alias("copy_id"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _blocks() -> Column:
    return F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum("grams") / BLOCK_GRAMS)).cast("int").alias("blocks")


def _dealt(chosen: DataFrame) -> DataFrame:
    """(node, n, doc_id, text_hash, bands, parts): parts are the groups (band, hash, blocks) in which a class is compared.

    That is its component if this fits a block (band -1, without bands), or else its buckets, of which it has no more than there are bands.
    """
    placed = chosen.join(chosen.groupBy("group").agg(_blocks()), "group")
    large = placed.where("blocks > 1")
    spots = large.select("node", "grams", F.posexplode("bands").alias("band", "hash"))
    buckets = spots.groupBy("band", "hash").agg(_blocks(), F.count("*").alias("classes")).where("classes > 1").drop("classes")
    parts = spots.join(buckets, ["band", "hash"]).groupBy("node").agg(F.collect_list(F.struct("band", "hash", "blocks")).alias("parts"))
    whole = F.array(F.struct(F.lit(-1).alias("band"), F.col("group").alias("hash"), "blocks")).alias("parts")
    small = placed.where("blocks = 1").select("node", "n", "rep", F.lit(None).cast("array<bigint>").alias("bands"), whole)
    wanted = small.unionByName(large.join(parts, "node").select("node", "n", "rep", "bands", "parts"))
    return wanted.select("node", "n", "rep.*", "bands", "parts")


def _links(docs: DataFrame, wanted: DataFrame, n: int, threshold: float) -> DataFrame:
    """(node, links, root) from every block or pair of blocks of the groups; wanted names one document for each class."""
    rows = docs.withColumn("text_hash", F.xxhash64("text"))
    same = rows["doc_id"].eqNullSafe(wanted["doc_id"]) & (rows["text_hash"] == wanted["text_hash"])
    # A shuffle at every size: the number of candidates grows with the documents, so a broadcast would only suit small inputs.
    found = rows.join(wanted.hint("merge"), same).select("node", "n", "bands", "parts", "text")

    def make():
        def apply(column):
            out = [b""] * len(column)
            for start, _, grams, owner in _sets(column, n):
                if len(grams):
                    begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                    for t, part in zip(owner[begins].tolist(), np.split(grams, begins[1:]), strict=True):
                        out[start + t] = part.tobytes()
            return {"set": out}

        return apply

    sets = columns_added(found, ["text"], [T.StructField("set", T.BinaryType())], make, keep=["node", "n", "bands", "parts"])
    sets = sets.withColumn("part", F.explode("parts")).select("node", "n", "set", "bands", "part.*")
    sets = sets.withColumn("before", F.slice("bands", F.lit(1), F.greatest("band", F.lit(0)))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # Block b meets every block: as (b, j) for j from b on, and as (i, b) before.
    met = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("node", "n", "band", "hash", "before", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "set")
    return met.groupBy("band", "hash", "i", "j").applyInPandas(lambda f: _verified(f, threshold), "node long, links long, root long")


def one_of_each(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with the columns they had, without those that are linked, over any number of links, to one with a smaller id. Rows that repeat an id and its text count once, rows with a null id stay, as do null and empty texts."""
    found = written(jaccard_join(documents, id_col, text_col, n, threshold), "near")
    gone = found.where("class_id <> doc_id").select("doc_id", "text_hash", F.lit(0).cast("long").alias("own")).distinct()
    # A number of its own for each row without an id: it repeats no other row, and those of one text are spread.
    rows = documents.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"))
    rows = rows.withColumn("own", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id() + 1).otherwise(F.lit(0)))
    stay = rows.join(gone, ["doc_id", "text_hash", "own"], "left_anti")
    # The join has dealt and sorted the rows by these keys, so the window shuffles nothing.
    first = F.row_number().over(Window.partitionBy("doc_id", "text_hash", "own").orderBy("own"))
    return stay.withColumn("place", first).where("place = 1").select("row.*")
