"""Masked pseudo-likelihood: a window network predicts each word from those on both sides, and a text's score is the sum of the logarithms.

Every word is counted over the whole corpus. The network adds an embedding for each place in the window, bends the sum, and
predicts in two steps: the word's class, then the word in its class. Words outside its vocabulary fall into rest classes by
shape, and each has its own part of the class's probability, by its count; one more occurrence is left to words that the corpus
doesn't have. The counts of frequent words go to all tasks, those of the others are joined. The network begins with numpy on
the driver, on windows chosen by hash from every place of all texts, and goes on with all other windows of the corpus: they are
dealt to rounds by hash, in a round each task takes steps on its own windows, and the tasks' weights are averaged.
"""

from __future__ import annotations

import copy
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.common import Words, byte_class, chunks, columns_added, discarded, mixed, shared_dir, sliced, utf8, written

#: Words of the vocabulary, and rest classes by shape.
VOCABULARY, SHAPES = 1984, 64
#: Words on either side of the window, width of the network, classes of words.
SIDE, WIDTH, CLASSES = 2, 24, 46
#: Windows that the network begins with (all, if there are no more), steps on these, and windows of a step.
FIRST_WINDOWS, STEPS, BATCH = 480_000, 700, 1024
#: Of all other windows one in so many is learned from too (1: every window), in so many rounds, each with windows of its own.
ONE_IN, ROUNDS = 1, 12
#: Windows of a task in a round, about; of a step of a task; and how many are put into another order together.
PER_TASK, TASK_BATCH, MIXED = 1 << 19, 1 << 13, 1 << 17
#: Parts of the weights that are averaged on their own.
PARTS = 16
#: Words outside the vocabulary whose counts go to all tasks; those of rarer words are joined.
KNOWN = 1 << 20
#: The first round's rate; a logarithm's smallest part when they are summed.
RATE, FINE = 0.2, float(1 << 32)

_SPACE = byte_class("nonspace")


def shapes(w: Words) -> np.ndarray:
    """Length up to 15, whether it begins in upper case, whether it ends with a mark."""
    data = np.frombuffer(w.data, np.uint8)
    head, tail = data[w.starts], data[w.ends - 1]
    upper = (head >= 65) & (head <= 90)
    mark = (tail < 48) | ((tail > 57) & (tail < 65)) | ((tail > 90) & (tail < 97)) | ((tail > 122) & (tail < 128))
    return np.minimum(w.ends - w.starts, 15).astype(np.int64) * 4 + upper * 2 + mark


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, shape, count) over all documents: word is its hash. Each task sums up its own words first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def together() -> None:
            word, shape, count = (np.concatenate(x) for x in zip(*found, strict=True))
            unique, first, back = np.unique(word, return_index=True, return_inverse=True)
            found[:] = [(unique, shape[first], np.bincount(back, weights=count).astype(np.int64))]

        for batch in batches:
            for _, data, offsets in chunks(utf8(batch.column(0))):
                w = Words(data, offsets, _SPACE)
                unique, first, count = np.unique(w.hashes, return_index=True, return_counts=True)
                found.append((unique, shapes(w)[first], count))
                if len(found) > 64:
                    together()
                if len(found[0][0]) > 1 << 21:  # bounded memory: what is known goes out
                    together()
                    yield pack(*found.pop())
        if found:
            together()
            yield pack(*found.pop())

    def pack(word, shape, count):
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(shape.astype(np.int32)), pa.array(count)], names=["word", "shape", "n"])

    return documents.select("text").mapInArrow(run, "word long, shape int, n long").groupBy("word").agg(F.min("shape").alias("shape"), F.sum("n").alias("n"))


@dataclass
class Network:
    words: np.ndarray
    rest: np.ndarray
    place_of: np.ndarray
    class_of: np.ndarray
    inputs: np.ndarray
    bias: np.ndarray
    classes: np.ndarray
    class_bias: np.ndarray
    outputs: np.ndarray
    output_bias: np.ndarray
    #: Hashes of frequent words outside the vocabulary, in order, and the logarithms of their counts.
    known: np.ndarray
    known_log: np.ndarray
    #: (word, n) of all words.
    counts: DataFrame | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"counts": None}

    def __post_init__(self) -> None:
        self._low = np.full(1 << 20, -1, np.int32)
        self._low[(self.words & np.uint64((1 << 20) - 1)).astype(np.int64)] = np.arange(len(self.words))
        self._order = np.argsort(self.words)

    def ids(self, w: Words) -> np.ndarray:
        """1 to the vocabulary's size for its words, beyond that for shapes; 0 stands outside a text."""
        if not len(self.words):
            return len(self.words) + 1 + shapes(w)
        at = self._low[(w.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)]
        found = (at >= 0) & (self.words[at] == w.hashes)
        rest = np.flatnonzero((at >= 0) & ~found)  # two words may share their low bits
        where = self._order[np.minimum(np.searchsorted(self.words[self._order], w.hashes[rest]), len(self.words) - 1)]
        at[rest], found[rest] = where, self.words[where] == w.hashes[rest]
        return np.where(found, at + 1, len(self.words) + 1 + shapes(w))

    def contexts(self, ids: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The ids beside each word, from the left to the right; 0 where the text ends."""
        out = np.zeros((len(ids), 2 * SIDE), ids.dtype)
        for k, d in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
            n = len(ids) - abs(d)
            if n > 0:
                a, b = (slice(-d, None), slice(0, n)) if d < 0 else (slice(0, n), slice(d, None))
                out[a, k] = np.where(text[a] == text[b], ids[b], 0)
        return out

    def hidden(self, contexts: np.ndarray) -> np.ndarray:
        h = self.bias + self.inputs[0].take(contexts[:, 0], axis=0)
        for k in range(1, 2 * SIDE):
            h += self.inputs[k].take(contexts[:, k], axis=0)
        return np.tanh(h, out=h)

    def log_probabilities(self, ids: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Of each word, given those on both sides; of a word outside the vocabulary without the logarithm of its own count."""
        h = self.hidden(self.contexts(ids, text))
        k = self.class_of[ids]
        out = _log_softmax_at(self.classes.T @ h.T + self.class_bias[:, None], k)
        order = np.argsort(k.astype(np.int16), kind="stable")
        cuts = np.searchsorted(k[order], np.arange(CLASSES + 1))
        for c in range(CLASSES):
            at = order[cuts[c] : cuts[c + 1]]
            if len(at):
                out[at] += _log_softmax_at(self.outputs[c].T @ h[at].T + self.output_bias[c][:, None], self.place_of[ids[at]])
        return out - self.rest[ids]

    def own_counts(self, hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(logarithm of the count of each word outside the vocabulary, 0 for all others, whether it is yet to be joined)."""
        out, rest = np.zeros(len(ids)), ids > len(self.words)
        if not len(self.known):
            return out, rest
        where = np.flatnonzero(rest)
        at = np.minimum(np.searchsorted(self.known, hashes[where]), len(self.known) - 1)
        found = self.known[at] == hashes[where]
        out[where[found]] = self.known_log[at[found]]
        rest[where[found]] = False
        return out, rest

    def gradients(self, c: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the negative log-likelihood, summed over the windows (contexts, words)."""
        order = np.argsort(self.class_of[y].astype(np.int16), kind="stable")  # so that a class is a slice
        c, y = c[order], y[order]
        k = self.class_of[y]
        h = self.hidden(c)
        p = _errors(self.classes.T @ h.T + self.class_bias[:, None], k)
        grad = {n: np.zeros_like(getattr(self, n)) for n in LEARNED}
        dh = p.T @ self.classes.T
        grad["classes"], grad["class_bias"] = (p @ h).T, p.sum(axis=1)
        cuts = np.searchsorted(k, np.arange(CLASSES + 1))
        for own in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[own], cuts[own + 1]
            q = _errors(self.outputs[own].T @ h[a:b].T + self.output_bias[own][:, None], self.place_of[y[a:b]])
            dh[a:b] += q.T @ self.outputs[own].T
            grad["outputs"][own], grad["output_bias"][own] = (q @ h[a:b]).T, q.sum(axis=1)
        dh *= 1 - h * h
        for place in range(2 * SIDE):
            order = np.argsort(c[:, place].astype(np.int16), kind="stable")
            beside = c[order, place]
            first = np.flatnonzero(np.diff(beside, prepend=-1))
            grad["inputs"][place][beside[first]] = np.add.reduceat(dh.take(order, axis=0), first, axis=0)
        grad["bias"] = dh.sum(axis=0)
        return grad

    def step(self, grad: dict[str, np.ndarray], n: int, scale: dict[str, np.ndarray], rate: float) -> None:
        for name in LEARNED:
            g = (grad[name] / n).astype(np.float32)
            scale[name] += g * g
            setattr(self, name, getattr(self, name) - np.float32(rate) * g / np.sqrt(scale[name]))


LEARNED = ("inputs", "bias", "classes", "class_bias", "outputs", "output_bias")


def _errors(scores: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The probabilities, less 1 at the right one: a row for each choice, a column for each window."""
    scores -= scores.max(axis=0)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=0)
    scores[at, np.arange(len(at))] -= 1
    return scores


def _log_softmax_at(scores: np.ndarray, at: np.ndarray) -> np.ndarray:
    scores -= scores.max(axis=0)
    chosen = scores[at, np.arange(len(at))]
    np.exp(scores, out=scores)
    return (chosen - np.log(scores.sum(axis=0))).astype(np.float64)


def untrained(words: np.ndarray, counts: np.ndarray, rest: np.ndarray, known: np.ndarray, known_log: np.ndarray, seed: int = 7) -> Network:
    """counts: over the corpus, by id; words of like frequency share a class."""
    rng = np.random.default_rng(seed)
    size = len(words) + 1 + SHAPES
    order = np.argsort(-counts[1:], kind="stable") + 1
    class_of, place_of = np.zeros(size, np.int64), np.zeros(size, np.int64)
    per = -(-(size - 1) // CLASSES)
    class_of[order], place_of[order] = np.arange(size - 1) // per, np.arange(size - 1) % per
    f = np.float32
    inputs = (rng.standard_normal((2 * SIDE, size, WIDTH)) * 0.1).astype(f)
    classes, outputs = (rng.standard_normal((WIDTH, CLASSES)) * 0.1).astype(f), (rng.standard_normal((CLASSES, WIDTH, per)) * 0.1).astype(f)
    class_bias, output_bias = np.full(CLASSES, -20, f), np.full((CLASSES, per), -20, f)
    share = (counts + 0.5) / (counts[1:].sum() + 0.5 * (size - 1))
    total = np.bincount(class_of[1:], weights=share[1:], minlength=CLASSES)
    class_bias[total > 0] = np.log(total[total > 0])
    output_bias[class_of[1:], place_of[1:]] = np.log(share[1:] / total[class_of[1:]])
    return Network(words, rest, place_of, class_of, inputs, np.zeros(WIDTH, f), classes, class_bias, outputs, output_bias, known, known_log)


def trained(net: Network, windows: np.ndarray, steps: int = STEPS, seed: int = 11) -> dict[str, np.ndarray]:
    """Adagrad on windows (the word, then those beside it); returns the sums of squares that later steps go on with."""
    rng = np.random.default_rng(seed)
    scale = {n: np.full_like(getattr(net, n), 1e-6) for n in LEARNED}
    for t in range(steps if len(windows) else 0):
        pick = windows[rng.integers(0, len(windows), BATCH)].astype(np.int64)
        net.step(net.gradients(pick[:, 1:], pick[:, 0]), BATCH, scale, 0.1 * (1 - t / steps) + 0.005)
    return scale


def windows_of(documents: DataFrame, namer: Network, first: float, others: float, rounds: int) -> DataFrame:
    """(round, ids): windows of all texts, packed, by a hash of row and place. The share first is in round -1, the share others of the rest in the rounds from 0."""
    shared = documents.sparkSession.sparkContext.broadcast(namer)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in sliced(batches):
            rows, out = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), ([], [])
            for start, data, offsets in chunks(utf8(batch.column(0))):
                w = Words(data, offsets, _SPACE)
                many = np.diff(w.first)
                text = np.repeat(np.arange(len(many)), many)
                place = np.arange(len(text)) - w.first[text]
                key = mixed(mixed(rows[start + text]) + place.astype(np.uint64))
                u = (key >> np.uint64(11)).astype(np.float64) / (1 << 53)
                taken = np.flatnonzero(u < first + (1 - first) * others)
                if not len(taken):
                    continue
                ids = net.ids(w).astype(np.int16)
                which = np.where(u[taken] < first, -1, (key[taken] & np.uint64(2047)).astype(np.int64) % rounds).astype(np.int16)
                order = np.argsort(which, kind="stable")
                found = np.column_stack([ids, net.contexts(ids, text)])[taken[order]]
                cuts = np.flatnonzero(np.diff(which[order], prepend=-2))
                out[0].extend(which[order[cuts]].tolist())
                out[1].extend(found[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(found)], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], names=["round", "ids"])

    return documents.select("text", F.xxhash64("doc_id", "text").alias("row")).mapInArrow(run, "round int, ids binary")


def unpacked(ids: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x) for x in ids), np.int16).reshape(-1, 2 * SIDE + 1)


def learned(windows: DataFrame, net: Network, scale: dict[str, np.ndarray], rate: float, tasks: int) -> None:
    """Each task takes steps on its own windows from the same weights; of each weight the average goes on, by the squared gradients that it had in each task.

    The tasks' weights are averaged in PARTS parts by other tasks, so that the driver gets them once, whatever the number of tasks.
    """
    shared = windows.sparkSession.sparkContext.broadcast((net, scale))

    def groups(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
        held, size = [], 0
        for packed in (x for batch in batches for x in batch.column(0).to_pylist()):
            held.append(packed)
            size += len(packed)
            if size >= MIXED * 2 * (2 * SIDE + 1):
                yield unpacked(held)
                held, size = [], 0
        if held:
            yield unpacked(held)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, squares = shared.value
        own, sums, rng = None, {k: x.copy() for k, x in squares.items()}, np.random.default_rng(13)
        for found in groups(batches):
            own = own or copy.copy(begin)
            for pick in np.array_split(rng.permutation(len(found)), -(-len(found) // TASK_BATCH)):
                own.step(own.gradients(found[pick, 1:], found[pick, 0]), len(pick), sums, rate)
        if own:
            weights = np.concatenate([getattr(own, k).ravel() for k in LEARNED])
            gained = np.concatenate([(sums[k] - squares[k]).ravel() for k in LEARNED])
            for part, (x, w) in enumerate(zip(np.array_split(weights, PARTS), np.array_split(gained, PARTS), strict=True)):
                yield packed_part(part, x, w)

    def packed_part(part: int, x: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        arrays = [pa.array([part], pa.int32()), *[pa.array([v.astype(np.float32).tobytes()], pa.binary()) for v in (x, w)]]
        return pa.RecordBatch.from_arrays(arrays, names=["part", "weights", "gained"])

    def averaged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, x, w in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                x, w = (np.frombuffer(v, np.float32).astype(np.float64) for v in (x, w))
                total[part] = total.get(part, 0) + np.stack([w, w * x, w * w])
        for part, (w, wx, ww) in total.items():
            yield packed_part(part, *[np.divide(v, w, out=np.full(len(w), np.nan), where=w > 0) for v in (wx, ww)])  # none where no task had a gradient

    schema = "part int, weights binary, gained binary"
    found = windows.select("ids").coalesce(tasks).mapInArrow(run, schema)
    rows = sorted(found.repartition(PARTS, "part").mapInArrow(averaged, schema).collect(), key=lambda r: r.part)
    shared.unpersist()
    if not rows:
        return
    new, gained = (np.concatenate([np.frombuffer(bytes(r[c]), np.float32) for r in rows]) for c in ("weights", "gained"))
    cuts = np.cumsum([getattr(net, k).size for k in LEARNED])[:-1]
    for k, x, g in zip(LEARNED, np.split(new, cuts), np.split(gained, cuts), strict=True):
        old = getattr(net, k)
        x, g = x.reshape(old.shape), g.reshape(old.shape)
        setattr(net, k, np.where(np.isnan(x), old, x))
        scale[k] = scale[k] + np.nan_to_num(g)


def fit(documents: DataFrame, first: int = FIRST_WINDOWS, one_in: int = ONE_IN, steps: int = STEPS, rounds: int = ROUNDS, known: int = KNOWN) -> Network:
    """Counts of all words; the network from about first windows, and from all others (or one in one_in of them), wherever in their texts they stand."""
    counts = written(word_counts(documents), "words")
    top = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()
    rest_rows = counts.join(F.broadcast(counts.orderBy(F.desc("n"), "word").limit(VOCABULARY).select("word")), "word", "left_anti")
    rest_counts = {r["shape"]: r["n"] for r in rest_rows.groupBy("shape").agg(F.sum("n").alias("n")).collect()}
    least, many = 0, 0  # the least count with which a word is known to all tasks
    for r in rest_rows.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect():
        if (many := many + r.words) > known:
            least = r.n + 1
            break
    frequent = rest_rows.where(F.col("n") >= least).select("word", "n").toArrow()
    words = np.array([r.word for r in top], np.int64).view(np.uint64)
    by_id = np.zeros(len(words) + 1 + SHAPES)
    by_id[1 : len(words) + 1] = [r.n for r in top]
    rest = np.zeros(len(by_id))
    for shape, n in rest_counts.items():
        by_id[len(words) + 1 + shape], rest[len(words) + 1 + shape] = n, np.log(n + 1)
    hashes = frequent.column("word").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    nothing = np.zeros(0, np.uint64), np.zeros(0)
    net = untrained(words, by_id, rest, *nothing)
    total = by_id.sum()
    share = min(1.0, first / max(total, 1))
    path = f"{shared_dir(documents.sparkSession)}/windows-{uuid.uuid4().hex}"
    chosen = windows_of(documents.where("text is not null"), net, share, 1 / one_in, rounds)
    chosen.write.partitionBy("round").parquet(path)
    chosen = documents.sparkSession.read.schema("ids binary, round int").parquet(path)
    chosen.shared_path = path
    begin = unpacked(r.ids for r in chosen.where("round = -1").select("ids").collect())
    scale = trained(net, begin[np.lexsort(begin.T)], steps)
    tasks = int(total / one_in / rounds // PER_TASK) + 1
    for t in range(rounds if share < 1 else 0):
        learned(chosen.where(F.col("round") == t), net, scale, RATE * (1 - t / rounds) + 0.005, tasks)
    discarded(chosen)
    net.known, net.known_log, net.counts = hashes[order], np.log(frequent.column("n").to_numpy()[order]), counts.select("word", "n")
    return net


def with_scores(documents: DataFrame, network: Network, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """documents (or the columns in keep) with n_words, pseudo_log_likelihood (0 without words) and per_word (null without words). New columns replace documents' of their names; rows are scored one by one, whole.

    Only rare words, whose counts not every task has, are shuffled, to be joined with their counts.
    """
    shared = documents.sparkSession.sparkContext.broadcast(network)
    fields = [T.StructField("n_words", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("rare", T.ArrayType(T.LongType()))]

    def make():
        net = shared.value

        def apply(column):
            n, total = np.zeros(len(column), np.int64), np.zeros(len(column))
            rare, many_rare = [], np.zeros(len(column) + 1, np.int64)
            for start, data, offsets in chunks(utf8(column)):
                w = Words(data, offsets, _SPACE)
                many = np.diff(w.first)
                text = np.repeat(np.arange(len(many)), many)
                ids = net.ids(w)
                own, missing = net.own_counts(w.hashes, ids)
                rare.append(w.hashes[missing].view(np.int64))
                many_rare[start + 1 : start + 1 + len(many)] = np.bincount(text[missing], minlength=len(many))
                for a in range(0, len(ids), 1 << 16):  # with the words beside, so that long texts take no more memory
                    low, high = max(0, a - SIDE), min(len(ids), a + (1 << 16) + SIDE)
                    p = net.log_probabilities(ids[low:high], text[low:high])[a - low : a - low + (1 << 16)] + own[a : a + (1 << 16)]
                    total[start : start + len(many)] += np.bincount(text[a : a + (1 << 16)], weights=p, minlength=len(many))
                n[start : start + len(many)] = many
            words = pa.array(np.concatenate([*rare, np.zeros(0, np.int64)]))
            return {"n_words": n, "score": total, "rare": pa.ListArray.from_arrays(pa.array(np.cumsum(many_rare).astype(np.int32)), words)}

        return apply

    new = ["n_words", "pseudo_log_likelihood", "per_word"]
    kept = [c for c in (documents.columns if keep is None else keep) if c not in new]
    source = documents.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("kept"), F.monotonically_increasing_id().alias("row"), F.col(f"`{text_col}`").alias("_text"))
    scored = written(columns_added(source, ["_text"], fields, make, keep=["kept", "row"]), "scores")
    rare = scored.select("row", F.explode("rare").alias("word"))
    if network.counts is not None:
        rare = rare.join(network.counts, "word", "left")
    else:
        rare = rare.withColumn("n", F.lit(1))
    # whole numbers, so that the order of the sum doesn't matter
    logs = rare.groupBy("row").agg(F.sum(F.round(F.log(F.coalesce("n", F.lit(1))) * FINE).cast("long")).alias("more"))
    total = F.col("score") + F.coalesce(F.col("more") / FINE, F.lit(0.0))
    out = scored.join(logs, "row", "left").select("kept", "n_words", total.alias("pseudo_log_likelihood"))
    return out.select("kept.*", "n_words", "pseudo_log_likelihood", F.when(F.col("n_words") > 0, F.col("pseudo_log_likelihood") / F.col("n_words")).alias("per_word"))


def pseudo_likelihood(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, pseudo_log_likelihood, per_word. Words are whatever stands between spaces and control characters 9 to 13; null and empty texts have none; other columns are left out."""
    docs = documents.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return with_scores(docs, fit(docs), keep=["doc_id"]).select("doc_id", "n_words", "pseudo_log_likelihood", "per_word")
