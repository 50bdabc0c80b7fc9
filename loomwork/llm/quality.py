"""Document quality from a linear-chain conditional random field over lines, whose good-marginals are weighted by length."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.common import Words, byte_class, chunks, columns_added, sliced, utf8, written
from loomwork.llm.training import held_out, labelled_sample, logistic, logistic_fit

#: Labelled documents to learn from, at most, and lines of those that the field learns from, in all: whole texts, by their hashes, as long as there is room; one that would take a tenth of it alone is left out. How marginals make a document's score is learned from all of them.
TRAIN_ROWS, TRAIN_LINES = 6_000, 200_000
FOLDS, HELD_FOLD = 5, 0
THRESHOLD = 0.3


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int8)
    out[list(chars.encode())] = 1
    return out


_UPPER, _LOWER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz")
_LOWER[128:] = 1
_DIGIT, _MARK, _ODD = _class("0123456789"), _class(".,;:?\"'()-"), _class("#$%&*@^~_=+<>{}[]\\/")
_SHOUT, _BAR, _STOP = _class("!"), _class("|"), _class(".!?")
_SHARES = (_UPPER, _LOWER, _DIGIT, _MARK, _ODD, _SHOUT, _BAR)
_SPACE = byte_class("nonspace")


class Lines:
    """The lines of some texts: features, lengths, and where each text's lines begin."""

    def __init__(self, data: bytes, offsets: np.ndarray) -> None:
        buffer = np.frombuffer(data, np.uint8)
        breaks = np.flatnonzero(buffer == 10) + 1
        starts = np.sort(np.concatenate([offsets[:-1], breaks]))
        ends = np.r_[starts[1:], offsets[-1]] - 1  # without the line end, or what stands between texts
        self.first = np.searchsorted(starts, offsets)
        self.length = ends - starts
        n = np.maximum(self.length, 1).astype(np.float32)
        columns = [np.log1p(self.length) / 5]
        for table in _SHARES:
            sums = np.concatenate([[0], np.cumsum(table[buffer], dtype=np.int32)])
            columns.append((sums[ends] - sums[starts]) / n)
        text = np.searchsorted(offsets, starts, "right") - 1
        words = Words(data, offsets, _SPACE)
        at = np.searchsorted(words.starts, np.r_[starts, len(buffer)])
        many = np.diff(at)
        size = np.maximum(many, 1).astype(np.float32)
        columns += [np.log1p(many) / 4, self.length / size / 10]
        last, head = buffer[np.maximum(ends - 1, 0)], buffer[np.minimum(starts, len(buffer) - 1)]
        some = self.length > 0
        columns += [some & (_STOP[last] == 1), some & (_UPPER[head] == 1), ~some]
        for k in (1, 3):  # shares of words, and of three words in a row, that the text has more than once
            grams = words.grams(k)
            owner = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))[: len(grams)]
            _, back, count = np.unique(grams ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
            again = np.concatenate([[0], np.cumsum(count[back] > 1), np.full(k - 1, (count[back] > 1).sum())]) if len(grams) else np.zeros(len(words.hashes) + 1)
            columns.append((again[at[1:]] - again[at[:-1]]) / size)
        # Lines that the text repeats.
        code = self._codes(words, at)
        _, back, count = np.unique(code ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
        columns += [some & (count[back] > 1), np.log1p(np.diff(self.first)[text]) / 5]
        own = np.column_stack([np.asarray(c, np.float32) for c in columns])
        own = np.column_stack([own, own[:, 5] > 0.05])
        border = np.zeros((1, own.shape[1] - 1), np.float32)
        before, after = np.vstack([border, own[:-1, 1:]]), np.vstack([own[1:, 1:], border])
        is_first, is_last = np.zeros(len(own), bool), np.zeros(len(own), bool)
        is_first[self.first[:-1]] = is_last[self.first[1:] - 1] = True
        before[is_first] = after[is_last] = 0
        self.features = np.column_stack([own, before, after, is_first, is_last, np.ones(len(own))]).astype(np.float32)

    @staticmethod
    def _codes(words: Words, at: np.ndarray) -> np.ndarray:
        """A hash of each line's words, in order."""
        place = np.arange(len(words.hashes)) - np.repeat(at[:-1], np.diff(at)) if len(words.hashes) else np.zeros(0, np.int64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(words.hashes * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)), dtype=np.uint64)])
        return sums[at[1:]] - sums[at[:-1]]


def marginals(node: np.ndarray, first: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability that each line is good, and expected transitions (2 x 2) over all texts.

    node: a line's log-odds of good; first: where each text's lines begin; step[a, b]: score of label b after a. Texts go side by side, the longest first, a line at a time.
    """
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    counts, begin = counts[order], first[:-1][order]
    longest = int(counts[0]) if len(counts) else 0
    active = np.searchsorted(-counts, -np.arange(1, longest + 1), "right")
    score = np.zeros((len(node), 2))
    score[:, 1] = node
    ahead, behind = np.zeros_like(score), np.zeros_like(score)
    for t in range(longest):
        at = begin[: active[t]] + t
        ahead[at] = score[at] if t == 0 else score[at] + np.logaddexp(ahead[at - 1, :1] + step[0], ahead[at - 1, 1:] + step[1])
    for t in range(longest - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        onward = score[at + 1] + behind[at + 1]
        behind[at] = np.logaddexp(step[:, 0] + onward[:, :1], step[:, 1] + onward[:, 1:])
    good = 1 / (1 + np.exp(-np.clip((ahead + behind)[:, 1] - (ahead + behind)[:, 0], -60, 60)))
    inside = np.ones(len(node), bool)
    inside[first[:-1][np.diff(first) > 0]] = False
    at = np.flatnonzero(inside)
    pair = ahead[at - 1][:, :, None] + step[None] + (score[at] + behind[at])[:, None, :]
    pair -= pair.max(axis=(1, 2), keepdims=True, initial=-1e30) if len(at) else 0
    pair = np.exp(pair)
    return good, (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0) if len(at) else np.zeros((2, 2))


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    step: np.ndarray
    final: np.ndarray | None = None

    def node(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.spread) @ self.weights

    def documents(self, x: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each text: the log-odds of the length-weighted mean of its lines' marginals, of their least, and the share that is bad."""
        good, _ = marginals(self.node(x), first, self.step)
        weight = length + 1.0
        sums = lambda v: np.add.reduceat(v, first[:-1])
        mean = sums(good * weight) / sums(weight)
        odds = lambda p: np.log((p + 1e-3) / (1 - p + 1e-3))
        return np.column_stack([odds(mean), odds(np.minimum.reduceat(good, first[:-1])), sums((good < 0.5) * weight) / sums(weight)])


def trained(x: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 150, rate: float = 0.08, ridge: float = 1e-3) -> Model:
    """Conditional likelihood of lines that are all labelled as their text, with each text and each label weighing alike, by Adam steps."""
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread < 1e-6] = 1.0
    mean[-1], spread[-1] = 0.0, 1.0
    model = Model(mean, spread, np.zeros(x.shape[1]), np.zeros((2, 2)))
    z = (x - mean) / spread
    lines = np.repeat(label, np.diff(first)).astype(float)
    n = max(len(lines), 1)
    inside = np.ones(len(lines), bool)
    inside[first[:-1]] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (lines[inside].astype(int), lines[inside].astype(int)), 1)
    flat = np.zeros(len(model.weights) + 4)
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    for t in range(1, rounds + 1):
        model.weights, model.step = flat[:-4], flat[-4:].reshape(2, 2)
        good, pairs = marginals(z @ model.weights, first, model.step)
        gradient = np.concatenate([z.T @ (good - lines) / n + ridge * model.weights, ((pairs - seen) / n + ridge * model.step).ravel()])
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        flat = flat - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    model.weights, model.step = flat[:-4], flat[-4:].reshape(2, 2)
    return model


def fit(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, lines: int = TRAIN_LINES) -> Model:
    """Learns from at most rows labelled documents outside the held-out fold: the field from whole texts of at most so many lines in all, the documents' weights from all."""
    sample = written(labelled_sample(documents, labels, "quality", FOLDS, HELD_FOLD, rows), "quality-sample")
    sizes = sample.select(F.xxhash64("text").alias("h"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n"))
    room, chosen = lines, []
    for r in sorted(map(tuple, sizes.collect())):  # as many rows as the sample has
        if r[1] <= min(room, lines // 10):
            room -= r[1]
            chosen.append((r[0],))
    some = sample.join(F.broadcast(documents.sparkSession.createDataFrame(chosen, "h long")), F.xxhash64("text") == F.col("h"), "left_semi")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, found = batch.column(1).to_pylist(), []
            for _, data, offsets in chunks(utf8(batch.column(0))):
                parsed = Lines(data, offsets)
                found += [parsed.features[a:b].tobytes() for a, b in zip(parsed.first[:-1].tolist(), parsed.first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(found, pa.binary())], names=["label", "x"])

    got = sorted((bytes(r.x), r.label) for r in some.mapInArrow(run, "label int, x binary").collect())
    if not got:
        width = Lines(b" ", np.array([0, 1])).features.shape[1]
        return Model(np.zeros(width), np.ones(width), np.zeros(width), np.zeros((2, 2)), logistic_fit(np.zeros((0, 3)), np.zeros(0)))
    width = 4 * Lines(b" ", np.array([0, 1])).features.shape[1]
    first = np.cumsum([0, *[len(a) // width for a, _ in got]])
    x = np.frombuffer(b"".join(a for a, _ in got), np.float32).reshape(first[-1], -1).astype(float)
    model = trained(x, first, np.array([c for _, c in got], float))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [np.zeros((0, 3))]
            for _, data, offsets in chunks(utf8(batch.column(0))):
                parsed = Lines(data, offsets)
                found.append(shared.value.documents(parsed.features, parsed.length, parsed.first))
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), *[pa.array(c) for c in np.concatenate(found).T]], names=["label", "a", "b", "c"])

    figures = np.array(sorted(tuple(r) for r in sample.mapInArrow(whole, "label int, a double, b double, c double").collect()), float)
    model.final = logistic_fit(figures[:, 1:], figures[:, 0], ridge=0.1)
    return model


def with_scores(documents: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD, lines: bool = False) -> DataFrame:
    """documents with score and predicted, and on request line_scores, the probability of good for each line.

    Null and empty texts are a single empty line. New columns replace documents' of their names; rows are scored one by one, whole, without a shuffle.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), *[T.StructField("line_scores", T.ArrayType(T.DoubleType()))] * lines]

    def make():
        m = shared.value

        def apply(column):
            score, each = np.zeros(len(column)), [None] * len(column)
            for start, data, offsets in chunks(utf8(column)):
                parsed = Lines(data, offsets)
                score[start : start + len(offsets) - 1] = logistic(m.documents(parsed.features, parsed.length, parsed.first), m.final)
                if lines:
                    good, _ = marginals(m.node(parsed.features), parsed.first, m.step)
                    for i, (a, b) in enumerate(zip(parsed.first[:-1], parsed.first[1:], strict=True)):
                        each[start + i] = good[a:b].tolist()
            return {"score": score, "predicted": (score >= threshold).astype(np.int32)} | ({"line_scores": each} if lines else {})

        return apply

    return columns_added(documents, [text_col], fields, make)


def quality(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Learned from labels outside the held-out fold alone; without labels all scores are alike."""
    out = with_scores(documents.select("doc_id", "text"), fit(documents, labels, rows))
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_FOLD).alias("held_out"), "score", "predicted")
