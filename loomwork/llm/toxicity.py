"""Toxic passages as maximum-scoring segments of token log-odds, with extreme-value significance."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.common import LOWER, columns_added, utf8
from loomwork.llm.training import held_out, labelled_sample, logistic, logistic_fit

#: Labelled documents to learn from, at most.
TRAIN_ROWS = 12_000
#: Token scores kept, those of the largest z, and as many of beginnings of tokens: bounds the model's size. TRAIN_ROWS documents have fewer with LEAST_Z.
MODEL_TERMS = 100_000
FOLDS, HELD_FOLD = 4, 2
THRESHOLD = 0.3
#: Letters of a token's beginning, which stand for tokens that are too rare to have a score.
PREFIX = 5
#: Weight of the Dirichlet prior, as a share of all tokens seen, spread over terms by their frequency in both classes.
PRIOR = 0.1
LEAST_Z, LEAST_SEEN = 2.7, 2
#: A segment is significant if fewer than this many as good are expected by chance in a text of its length.
LEAST_E = 1.0
#: Figures of a text: three of passages of either label.
FEATURES = 6

_SEPARATORS = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else 32 for b in LOWER)


def tokens(text: bytes) -> list[bytes]:
    """Runs of 0-9, a-z (A-Z in lower case) and what is beyond ASCII."""
    return text.translate(_SEPARATORS).split()


def segments(scores: Iterable[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score), in one pass (Ruzzo and Tompa's algorithm).

    Each candidate keeps the sum left of it and at its end. A new one joins those from the last candidate with a smaller left
    sum on, if that one's right sum is no larger than its own.
    """
    found: list[tuple[int, int, float, float]] = []
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        begin, left, right = i, before, total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= right:
                found.append((begin, i + 1, left, right))
                break
            begin, left = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, right - left) for a, b, left, right in found]


@dataclass
class Model:
    terms: dict[bytes, float]
    prefixes: dict[bytes, float]
    other: float
    decay: float = 1.0
    scale: float = 1.0
    weights: np.ndarray | None = None
    #: The same for label 0: passages that speak against label 1.
    against: Model | None = None

    def scores(self, words: list[bytes]) -> dict[int, float]:
        """Scores that differ from other, by place."""
        terms, prefixes, out = self.terms, self.prefixes, {}
        for i, w in enumerate(words):
            s = terms.get(w)
            if s is None:
                s = prefixes.get(w[:PREFIX])
            if s is not None:
                out[i] = s
        return out

    def passages(self, words: list[bytes]) -> list[tuple[int, int, float, float]]:
        """Maximal scoring segments (begin, end, score, expected number of as good ones by chance)."""
        own = self.scores(words)
        if not any(s > 0 for s in own.values()):
            return []
        known = sorted(own)
        # Between tokens with a score of their own all others count the same: one gap.
        line, places, last = [], [], 0
        for i in known:
            if i > last:
                line.append(self.other * (i - last))
                places.append(last)
            line.append(own[i])
            places.append(i)
            last = i + 1
        n = max(len(words), 1)
        return [(places[a], places[b - 1] + 1, s, self.scale * n * math.exp(-min(self.decay * s, 700))) for a, b, s in segments(line)]

    def features(self, words: list[bytes]) -> tuple[float, ...]:
        """What passages tell for label 1, and what others tell against it; zeros for a side that has no weight."""
        sides = (self, self.against)
        used = [self.weights is None or bool(self.weights[a : a + 3].any()) for a in (0, 3)]
        return tuple(x for side, use in zip(sides, used, strict=True) for x in (side.figures(words) if use and side else (0.0, 0.0, 0.0)))

    def figures(self, words: list[bytes]) -> tuple[float, float, float]:
        """Largest and summed normalised score of the significant passages, and their number per thousand tokens, as logarithms."""
        best = [(-math.log(max(e, 1e-300))) for _, _, _, e in self.passages(words) if e < LEAST_E]
        return (math.log1p(max(best, default=0.0)), math.log1p(sum(best)), math.log1p(1000 * len(best) / max(len(words), 50)))


def _counted(sample: DataFrame) -> DataFrame:
    """(term, label, seen): in how many different neighbourhoods of three tokens it stands, so that copies count little. Ends of a text have none."""
    schema = "term binary, label int, place long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomwork.llm.common import Words, byte_class, chunks

        for batch in batches:
            labels = batch.column(1).to_pylist()
            for start, data, offsets in chunks([x.translate(LOWER) for x in utf8(batch.column(0))]):
                w = Words(data, offsets, byte_class("plain"))
                around = np.zeros(len(w.hashes), np.int64)
                if len(around) > 2:
                    around[1:-1] = np.where(w.within(3), w.grams(3), np.uint64(0)).view(np.int64)
                own = [data[a:b] for a, b in zip(w.starts.tolist(), w.ends.tolist(), strict=True)]
                label = np.repeat([labels[start + i] for i in range(len(offsets) - 1)], np.diff(w.first))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array(label.astype(np.int32)), pa.array(around)], names=["term", "label", "place"])

    tokens_seen = sample.mapInArrow(run, schema).distinct().groupBy("term", "label").agg(F.count("*").alias("seen"))
    return tokens_seen


def fit(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, terms: int = MODEL_TERMS) -> Model:
    """Learns from at most rows labelled documents outside the held-out fold."""
    from loomwork.llm.common import written

    sample = written(labelled_sample(documents, labels, "toxic", FOLDS, HELD_FOLD, rows), "toxic-sample")
    counts = written(_counted(sample).groupBy("term").agg(F.sum(F.expr("if(label = 1, seen, 0)")).alias("t"), F.sum(F.expr("if(label = 1, 0, seen)")).alias("c")), "toxic-terms")
    total_t, total_c = (x or 0 for x in counts.agg(F.sum("t"), F.sum("c")).first())

    def scored(df: DataFrame) -> list:
        """Log-odds under Dirichlet priors, and their z."""
        prior = (F.col("t") + F.col("c")) * F.lit(PRIOR)
        odds = lambda k, total: F.log((F.col(k) + prior) / (F.lit(total + PRIOR * (total_t + total_c) + 1.0) - F.col(k) - prior))
        df = df.where(f"t + c >= {LEAST_SEEN}").withColumn("s", odds("t", total_t) - odds("c", total_c))
        df = df.withColumn("z", F.col("s") / F.sqrt(1 / (F.col("t") + prior) + 1 / (F.col("c") + prior)))
        return df.where(f"abs(z) >= {LEAST_Z}").orderBy(F.desc(F.abs("z")), "term").limit(terms).select("term", "s", "t", "c").collect()

    own = scored(counts)
    begins = scored(counts.groupBy(F.expr(f"substring(term, 1, {PREFIX})").alias("term")).agg(F.sum("t").alias("t"), F.sum("c").alias("c")))
    model = _side(own, begins, 1, total_t, total_c)
    model.against = _side(own, begins, -1, total_c, total_t)
    _calibrate(model, sample, own, total_t, total_c)
    return model


def _side(own: list, begins: list, sign: int, total: int, total_other: int) -> Model:
    """The scores for label 1, or for label 0 with sign -1; totals are of the label's tokens and of the others."""
    model = Model({bytes(r.term): sign * r.s for r in own}, {bytes(r.term): sign * r.s for r in begins if sign * r.s > 0}, 0.0)
    # What remains loses a little, so that a passage ends where the label's tokens get rare.
    seen, seen_other = (sum(getattr(r, k) for r in own) for k in ("tc" if sign > 0 else "ct"))
    rest, rest_other = max(total - seen, 0) + 1.0, max(total_other - seen_other, 0) + 1.0
    model.other = min(-0.05, math.log(rest / (total + 1.0)) - math.log(rest_other / (total_other + 1.0)))
    return model


def _calibrate(model: Model, sample: DataFrame, own: list, total_t: int, total_c: int) -> None:
    """decay: the positive root of E[exp(decay s)] = 1 over tokens of the other label; scale: from its segments; weights: from the texts' features."""
    for side, sign, kind, total in ((model, 1, "c", total_c), (model.against, -1, "t", total_t)):
        s = np.array([sign * r.s for r in own] + [side.other])
        p = np.array([r[kind] + PRIOR * (r.t + r.c) for r in own] + [max(total - sum(r[kind] for r in own), 1.0)], float)
        p /= p.sum()
        low, high = 1e-3, 20.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if np.log(p @ np.exp(np.clip(mid * s, -700, 700))) < 0 else (low, mid)
        side.decay = max(low, 1e-3)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(1).to_pylist()
            rows = [(y, len(w), max((p[2] for p in (model.against if y else model).passages(w)), default=0.0)) for y, w in zip(labels, map(tokens, utf8(batch.column(0))), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _, _ in rows], pa.int32()), pa.array([n for _, n, _ in rows], pa.int64()), pa.array([top for *_, top in rows], pa.float64())], names=["label", "n", "top"])

    others = np.array([tuple(r) for r in sample.mapInArrow(run, "label int, n long, top double").collect()], float).reshape(-1, 3)
    for side, label, total in ((model, 0, total_c), (model.against, 1, total_t)):
        clean = others[others[:, 0] == label][:, 1:]
        top = clean[clean[:, 1] > 0]
        # Of the other label's texts a share has a segment beyond the middle one of those found: the rate that fixes the scale.
        level = np.median(top[:, 1]) if len(top) >= 5 else math.log(max(total, 2)) / side.decay
        hits = max((top[:, 1] >= level).sum(), 0.5)
        side.scale = float(np.clip(hits / max(clean[:, 0].sum(), 1.0) * math.exp(min(side.decay * level, 700)), 1e-3, 1e3))

    def figures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.array([model.features(tokens(x)) for x in utf8(batch.column(0))], float).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array(f.tolist(), pa.list_(pa.float64()))], names=["label", "f"])

    rows = sample.mapInArrow(figures, "label int, f array<double>").collect()
    model.weights = _weights(np.array([r.f for r in rows], float).reshape(-1, FEATURES), np.array([r.label for r in rows], float))


def _weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the figures of either side or of both, whichever explains the labels best for its number (Bayesian information criterion), so that a side that tells nothing adds no noise."""
    best, least = np.zeros(FEATURES + 1), math.inf
    for own in ([0, 1, 2], [3, 4, 5], [*range(FEATURES)]):
        w = logistic_fit(x[:, own], y, ridge=0.05)
        p = np.clip(logistic(x[:, own], w), 1e-9, 1 - 1e-9)
        cost = -np.log(np.where(y > 0, p, 1 - p)).sum() + len(own) / 2 * math.log(max(len(y), 2))
        if cost < least:
            best, least = np.zeros(FEATURES + 1), cost
            best[[*own, FEATURES]] = w
    return best


PASSAGE = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())])


def with_scores(documents: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD, passages: bool = False) -> DataFrame:
    """documents with score and predicted, and on request every significant passage as token numbers (both included).

    Null and empty texts get the score of a text without passages. New columns replace documents' of their names; rows are
    scored one by one, whole, without a shuffle.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    fields += [T.StructField("passages", T.ArrayType(PASSAGE))] * passages

    def make():
        m = shared.value

        def apply(column):
            texts = utf8(column)
            f = np.array([m.features(tokens(x)) for x in texts], float).reshape(-1, FEATURES)
            score = logistic(f, m.weights)
            out = {"score": score, "predicted": (score >= threshold).astype(np.int32)}
            if passages:
                out["passages"] = [[{"first": a, "last": b - 1, "score": s, "expected": e} for a, b, s, e in m.passages(tokens(x)) if e < LEAST_E] for x in texts]
            return out

        return apply

    return columns_added(documents, [text_col], fields, make)


def toxicity(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, passages: bool = False) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Learned from labels outside the held-out fold alone; without labels of both kinds all scores are alike."""
    model = fit(documents, labels, rows)
    out = with_scores(documents.select("doc_id", "text"), model, passages=passages)
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_FOLD).alias("held_out"), "score", "predicted", *["passages"] * passages)


def without_toxic(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents that aren't predicted toxic, with the columns they had. Null and empty texts have no passages, so they stay; repeated rows are treated one by one; an empty table gives no rows."""
    model = fit(documents, labels, rows)
    return with_scores(documents.select(F.struct("*").alias("row"), "text"), model).where("predicted = 0").select("row.*")
