"""Quality classifier: cumulative-link (proportional odds) regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut
the score into grades: P(grade >= k) = sigmoid(score - threshold[k]).  A document's expected
grade is the sum of these tail probabilities, and selection asks for one of them.

Features of a text, hashed into 2**BITS weights: its words (A-Z lower-cased), the first four
bytes of each word, and its style (shares of repeated words, of words that end in a symbol,
of bytes that aren't letters, and mean word length, each in steps).  Counts are damped by
a logarithm and not scaled by length, so that a single telling word counts in a long text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, id_and_text, mix64, short_batches, small

BITS = 18
GRADES = 3
#: The most labelled documents the model is fitted on (a hash of doc_id picks them).
TRAIN_ROWS = 12_000
EPOCHS, BATCH, RATE, DECAY = 16, 64, 0.15, 1e-6
#: A document is kept if its grade is the top one with at least this probability.
KEEP_AT = 0.5
STYLES = 4
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(128, 256), 0x20]] = True


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CSR rows (first, feature, value): each text's distinct features, sorted."""
    words = Words(texts, lower=True)
    n = len(words.first) - 1
    count = np.diff(words.first)
    row = np.repeat(np.arange(n), count)
    mask = np.uint64((1 << BITS) - 1)
    size = words.end - words.start
    at = words.start[:, None] + np.arange(4)
    lead = np.where(np.arange(4) < size[:, None], words.buf[np.minimum(at, max(len(words.buf) - 1, 0))] | np.uint8(0x20), 0) if len(row) else np.zeros((0, 4), np.uint8)
    head = mix64(np.ascontiguousarray(lead.astype(np.uint8)).view(np.uint32).ravel().astype(np.uint64) + np.uint64(1 << 40))
    key = np.concatenate([row.astype(np.uint64) << np.uint64(BITS) | words.hash & mask, row.astype(np.uint64) << np.uint64(BITS) | head & mask])
    key, times = np.unique(key, return_counts=True)
    of = (key >> np.uint64(BITS)).astype(np.int64)
    value = 0.2 * np.log1p(times)
    # style: one feature a text and measure
    first_seen = np.bincount(of, minlength=n) / 2
    letters = np.concatenate([[0], np.cumsum(_LETTER[words.buf])])
    ends = np.concatenate([[0], np.cumsum(~_LETTER[words.buf[words.end - 1]])]) if len(row) else np.zeros(1, np.int64)
    begin = np.concatenate([words.start, [len(words.buf)]])[np.minimum(words.first[:-1], len(words.start))]
    stop = np.where(count > 0, np.concatenate([[0], words.end])[words.first[1:]], begin)
    length = np.maximum(stop - begin, 1)
    safe = np.maximum(count, 1)
    measures = [1 - first_seen / safe, (ends[words.first[1:]] - ends[words.first[:-1]]) / safe, 1 - (letters[stop] - letters[begin]) / length, np.minimum(length / safe / 20, 1)]
    step = np.stack([np.clip((m * 20).astype(np.int64), 0, 20) + 21 * i for i, m in enumerate(measures)], axis=1)
    style = (mix64(step.astype(np.uint64).ravel() + np.uint64(1 << 50)) & mask) | np.repeat(np.arange(n, dtype=np.uint64), STYLES) << np.uint64(BITS)
    key, value = np.concatenate([key, style]), np.concatenate([value, np.full(len(style), 0.5)])
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    return np.searchsorted(key >> np.uint64(BITS), np.arange(n + 1, dtype=np.uint64)), (key & mask).astype(np.uint32), value.astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, first: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.weights[feature].astype(np.float64) * value)])
        return sums[first[1:]] - sums[first[:-1]]

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. GRADES - 1, one row a text."""
        return _sigmoid(scores[:, None] - self.thresholds)


def fit(first: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int = GRADES, epochs: int = EPOCHS) -> Model:
    """Likelihood ascent by AdaGrad on small batches; thresholds stay ordered as a start and positive gaps."""
    model = Model(np.zeros(1 << BITS, np.float32), np.zeros(grades - 1))
    if not len(grade):
        model.thresholds = np.arange(grades - 1) - 30.0  # nothing is known: every grade's tail is 1
        return model
    share = [np.clip(np.mean(grade >= k), 0.01, 0.99) for k in range(1, grades)]
    start, gaps = -np.log(share[0] / (1 - share[0])), np.maximum(-np.diff(np.log(np.array(share) / (1 - np.array(share)))), 0.1)
    past, past_cut = np.full(1 << BITS, 1e-3, np.float32), np.full(grades - 1, 1e-3)
    log_gaps, random = np.log(gaps), np.random.default_rng(7)
    for _ in range(epochs):
        order = random.permutation(len(grade))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            count = first[rows + 1] - first[rows]
            place = np.repeat(first[rows] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            index, x, of = feature[place], value[place], np.repeat(np.arange(len(rows)), count)
            cuts = np.cumsum([start, *np.exp(log_gaps)])
            score = np.bincount(of, model.weights[index] * x, minlength=len(rows))
            y = grade[rows]
            edge = np.concatenate([[-np.inf], cuts, [np.inf]])
            low, high = _sigmoid(score - edge[y]), _sigmoid(score - edge[y + 1])  # P(>= y), P(>= y + 1)
            chance = np.maximum(low - high, 1e-9)
            dlow, dhigh = low * (1 - low) / chance, high * (1 - high) / chance
            slope = dlow - dhigh
            g = np.bincount(index, slope[of] * x, minlength=1 << BITS).astype(np.float32) / len(rows) - DECAY * model.weights
            past += g * g
            model.weights += RATE * g / np.sqrt(past)
            dcut = np.array([dhigh[y == k - 1].sum() - dlow[y == k].sum() for k in range(1, grades)]) / len(rows)
            tail = np.cumsum(dcut[::-1])[::-1]
            step = np.concatenate([[tail[0]], tail[1:] * np.exp(log_gaps)])
            past_cut += step * step
            step = RATE * step / np.sqrt(past_cut)
            start, log_gaps = start + step[0], log_gaps + step[1:]
    model.thresholds = np.cumsum([start, *np.exp(log_gaps)])
    return model


def graded(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ratings as grades: 0 toxic, 1 poor, 2 good.  The lowest of a document's ratings holds; rows without one don't count."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality").isNotNull(), 1 + (F.col("quality") > 0).cast("int"))
    rated = labels.select(F.col(id_col).cast("long").alias("doc_id"), grade.cast("int").alias("grade"))
    return rated.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(df: DataFrame, grades: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_ROWS) -> Model:
    """Fit on at most `most` documents of grades (doc_id, grade from 0), picked by a hash of doc_id."""
    short_batches(df.sparkSession)
    picked = grades.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(most)
    rows = id_and_text(df, id_col, text_col).join(F.broadcast(picked), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            first, feature, value = features(batch["text"])
            spans = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["grade"], pa.array([feature[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([value[a:b].tobytes() for a, b in spans], pa.binary())], names=["doc_id", "grade", "feature", "value"])

    found = rows.select("doc_id", "grade", "text").mapInArrow(run, "doc_id long, grade int, feature binary, value binary").toArrow()
    found = found.sort_by([("doc_id", "ascending"), ("feature", "ascending")]) if len(found) else found
    feature = np.frombuffer(b"".join(found["feature"].to_pylist()), np.uint32)
    value = np.frombuffer(b"".join(found["value"].to_pylist()), np.float32)
    first = np.cumsum([0, *(len(x) // 4 for x in found["feature"].to_pylist())])
    return fit(first, feature, value, found["grade"].to_numpy().astype(np.int64))


SCORES = "doc_id long, score double, p_good double, p_not_toxic double, expected_grade double, keep boolean"


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """One row per row of df: score, tail probabilities, expected grade and the decision.

    A null or empty text has only style features and gets the score these give it.
    """
    spark = df.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = shared.value.scores(*features(batch["text"]))
            tails = shared.value.tails(found)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found), pa.array(tails[:, -1]), pa.array(tails[:, 0]), pa.array(tails.sum(1)), pa.array(tails[:, -1] >= keep_at)], names=["doc_id", "score", "p_good", "p_not_toxic", "expected_grade", "keep"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, SCORES)


def select(df: DataFrame, model: Model, text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of df, with all their columns, whose text is kept."""
    spark = df.sparkSession
    short_batches(spark)
    shared, at = spark.sparkContext.broadcast(model), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, text_col):
            tails = shared.value.tails(shared.value.scores(*features(batch.column(at))))
            yield batch.filter(pa.array(tails[:, -1] >= keep_at))

    return df.mapInArrow(run, df.schema)
