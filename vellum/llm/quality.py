"""Quality by ordinal regression: a cumulative-link model over hashed text.

Grades run from 0 to K - 1. One vector of weights serves all grades; K - 1 ascending thresholds cut the
scale: P(grade > j) = 1 / (1 + exp(theta_j - w . x)). x holds counts of words, of their outlines (letters
a, digits 9, marks as they are) and of pairs of outlines, hashed into FEATURES, as shares of the text's
words, under a square root, and a few shape figures. The expected grade is the sum of the K - 1 tail
probabilities; selection takes a tail probability.

Ratings are graded 2 for good, 1 for good but toxic, 0 for bad texts, from labels.quality and
labels.toxic. The model is fitted on at most SAMPLE rated texts, those with the smallest hashes of their
ids, and the texts of a fifth of all ids (crc32 modulo 5 is 0) never enter. All texts are scored whole.

Cases: null and empty texts are scored by the shape figures of no words; ids rated twice take their
lowest rating; null ratings are passed over; without ratings of two grades every text gets the
grade that there is (the highest without any); repeated rows are each scored; other columns pass through
whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import append_columns, id_crc, prepare, shielded, texts

FEATURES = 1 << 16
SAMPLE = 6000
GRADES = 3
_SHAPES = 6
_RUN = re.compile(r"(.)\1+")


def _outline(word: str) -> str:
    return _RUN.sub(r"\1", "".join("a" if c.isalpha() else "9" if c.isdigit() else c for c in word))


class _Slots(dict):
    """Of a word: the slots of itself and of its outline."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) > 300_000:
            self.clear()
        out = zlib.crc32(b"w" + word.lower().encode()) % FEATURES, zlib.crc32(b"o" + _outline(word).encode()) % FEATURES
        if len(word) < 60:
            self[word] = out
        return out


_slots = _Slots()


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text's features; the last slots are the shape figures."""
    words = text.split()
    n = len(words)
    pairs = np.array([_slots[w] for w in words], dtype=np.int64).reshape(n, 2)
    two = (pairs[:-1, 1] * 31 + pairs[1:, 1] * 17 + 1) % FEATURES
    count = np.bincount(np.concatenate((pairs.ravel(), two)), minlength=0)
    slot = np.flatnonzero(count)
    value = np.sqrt(count[slot] / max(n, 1))
    lines = text.count("\n") + 1
    shape = [n == 0, np.log1p(n) / 10, n / lines / 100, len(set(words)) / max(n, 1), len(text) / max(n, 1) / 10, sum(map(text.count, "|{}<>=")) / max(len(text), 1) * 10]
    return np.concatenate((slot, np.arange(FEATURES, FEATURES + _SHAPES))), np.concatenate((value, np.minimum(shape, 5.0)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending; infinite ones stand for what was never rated

    def tails(self, batch: list[str]) -> np.ndarray:
        """P(grade > j) of each text, a column for each j."""
        z = np.array([self.weights[s] @ v for s, v in map(features, batch)]).reshape(-1, 1)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int = GRADES, epochs: int = 30, rate: float = 0.3, ridge: float = 1e-5) -> Model:
    """Maximum likelihood by Adagrad; thresholds stay in order, as a first one and positive steps."""
    rng = np.random.default_rng(5)
    w, sq = np.zeros(FEATURES + _SHAPES), np.full(FEATURES + _SHAPES, 1e-2)
    share = [np.clip((grades > j).mean(), 1e-3, 1 - 1e-3) for j in range(levels - 1)]
    cut = -np.log(np.array(share) / (1 - np.array(share)))
    step = np.log(np.maximum(np.diff(cut), 1e-2))
    first, top_sq = cut[0], np.full(levels - 1, 1e-1)
    order = np.arange(len(rows))
    for _ in range(epochs):
        rng.shuffle(order)
        for part in np.array_split(order, max(1, len(order) // 32)):
            slot = np.concatenate([rows[i][0] for i in part])
            value = np.concatenate([rows[i][1] for i in part])
            row = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            z = np.bincount(row, weights=w[slot] * value, minlength=len(part))
            theta = first + np.concatenate(([0], np.cumsum(np.exp(step))))
            y = grades[part]
            edge = np.concatenate(([-np.inf], theta, [np.inf]))
            low, high = (1 / (1 + np.exp(-np.clip(edge[y + k] - z, -30, 30))) for k in (0, 1))
            low, high = np.where(y == 0, 0.0, low), np.where(y == levels - 1, 1.0, high)
            p = np.maximum(high - low, 1e-9)
            d_low, d_high = low * (1 - low) / p, high * (1 - high) / p
            g_z = d_high - d_low  # of the negative log likelihood
            g = np.zeros_like(w)
            np.add.at(g, slot, g_z[row] * value)
            g = g / len(part) + ridge * w
            sq += g * g
            w -= rate * g / np.sqrt(sq)
            g_t = np.array([(d_low[y == j + 1].sum() - d_high[y == j].sum()) for j in range(levels - 1)]) / len(part)
            g_u = np.concatenate(([g_t.sum()], [g_t[k + 1 :].sum() * np.exp(step[k]) for k in range(levels - 2)]))
            top_sq += g_u * g_u
            move = rate * g_u / np.sqrt(top_sq)
            first -= move[0]
            step -= move[1:]
    return Model(w, first + np.concatenate(([0], np.cumsum(np.exp(step)))))


def ratings(labels: DataFrame) -> DataFrame:
    """doc_id and grade."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("grade")).where("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))


def fit(documents: DataFrame, rated: DataFrame, size: int = SAMPLE, levels: int = GRADES) -> Model:
    """The model from rated (doc_id, grade) documents that aren't held out."""
    spark = prepare(documents.sparkSession)
    chosen = rated.where(id_crc() % 5 != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    found = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `size` ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            made = [features(t) for t in texts(batch)]
            yield [[s.astype("<i4").tobytes() for s, _ in made], [v.astype("<f4").tobytes() for _, v in made]]

    rows = append_columns(found, [("slots", T.BinaryType()), ("values", T.BinaryType())], work).select("grade", "doc_id", "slots", "values").orderBy("doc_id").collect()
    grades = np.array([r.grade for r in rows], dtype=np.int64)
    if len(set(grades.tolist())) < 2:
        only = int(grades[0]) if len(grades) else levels - 1
        return Model(np.zeros(FEATURES + _SHAPES), np.array([-30.0 if j < only else 30.0 for j in range(levels - 1)]))
    return train([(np.frombuffer(r.slots, "<i4").astype(np.int64), np.frombuffer(r["values"], "<f4").astype(float)) for r in rows], grades, levels)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """documents with quality_grade (expected) and quality_tails (P(grade > j), from j = 0), in the place of columns of these names."""
    held = prepare(documents.sparkSession).sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            tails = held.value.tails(texts(batch))
            yield [pa.array(tails.sum(axis=1)), tails.tolist()]

    return append_columns(documents, [("quality_grade", T.DoubleType()), ("quality_tails", T.ArrayType(T.DoubleType()))], work, replace=True)


def select_good(documents: DataFrame, model: Model, above: int = 0, threshold: float = 0.5) -> DataFrame:
    """Documents whose grade is above `above` with a probability of at least the threshold."""
    return shielded(documents, lambda d: score(d, model).where(F.get("quality_tails", F.lit(above)) >= threshold))


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's expected grade, tail probabilities, and whether it is kept as good text."""
    documents = documents.select("doc_id", "text")
    out = score(documents, fit(documents, ratings(labels)))
    tail = [F.get("quality_tails", F.lit(j)) for j in range(GRADES - 1)]
    return out.select("doc_id", (id_crc() % 5 == 0).alias("held_out"), F.col("quality_grade").alias("expected_grade"), tail[0].alias("p_at_least_1"), tail[1].alias("p_at_least_2"), (tail[0] >= 0.5).alias("keep"))
