"""Toxicity by class-conditional Kneser-Ney models.

There is a model of each class, toxic and ordinary, over the words of labelled texts. As in Kneser-Ney smoothing a
word counts by how many different words it follows. A word is reached by its beginnings of 4, 5 and 6 bytes:
P(word) = P(first beginning) * P(next | first) * ... * P(word | last), and each of these is a discounted share of the
class's counts and, by what the discount sets free, the share in both classes together. So a rare expression is
smoothed through counts that the classes share, and one that was never read speaks by its beginning. In the
shared counts, what is set free goes evenly to all that is known to follow and to one unknown event, so the
probabilities add up to 1. Discounts are n1 / (n1 + 2 n2) for each class and length.

A text is compared by the difference of the two log likelihoods, normalised by length: over the whole text, and over
those of its stretches of 1, 4 and 16 words where it is largest, as an insult in a long text is. The score is a
logistic curve over these, fitted on labelled texts that the counts have not seen.

Counts come from at most SAMPLE labelled texts of each class, those with the smallest hashes of
their ids, and the curve from as many others; all counts of this sample are kept, so the sample bounds the model,
which is broadcast. All texts are scored whole.

Cases: null and empty texts have a difference of 0 and get the curve's value there; ids that are labelled
twice are toxic if any label says so; null labels are passed over; without labelled texts of both
classes every score is the toxic share of the labels (0 without any); repeated rows are each scored;
other columns pass through whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import Scratch, append_columns, fold_words, id_crc, only, prepare, raw_texts, shielded

SAMPLE = 4000
BEGINNINGS = (4, 5, 6)
STRETCHES = (1, 4, 16)
START = b""


def path(word: bytes) -> list[bytes]:
    """Keys of a word's beginnings, which are no words, and the word itself."""
    return [*(b"\0" + word[:k] for k in BEGINNINGS if len(word) >= k), word]


class Vocabulary(dict):
    """Numbers of words; an unknown word has that of its longest known beginning, or 0.

    The known ones come first, in one dict with the unknown words that were met: a worker holds no second one.
    """

    def __init__(self, known: dict[bytes, int]):
        super().__init__(known)
        self.size = len(known)

    @property
    def known(self) -> dict[bytes, int]:
        return dict(islice(self.items(), self.size))

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.size + 500_000:
            while len(self) > self.size:
                self.popitem()
        #: Beginnings hold a zero byte and so are never words that were met.
        at = self[word] = next((self[k] for k in reversed(path(word)[:-1]) if k in self), 0)
        return at

    def __reduce__(self):
        return Vocabulary, (self.known,)


def discount(counts: np.ndarray) -> float:
    """n1 / (n1 + 2 n2): what is taken off each count; a half where none is 1."""
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return one / (one + 2 * two) if one else 0.5


@dataclass
class Model:
    vocabulary: Vocabulary  # 0 is the root: all that is unknown
    words: np.ndarray  # log P of each known word, and of an unknown word of each beginning; a row for each class
    curve: np.ndarray
    prior: float

    def differences(self, docs: list[bytes]) -> np.ndarray:
        """Of each text the difference of the classes' log likelihoods a word: in all, and in its stretches where it is largest."""
        only("toxicity")
        out, get = np.zeros((len(docs), 1 + len(STRETCHES))), self.vocabulary.__getitem__
        for d, text in enumerate(docs):
            w = fold_words(text)
            if w:
                toxic, ordinary = self.words[:, np.fromiter(map(get, w), dtype=np.int64, count=len(w))]
                sums = np.concatenate(([0.0], np.cumsum(toxic - ordinary)))
                out[d] = [sums[-1] / len(w), *((sums[k:] - sums[:-k]).max() / k for k in (min(len(w), n) for n in STRETCHES))]
        return out

    def scores(self, docs: list[bytes]) -> np.ndarray:
        if not self.curve.any():
            return np.full(len(docs), self.prior)
        return 1 / (1 + np.exp(-np.clip(_features(self.differences(docs)) @ self.curve, -30, 30)))


def _features(differences: np.ndarray) -> np.ndarray:
    return np.column_stack((10 * differences[:, :1], differences[:, 1:], np.ones(len(differences))))


def models(words: list[bytes], counts: list[np.ndarray]) -> Model:
    """Both classes' models from the words' counts in the ordinary and the toxic class, without a curve."""
    number: dict[bytes, int] = {START: 0}
    parent, depth, leaf = [0], [0], np.empty(len(words), np.int64)
    for k, word in enumerate(words):
        at = 0
        for level, key in enumerate(path(word), 1):
            if (new := number.get(key)) is None:
                new = number[key] = len(parent)
                parent.append(at)
                depth.append(level)
            at = new
        leaf[k] = at
    above, level, size = np.array(parent), np.array(depth), len(parent)
    n = np.zeros((3, size))
    n[0, leaf], n[1, leaf] = counts
    for deep in range(level.max(), 0, -1):
        at = np.flatnonzero(level == deep)
        for c in (0, 1):
            n[c] += np.bincount(above[at], weights=n[c, at], minlength=size)
    n[2] = n[0] + n[1]
    kinds = np.array([np.bincount(above[1:], weights=n[c, 1:] > 0, minlength=size) for c in range(3)])
    #: Of each node given its parent, and of something unknown below it: first in both classes, then in each.
    d = np.zeros((3, size))
    for deep in range(1, level.max() + 1):
        at = level == deep
        d[:, at] = np.array([discount(n[c, at]) for c in range(3)])[:, None]
    free = np.array([np.bincount(above[1:], weights=d[c, 1:] * (n[c, 1:] > 0), minlength=size) for c in range(3)]) / np.maximum(n, 1)
    own = np.maximum(n - d, 0) / np.maximum(n[:, above], 1)
    even = free[2] / (kinds[2] + 1)
    shared, unknown = own[2] + even[above], np.where(n[2] > 0, even, 1.0)
    log = np.zeros((2, size))
    left = np.where(n > 0, free, 1.0)
    with np.errstate(divide="ignore"):  # of the root, where there are no words
        step = np.log(own[:2] + left[:2][:, above] * shared)
    for deep in range(1, level.max() + 1):
        at = np.flatnonzero(level == deep)
        log[:, at] = log[:, above[at]] + step[:, at]
    inner = kinds[2] > 0
    inner[0] = True
    with np.errstate(divide="ignore"):
        log = np.where(inner, log + np.log(left[:2] * unknown), log)
    return Model(Vocabulary(number), log[::-1], np.zeros(2 + len(STRETCHES)), 0.0)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method; weights sum to the number of rows."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (y - p)) - ridge * len(y) * b * np.array([1] * (x.shape[1] - 1) + [0])
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b


def _sample(documents: DataFrame, marks: DataFrame, size: int) -> DataFrame:
    """text and toxic of the documents of at most `size` labelled ids of each class, by the smallest hashes of their ids."""
    chosen = [marks.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size) for c in (0, 1)]
    ids = chosen[0].unionAll(chosen[1])
    #: At most 2 * size ids.
    return documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(raw_texts(batch), batch.column("toxic").to_pylist(), strict=True):
            w = fold_words(text)
            counts[toxic].update(zip([START, *w], w, strict=False))
    for c in (0, 1):
        items = list(counts[c].items())
        for k in range(0, len(items), 50_000):
            part = items[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([p[0][0] for p in part], pa.binary()), pa.array([p[0][1] for p in part], pa.binary()), pa.array([c] * len(part), pa.int32()), pa.array([p[1] for p in part], pa.int64())], names=["v", "w", "toxic", "n"])


def fit(documents: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    """The model from labelled documents outside the held-out fifth (crc32 of the id, modulo 5, is 0)."""
    spark = prepare(documents.sparkSession)
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.withColumn("fold", id_crc() % 5).where("fold <> 0")
    n = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    prior = n.get(1, 0) / max(1, sum(n.values()))
    scratch = Scratch(spark, "toxicity")
    sides = [F.count_if(F.col("toxic") == c).alias(f"n{c}") for c in (0, 1)]
    pairs = _sample(documents, marks.where("fold <> 4"), size).mapInArrow(_count, "v binary, w binary, toxic int, n long").select("v", "w", "toxic").distinct()
    table = scratch.save(pairs.groupBy("w").agg(*sides)).orderBy("w").toArrow()  # the words of 2 * size texts
    model = models(table.column("w").to_pylist(), [table.column(c).to_numpy() for c in ("n0", "n1")])
    model.prior = prior
    scratch.clear()
    if not all(table.column(c).to_numpy().any() for c in ("n0", "n1")):
        return model
    del table
    held = spark.sparkContext.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            yield [held.value.differences(raw_texts(batch)).tolist()]

    rest = append_columns(_sample(documents, marks.where("fold = 4"), size), [("differences", T.ArrayType(T.DoubleType()))], measured).orderBy("doc_id").select("toxic", "differences").collect()
    y = np.array([r.toxic for r in rest], dtype=float)
    if 0 < y.sum() < len(y):
        share = y.mean()
        weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
        model.curve = _logistic(_features(np.array([r.differences for r in rest])), y, weight)
    return model


def score(documents: DataFrame, model: Model) -> DataFrame:
    """documents with tox_score, 0 to 1, in the place of a column of that name."""
    held = prepare(documents.sparkSession).sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            yield [pa.array(held.value.scores(raw_texts(batch)))]

    return append_columns(documents, [("tox_score", T.DoubleType())], work, replace=True)


def drop_toxic(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    return shielded(documents, lambda d: score(d, model).where(F.col("tox_score") < threshold))


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's score, the verdict at 0.5, and whether its label was kept from the model."""
    documents = documents.select("doc_id", "text")
    out = score(documents, fit(documents, labels))
    return out.select("doc_id", (id_crc() % 5 == 0).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"))
