"""Language-model scoring: a log-bilinear model trained by noise-contrastive estimation in numpy.

Words fall into classes: each of the WORDS most frequent tokens is its own, all others go by a hash of
their last letters into ENDINGS classes. The model predicts the class of a token from the classes of the
two before it: logits = (r[c1] M1 + r[c2] M2) . r[c] + b[c], normalised over all classes by matrix
products. Within a class, P(w) = (c + 0.1) / (N_class + 0.1 (V_class + 1)), with one share for
unknown words, so token probabilities add up to 1. A text's score is the sum of log10 P over its tokens,
its end included.

Counts cover all training texts. Texts are numbered by units of about UNIT_WORDS words, each with its
own vocabulary; the units' vocabularies are counted and joined with the counts, not the texts. Training is
data-parallel: tasks run NCE over their training texts from shared parameters, which are averaged by the
number of tokens in two levels of groups; there are ROUNDS rounds, over different texts each.

Cases: null and empty texts are their end alone; a null id counts as the empty text for the crc32;
words of any length are whole tokens; repeated rows are counted and scored each; without training texts
every token has the same share of nothing known (log10 1) in the base, and classes are uniform; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vellum.llm.common import Scratch, id_crc, prepare, raw_texts

WORDS, ENDINGS = 960, 64
WIDTH = 24
NOISE = 64
BATCH = 4096
ROUNDS = 2
RATE = 0.1
UNIT_WORDS = 2_000_000
END = b""
#: A-Z as a-z.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Words between white space (ASCII), A-Z as a-z, and the end."""
    return [*text.translate(_LOWER).split(), END]


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def packed(ids: np.ndarray) -> bytes:
    """Numbers in three planes of bytes (the third is mostly 0 and compresses away); four where they are larger."""
    planes = 3 if not len(ids) or ids.max() < 1 << 24 else 4
    return bytes([planes]) + np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :planes].T).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<u4").ravel().astype(np.int64)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        out = self[word] = len(self)
        return out


def _numbered(documents: DataFrame) -> DataFrame:
    """Rows of texts (unit, doc_id, held_out, ids) and of words (unit, word, number, ending, n)."""
    kind = documents.schema["doc_id"].dataType
    names = ["unit", "doc_id", "held_out", "ids", "word", "number", "ending", "n"]
    types = [pa.int64(), to_arrow_type(kind), pa.bool_(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = TaskContext.get().partitionId() << 32
        numbers, counts, size = _Numbers(), np.zeros(0, np.int64), 0

        def vocabulary() -> Iterator[pa.RecordBatch]:
            all_words = list(numbers)
            for k in range(0, len(all_words), 50_000):
                part = all_words[k : k + 50_000]
                n, none = len(part), [None] * len(part)
                arrays = [[unit] * n, none, none, none, part, range(k, k + n), [ending(w) for w in part], counts[k : k + n]]
                yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, types, strict=True)], names=names)

        for batch in batches:
            held = batch.column("held_out").to_pylist()
            out = []
            for text, h in zip(raw_texts(batch), held, strict=True):
                w = tokens(text)
                ids = np.fromiter(map(numbers.__getitem__, w), dtype=np.int32, count=len(w))
                if len(numbers) > len(counts):
                    counts = np.concatenate((counts, np.zeros(2 * len(numbers) - len(counts), np.int64)))
                if not h:
                    np.add.at(counts, ids, 1)
                size += len(w)
                out.append(packed(ids))
            n = batch.num_rows
            none = [None] * n
            arrays = [[unit] * n, batch.column("doc_id"), batch.column("held_out"), out, none, none, none, none]
            yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, t) for a, t in zip(arrays, types, strict=True)], names=names)
            if size >= UNIT_WORDS:
                yield from vocabulary()
                unit, numbers, counts, size = unit + 1, _Numbers(), np.zeros(0, np.int64), 0
        if numbers:
            yield from vocabulary()

    picked = documents.select("doc_id", "text", (id_crc() % 10 == 0).alias("held_out"))
    return picked.mapInArrow(work, f"unit long, doc_id {kind.simpleString()}, held_out boolean, ids binary, word binary, number int, ending int, n long")


@dataclass
class Model:
    r: np.ndarray  # classes, and one for what is before a text
    m1: np.ndarray
    m2: np.ndarray
    b: np.ndarray
    log_noise: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.r, self.m1, self.m2, self.b]


def begin(counts: np.ndarray) -> Model:
    """Parameters at which the model is the distribution of classes by their counts."""
    rng = np.random.default_rng(3)
    n = len(counts)
    log_p = np.log((counts + 1.0) / (counts + 1.0).sum()).astype(np.float32)
    return Model(rng.normal(0, 0.1, (n + 1, WIDTH)).astype(np.float32), np.eye(WIDTH, dtype=np.float32) * 0.5, np.eye(WIDTH, dtype=np.float32) * 0.5, log_p.copy(), log_p)


def contexts(classes: list[np.ndarray], before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two classes before each token, and its own."""
    c1, c2 = [], []
    for c in classes:
        pad = np.concatenate(([before, before], c))
        c2.append(pad[:-2])
        c1.append(pad[1:-1])
    return (np.concatenate(c1), np.concatenate(c2), np.concatenate(classes)) if classes else (np.zeros(0, np.int64),) * 3


def _add_rows(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds rows to those of `to`; rows for one place are added up first."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    to[at[first]] += np.add.reduceat(rows[order], first, axis=0)


def train(model: Model, batches: Iterator[list[np.ndarray]], seed: int) -> int:
    """One pass of NCE over class sequences, with noise shared by a mini-batch; returns the tokens seen."""
    rng = np.random.default_rng(seed)
    n, before = len(model.b), len(model.b)
    cumulated = np.cumsum(np.exp(model.log_noise.astype(float)))
    squares = [np.full_like(a, 1e-3) for a in model.arrays()]
    seen = 0
    for classes in batches:
        c1, c2, c = contexts(classes, before)
        order = rng.permutation(len(c))
        seen += len(c)
        for k in range(0, len(c), BATCH):
            at = order[k : k + BATCH]
            i1, i2, i = c1[at], c2[at], c[at]
            noise = np.minimum(np.searchsorted(cumulated, rng.random(NOISE) * cumulated[-1]), n - 1)
            r1, r2, rt, rn = model.r[i1], model.r[i2], model.r[i], model.r[noise]
            q = r1 @ model.m1 + r2 @ model.m2
            log_k = np.float32(np.log(NOISE))
            data = 1 / (1 + np.exp(np.clip((q * rt).sum(1) + model.b[i] - model.log_noise[i] - log_k, -30, 30)))  # 1 - P(data)
            fake = -1 / (1 + np.exp(-np.clip(q @ rn.T + (model.b[noise] - model.log_noise[noise] - log_k)[None, :], -30, 30)))
            size = np.float32(len(at))
            g_q = (data[:, None] * rt + fake @ rn) / size
            g_r, g_b = np.zeros_like(model.r), np.zeros_like(model.b)
            _add_rows(g_r, np.concatenate((i, noise, i1, i2)), np.concatenate(((data[:, None] * q) / size, (fake.T @ q) / size, g_q @ model.m1.T, g_q @ model.m2.T)))
            np.add.at(g_b, i, data / size)
            np.add.at(g_b, noise, fake.sum(0) / size)
            for a, g, s in zip(model.arrays(), (g_r, r1.T @ g_q, r2.T @ g_q, g_b), squares, strict=True):
                s += g * g
                a += np.float32(RATE) * g / np.sqrt(s)
    return seen


class Scorer:
    """Normalised log probabilities of classes; normalisers are made for each pair of classes once."""

    def __init__(self, model: Model):
        self.s1, self.s2 = ((model.r @ m) @ model.r[:-1].T for m in (model.m1, model.m2))
        self.b, self.n = model.b, len(model.b)
        self.z = np.full((self.n + 1) ** 2, np.nan, np.float32)

    def log10(self, classes: list[np.ndarray]) -> np.ndarray:
        """The log10 probability of each sequence."""
        c1, c2, c = contexts(classes, self.n)
        pair = c1 * (self.n + 1) + c2
        new = np.unique(pair[np.isnan(self.z[pair])])
        for k in range(0, len(new), 2048):
            a, b = np.divmod(new[k : k + 2048], self.n + 1)
            logits = self.s1[a] + self.s2[b] + self.b
            top = logits.max(1)
            self.z[new[k : k + 2048]] = top + np.log(np.exp(logits - top[:, None]).sum(1))
        value = (self.s1[c1, c] + self.s2[c2, c] + self.b[c] - self.z[pair]).astype(float)
        starts = np.cumsum([0] + [len(x) for x in classes[:-1]])
        return np.add.reduceat(value, starts) / np.log(10) if classes else np.zeros(0)


def _classes(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype="<u2").astype(np.int64) for b in batch.column("classes").to_pylist()]


def _mean(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted sums of parameter vectors."""
    total, n = None, 0.0
    for batch in batches:
        for m, raw in zip(batch.column("n").to_pylist(), batch.column("parameters").to_pylist(), strict=True):
            part = np.frombuffer(raw, dtype="<f4").astype(float) * m
            total, n = part if total is None else total + part, n + m
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([(total / max(n, 1)).astype("<f4").tobytes()], pa.binary())], names=["n", "parameters"])


def fit(rows: DataFrame, counts: np.ndarray, rounds: int = ROUNDS) -> Model:
    """The model from rows (doc_id, held_out, classes)."""
    spark = rows.sparkSession
    model = begin(counts)
    for k in range(rounds):
        held = spark.sparkContext.broadcast(model)

        def work(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            own = held.value
            own = Model(*(a.copy() for a in own.arrays()), own.log_noise)
            seen = train(own, (_classes(b) for b in batches), TaskContext.get().partitionId())
            if seen:
                flat = np.concatenate([a.ravel() for a in own.arrays()])
                yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), pa.array([flat.astype("<f4").tobytes()], pa.binary())], names=["n", "parameters"])

        part = rows.where(~F.col("held_out") & (F.pmod(F.xxhash64("classes"), F.lit(rounds)) == k))
        out = part.select("classes").mapInArrow(work, "n double, parameters binary")
        for salts in (64, 1):
            out = out.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))).groupBy("salt").applyInArrow(_mean, "n double, parameters binary")
        got = out.collect()  # one row
        if got:
            flat, at = np.frombuffer(got[0].parameters, dtype="<f4"), 0
            for a in model.arrays():
                a[...] = flat[at : at + a.size].reshape(a.shape)
                at += a.size
    return model


def score_documents(documents: DataFrame, words: int = WORDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = prepare(documents.sparkSession)
    scratch = Scratch(spark, "lm")
    kind = documents.schema["doc_id"].dataType
    numbered = scratch.save(_numbered(documents))
    vocabulary = numbered.where("word is not null")
    counts = scratch.save(vocabulary.groupBy("word").agg(F.sum("n").alias("c"), F.first("ending").alias("ending")))
    total, known = counts.where("c > 0").select(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequent = counts.where("c > 0").orderBy(F.desc("c"), "word").limit(words).select("word", "c").collect()
    top = spark.createDataFrame([(bytearray(r.word), k) for k, r in enumerate(frequent)], "word binary, top int")
    n_top = len(frequent)
    classed = counts.join(F.broadcast(top), "word", "left").select("word", "c", F.coalesce("top", F.col("ending") + n_top).alias("class"))  # WORDS rows
    n_classes = n_top + ENDINGS
    of_class = np.zeros(n_classes)
    types = np.zeros(n_classes)
    for r in classed.where("c > 0").groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        of_class[r["class"]], types[r["class"]] = r.c, r.v
    looked = scratch.save(vocabulary.select("unit", "word", "number").join(classed, "word").select("unit", "number", "c", "class"))
    scratch.drop(counts)
    log_rest = np.log10(of_class + 0.1 * (types + 1))
    log_all = float(np.log10(total + 0.1 * (known + 1)))

    def number(texts: pa.Table, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("number").to_numpy())
        c, k = table.column("c").to_numpy()[order], table.column("class").to_numpy()[order]
        log_c = np.log10(c + 0.1)
        inside = np.where(k < n_top, 0.0, log_c - log_rest[k])
        n_tokens, n_known, base, within, classes = [], [], [], [], []
        for raw in texts.column("ids").to_pylist():
            ids = unpacked(raw)
            n_tokens.append(len(ids))
            n_known.append(int((c[ids] > 0).sum()))
            base.append(float(log_c[ids].sum() - log_all * len(ids)))
            within.append(float(inside[ids].sum()))
            classes.append(k[ids].astype("<u2").tobytes())
        return pa.table({"doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "base_score": pa.array(base, pa.float64()), "within": pa.array(within, pa.float64()), "classes": pa.array(classes, pa.binary())})

    texts = numbered.where("word is null").select("unit", "doc_id", "held_out", "ids")
    schema = f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, within double, classes binary"
    rows = scratch.save(texts.groupBy("unit").cogroup(looked.groupBy("unit")).applyInArrow(number, schema))
    scratch.drop(numbered, looked)
    held = spark.sparkContext.broadcast(fit(rows, of_class, rounds))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            score = scorer.log10(_classes(batch)) + batch.column("within").to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    out = rows.mapInArrow(work, f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")


def report(documents: DataFrame) -> DataFrame:
    return score_documents(documents.select("doc_id", "text"))
