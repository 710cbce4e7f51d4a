"""Lexical retrieval packing: windows filled with the BM25 neighbours of a seed document.

Documents become token ids, each ended by END. Whole windows of a long document are sequences by
themselves and have no neighbours; what is left of every document, less than a window, is a piece to be packed.

The inverted index, with BM25 weights (document frequencies and lengths over all pieces), is sharded by what it
retrieves by: pieces are ordered by their rarest ids that other pieces have too, rarest first, and consecutive
SHARD_PIECES of them are a shard. So those that share what weighs most in BM25, near copies first of all, stand in one
shard, and the time grows in proportion to the input. A seed is a shard's first unused piece; all of its
different ids are the query, and the unused pieces of its shard fill its window by rank while they fit. Where none
fits any more, the best one is cut. So all windows of a shard but its last are full.

Texts are tokenized once into a written table.

Cases: null and empty texts are END alone; texts of any length are tokenized whole; the vocabulary's special token in
a text is its one id, as the tokenizers library has it; repeated rows are packed each; pieces of equal keys stand in
the order of their rows, so a group of copies fills many shards; ties of rank go to the earlier piece; pieces
without common terms score 0 and are packed too; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import Scratch, append_columns, kept, prepare, texts

WINDOW = 1024
END = 0
RANKS = "byte_bpe_50k.tiktoken"
#: The vocabulary's added token, and its id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Pieces of a shard; shards that one task fills, one after another.
SHARD_PIECES, TASK_SHARDS = 1000, 12
#: Rare ids of a piece that place it, and seeds scored at once.
KEY_IDS, QUERIES = 6, 64
K1, B = 1.2, 0.75
#: Words whose ids a worker remembers.
REMEMBERED = 600_000


class Encoder:
    """Byte-level BPE, as the tokenizers library does it with the same vocabulary, with a memory for words.

    Where every gap between words is one space or one line feed, no token spans two words, so a
    text's ids are those of its words, each with the space before it. Other texts are encoded whole.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.spaced, self.bare = _Memory(self.encode, " "), _Memory(self.encode, "")
        self.feed = self.bare["\n"]

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 16-bit ids."""
        if SPECIAL in text:
            return np.array([SPECIAL_ID], dtype="<u2").tobytes().join(map(self.ids, text.split(SPECIAL)))
        if not text:
            return b""
        words = text.split()
        gaps = len(words) - 1
        if gaps < 0 or sum(map(len, words)) + gaps != len(text) or text.count(" ") + text.count("\n") != gaps:
            return np.array(self.encode(text), dtype="<u2").tobytes()
        lines = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            lines.append(self.bare[first] + b"".join(map(self.spaced.__getitem__, rest)))
        return self.feed.join(lines)


class _Memory(dict):
    def __init__(self, encode, prefix: str):
        super().__init__()
        self.encode, self.prefix = encode, prefix

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        out = np.array(self.encode(self.prefix + word), dtype="<u2").tobytes()
        if len(word) <= 40:
            self[word] = out
        return out


def encoder(path: str) -> Encoder:
    """One for each worker and vocabulary."""
    held = kept("packing", dict)
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _pieces(documents: DataFrame, window: int, path: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id (of whole windows), ids and row (a number) of the rest."""
    kind = documents.schema["doc_id"].dataType
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "row", "ids"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).ids
        end = np.array([END], dtype="<u2").tobytes()
        sequence = TaskContext.get().partitionId() << 32
        for batch in batches:
            rows: list[tuple] = []
            of = []
            for d, text in enumerate(texts(batch)):
                raw = encode(text) + end
                ids = np.frombuffer(raw, dtype="<u2")
                n, whole = len(ids), len(ids) // window * window
                for a in range(0, whole, window):
                    rows.append((a, window, _crc(ids[a : a + window]), n, sequence, None, None))
                    of.append(d)
                    sequence += 1
                if n > whole:
                    rows.append((whole, n - whole, 0, n, None, sequence, raw[2 * whole :]))
                    of.append(d)
                    sequence += 1
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            arrays = [batch.column("doc_id").take(pa.array(of, pa.int64()))] + [pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(columns[6], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return documents.select("doc_id", "text").mapInArrow(work, f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, row long, ids binary")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many pieces of a partition hold each id."""
    n = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for raw in batch.column("ids").to_pylist():
            n[np.unique(np.frombuffer(raw, dtype="<u2"))] += 1
    ids = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n[ids])], names=["id", "n"])


def _spans(offset: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The postings of terms, one term after another, and how many each has."""
    many = offset[terms + 1] - offset[terms]
    return np.arange(many.sum()) + np.repeat(offset[terms] - np.cumsum(many) + many, many), many


class Shard:
    """An inverted index of pieces; terms that many of them hold are rows of a matrix."""

    def __init__(self, pieces: list[np.ndarray], idf: np.ndarray, mean: float):
        self.pieces, self.n = pieces, len(pieces)
        found = [np.unique(p, return_counts=True) for p in pieces]
        term = np.concatenate([f[0] for f in found]).astype(np.int64)
        tf = np.concatenate([f[1] for f in found]).astype(np.float64)
        doc = np.repeat(np.arange(self.n), [len(f[0]) for f in found])
        size = np.array([len(p) for p in pieces], dtype=np.float64)[doc]
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
        held = np.bincount(term, minlength=1 << 16)
        common = np.flatnonzero(held > self.n / 32)
        self.place = np.full(1 << 16, -1)
        self.place[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), self.n), np.float32)
        dense = self.place[term] >= 0
        self.matrix[self.place[term[dense]], doc[dense]] = weight[dense]
        term, doc, weight = term[~dense], doc[~dense], weight[~dense]
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.offset = np.searchsorted(term[order], np.arange((1 << 16) + 1))
        self.terms = [f[0] for f in found]

    def scores(self, queries: list[np.ndarray]) -> np.ndarray:
        """The BM25 score of every piece for all different ids of each query."""
        term = np.concatenate(queries).astype(np.int64)
        query = np.repeat(np.arange(len(queries)), [len(q) for q in queries])
        wanted = np.zeros((len(queries), len(self.matrix)), np.float32)
        dense = self.place[term] >= 0
        wanted[query[dense], self.place[term[dense]]] = 1
        at, many = _spans(self.offset, term[~dense])
        rare = np.bincount(np.repeat(query[~dense], many) * self.n + self.doc[at], weights=self.weight[at], minlength=len(queries) * self.n)
        return wanted @ self.matrix + rare.reshape(len(queries), self.n)


def fill(shard: Shard, window: int) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (piece, from, to): every id of every piece in exactly one place."""
    at = np.zeros(shard.n, np.int64)
    size = np.array([len(p) for p in shard.pieces], dtype=np.int64)
    out: list[list[tuple[int, int, int]]] = []
    scores: dict[int, np.ndarray] = {}
    for seed in range(shard.n):
        if at[seed] >= size[seed]:
            continue
        here, space = [(seed, int(at[seed]), int(size[seed]))], window - int(size[seed] - at[seed])
        at[seed] = size[seed]
        if space and (at < size).any():
            if seed not in scores:
                asked = [seed, *(seed + 1 + np.flatnonzero(at[seed + 1 :] < size[seed + 1 :])[: QUERIES - 1]).tolist()]
                scores = dict(zip(asked, shard.scores([shard.terms[p] for p in asked]), strict=True))
            ranked = np.argsort(-scores[seed], kind="stable")
            ranked = ranked[at[ranked] < size[ranked]]
            left = size[ranked] - at[ranked]
            k = 0
            while space and len(fits := np.flatnonzero(left[k:] <= space)):
                k += int(fits[0])
                p = int(ranked[k])
                here.append((p, int(at[p]), int(size[p])))
                space -= int(left[k])
                at[p] = size[p]
                k += 1
            if space and len(rest := ranked[at[ranked] < size[ranked]]):
                p = int(rest[0])
                here.append((p, int(at[p]), int(at[p]) + space))
                at[p] += space
        out.append(here)
    return out


def key_of(ids: np.ndarray, frequency: np.ndarray) -> bytes:
    """What orders a piece: its rarest ids that more than one piece has, rarest first."""
    u = np.unique(ids).astype(np.int64)
    n = frequency[u]
    u, n = u[n > 1], n[n > 1]
    first = np.lexsort((u, n))[:KEY_IDS]
    return b"".join(int(n[k]).to_bytes(6, "big") + int(u[k]).to_bytes(2, "big") for k in first)


def sharded(pieces: DataFrame, frequency, n: int, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """pieces (ids, row, ...) with pk_key, ordered by it within and across partitions of a few shards; frequency: a broadcast array."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            yield [pa.array([key_of(np.frombuffer(raw, dtype="<u2"), frequency.value) for raw in batch.column("ids").to_pylist()], pa.binary())]

    keys = append_columns(pieces, [("pk_key", T.BinaryType())], work)
    return keys.repartitionByRange(max(1, -(-n // (shard_pieces * TASK_SHARDS))), "pk_key", "row").sortWithinPartitions("pk_key", "row")


def pack(documents: DataFrame, window: int = WINDOW, path: str | None = None, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """The pieces of all documents with their places: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = prepare(documents.sparkSession)
    scratch = Scratch(spark, "packing")
    kind = documents.schema["doc_id"].dataType.simpleString()
    pieces = scratch.save(_pieces(documents, window, path or public_tokenizers.path(RANKS)))
    rest = pieces.where("ids is not null")
    n, mean = rest.select(F.count("*"), F.avg("length")).first()
    frequency = np.zeros(1 << 16, np.int64)
    #: A row for each id of the vocabulary at most.
    for r in rest.select("ids").mapInArrow(_frequencies, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        frequency[r.id] = r.n
    held = spark.sparkContext.broadcast(frequency)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = np.log(1 + (n - held.value + 0.5) / (held.value + 0.5))
        sequence = (TaskContext.get().partitionId() << 32) | (1 << 62)
        waiting: list[pa.RecordBatch] = []

        def filled(table: pa.Table) -> pa.RecordBatch:
            nonlocal sequence
            ids = [np.frombuffer(b, dtype="<u2") for b in table.column("ids").to_pylist()]
            rows = []
            for placed in fill(Shard(ids, idf, mean), window):
                offset = 0
                for p, a, b in placed:
                    rows.append((p, a, b - a, _crc(ids[p][a:b]), sequence, offset))
                    offset += b - a
                sequence += 1
            of, a, length, crc, number, offset = (np.array(c, dtype=np.int64) for c in zip(*rows, strict=True))
            start, tokens = (table.column(c).to_numpy()[of] for c in ("start", "doc_tokens"))
            return pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks().take(pa.array(of)), *(pa.array(c) for c in (start + a, length, crc, tokens, number, offset))], names=names)

        for batch in batches:
            waiting.append(batch)
            while sum(b.num_rows for b in waiting) >= shard_pieces:
                table = pa.Table.from_batches(waiting)
                yield filled(table.slice(0, shard_pieces))
                waiting = table.slice(shard_pieces).to_batches()
        if sum(b.num_rows for b in waiting):
            yield filled(pa.Table.from_batches(waiting))

    dealt = sharded(rest.select("row", "doc_id", "start", "doc_tokens", "ids"), held, n, shard_pieces).drop("pk_key")
    packed = dealt.mapInArrow(work, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return pieces.where("ids is null").select(*names[:-1], F.lit(0).cast("long").alias("offset")).unionAll(packed)


def report(documents: DataFrame) -> DataFrame:
    return pack(documents)
