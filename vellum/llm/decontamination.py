"""Benchmark decontamination with suffix arrays over shards of the training documents.

A shard is one Arrow batch of documents. Its words become numbers (0 for any word that no test item
has), the stretches that hold test words only are laid end to end, and a suffix array orders their
suffixes. Every suffix of every test item is then searched in it by bisection, word by word, which
gives the longest verbatim match with its places, and all places of each window.

Test items are broadcast in blocks of at most BLOCK_BYTES of text, one pass over the documents each;
hits of several blocks are merged. Nothing else is sent to executors.

Cases: a null or wordless text has no words and is never hit; documents of any length are searched
whole; repeated rows are each scored; an empty table on either side gives no hits; items without
words and items with a null id are passed over; items that repeat an id count once; columns of the
documents other than doc_id and text pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import append_columns, fold_words, prepare, raw_texts, shielded

WINDOW = 13
BLOCK_BYTES = 16 << 20

class Items:
    """A block of test items as numbers: their distinct windows, and all of their suffixes."""

    def __init__(self, rows: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in rows})
        number = {n: k for k, n in enumerate(self.names)}
        laid: list[int] = []
        self.suffix_item, self.suffix_at, starts, lengths = [], [], [], []
        self.least, self.longest = window, 1
        found: dict[tuple[int, ...], list[int]] = {}
        first: dict[tuple[int, ...], int] = {}
        for name, text in rows:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in fold_words(text)]
            if not ids:
                continue
            n = min(window, len(ids))
            self.longest = max(self.longest, len(ids))
            self.least = min(self.least, n)
            for k in range(len(ids)):
                starts.append(len(laid) + k)
                self.suffix_item.append(number[name])
                self.suffix_at.append(k)
                if k + n <= len(ids):
                    key = tuple(ids[k : k + n])
                    first.setdefault(key, len(starts) - 1)
                    found.setdefault(key, []).append(number[name])
            laid += [*ids, 0]
        self.laid = np.array(laid + [0], dtype=np.int64)
        self.starts = np.array(starts, dtype=np.int64)
        #: Of each distinct window: the suffix that begins with it, its length, the items that have it.
        self.windows = [(first[k], len(k), sorted(set(v))) for k, v in found.items()]


class Shard:
    """The documents of one batch, with the suffix array of the stretches that could match."""

    def __init__(self, docs: list[bytes], items: Items):
        vocabulary, parts, self.n_words = items.vocabulary, [], []
        for text in docs:
            w = fold_words(text)
            self.n_words.append(len(w))
            parts += [np.fromiter(map(vocabulary.get, w, repeat(0)), dtype=np.int64, count=len(w)), np.zeros(1, np.int64)]
        all_ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.doc_starts = np.concatenate(([0], np.cumsum(np.array(self.n_words, dtype=np.int64) + 1)))
        #: Stretches of known words that are long enough for the shortest window, each with a 0 behind it.
        known = np.concatenate(([0], (all_ids > 0).astype(np.int8), [0]))
        edge = np.diff(known)
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = b - a >= items.least
        a, b = a[long], b[long]
        size = b - a + 1
        total = int(size.sum())
        before = np.repeat(np.cumsum(size) - size, size)
        self.place = np.repeat(a, size) + np.arange(total) - before  # where each one stands among all words
        self.ids = all_ids[self.place] if total else np.zeros(0, np.int64)
        self.sa = self._suffixes(items.longest)

    def _suffixes(self, longest: int) -> np.ndarray:
        """Prefix doubling: ranks by 1, 2, 4, ... words until no two suffixes tie, or no test suffix is longer."""
        n = len(self.ids)
        if not n:
            return np.zeros(0, np.int64)
        rank, step = self.ids.copy(), 1
        while True:
            after = np.zeros(n, np.int64)
            after[:-step] = rank[step:] + 1 if step < n else after[:-step]
            key = rank * (int(after.max()) + 1) + after
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            new = np.empty(n, np.int64)
            new[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
            rank, step = new, step * 2
            if rank[order[-1]] == n - 1 or step >= min(n, longest):
                return order

    def search(self, items: Items) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
        """For every test suffix the words of its longest match and one place of it; by depth, the ranges that hold it."""
        n, sa, ids = len(self.sa), self.sa, np.concatenate((self.ids, [0]))
        m = len(items.starts)
        longest, place = np.zeros(m, np.int64), np.full(m, -1, np.int64)
        live, low, high = np.arange(m), np.zeros(m, np.int64), np.full(m, n, np.int64)
        wanted, ranges = {length for _, length, _ in items.windows}, {}
        depth = 0
        while len(live) and n:
            word = items.laid[items.starts[live] + depth]
            live, low, high, word = (x[word > 0] for x in (live, low, high, word))
            ends = []
            for right in (False, True):
                x, y = low.copy(), high.copy()
                while (going := x < y).any():
                    mid = (x + y) // 2
                    there = ids[np.minimum(sa[np.minimum(mid, n - 1)] + depth, n)]
                    up = going & ((there <= word) if right else (there < word))
                    x = np.where(up, mid + 1, x)
                    y = np.where(going & ~up, mid, y)
                ends.append(x)
            some = ends[0] < ends[1]
            live, low, high = live[some], ends[0][some], ends[1][some]
            depth += 1
            longest[live], place[live] = depth, sa[low]
            if depth in wanted:
                at_low, at_high = np.zeros(m, np.int64), np.zeros(m, np.int64)
                at_low[live], at_high[live] = low, high
                ranges[depth] = at_low, at_high
        return longest, place, ranges

    def document(self, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document and word number of positions in the suffix array's text."""
        at = self.place[position]
        doc = np.searchsorted(self.doc_starts, at, side="right") - 1
        return doc, at - self.doc_starts[doc]


def _merged(pairs: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[Items]:
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text"), F.lit("")).alias("text")).where("item is not null")
    total = rows.select(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    parts = -(-total // block_bytes) or 1
    for k in range(parts):
        part = rows.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == k) if parts > 1 else rows
        yield Items([(r.item, r.text.encode()) for r in part.collect()], window)


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """documents with contam_n_words, contam_spans (word ranges hit: start, end, start, ...) and contam_items, in the place of columns of these names."""
    spark = prepare(documents.sparkSession)
    added = [("contam_n_words", T.LongType()), ("contam_spans", T.ArrayType(T.LongType())), ("contam_items", T.ArrayType(T.StringType()))]
    out = documents
    for k, block in enumerate(_blocks(benchmark, window, block_bytes)):
        held = spark.sparkContext.broadcast(block)

        def work(batches: Iterator[pa.RecordBatch], held=held, k=k) -> Iterator[list]:
            items = held.value
            for batch in batches:
                shard = Shard(raw_texts(batch), items)
                spans: dict[int, list[tuple[int, int]]] = {}
                names: dict[int, set[str]] = {}
                if k:
                    for d, (s, i) in enumerate(zip(batch.column("contam_spans").to_pylist(), batch.column("contam_items").to_pylist(), strict=True)):
                        if s:
                            spans[d], names[d] = list(zip(s[::2], s[1::2], strict=True)), set(i)
                ranges = shard.search(items)[2]
                for suffix, length, owners in items.windows:
                    if length not in ranges or (a := ranges[length][0][suffix]) >= (b := ranges[length][1][suffix]):
                        continue
                    doc, at = shard.document(shard.sa[a:b])
                    for d, p in zip(doc.tolist(), at.tolist(), strict=True):
                        spans.setdefault(d, []).append((p, p + length))
                        names.setdefault(d, set()).update(items.names[o] for o in owners)
                n = batch.num_rows
                yield [shard.n_words, [_merged(spans.get(d, [])) for d in range(n)], [sorted(names.get(d, ())) for d in range(n)]]

        out = append_columns(out, added, work, replace=True)
    return out


def longest_matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Of every test suffix the longest verbatim match in all documents: item_id, item_word, length, doc_id, doc_word.

    Ties go to the smallest doc_id, then the first word. Suffixes without a match of the shortest window are left out.
    """
    spark = prepare(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()
    out = None
    for block in _blocks(benchmark, window, block_bytes):
        held = spark.sparkContext.broadcast(block)

        def work(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items = held.value
            for batch in batches:
                shard = Shard(raw_texts(batch), items)
                longest, place, _ = shard.search(items)
                hit = np.flatnonzero(longest >= items.least)
                doc, at = shard.document(place[hit])
                yield pa.RecordBatch.from_arrays([pa.array([items.names[items.suffix_item[h]] for h in hit], pa.string()), pa.array([items.suffix_at[h] for h in hit], pa.int64()), pa.array(longest[hit]), batch.column("doc_id").take(pa.array(doc)), pa.array(at)], names=["item_id", "item_word", "length", "doc_id", "doc_word"])

        part = documents.select("doc_id", "text").mapInArrow(work, f"item_id string, item_word long, length long, doc_id {kind}, doc_word long")
        out = part if out is None else out.unionAll(part)
    best = F.min_by(F.struct("length", "doc_id", "doc_word"), F.struct(-F.col("length"), F.col("doc_id"), F.col("doc_word")))
    return out.groupBy("item_id", "item_word").agg(best.alias("best")).select("item_id", "item_word", "best.*")


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """documents without those that share at least one word in `share` with windows of test items."""
    return shielded(documents, lambda d: find_contamination(d, benchmark, window).where(~_contaminated(share)))


def _n_hit():
    signed = F.transform("contam_spans", lambda x, k: F.when(k % 2 == 1, x).otherwise(-x))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda a, b: a + b)


def _contaminated(share: int):
    hit = _n_hit()
    return (hit > 0) & (share * hit >= F.col("contam_n_words"))


def report(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """One row a document: its words, those hit, the items found in it and the verdict."""
    found = find_contamination(documents.select("doc_id", "text"), benchmark, window)
    return found.select(
        "doc_id",
        F.col("contam_n_words").alias("n_words"),
        _n_hit().alias("n_hit"),
        F.size("contam_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("contam_items"), ",").cast("binary"), 256).alias("items_sha256"),
        _contaminated(share).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

REPORT_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[p : p + least(len(w), {WINDOW}) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.p, dw.n, win.item_id FROM dw JOIN win ON dw.n = win.n AND dw.k = win.k),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hits)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
