"""Exact top-k search in binary codes by incremental multi-index hashing.

An embedding's code has a bit for each of its components, set where the component is above 0, in as many
words of 64 bits as the longest vector fills. Codes are dealt into blocks by a hash, queries into blocks of their own, and each pair of blocks is searched
in one task. A block indexes its distinct codes by SEGMENTS segments a word. A query probes every segment at
radius 0, 1, 2, ...; after radius r all codes nearer than (r + 1) times the segments have been seen, so the
search of a query ends as soon as its kth verified distance is below that. Equal codes are one entry
of the index with a list of ids, and blocks give k rows a query, so a code shared by a third of all
rows costs nothing more. The k best of all blocks are the k best of all.

Cases: null components count as not set, missing ones too; a null embedding
or id is neither found nor a query; ties of distance go to the smaller id; repeated rows count once;
a query may find itself, at distance 0; with fewer than k codes all are returned; empty tables give no
rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import prepare

BITS = 64
SEGMENTS = 4
WIDTH = BITS // SEGMENTS
TOP = 10
QUERY_EVERY = 50
BLOCK_CODES, BLOCK_QUERIES = 32_768, 4096


def with_code(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id and code (a long, or an array of longs where a vector has more than BITS components) of every vector that has both."""
    given = vectors.where(F.col(column).isNotNull() & F.col(id_column).isNotNull())
    words = -(-(given.agg(F.max(F.size(column))).first()[0] or 0) // BITS)
    word = f"aggregate(transform(slice(`{column}`, {{}}, {BITS}), (x, k) -> if(coalesce(x > 0, false), shiftleft(1L, k), 0L)), 0L, (a, b) -> a | b)"
    code = F.expr(word.format(1)) if words <= 1 else F.array(*(F.expr(word.format(BITS * w + 1)) for w in range(words)))
    return given.select(F.col(id_column).cast("long").alias("id"), code.alias("code")).dropDuplicates(["id"])


def _words(codes: pa.ChunkedArray) -> np.ndarray:
    """A row of words for each code."""
    n, codes = len(codes), codes.combine_chunks()
    return (codes.flatten() if pa.types.is_list(codes.type) else codes).to_numpy().view(np.uint64).reshape(n, -1)


def _masks(radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(range(WIDTH), radius)], dtype=np.uint64)


def _segments(codes: np.ndarray) -> list[np.ndarray]:
    return [(word >> np.uint64(WIDTH * s)) & np.uint64((1 << WIDTH) - 1) for word in codes.T for s in range(SEGMENTS)]


class Index:
    """The distinct codes of a block, findable by each segment's value."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.by = codes, []
        for part in _segments(codes):
            order = np.argsort(part, kind="stable")
            self.by.append((order, np.searchsorted(part[order], np.arange((1 << WIDTH) + 1, dtype=np.uint64))))

    def candidates(self, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of query and code whose distance in some segment is the radius, each once for a segment."""
        masks, who, what = _masks(radius), [], []
        for part, (order, offset) in zip(_segments(query), self.by, strict=True):
            value = (part[:, None] ^ masks[None, :]).astype(np.int64)
            a, n = offset[value], offset[value + 1] - offset[value]
            hit = np.nonzero(n)
            a, n = a[hit], n[hit]
            who.append(np.repeat(hit[0], n))
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
            what.append(order[at])
        return np.concatenate(who), np.concatenate(what)


def search(codes: np.ndarray, weight: np.ndarray, queries: np.ndarray, k: int, step: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All codes within the distance at which a query has k ids: query number, code number, distance."""
    index, out = Index(codes), []
    total = int(weight.sum())
    for first in range(0, len(queries), step):
        query = queries[first : first + step]
        live = np.arange(len(query))
        pairs = np.zeros(0, np.int64)
        for radius in range(WIDTH + 1):
            who, what = index.candidates(query[live], radius)
            pairs = np.unique(np.concatenate((pairs, live[who] * len(codes) + what)))
            q, c = np.divmod(pairs, len(codes))
            distance = np.bitwise_count(query[q] ^ codes[c]).sum(axis=1, dtype=np.int64)
            covered = len(index.by) * (radius + 1) - 1
            near = distance <= covered
            count = np.bincount(q[near], weights=weight[c[near]], minlength=len(query))
            done = (count[live] >= min(k, total)) if radius < WIDTH else np.ones(len(live), bool)
            over = np.zeros(len(query), bool)
            over[live[done]] = True
            ends = over[q]
            out.append((q[ends & near] + first, c[ends & near], distance[ends & near]) if radius < WIDTH else (q[ends] + first, c[ends], distance[ends]))
            pairs, live = pairs[~ends], live[~done]
            if not len(live):
                break
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _nearest(ids: np.ndarray, codes: np.ndarray, query_ids: np.ndarray, query_codes: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """The k nearest ids of each query in a block, by distance, then id."""
    order = np.lexsort((ids, *codes.T))
    ids, codes = ids[order], codes[order]
    distinct, start, count = np.unique(codes, axis=0, return_index=True, return_counts=True)
    q, c, d = search(distinct, count, query_codes, k)
    n = np.minimum(count[c], k)
    row = np.repeat(np.arange(len(q)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + start[c[row]]
    q, d, found = q[row], d[row], ids[at]
    order = np.lexsort((found, d, q))
    q, d, found = q[order], d[order], found[order]
    first = np.searchsorted(q, q)
    best = np.arange(len(q)) - first < k
    return {"query_id": query_ids[q[best]], "id": found[best], "distance": d[best]}


def top_k(codes: DataFrame, queries: DataFrame, k: int = TOP, block_codes: int = BLOCK_CODES, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The k nearest of codes (id, code) for each of queries (id, code): query_id, rank, id, distance."""
    prepare(codes.sparkSession)
    n, m = codes.count(), queries.count()
    blocks, groups = max(1, -(-n // block_codes)), max(1, -(-m // block_queries))
    each = lambda df, own, other, name: df.withColumn(name[0], F.pmod(F.xxhash64("id"), F.lit(own)).cast("int")).withColumn(name[1], F.explode(F.sequence(F.lit(0), F.lit(other - 1))))
    left = each(codes, blocks, groups, ("block", "part"))
    right = each(queries, groups, blocks, ("part", "block"))

    def both(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            out = {"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "distance": np.zeros(0, np.int64)}
        else:
            out = _nearest(a.column("id").to_numpy(), _words(a.column("code")), b.column("id").to_numpy(), _words(b.column("code")), k)
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    near = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(both, "query_id long, id long, distance long")
    best = near.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.id").alias("id"), F.col("b.distance").alias("distance"))


def report(vectors: DataFrame) -> DataFrame:
    """The 10 nearest vectors, by their binary codes, of every vector whose id is divisible by 50."""
    codes = with_code(vectors)
    out = top_k(codes, codes.where(F.col("id") % QUERY_EVERY == 0))
    return out.select(F.col("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), F.col("distance").cast("int").alias("distance"))


REPORT_SQL = f"""
WITH c AS (SELECT vec_id, list_transform(embedding[1:{BITS}], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
bits AS (SELECT vec_id, generate_subscripts(b, 1) AS k, unnest(b) AS v FROM c),
codes AS (SELECT vec_id, bit_or(CASE WHEN v = 1 THEN CAST(1 AS UBIGINT) << (k - 1) ELSE CAST(0 AS UBIGINT) END) AS code FROM bits GROUP BY vec_id),
pairs AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(bit_count(xor(q.code, x.code)) AS INTEGER) AS distance FROM codes q, codes x WHERE q.vec_id % {QUERY_EVERY} = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS r FROM pairs) WHERE r <= {TOP}
"""
