"""Sharding by Karmarkar-Karp differencing: shards of nearly equal bytes, groups of equal texts undivided.

A partial partition is a tuple of k subset sums. Differencing takes the two with the largest spread
(largest less smallest sum) and adds them oppositely ordered, until one is left. Groups are dealt
into chunks by a hash of their text, differencing runs in each chunk, and then over the chunks'
tuples, one tuple of k sums a chunk, FAN of them in a task, level by level until one tuple is left, which
goes on with the same procedure from where they stopped.
A group of a third of all rows is one number: its rows are never brought together.

Slots number the rows of a shard without gaps: rows are counted by (shard, bucket), buckets get
offsets, and rows are numbered within their bucket, so no task holds a shard.

Cases: a null text counts as the empty text, whose group is like any other; repeated rows each get a
slot; an empty table gives no rows; where groups are fewer than shards, some shards are empty; ties
of spread go to the tuple that came first; other columns pass through plan_shards(), which puts its own in
the place of such as have their names.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, prepare

SHARDS = 24
_ADDED = ("shard_size", "shard_crc32", "shard", "shard_slot")
#: Groups that a chunk has on average; one chunk is differenced in one task's memory.
CHUNK_GROUPS = 20_000
#: Tuples that are differenced in one task, level by level.
FAN = 1000
#: Rows of a shard that one numbering bucket has on average.
BUCKET_ROWS = 20_000


class _Node:
    """A partial partition: sums in ascending order; where each came from is kept for walking back down."""

    __slots__ = ("sums", "left", "right", "order", "leaf", "at")

    def __init__(self, sums, leaf=None, at=None, left=None, right=None, order=None):
        self.sums, self.leaf, self.at, self.left, self.right, self.order = sums, leaf, at, left, right, order


def difference(tuples: list[list[int]]) -> tuple[list[list[int]], list[int]]:
    """Differencing over tuples of k sums each.

    Returns for each tuple, by the position of its sums, the subset each one joins; and the subset sums.
    """
    heap = []
    for n, t in enumerate(tuples):
        at = sorted(range(len(t)), key=t.__getitem__)
        sums = [t[i] for i in at]
        heap.append((sums[0] - sums[-1], n, _Node(sums, leaf=n, at=at)))
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heap[0]
        added = [x + y for x, y in zip(a.sums, reversed(b.sums), strict=True)]
        order = sorted(range(len(added)), key=added.__getitem__)
        sums = [added[i] for i in order]
        heapq.heapreplace(heap, (sums[0] - sums[-1], count, _Node(sums, left=a, right=b, order=order)))
        count += 1
    out: list[list[int]] = [[] for _ in tuples]
    if not heap:
        return out, []
    root = heap[0][2]
    k = len(root.sums)
    stack = [(root, list(range(k)))]
    while stack:
        node, subset = stack.pop()
        if node.leaf is not None:
            mine = [0] * k
            for i, at in enumerate(node.at):
                mine[at] = subset[i]
            out[node.leaf] = mine
            continue
        inner = [0] * k
        for i, o in enumerate(node.order):
            inner[o] = subset[i]
        stack.append((node.left, inner))
        stack.append((node.right, inner[::-1]))
    return out, list(root.sums)


def _lifted(tuples: DataFrame, n: int, shards: int) -> DataFrame:
    """Differencing over n chunks' tuples (chunk, part, s) by groups of FAN: chunk, part, parent, and up, the part of the parent, with its sum."""
    parents = max(1, -(-n // FAN))

    def work(key: tuple, table: pa.Table) -> pa.Table:
        sums: dict[int, list[int]] = {}
        for chunk, part, s in zip(*(table.sort_by([("chunk", "ascending"), ("part", "ascending")]).column(c).to_pylist() for c in ("chunk", "part", "s")), strict=True):
            sums.setdefault(chunk, [0] * shards)[part] = s
        placed, of = difference(list(sums.values()))
        rows = [(c, k, key[0].as_py(), up, of[up]) for c, p in zip(sums, placed, strict=True) for k, up in enumerate(p)]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["chunk", "part", "parent", "up", "up_sum"])

    return tuples.withColumn("parent", F.col("chunk") % parents).groupBy("parent").applyInArrow(work, "chunk long, part int, parent long, up int, up_sum long")


def assign(groups: DataFrame, shards: int = SHARDS, chunk_groups: int = CHUNK_GROUPS, scratch: Scratch | None = None) -> DataFrame:
    """groups (group, weight) with the shard of each: group, shard. Nothing but counts comes to the driver."""
    spark = prepare(groups.sparkSession)
    scratch = scratch or Scratch(spark, "shards")
    n = max(1, -(-groups.count() // chunk_groups))
    kind = groups.schema["group"].dataType.simpleString()

    def local(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("weight", "descending"), ("group", "ascending")])
        placed, sums = difference([[w] + [0] * (shards - 1) for w in table.column("weight").to_pylist()])
        chunk = pa.array([key[0].as_py()] * len(placed), pa.int64())
        return pa.table({"chunk": chunk, "group": table.column("group"), "part": pa.array([p[0] for p in placed], pa.int32()), "part_sum": pa.array([sums[p[0]] for p in placed], pa.int64())})

    dealt = groups.withColumn("chunk", F.pmod(F.xxhash64("group"), F.lit(n)).cast("long"))
    parts = scratch.save(dealt.groupBy("chunk").applyInArrow(local, f"chunk long, group {kind}, part int, part_sum long"))
    tuples, levels = parts.groupBy("chunk", "part").agg(F.max("part_sum").alias("s")), []
    while True:
        levels.append(scratch.save(_lifted(tuples, n, shards)))
        if n <= FAN:
            break
        tuples, n = levels[-1].groupBy(F.col("parent").alias("chunk"), F.col("up").alias("part")).agg(F.max("up_sum").alias("s")), -(-n // FAN)
    final = levels[-1].select("chunk", "part", F.col("up").alias("shard"))
    for below in levels[-2::-1]:
        above = final.select(F.col("chunk").alias("parent"), F.col("part").alias("up"), "shard")
        final = below.join(above, ["parent", "up"]).select("chunk", "part", "shard")
    return parts.join(final, ["chunk", "part"]).select("group", "shard")


def plan_shards(documents: DataFrame, shards: int = SHARDS, chunk_groups: int = CHUNK_GROUPS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """documents with shard_size (UTF-8 bytes plus 8), shard_crc32, shard and shard_slot, in the place of columns of these names; text itself is left out."""
    spark = prepare(documents.sparkSession)
    scratch = Scratch(spark, "shards")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    others = [c for c in documents.columns if c not in ("text", *_ADDED)]
    safe = [f"other{k}" for k in range(len(others))]
    kept = [F.col(f"`{c}`").alias(k) for c, k in zip(others, safe, strict=True)]
    rows = scratch.save(documents.select(*kept, (F.octet_length(text) + 8).cast("long").alias("shard_size"), F.crc32(text).alias("shard_crc32"), F.md5(text).alias("shard_group")))
    rows = rows.withColumn("shard_row", F.monotonically_increasing_id())
    groups = scratch.save(rows.groupBy(F.col("shard_group").alias("group")).agg(F.sum("shard_size").alias("weight")))
    placed = assign(groups, shards, chunk_groups, scratch)
    #: The groups' side of this join has a row a key, so a hot group's rows can be split over tasks (adaptive skew join).
    joined = rows.join(placed.withColumnRenamed("group", "shard_group"), "shard_group")
    buckets = max(1, -(-rows.count() // (shards * bucket_rows)))
    placed_rows = scratch.save(joined.select(*safe, "shard_size", "shard_crc32", "shard", F.pmod(F.xxhash64("shard_row"), F.lit(buckets)).cast("int").alias("shard_bucket"), "shard_row"))
    counts = placed_rows.groupBy("shard", "shard_bucket").count()
    before = Window.partitionBy("shard").orderBy("shard_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "shard_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shard_offset"))
    within = Window.partitionBy("shard", "shard_bucket").orderBy("shard_row")
    return (
        placed_rows.withColumn("shard_at", F.row_number().over(within) - 1)
        .join(offsets, ["shard", "shard_bucket"])
        .select(*safe, "shard_size", "shard_crc32", "shard", (F.col("shard_offset") + F.col("shard_at")).cast("long").alias("shard_slot"))
        .toDF(*others, *_ADDED)
    )


def report(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The shard and slot of every document, by the law of near-equal bytes."""
    out = plan_shards(documents.select("doc_id", "text"), shards)
    return out.select("doc_id", F.col("shard_size").alias("size"), F.col("shard_crc32").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("shard_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
