"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text's shingles are its runs of five words (all its words, where it has fewer). A shingle weighs
(1 + ln tf) * idf, so that no phrase repeated hundreds of times speaks for a whole text, with
idf = ln(1 + N / (N + df)): df comes from counters of a fixed size over all texts, and the
sum in the denominator keeps a shingle that a third of all texts share at 0.8 of the weight of one that no
other has, so a large group of copies can't push its own members apart.

ICWS draws for shingle s and sample k the values r and c (gamma), and b (uniform) from a hash of both; with
t = floor(ln(weight) / r + b), the sample is the (s, t) of least ln(c) - r * (t - b) - r. Two texts
agree in a sample with a probability equal to their weighted Jaccard similarity. BANDS bands of ROWS samples
are compared; at similarity 0.8 a pair shares a band with probability 0.999.

Equal texts are one from the start. Texts that share a band are a bucket. A pair of them is a candidate if
it agrees in at least AGREE of all samples (of 7 bits each); at similarity 0.8 that holds with probability
0.997; and their weights and bitmaps, in which each shingle that is not common flips one of 512 bits, must
allow it. First each member of a bucket is verified against the bucket's first one (by hash), in a bucket of more
than HOT members against the best few of HEADS of them. The links found make classes; then each member that is
not in its bucket's largest class is verified against all of the bucket that are in another class: so no link
between candidates is lost that would join two classes, but pairs within what is joined already are not made.
Verification reads both texts whole. Classes are the connected components of the links, found by hooking
and pointer jumping on written tables.

Cases: null texts count as empty, and all empty texts are equal; repeated rows are equal texts; ties go to
the smallest id (of any type with an order), then the text's hash; a null id sorts first; an empty table gives
no rows; other columns pass through drop_near_duplicates() whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import Scratch, append_columns, keyed, only, prepare, shielded, temporary, texts

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 10, 3
AGREE = 18
#: Members of a bucket that is not large yet; heads of a larger one, and how many of them a member is verified against.
HOT, HEADS, TRIED = 64, 16, 3
#: Counters of document frequency, by a hash of the shingle.
COUNTERS = 1 << 18
#: Characters of texts that are worked on at once: their arrays stay in a core's cache.
STRETCH = 1 << 17

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


#: The bytes of a word of 0 to 8 bytes in the 8 that begin with it.
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


def _words(batch_texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, laid end to end, and how many each text has. Words are those of str.lower and str.split."""
    split = pc.utf8_split_whitespace(pa.array([t.lower() for t in batch_texts], pa.large_string()))
    offsets = np.frombuffer(split.values.buffers()[1], "<i8")[: len(split.values) + 1]
    ends = split.offsets.to_numpy()
    #: White space at the ends of a text gives empty words.
    there = offsets[1:] > offsets[:-1]
    count = np.diff(np.concatenate(([0], np.cumsum(there)))[ends])
    at, size = offsets[:-1][there], np.diff(offsets)[there]
    if not len(at):
        return np.zeros(0, _U), count
    data = np.concatenate((np.frombuffer(split.values.buffers()[2], np.uint8)[: offsets[-1]], np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    out = _mix(eight[at] & _BYTES[np.minimum(size, 8)] ^ size.astype(_U) * _U(0x9E3779B97F4A7C15))
    long = np.flatnonzero(size > 8)
    done = 8
    while len(long):
        out[long] = _mix(out[long] * _U(0xD6E8FEB86659FD93) + (eight[at[long] + done] & _BYTES[np.minimum(size[long] - done, 8)]))
        done += 8
        long = long[size[long] > done]
    return out, count


def shingled(batch_texts: list[str], size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each text's different shingles, ascending, how often it has each, and how many each text has; texts laid end to end."""
    only("near_dedup")
    h, words = _words(batch_texts)
    ends = np.cumsum(words)
    n = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    first = np.cumsum(n) - n
    runs, short = np.zeros(len(h), _U), []
    for k in range(size):
        runs = (runs[: len(h) - k] + h[k:]) * _U(0x9E3779B97F4A7C15)
        runs ^= runs >> _U(29)
        #: A text of fewer words is one run of them all.
        fewer = np.flatnonzero(words == k + 1) if k + 1 < size else []
        short.append((first[fewer], runs[ends[fewer] - k - 1]) if len(fewer) else None)
    whole = np.where(words >= size, n, 0)
    out = np.empty(int(n.sum()), _U)
    at = np.arange(len(out)) - np.repeat(first - (ends - words), n)
    if len(runs):
        out[:] = runs[np.minimum(at, len(runs) - 1)]
    for found in short:
        if found is not None:
            out[found[0]] = found[1]
    out = _mix(out)
    for a, m in zip(first.tolist(), whole.tolist(), strict=True):
        out[a : a + m].sort()
    new = np.concatenate((out[:1] == out[:1], out[1:] != out[:-1]))
    new[first[n > 0]] = True
    tops = np.flatnonzero(new)
    each = np.diff(np.concatenate(([0], np.cumsum(new)))[np.concatenate(([0], np.cumsum(n)))])
    return out[tops], np.diff(np.concatenate((tops, [len(out)]))), each


def shingles(text: str, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's different shingles, ascending, and how often it has each."""
    return shingled([text], size)[:2]


def stretches(batch_texts: list[str]) -> Iterator[list[str]]:
    """Texts in order, STRETCH characters or somewhat more at once."""
    held, size = [], 0
    for text in batch_texts:
        held.append(text)
        size += len(text)
        if size >= STRETCH or len(held) >= 256:
            yield held
            held, size = [], 0
    if held:
        yield held


def _sets(batch_texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """shingles() of each text."""
    for some in stretches(batch_texts):
        s, tf, each = shingled(some)
        ends = np.cumsum(each)
        for a, b in zip((ends - each).tolist(), ends.tolist(), strict=True):
            yield s[a:b], tf[a:b]


def _slot(s: np.ndarray) -> np.ndarray:
    return (s & _U(COUNTERS - 1)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counters of a partition, as one row, and its texts."""
    n, total = np.zeros(COUNTERS, np.int64), 0
    for batch in batches:
        held, size = [], 0
        for some in stretches(texts(batch)):
            held.append(_slot(shingled(some)[0]))
            size += len(held[-1])
            if size >= COUNTERS:
                n += np.bincount(np.concatenate(held), minlength=COUNTERS)
                held, size = [], 0
        if held:
            n += np.bincount(np.concatenate(held), minlength=COUNTERS)
        total += batch.num_rows
    for k in range(0, COUNTERS, 1 << 14):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([total], pa.int64()), pa.array([n[k : k + (1 << 14)].astype("<i4").tobytes()], pa.binary())], names=["part", "n", "counts"])


def _add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up counters; the key ends in the bytes of a number in them."""
    total, n = None, 0
    for batch in batches:
        for m, raw in zip(batch.column("n").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            part = np.frombuffer(raw, dtype=f"<i{key[-1].as_py()}").astype(np.int64)
            total, n = part if total is None else total + part, n + m
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([n], pa.int64()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["part", "n", "counts"])


def idf_table(documents: DataFrame) -> np.ndarray:
    """ln(1 + N / (N + df)) for each counter; df is less what other shingles add to a counter on average.

    Partitions' counters are added up in two levels, so the driver gets COUNTERS numbers whatever the input.
    """
    out, kind = documents.select("text").mapInArrow(_count, "part long, n long, counts binary"), "part long, n long, counts binary"
    for salts, width in ((16, 4), (1, 8)):
        salted = out.select("*", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"), F.lit(width).alias("width"))
        out = salted.groupBy("part", "salt", "width").applyInArrow(_add, kind)
    rows = sorted(out.collect(), key=lambda r: r.part)
    n = rows[0].n if rows else 0
    counts = np.concatenate([np.frombuffer(r.counts, dtype="<i8") for r in rows]).astype(float) if rows else np.zeros(COUNTERS)
    df = np.maximum(counts - np.median(counts), 0)
    return np.log1p(n / np.maximum(n + df, 1)).astype(np.float32) if n else np.full(COUNTERS, np.log(2), np.float32)


def _gamma_tables() -> tuple[np.ndarray, np.ndarray]:
    """2^12 quantiles of the gamma distribution of shape 2, and their logarithms."""
    x = np.linspace(0, 25, 400_001)
    below = 1 - np.exp(-x) * (1 + x)
    q = np.interp((np.arange(4096) + 0.5) / 4096, below, x)
    return q.astype(np.float32), np.log(q).astype(np.float32)


_GAMMA, _LOG_GAMMA = _gamma_tables()
#: An odd factor for each sample.
_FACTORS = _mix(np.arange(1, 4097, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def samples(s: np.ndarray, log_weight: np.ndarray, starts: np.ndarray, count: int = BANDS * ROWS) -> np.ndarray:
    """ICWS samples of texts whose shingles are laid end to end, ascending in each: an unsigned 64-bit number each."""
    out = np.empty((count, len(starts)), _U)
    sizes = np.diff(np.concatenate((starts, [len(s)])))
    h, at = np.empty(len(s), _U), np.empty(len(s), _U)
    low, place = h.view("<u4")[::2], at.view(np.int64)
    r, b, t, least = (np.empty(len(s), np.float32) for _ in range(4))
    for k in range(count):
        #: Three parts of a product: r and c by its highest 12 bits each, b by its lower half.
        np.multiply(s, _FACTORS[k], out=h)
        np.right_shift(h, _U(52), out=at)
        np.take(_GAMMA, place, out=r, mode="clip")
        np.right_shift(h, _U(40), out=at)
        np.bitwise_and(at, _U(0xFFF), out=at)
        np.take(_LOG_GAMMA, place, out=least, mode="clip")
        np.multiply(low, np.float32(2**-32), out=b, dtype=np.float32, casting="unsafe")
        np.divide(log_weight, r, out=t)
        t += b
        np.floor(t, out=t)
        np.subtract(t, b, out=b)
        b += np.float32(1)
        b *= r
        least -= b
        best = np.flatnonzero(least == np.repeat(np.minimum.reduceat(least, starts), sizes))
        if len(best) > len(starts):  # ties go to the least shingle
            best = best[np.unique(np.searchsorted(starts, best, "right"), return_index=True)[1]]
        out[k] = _mix(s[best] * _U(0xA0761D6478BD642F) + t[best].astype(np.int64).view(_U) * _U(0xE7037ED1A0B428DB))
    return out


#: The idf of shingles in less than a sixth of all texts.
RARE = 0.9 * float(np.log(2))


def weight(s: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """(1 + ln tf) * idf of each shingle."""
    return (1 + np.log(tf)) * idf[_slot(s)]


#: Numbers that hold 7 bits of each sample, 7 samples each; and those of a text's bitmap.
SKETCH, BITMAP = -(-BANDS * ROWS // 7), 8


def bitmaps(s: np.ndarray, each: np.ndarray, idf: np.ndarray) -> list[list[int]]:
    """Of each text: each shingle of an idf of RARE or more flips a bit: two texts' bitmaps differ in no more bits than these shingles do."""
    bits = 64 * BITMAP
    at = (s >> _U(20)).astype(np.int64) % bits + np.repeat(np.arange(len(each)) * bits, each)
    flips = np.bincount(at[idf[_slot(s)] >= RARE], minlength=len(each) * bits) & 1
    return np.packbits(flips.astype(bool).reshape(len(each), bits), axis=1).view(np.int64).tolist()


def signatures(batch_texts: list[str], idf: np.ndarray) -> list[list]:
    """The band keys, sketch, bitmap and weight of each text; no keys for a text without words."""
    out: list[list] = [[], [], [], []]
    for some in stretches(batch_texts):
        s, tf, each = shingled(some)
        w = weight(s, tf, idf)
        full = np.flatnonzero(each)
        starts = (np.cumsum(each) - each)[full]
        keys, packed, total = np.zeros((len(some), BANDS), _U), np.zeros((len(some), SKETCH), _U), np.zeros(len(some))
        if len(full):
            drawn = samples(s, np.log(w).astype(np.float32), starts)
            for band in range(BANDS):
                key = np.full(len(full), _U(band + 1))
                for row in range(ROWS):
                    key = _mix(key * _U(0x9E3779B97F4A7C15) + drawn[band * ROWS + row])
                keys[full, band] = key
            for k in range(BANDS * ROWS):
                packed[full, k // 7] |= (_mix(drawn[k]) & _U(127)) << _U(8 * (k % 7))
            total[full] = np.add.reduceat(w, starts)
        out[0] += [v if n else [] for v, n in zip(keys.view(np.int64).tolist(), each.tolist(), strict=True)]
        out[1] += packed.view(np.int64).tolist()
        out[2] += bitmaps(s, each, idf)
        out[3] += total.tolist()
    return out


def _agree(a: str, b: str) -> Column:
    """In how many samples two sketches agree: a byte of their difference is 0 where they do."""
    ones, tops = 0x007F7F7F7F7F7F7F, 0x0080808080808080
    differ = [f"bit_count((({a}.sketch[{k}] ^ {b}.sketch[{k}]) + {ones}L) & {tops}L)" for k in range(SKETCH)]
    return BANDS * ROWS - F.expr(" + ".join(differ))


def _candidate(a: str, b: str, t: float) -> Column:
    """Whether two signatures allow the similarity: by samples in all likelihood, by weights and bitmaps for certain.

    Shingles that only one text has weigh no more than (1 - t) / (1 + t) of both texts together.
    """
    differ = F.expr(" + ".join(f"bit_count({a}.bitmap[{k}] ^ {b}.bitmap[{k}])" for k in range(BITMAP)))
    x, y = F.col(f"{a}.weight"), F.col(f"{b}.weight")
    room = (x + y) * ((1 - t) / (1 + t)) * 1.000001
    return (_agree(a, b) >= AGREE) & (F.abs(x - y) <= room) & (differ * RARE <= room)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> float:
    """Weighted Jaccard similarity of two texts' shingles with their counts."""
    s, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    wa, wb = weight(*a, idf), weight(*b, idf)
    both = float(np.minimum(wa[at_a], wb[at_b]).sum())
    every = float(wa.sum() + wb.sum()) - both
    return both / every if every > 0 else 0.0


def _verified(pairs: DataFrame, docs: DataFrame, held, threshold: float) -> DataFrame:
    """Those of pairs (a, b: text hashes) that are similar enough. docs has hash and text, once each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, last, known = held.value, None, None
        for batch in batches:
            keep, of = [], batch.column("a").to_pylist()
            new = [a != b for a, b in zip(of, [last, *of], strict=False)]
            heads = _sets(batch.column("text_a").filter(pa.array(new, pa.bool_())).to_pylist())
            for first, other in zip(new, _sets(batch.column("text_b").to_pylist()), strict=True):
                known = next(heads) if first else known
                keep.append(similarity(known, other, idf) >= threshold)
            last = of[-1] if of else last
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(docs.select(F.col("hash").alias("b"), F.col("text").alias("text_b")), "b").join(docs.select(F.col("hash").alias("a"), F.col("text").alias("text_a")), "a")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(work, "a string, b string")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """hash and root (the smallest hash of its component) of every end of links (a, b)."""
    edges = scratch.save(links.selectExpr("a as x", "b as y").unionAll(links.selectExpr("b as x", "a as y")).where("x <> y").distinct())
    root = scratch.save(edges.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("root")).select(F.col("x").alias("hash"), "root"))
    while True:
        around = edges.join(root.select(F.col("hash").alias("y"), F.col("root").alias("near")), "y").groupBy("x").agg(F.min("near").alias("near"))
        hooked = root.join(around.withColumnRenamed("x", "hash"), "hash", "left").select("hash", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        #: A root takes on the least root that any of its members has seen, then members look up their root's root.
        lower = hooked.groupBy(F.col("old").alias("of")).agg(F.min("root").alias("lower"))
        moved = hooked.join(lower, hooked["old"] == lower["of"], "left").select("hash", "old", F.least("root", "lower").alias("root"))
        up = moved.select(F.col("hash").alias("root"), F.col("root").alias("above"))
        new = scratch.save(moved.join(up, "root", "left").select("hash", "old", F.least("root", "above").alias("root")))
        changed = new.where("old <> root").limit(1).count()
        scratch.drop(root)
        root = new
        if not changed:
            scratch.drop(edges)
            return root.select("hash", "root")


def _text():
    return F.coalesce(F.col("text"), F.lit(""))


def _first_pairs(members: DataFrame, t: float) -> DataFrame:
    """a and b: what members (band, hash, sig, size) of buckets are to be verified against first, the best of its heads."""
    head = F.min(F.struct(F.col("hash").alias("a"), F.col("sig").alias("sig_a"))).alias("h")
    part = F.when(F.col("size") > HOT, F.pmod(F.xxhash64("hash"), F.lit(HEADS))).otherwise(0)
    heads = members.groupBy("band", part.alias("part")).agg(head).select("band", "h.*")
    near = members.join(heads, "band").where((F.col("hash") != F.col("a")) & _candidate("sig", "sig_a", t))
    best = near.groupBy("hash").agg(F.collect_set(F.struct(_agree("sig", "sig_a").alias("agree"), "a")).alias("of"))  # at most BANDS * HEADS
    return best.select(F.col("hash").alias("b"), F.explode(F.slice(F.sort_array("of", asc=False), 1, TRIED)).alias("o")).select("o.a", "b")


def _cross_pairs(members: DataFrame, roots: DataFrame, t: float) -> DataFrame:
    """a and b: candidates of a bucket that are in different classes so far; the bucket's largest class is not compared with itself."""
    known = members.join(roots, "hash", "left").select("band", "hash", "sig", F.coalesce("root", "hash").alias("root"))
    largest = known.groupBy("band", "root").agg(F.count("*").alias("n")).groupBy("band").agg(F.max(F.struct("n", "root")).alias("m")).select("band", F.col("m.root").alias("main"))
    alone = known.join(largest, "band").where("root <> main").select("band", F.col("hash").alias("x"), F.col("sig").alias("s"), F.col("root").alias("root_x"))
    within = known.select("band", F.col("hash").alias("y"), F.col("sig").alias("o"), F.col("root").alias("root_y"))
    return alone.join(within, "band").where((F.col("root_x") != F.col("root_y")) & _candidate("s", "o", t)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def classes(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """hash and root of each different text that has a near-duplicate."""
    spark = prepare(documents.sparkSession)
    scratch = Scratch(spark, "neardup")
    hashed = documents.select(F.sha2(_text().cast("binary"), 256).alias("hash"), _text().alias("text"))
    held = spark.sparkContext.broadcast(idf_table(documents))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            yield signatures(texts(batch), held.value)

    def verified(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("hash")).unionAll(pairs.select("b")).distinct()
        docs = scratch.save(hashed.join(wanted, "hash", "left_semi").groupBy("hash").agg(F.first("text").alias("text")))
        out = scratch.save(_verified(pairs, docs, held, threshold))
        scratch.drop(docs)
        return out

    longs = T.ArrayType(T.LongType())
    marked = append_columns(hashed, [("bands", longs), ("sketch", longs), ("bitmap", longs), ("weight", T.DoubleType())], work)
    marked = marked.select("hash", "bands", F.struct("sketch", "bitmap", "weight").alias("sig"))
    signed = scratch.save(marked.groupBy("hash").agg(F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    shared = signed.select(F.explode("bands").alias("band")).groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    members = scratch.save(signed.select("hash", "sig", F.explode("bands").alias("band")).join(shared, "band"))
    scratch.drop(signed)
    pairs = scratch.save(_first_pairs(members, threshold))
    links = verified(pairs)
    roots = components(links, scratch)
    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = scratch.save(_cross_pairs(members, roots, threshold).join(tried, ["a", "b"], "left_anti"))
    scratch.drop(members, pairs, links)
    found = verified(more) if more.limit(1).count() else more
    if not found.limit(1).count():
        return roots
    #: Further links join classes: the same again over their roots.
    ends = [found.join(roots.select(F.col("hash").alias(c), F.col("root").alias(f"of_{c}")), c, "left").select("a", "b", F.coalesce(f"of_{c}", c).alias(f"root_{c}")) for c in ("a", "b")]
    between = scratch.save(ends[0].join(ends[1], ["a", "b"]).where("root_a <> root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct())
    upper = components(between, scratch).select(F.col("hash").alias("root"), F.col("root").alias("above"))
    every = roots.unionAll(found.select(F.explode(F.array("a", "b")).alias("hash")).distinct().join(roots, "hash", "left_anti").select("hash", F.col("hash").alias("root")))
    return every.join(upper, "root", "left").select("hash", F.coalesce("above", "root").alias("root"))


def with_class(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """documents with dup_hash (of the text) and dup_class (the same for near-duplicates)."""
    hashed = documents.withColumn("dup_hash", F.sha2(_text().cast("binary"), 256))
    found = classes(documents, threshold).select(F.col("hash").alias("dup_hash"), F.col("root").alias("dup_root"))
    return hashed.join(found, "dup_hash", "left").withColumn("dup_class", F.coalesce("dup_root", "dup_hash")).drop("dup_root")


def first_of_class(documents: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """dup_hash, first_id, first_hash and n_docs of the class of each different text, as a table in scratch."""
    with temporary():
        return scratch.save(_first_of_class(documents, threshold))


def _first_of_class(documents: DataFrame, threshold: float) -> DataFrame:
    light = documents.select("doc_id", F.sha2(_text().cast("binary"), 256).alias("dup_hash"))
    found = classes(documents, threshold).select(F.col("hash").alias("dup_hash"), F.col("root"))
    by_text = light.groupBy("dup_hash").agg(F.min(F.struct("doc_id")).alias("id"), F.count("*").alias("n"))
    named = by_text.join(found, "dup_hash", "left").withColumn("root", F.coalesce("root", "dup_hash"))
    best = named.groupBy("root").agg(F.min(F.struct("id", "dup_hash")).alias("first"), F.sum("n").alias("n_docs"))
    return named.join(best, "root").select("dup_hash", F.col("first.id.doc_id").alias("first_id"), F.col("first.dup_hash").alias("first_hash"), "n_docs")


def drop_near_duplicates(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class stays: that with the smallest id (of repeated rows, any one)."""

    def change(docs: DataFrame) -> DataFrame:
        scratch = Scratch(prepare(docs.sparkSession), "neardup")
        kept = first_of_class(docs, scratch, threshold).where("dup_hash = first_hash").select("dup_hash", "first_id")
        rows = keyed(docs, scratch).withColumn("dup_hash", F.sha2(_text().cast("binary"), 256))
        light = rows.select("dup_hash", "doc_id", "row_file", "row_at")
        here = light.join(kept, (light["dup_hash"] == kept["dup_hash"]) & light["doc_id"].eqNullSafe(kept["first_id"]), "left_semi")
        first = scratch.save(here.groupBy("dup_hash").agg(F.min(F.struct("row_file", "row_at")).alias("first")).select("first.*"))
        return rows.join(first, ["row_file", "row_at"], "left_semi")

    return shielded(documents, change)


def report(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The class of every document, named by its smallest doc_id, and how many documents it has."""
    documents = documents.select("doc_id", "text")
    found = first_of_class(documents, Scratch(prepare(documents.sparkSession), "neardup"), threshold)
    light = documents.select("doc_id", F.sha2(_text().cast("binary"), 256).alias("dup_hash"))
    return light.join(found, "dup_hash").select("doc_id", F.col("first_id").alias("class_id"), F.col("n_docs").cast("long").alias("class_size"))
