"""Personal data: fixed patterns, and bootstrapped contextual extraction around them.

Base spans of e-mail addresses, IP addresses, card and phone numbers seed the second step. There a
candidate is a run of non-space characters that holds a digit, '@' or '_' and touches no base span.
Lexical patterns link to what they surround: the two words before, the word before with the word
after, and the word before with the outline of the run itself (letters a, digits 9). A bipartite graph
of patterns and instances, pre-aggregated to one edge a pair, is scored by turns in Spark: a pattern's
confidence for a kind is the mean score of its instances, shrunk by PRIOR; an instance's score for a pattern is the
best confidence of its patterns after other words, so no pattern speaks for itself, nor for those that stand in
the same places. Seeds stay at 1. After ROUNDS turns, candidates under patterns with at
least LEAST_SEEDS different seeds and a confidence of CONFIDENCE become spans of the pattern's kind.

Documents are read once; occurrences are written without texts, and only they are joined.

Cases: a null text is empty; texts of any length are scanned whole, in time linear in their length;
repeated rows each get their own spans; a run with several confident kinds takes the likeliest, then
the first by name; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import Scratch, append_columns, prepare, texts

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
LEAST_SEEDS = 3
CONFIDENCE = 0.6
PRIOR = 1.0

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK, _REST = re.compile(r"[0-9@_]"), re.compile(r"\S*")
_RUN = re.compile(r"\S+")
#: Characters of a word that stands for itself in a pattern.
SHORT = 64
_EDGE = ".,;:!?()[]{}<>\"'"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From every '@' the address is grown both ways, which a pattern that starts at each letter can't do in linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        else:
            end = max(end, start)
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, leftmost first, in code points."""
    out: dict[str, list[tuple[int, int]]] = {"email": list(_emails(text))}
    out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) < 4 and int(p or "0") < 256 for x in m.groups())]
    cards = out["card"] = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                cards.append(m.span())
    out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15] if "+" in text else []
    return out


def _marked(text: str) -> Iterator[tuple[int, int]]:
    """Runs of non-space characters that hold a digit, '@' or '_'."""
    end = 0
    while m := _MARK.search(text, end):
        a = m.start()
        while a > end and not text[a - 1].isspace():
            a -= 1
        end = _REST.match(text, m.start()).end()
        yield a, end


def outline(run: str) -> str:
    """Letters as a, digits as 9, repeats once."""
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "9", run)))


class Words:
    """The words around places of a text. A long one stands as a digest of its whole run, so that none is cut."""

    def __init__(self, text: str):
        self.text = text
        runs = [m.span() for m in _RUN.finditer(text)]
        self.starts, self.ends = [a for a, _ in runs], [b for _, b in runs]
        self.digests: dict[int, int] = {}

    def _word(self, run: int, a: int, b: int) -> str:
        if b - a <= SHORT:
            return self.text[a:b].lower()
        start, end = self.starts[run], self.ends[run]
        if run not in self.digests:
            self.digests[run] = zlib.crc32(self.text[start:end].lower().encode("utf-8", "surrogatepass"))
        return f"#{self.digests[run]}:{a - start}:{end - b}"

    def before(self, at: int) -> list[str]:
        """The two words before a place, the first of which may be the beginning of its run; \\x02 stands for the text's start."""
        k, out = bisect_left(self.starts, at) - 1, []
        while len(out) < 2:
            out.insert(0, self._word(k, self.starts[k], min(at, self.ends[k])) if k >= 0 else "\x02")
            k -= 1
        return out

    def after(self, at: int) -> str:
        """The first word at or after a place, which may be the rest of a run."""
        k = bisect_right(self.ends, at)
        return self._word(k, max(at, self.starts[k]), self.ends[k]) if k < len(self.ends) else ""


def patterns(words: Words, start: int, end: int) -> list[str]:
    """What surrounds a span: the word before, the kind of context, and the rest of it."""
    two, one = words.before(start)
    run = words.text[start:end]
    return [f"{one}\x1fS\x1f{outline(run)}", f"{one}\x1fR\x1f{words.after(end)}", f"{one}\x1fL\x1f{two}"]


def occurrences(text: str) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str | None, int, int, str, list[str]]]]:
    """Base spans, and all mentions: kind (None for a candidate), start, end, instance, patterns."""
    base, words = base_spans(text), Words(text)
    mentions = [(kind, a, b, text[a:b], patterns(words, a, b)) for kind in KINDS for a, b in base[kind]]
    covered = sorted(s for kind in KINDS for s in base[kind])
    k = 0
    for a, b in _marked(text):
        run = text[a:b]
        a, b = a + len(run) - len(run.lstrip(_EDGE)), b - len(run) + len(run.rstrip(_EDGE))
        while k < len(covered) and covered[k][1] <= a:
            k += 1
        if b - a >= 3 and not any(s < b and a < e for s, e in covered[k : k + 4]):
            mentions.append((None, a, b, text[a:b], patterns(words, a, b)))
    return base, mentions


_MENTION = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("instance", T.StringType()), T.StructField("patterns", T.ArrayType(T.StringType()))]))
_NAMES = ("kind", "start", "end", "instance", "patterns")


def confident_patterns(edges: DataFrame, scratch: Scratch, rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS, confidence: float = CONFIDENCE) -> DataFrame:
    """Patterns that may discover, from edges (pattern, instance, kind; null kind: a candidate): pattern, kind, confidence."""
    seeds = edges.where("kind is not null").groupBy("pattern", "kind").agg(F.count("*").alias("seeds"))
    able = scratch.save(seeds.where(F.col("seeds") >= least_seeds))
    #: Only patterns with enough seeds can ever discover; the graph is cut down to them.
    graph = scratch.save(edges.join(able.select("pattern").distinct(), "pattern", "left_semi"))
    size = graph.groupBy("pattern").agg(F.count("*").alias("size"))
    scored = able.join(size, "pattern").withColumn("confidence", F.col("seeds") / (F.col("size") + PRIOR))
    candidates = graph.where("kind is null").select("pattern", "instance", F.substring_index("pattern", "\x1f", 1).alias("before"))
    for _ in range(rounds - 1):
        #: What an instance is worth to a pattern comes from its patterns after other words: those after the same word stand in the same places.
        by_word = candidates.join(scored, "pattern").groupBy("instance", F.col("kind").alias("found"), "before").agg(F.max("confidence").alias("c"))
        best = by_word.groupBy("instance", "found").agg(F.max("c").alias("first"), F.max_by("before", F.struct("c", "before")).alias("of"))
        second = by_word.join(best, ["instance", "found"]).where("before <> of").groupBy("instance", "found").agg(F.max("c").alias("second"))
        worth = best.join(second, ["instance", "found"])  # those with patterns after two words at least
        gained = candidates.join(worth, "instance").groupBy("pattern", F.col("found").alias("kind")).agg(F.sum(F.when(F.col("before") == F.col("of"), F.col("second")).otherwise(F.col("first"))).alias("gained"))
        scored = able.join(size, "pattern").join(gained, ["pattern", "kind"], "left").withColumn("confidence", (F.col("seeds") + F.coalesce("gained", F.lit(0.0))) / (F.col("size") + PRIOR)).select("pattern", "kind", "seeds", "size", "confidence")
        scored = scratch.save(scored)
    return scored.where(F.col("confidence") >= confidence).select("pattern", "kind", "confidence")


def find_pii(documents: DataFrame, rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS, confidence: float = CONFIDENCE) -> DataFrame:
    """documents without text, with pii_base and pii_found, arrays of (kind, start, end) in code points, in the place of columns of these names."""
    spark = prepare(documents.sparkSession)
    scratch = Scratch(spark, "pii")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            yield [pa.array([[dict(zip(_NAMES, m, strict=True)) for m in occurrences(t)[1]] for t in texts(batch)])] if batch.num_rows else [pa.array([])]

    others = [c for c in documents.columns if c not in ("text", "pii_base", "pii_found")]
    safe = documents.select("text", *(F.col(f"`{c}`").alias(f"other{k}") for k, c in enumerate(others)))
    #: Numbered before it is written, so that every reading sees the same numbers.
    rows = scratch.save(append_columns(safe, [("pii_mentions", _MENTION)], work).drop("text").withColumn("pii_row", F.monotonically_increasing_id()))
    mentions = rows.select("pii_row", F.explode("pii_mentions").alias("m")).select("pii_row", "m.*")
    edges = mentions.select("kind", "instance", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.max("kind").alias("kind"))
    sure = confident_patterns(scratch.save(edges), scratch, rounds, least_seeds, confidence)
    named = mentions.where("kind is null").drop("kind").withColumn("pattern", F.explode("patterns")).join(sure, "pattern")
    best = named.groupBy("pii_row", "start", "end").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "kind")).alias("b")).select("pii_row", F.struct(F.col("b.kind").alias("kind"), "start", "end").alias("s"))
    new = best.groupBy("pii_row").agg(F.array_sort(F.collect_list("s")).alias("pii_found"))
    base = F.transform(F.filter("pii_mentions", lambda m: m.kind.isNotNull()), lambda m: F.struct(m.kind.alias("kind"), m.start.alias("start"), m.end.alias("end")))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    out = rows.join(new, "pii_row", "left").select(*(f"other{k}" for k in range(len(others))), base.alias("pii_base"), F.coalesce("pii_found", none).alias("pii_found"))
    return out.toDF(*others, "pii_base", "pii_found")


def report(documents: DataFrame) -> DataFrame:
    """Counts and a digest of the base spans, and all spans, of every document."""
    out = find_pii(documents.select("doc_id", "text"))

    def of(column: str, kind: str):
        return F.filter(column, lambda s: s.kind == kind)

    def joined(column: str):
        """By kind as listed, then start."""
        parts = [F.array_sort(of(column, k)) for k in KINDS]
        return F.array_join(F.transform(F.concat(*parts), lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    every = out.withColumn("every", F.concat("pii_base", "pii_found"))
    counts = [F.size(of("pii_base", k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return every.select("doc_id", *counts, F.sha2(joined("pii_base").cast("binary"), 256).alias("base_sha256"), joined("every").alias("spans"))
