"""Each operator against a brute-force version on small tables, and on what tables can hold of odd rows."""

import collections
import functools
import hashlib
import itertools
import math
import pickle
import random
import re
import weakref
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import decontamination, line_dedup, lm_scoring, near_dedup, packing, pii, quality, sharding, topk, toxicity
from vellum.llm.common import fold_words, settings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (3, " \n "), (None, "one two three four five six"), (4, "word " * 30_000), (5, "same text of a few words here"), (5, "same text of a few words here"), (6, "x"), (7, "é ü \t 12 a@b.co")]
WORDS = "amber birch cedar delta ember fjord grove haven islet jetty knoll larch marsh north ocean prism quartz ridge slate thorn umber vale wharf xenon yield zephyr".split()


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def prose(rng, n, lines=1):
    return "\n".join(" ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n)) for _ in range(lines))


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, " ".join(WORDS[:20])), (2, "four five"), (3, None), (None, "six"), (4, " ".join(WORDS[5:20]))], "item_id long, text string")


# -- odd rows and empty tables


def test_every_operator_takes_odd_rows(odd, items, no_labels):
    n = len(ODD)
    assert pii.report(odd).count() == n
    assert lm_scoring.report(odd).count() == n
    assert quality.report(odd, no_labels).where("keep").count() == n
    assert line_dedup.report(odd).count() == n
    classes = near_dedup.report(odd).collect()
    assert len(classes) == n and {r.class_size for r in classes if r.doc_id in (1, 2)} == {2}
    assert sharding.report(odd).count() == n
    assert [r.score for r in toxicity.report(odd, no_labels).collect()] == [0.0] * n
    found = {r.doc_id: r for r in decontamination.report(odd, items).collect()}
    assert found[None].n_hit == 2 and found[None].n_items == 1 and found[1].n_words == 0 and not found[1].contaminated
    assert packing.report(odd).agg(F.sum("length")).first()[0] >= 30_000


def test_every_operator_takes_empty_tables(none, items, no_labels, spark):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    for out in (pii.report(none), packing.report(none), lm_scoring.report(none), quality.report(none, no_labels), line_dedup.report(none), near_dedup.report(none), topk.report(vectors), sharding.report(none), toxicity.report(none, no_labels), decontamination.report(none, items), decontamination.longest_matches(none, items)):
        assert out.count() == 0


def test_other_columns_pass_through_whatever_their_names(spark, no_labels, items):
    docs = spark.createDataFrame([(1, "four five six seven eight nine", 5, "x", [1]), (2, "other words", 6, "y", [2])], "doc_id long, text string, score int, `a.b` string, shard array<int>")
    for out in (toxicity.drop_toxic(docs, toxicity.fit(docs, no_labels)), line_dedup.drop_repeated_lines(docs), near_dedup.drop_near_duplicates(docs), decontamination.decontaminate(docs, items.where("item_id = 1")), quality.select_good(docs, quality.fit(docs, quality.ratings(no_labels)))):
        assert out.columns == docs.columns and sorted(r.score for r in out.collect()) == [5, 6]


def test_added_columns_take_the_place_of_such_names(spark, no_labels, items):
    docs = spark.createDataFrame([(1, "four five six", 5, 5, 5, 5, 5), (2, "other words", 6, 6, 6, 6, 6)], "doc_id long, text string, shard_size int, contam_spans int, quality_grade int, tox_score int, score int")
    outs = {"shard_size": sharding.plan_shards(docs), "contam_spans": decontamination.find_contamination(docs, items), "quality_grade": quality.score(docs, quality.fit(docs, quality.ratings(no_labels))), "tox_score": toxicity.score(docs, toxicity.fit(docs, no_labels))}
    for name, out in outs.items():
        assert out.columns.count(name) == 1 and sorted(r.score for r in out.collect()) == [5, 6] and sorted(r[name] or [] for r in out.collect()) != [5, 6]


# -- 1


def test_pii_base_spans_are_those_of_the_patterns():
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, d[::-1]))) % 10 == 0

    def valid(kind, t):
        d = re.sub("[^0-9]", "", t)
        return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in t.split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()

    rng = random.Random(1)
    texts = ["a@b@c.d x@@y.z .@a.b. foo.@bar..com", "1.2.3.4.5 300.1.1.1.2 0001.2.3.255", "+12345678 (9) +1+2 +1 (22)33-44.55.", "a@b.c.@d.e", "4111 1111 1111 1111 4111-1111-1111-1111", "é@a.b 4111111111111111é"]
    texts += ["".join(rng.choice("ab1290.@+-( )é4") for _ in range(200)) for _ in range(300)]
    for t in texts:
        want = {k: [m.span() for m in re.finditer(p, t) if valid(k, m.group())] for k, p in patterns.items()}
        assert pii.base_spans(t) == want, t


def test_pii_long_runs_take_linear_time():
    for t in ("a" * 400_000, "1" * 400_000, "@" * 400_000, "+1" + "(" * 400_000, "a.b@" * 100_000, "9 " * 200_000):
        pii.occurrences(t)


def test_pii_contexts_discover_what_no_pattern_has(spark):
    rows = [(k, f"please reach me on user{k}@mail.org now thanks") for k in range(6)] + [(10, "please reach me on bob_77 now thanks"), (11, "version 2.0 of it"), (12, "call on x9 tomorrow")]
    got = {r.doc_id: r.spans for r in pii.report(table(spark, rows)).collect()}
    assert got[0] == "email:19:33" and got[10] == "email:19:25" and got[11] == "" and got[12] == ""


def test_pii_patterns_do_not_speak_for_themselves(spark):
    """30 addresses and 70 plain words in the same places: the pattern is worth 0.3, in every round."""
    rows = [(k, f"the total is user{k}@mail.org now") for k in range(30)] + [(100 + k, f"the total is item_{k} now") for k in range(70)]
    got = {r.doc_id: r.spans for r in pii.report(table(spark, rows)).collect()}
    assert all(got[k] for k in range(30)) and not any(got[100 + k] for k in range(70))


def test_pii_precision_and_recall_of_discovered_spans(spark):
    """Names after a confident context are found, those in plain contexts are left alone; other columns keep their values."""
    rng = random.Random(22)
    rows, planted = [], set()
    for k in range(200):
        words = prose(rng, 12)
        if k % 4 == 0:
            rows.append((k, f"{words} write to me at u{k}@mail.org please {words}"))
        elif k % 10 == 1:
            planted.add(k)
            rows.append((k, f"{words} write to me at nick_{k} please {words}"))
        else:
            rows.append((k, f"{words} version_{k} of it {words}"))
    docs = table(spark, rows).withColumn("pii_row", F.col("doc_id") + 5).withColumn("other0", F.lit("x"))
    out = pii.find_pii(docs).collect()
    found = {r.doc_id for r in out if r.pii_found}
    assert planted <= found and len(found - planted) <= 0.02 * len(rows)
    assert all(r.pii_row == r.doc_id + 5 and r.other0 == "x" for r in out)


def test_pii_words_are_whole():
    long = "x" * 250
    words = pii.Words(f"a {long} me@b.co {long}y")
    assert words.before(253) != pii.Words(f"a {long}z me@b.co").before(254) and words.before(2) == ["\x02", "a"]
    assert words.after(260) != words.before(253)[1] and pii.Words("a b").after(3) == ""


# -- 2


def test_packing_is_an_exact_cover(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    texts = [None, "", " ", "a  b", "it's\n\nfine\t\tnow  x y", "<|endoftext|> <|x|>", "a <|endoftext|> b<|endoftext|>", "<|endoftext|><|endoftext|>\n", "x\ny z", "日本 語\nテスト 123's", " lead", "trail ", "\n"] + [prose(rng, rng.randrange(1, 900), rng.randrange(1, 4)) for _ in range(60)]
    out = packing.pack(table(spark, list(enumerate(texts))), shard_pieces=25).collect()
    want = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], dtype="<u4") for i, x in enumerate(texts)}
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        assert r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes())
    for i, ids in want.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert sum(sum(r.length for r in rows) < 1024 for rows in by_seq.values()) <= 4


def test_packing_neighbours_share_words():
    rng = np.random.default_rng(1)
    topics = [rng.integers(1000 * k + 1, 1000 * k + 400, 200).astype("<u2") for k in (1, 2) for _ in range(8)]
    order = rng.permutation(16)
    df = np.zeros(1 << 16)
    for p in topics:
        df[np.unique(p)] += 1
    shard = packing.Shard([topics[i] for i in order], np.log(1 + (16 - df + 0.5) / (df + 0.5)), 200.0)
    for window in packing.fill(shard, 1024)[:2]:
        assert len({order[p] // 8 for p, a, b in window if b - a == 200}) == 1


def bm25(query, piece, df, n, mean):
    c = collections.Counter(piece.tolist())
    return sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(piece) / mean)) for t in set(query.tolist()) & set(c))


def test_packing_scores_and_fill_are_brute_force():
    rng = np.random.default_rng(3)
    pieces = [rng.integers(1, 300, rng.integers(60, 200)).astype("<u2") for _ in range(90)]
    df = collections.Counter(t for p in pieces for t in set(p.tolist()))
    idf, mean = np.zeros(1 << 16), float(np.mean([len(p) for p in pieces]))
    for t, k in df.items():
        idf[t] = math.log(1 + (90 - k + 0.5) / (k + 0.5))
    shard = packing.Shard(pieces, idf, mean)
    want = np.array([[bm25(q, p, df, 90, mean) for p in pieces] for q in pieces])
    assert shard.scores(shard.terms) == pytest.approx(want, rel=1e-4)
    at, windows = [0] * 90, []
    for seed in range(90):
        if at[seed] == len(pieces[seed]):
            continue
        here, space = [(seed, at[seed], len(pieces[seed]))], 1024 - len(pieces[seed]) + at[seed]
        at[seed] = len(pieces[seed])
        ranked = sorted(range(90), key=lambda p: (-want[seed][p], p))
        for p in ranked:
            if at[p] < len(pieces[p]) and len(pieces[p]) - at[p] <= space:
                here.append((p, at[p], len(pieces[p])))
                space -= len(pieces[p]) - at[p]
                at[p] = len(pieces[p])
        if space and (p := next((p for p in ranked if at[p] < len(pieces[p])), None)) is not None:
            here.append((p, at[p], at[p] + space))
            at[p] += space
        windows.append(here)
    assert packing.fill(shard, 1024) == windows


def test_packing_of_many_shards_fills_windows_with_neighbours(spark):
    rng = random.Random(12)
    words = {t: [f"{a}{b}" for a in rng.sample(WORDS, 5) for b in rng.sample(WORDS, 4)] for t in range(20)}
    rows = [(i, " ".join(rng.choice(words[i % 20]) for _ in range(rng.choice((50, 70, 90))))) for i in range(240)]
    out = packing.pack(table(spark, rows), shard_pieces=60).collect()
    windows = collections.defaultdict(list)
    for r in out:
        windows[r.sequence_id].append(r)
    assert sum(sum(r.length for r in w) < 1024 for w in windows.values()) <= 4
    assert sum(r.length for r in out) == sum({r.doc_id: r.doc_tokens for r in out}.values())
    most = [max(collections.Counter(r.doc_id % 20 for r in w).values()) / len(w) for w in windows.values()]
    assert np.mean(most) > 0.6


def test_packing_ids_are_those_of_the_tokenizers_library():
    import duckdb
    import public_tokenizers
    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder(public_tokenizers.path(packing.RANKS))
    for (text,) in duckdb.sql("SELECT coalesce(text, '') FROM '/root/testdata/sf0.01/documents.parquet'").fetchall():
        assert np.frombuffer(own.ids(text), "<u2").tolist() == t.encode(text, add_special_tokens=False).ids


# -- 3


def test_lm_base_scores_and_normalised_classes(spark):
    rng = random.Random(3)
    rows = [(i, None if i == 7 else prose(rng, 30, 2).upper() + "\x0bend") for i in range(120)]
    out = {r.doc_id: r for r in lm_scoring.report(table(spark, rows)).collect()}
    tokens = {i: [*re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (t or "").encode())), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert r.score < 0


def test_lm_scores_held_out_texts_better_than_the_base(spark):
    """Texts in which each word tells the next one."""
    rng = random.Random(23)
    rows = []
    for i in range(300):
        at, out = rng.randrange(26), []
        for _ in range(120):
            out.append(WORDS[at])
            at = (at * 5 + rng.choice((1, 2))) % 26
        rows.append((i, " ".join(out)))
    held = lm_scoring.report(table(spark, rows)).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert held.s > held.b


def test_lm_numbers_are_packed_without_loss():
    for ids in ([], [0], [1, 70_000, 2**24 - 1], [2**24, 5], list(range(1000))):
        assert lm_scoring.unpacked(lm_scoring.packed(np.array(ids, dtype=np.int32))).tolist() == ids


def test_lm_classes_add_up_to_one_and_training_helps():
    rng = np.random.default_rng(4)
    model = lm_scoring.begin(np.array([50.0, 30, 15, 5, 1, 1]))
    sequences = [np.tile([0, 1, 2, 0, 1, 3], 200) for _ in range(20)]
    before = lm_scoring.Scorer(model).log10(sequences[:1])[0]
    for k in range(20):
        lm_scoring.train(model, iter([sequences]), k)
    scorer = lm_scoring.Scorer(model)
    assert scorer.log10(sequences[:1])[0] > before * 0.7
    for c1, c2 in rng.integers(0, 7, (10, 2)):
        logits = scorer.s1[c1] + scorer.s2[c2] + scorer.b
        one = [scorer.log10([np.array([c])])[0] for c in range(6)]
        assert np.exp(logits - np.logaddexp.reduce(logits)).sum() == pytest.approx(1) and sum(10.0 ** np.array(one)) == pytest.approx(1, rel=1e-4)


# -- 4


def test_quality_orders_grades_and_separates_held_out_texts(spark):
    rng = random.Random(5)
    make = {0: lambda: " ".join("|" + rng.choice("#=~") * 3 for _ in range(40)), 1: lambda: prose(rng, 40) + " || ##", 2: lambda: prose(rng, 40)}
    rows = [(i, make[i % 3]()) for i in range(450)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 1)) for i in range(450)], "doc_id long, quality int, toxic int")
    out = [r for r in quality.report(table(spark, rows), labels).collect() if r.held_out]
    assert len(out) > 50 and all(1 >= r.p_at_least_1 >= r.p_at_least_2 >= 0 for r in out)
    assert all(r.expected_grade == pytest.approx(r.p_at_least_1 + r.p_at_least_2) for r in out)
    assert np.mean([r.keep == (r.doc_id % 3 > 0) for r in out]) > 0.95
    assert np.mean([(r.p_at_least_2 >= 0.5) == (r.doc_id % 3 == 2) for r in out]) > 0.9


def test_quality_scores_and_fit_are_those_of_the_definition():
    """Features counted word by word, tails by the formula, and a fit whose likelihood beats the thresholds alone."""
    rng = random.Random(6)
    texts = [prose(rng, rng.randrange(1, 30), 2) + rng.choice(("", " |## 12")) for _ in range(120)]
    grades = np.array([min(2, t.count("#") + t.count("amber")) for t in texts])
    model = quality.train([quality.features(t) for t in texts], grades, epochs=5)
    assert list(model.thresholds) == sorted(model.thresholds)

    def outline(w):
        return re.sub(r"(.)\1+", r"\1", "".join("a" if c.isalpha() else "9" if c.isdigit() else c for c in w))

    def z(t):
        words, x = t.split(), collections.Counter()
        slots = [zlib.crc32(b"o" + outline(w).encode()) % quality.FEATURES for w in words]
        x.update(zlib.crc32(b"w" + w.lower().encode()) % quality.FEATURES for w in words)
        x.update(slots)
        x.update((a * 31 + b * 17 + 1) % quality.FEATURES for a, b in itertools.pairwise(slots))
        shape = [not words, math.log1p(len(words)) / 10, len(words) / (t.count("\n") + 1) / 100, len(set(words)) / max(1, len(words)), len(t) / max(1, len(words)) / 10, sum(map(t.count, "|{}<>=")) / max(1, len(t)) * 10]
        return sum(model.weights[k] * math.sqrt(n / max(1, len(words))) for k, n in x.items()) + sum(w * min(v, 5.0) for w, v in zip(model.weights[quality.FEATURES :], shape, strict=True))

    tails = model.tails(texts)
    for t, row in zip(texts, tails, strict=True):
        assert row == pytest.approx([1 / (1 + math.exp(c - z(t))) for c in model.thresholds], rel=1e-6)
    edge = np.column_stack((np.ones(len(texts)), tails, np.zeros(len(texts))))
    likelihood = np.log(edge[np.arange(len(texts)), grades] - edge[np.arange(len(texts)), grades + 1]).mean()
    share = np.bincount(grades, minlength=3) / len(grades)
    assert likelihood > (share * np.log(np.maximum(share, 1e-9))).sum() + 0.1


# -- 5


def lines_by_brute_force(rows, t=0.8, least=5):
    seen, out = [], {}
    for i, text in sorted(rows):
        kept, n = [], 0
        for line in text.split("\n"):
            w = set(line.lower().split())
            gone = len(w) >= least and any(len(w & x) >= t * len(w | x) - 1e-9 for x in seen)
            if len(w) >= least:
                seen.append(w)
            n += gone
            kept += [] if gone else [line]
        out[i] = (n, hashlib.md5("\n".join(kept).encode()).hexdigest())
    return out


def test_line_dedup_is_all_pairs(spark):
    rng = random.Random(6)
    base = [prose(rng, rng.randrange(3, 40)) for _ in range(30)]

    def edited(line):
        w = line.split()
        for _ in range(rng.randrange(0, max(1, len(w) // 6) + 1)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        return " ".join(w)

    rows = [(i, "\n".join(edited(rng.choice(base)) if rng.random() < 0.7 else prose(rng, 12) for _ in range(5))) for i in range(120)]
    assert line_dedup.repeated(table(spark, rows)).select("doc_id").distinct().count() > 10
    got = {r.doc_id: (r.n_removed, r.kept_md5) for r in line_dedup.report(table(spark, rows)).collect()}
    assert got == lines_by_brute_force(rows)


def test_line_dedup_of_many_files_and_partitions(spark, tmp_path):
    """Ids in no order of the files, documents read by many tasks, partitions as they are dealt."""
    rng = random.Random(17)
    base = [prose(rng, rng.randrange(2, 60)) for _ in range(25)]

    def line():
        w = rng.choice(base).split()
        for _ in range(rng.randrange(0, len(w) // 5 + 2)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        return " ".join(w)

    ids = list(range(200))
    rng.shuffle(ids)
    rows = [(i, "\n".join(line() for _ in range(6))) for i in ids]
    table(spark, rows).repartition(9).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    with settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "1k"}):
        for docs_again in (docs, docs.repartition(5), docs.select("doc_id", "text").distinct()):
            got = {r.doc_id: (r.n_removed, r.kept_md5) for r in line_dedup.report(docs_again, least=1).collect()}
            assert got == lines_by_brute_force(rows, least=1)


def test_line_dedup_takes_ids_of_any_type(spark):
    rows = [("b", "one two three four five\nsix"), ("a", "one two three four five"), (None, "six seven")]
    out = line_dedup.report(spark.createDataFrame(rows, "doc_id string, text string"), least=1)
    assert {r.doc_id: r.n_removed for r in out.collect()} == {"a": 0, "b": 1, None: 0}


def test_line_dedup_query_removes_short_lines_too(spark, tmp_path):
    from vellum.llm import queries

    rng = random.Random(16)
    few = WORDS[:7]
    rows = [(1, "all rights reserved\n\na b c d\none"), (2, "b a d c e\nAll  rights reserved\n \n\ntwo"), (3, "all rights reserved\n\na b c d\none"), (4, "all rights"), (5, "\n\n")]
    rows += [(i, "\n".join(" ".join(rng.choice(few) for _ in range(rng.randrange(0, 8))) for _ in range(4))) for i in range(6, 60)]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_removed, r.kept_md5) for r in queries.op5_line_dedup(spark, str(tmp_path)).collect()}
    assert got == lines_by_brute_force(rows, least=1) and [got[i][0] for i in (1, 2, 3, 4, 5)] == [0, 2, 3, 0, 0]
    stage = dict(corpus_pipeline.STAGES)["line dedup"]
    assert 3 not in {r.doc_id for r in stage(spark, table(spark, rows), str(tmp_path)).collect()}


def test_line_dedup_is_exact_whatever_the_keys(spark, monkeypatch):
    """Keys that many words share, small groups taken for large ones, and all joins by shuffles."""
    for name, value in {"HOT": 4, "HEADS": 2, "KEY_BITS": 5, "SAMPLE": 3, "_few": lambda *_: False}.items():
        monkeypatch.setattr(line_dedup, name, value)
    rng = random.Random(23)
    base = [prose(rng, rng.randrange(2, 30)).split() for _ in range(12)]
    rows = [(i, "\n".join(" ".join(rng.choice(WORDS) if rng.random() < 0.08 else w for w in rng.choice(base)) for _ in range(6))) for i in range(80)]
    got = {r.doc_id: (r.n_removed, r.kept_md5) for r in line_dedup.report(table(spark, rows), least=1).collect()}
    assert got == lines_by_brute_force(rows, least=1)


def test_line_dedup_shuffles_only_rows_that_may_matter(spark):
    rows = spark.range(2000).withColumnRenamed("id", "key")
    got = {r.key for r in line_dedup._sieved(rows, rows.where("key % 40 = 0"), ["key"]).collect()}
    assert {k for k in range(2000) if k % 40 == 0} <= got and len(got) < 60
    plan = line_dedup._with_kept(table(spark, [(1, "a b c d e f\ng"), (2, "a b c d e f\nh i")]), 0.8, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan


def test_line_dedup_joins_postings_once_and_drops_lines_early(spark, monkeypatch):
    """Members of large groups that their heads don't decide need no second join of all postings, and copies no second table of all lines."""
    monkeypatch.setattr(line_dedup, "HOT", 4)
    joins, light, dropped = [], [], []
    candidates, prefixes, drop = line_dedup._candidates, line_dedup._prefixes, line_dedup.Scratch.drop
    monkeypatch.setattr(line_dedup, "_prefixes", lambda *a: light.append((out := prefixes(*a)).columns) or out)
    monkeypatch.setattr(line_dedup, "_candidates", lambda *a: joins.append(len(dropped)) or candidates(*a))
    monkeypatch.setattr(line_dedup.Scratch, "drop", lambda self, *t: dropped.extend(x for x in t if x.columns in light) or drop(self, *t))
    rng = random.Random(29)
    rows = [(i, "\n".join(" ".join(rng.choice(WORDS[:9]) for _ in range(9)) for _ in range(4))) for i in range(60)]
    got = {r.doc_id: (r.n_removed, r.kept_md5) for r in line_dedup.report(table(spark, rows), least=1).collect()}
    assert got == lines_by_brute_force(rows, least=1)
    assert joins == [1]


def test_line_dedup_runs_no_python(spark):
    plan = line_dedup.report(table(spark, [(1, "a b c d e f"), (2, "a b c d e f")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_line_dedup_sorts_sets_when_lines_and_their_shuffle_are_gone(spark, monkeypatch):
    """What the ranges and the sort read is a written table, so that the disk need not hold all lines, their shuffle and that of the sort at once."""
    light, dropped, sorted_ = [], [], []
    prefixes, drop, save = line_dedup._prefixes, line_dedup.Scratch.drop, line_dedup.Scratch.save

    def saving(self, df):
        if {"id", "first"} <= set(df.columns):
            sorted_.append((len(dropped), "Aggregate" in df._jdf.queryExecution().optimizedPlan().toString()))
        return save(self, df)

    monkeypatch.setattr(line_dedup, "_prefixes", lambda *a: light.append((out := prefixes(*a)).columns) or out)
    monkeypatch.setattr(line_dedup.Scratch, "drop", lambda self, *t: dropped.extend(x for x in t if x.columns in light) or drop(self, *t))
    monkeypatch.setattr(line_dedup.Scratch, "save", saving)
    rng = random.Random(31)
    rows = [(i, "\n".join(" ".join(rng.choice(WORDS[:9]) for _ in range(9)) for _ in range(4))) for i in range(40)] + [(50, "a b c\na b c"), (51, "A  b c")]
    got = {r.doc_id: (r.n_removed, r.kept_md5) for r in line_dedup.report(table(spark, rows), least=1).collect()}
    assert got == lines_by_brute_force(rows, least=1)
    assert sorted_[0] == (1, False)


def test_line_dedup_meets_sets_by_the_larger_one(spark, tmp_path):
    """All similar pairs meet, by one shuffle, of which one side takes the words of index prefixes only; none are told apart in the join's tasks."""
    rng = random.Random(37)
    base = [rng.sample(range(300), rng.randrange(1, 40)) for _ in range(12)]
    sets = [sorted({rng.randrange(300) if rng.random() < 0.06 else w for w in rng.choice(base)[: rng.randrange(1, 41)]}) for _ in range(150)]
    bits = [functools.reduce(lambda a, w: a ^ (1 << w % 63), s, 0) for s in sets]
    gone = {k for k in range(150) if k % 7 == 0}
    for t in (0.5, 0.8, 1.0):
        cut = [(-1 - k if k in gone else k, len(s), b, 0, s[: len(s) - math.ceil(t * len(s) - 1e-9) + 1]) for k, (s, b) in enumerate(zip(sets, bits, strict=True))]
        spark.createDataFrame(cut, "signed long, size int, odd long, even long, prefix array<int>").write.parquet(str(tmp_path / str(t)))
        met = line_dedup._meeting(line_dedup._words(spark.read.parquet(str(tmp_path / str(t))), t), t)
        got = {(r.x, r.y) for r in met.collect()}
        similar = {(x, y) for x in range(150) for y in range(x) if x not in gone and len({*sets[x]} & {*sets[y]}) >= t * len({*sets[x]} | {*sets[y]}) - 1e-9}
        assert similar <= got and len(similar) > 10
        assert all(y < x and x not in gone and bin(bits[x] ^ bits[y]).count("1") <= (len(sets[x]) + len(sets[y])) * (1 - t) / (1 + t) + 1e-9 for x, y in got)
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and "spark_partition_id" in plan.lower()
    with settings(spark, {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}):
        plan = line_dedup._meeting(line_dedup._words(spark.read.parquet(str(tmp_path / "0.8")), 0.8), 0.8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedExchange") == 1


def links_by_brute_force(rows, t=0.8):
    """Of each row its class (the smallest id that links lead to) and how many other lines its lines are similar to."""
    lines = [(k, w) for k, (_, text) in enumerate(rows) for line in (text or "").split("\n") if (w := set(line.lower().split()))]
    links, root = [0] * len(rows), list(range(len(rows)))
    for (k, w), (m, x) in itertools.combinations(lines, 2):
        if len(w & x) >= t * len(w | x) - 1e-9:
            links[k] += 1
            links[m] += 1
            root = [root[m] if r == root[k] else r for r in root]
    least = {r: min((i for (i, _), q in zip(rows, root, strict=True) if q == r), key=lambda i: (i is not None, i or 0)) for r in root}
    return collections.Counter((i, least[r], n) for (i, _), r, n in zip(rows, root, links, strict=True))


def test_line_dedup_links_and_classes_are_all_pairs(spark, monkeypatch):
    """No link of a set that a head of its group decides is left out, and what goes is the same with heads as by all links."""
    for name, value in {"HOT": 4, "HEADS": 2, "GROUP_SAMPLE": 1}.items():
        monkeypatch.setattr(line_dedup, name, value)
    rng = random.Random(41)
    base = [prose(rng, rng.randrange(1, 40)).split() for _ in range(40)]
    edited = lambda w: " ".join(rng.choice(WORDS) if rng.random() < 0.05 else v for v in w)
    rows = [(i, "\n".join(edited(rng.choice(base[:4] if rng.random() < 0.3 else base[4:])) for _ in range(rng.randrange(1, 4)))) for i in range(60)]
    rows += [(100 + i, prose(rng, 12)) for i in range(20)] + [(None, rows[7][1]), (200, rows[9][1]), (200, rows[9][1]), (201, None), (202, ""), (203, "x\nX \n\nx")]
    got = line_dedup.report(table(spark, rows), least=1).collect()
    assert collections.Counter((r.doc_id, r.class_id, r.n_links) for r in got) == links_by_brute_force(rows)
    assert any(r.class_id is None and r.doc_id is not None for r in got) and sum(r.n_links for r in got) > 300
    gone = collections.Counter(r.doc_id for r in line_dedup.repeated(table(spark, rows), least=1).collect())
    assert gone == collections.Counter({i: n for i in {r.doc_id for r in got} if (n := sum(r.n_removed for r in got if r.doc_id == i))})


def test_line_dedup_counts_pairs_of_large_groups_by_sums(spark, monkeypatch):
    """Near copies are counted without a row for each pair, by whatever joins; none of their links, copies or removals gets lost."""
    for name, value in {"CIRCLE_SAMPLE": 1, "CIRCLE": 4}.items():
        monkeypatch.setattr(line_dedup, name, value, raising=False)
    met, similar = [], line_dedup._similar
    monkeypatch.setattr(line_dedup, "_similar", lambda *a: met.append((out := similar(*a)).count()) or out)
    rng = random.Random(43)
    base = [[f"w{k}-{rng.randrange(10**6)}" for _ in range(n)] for k, n in enumerate((45, 30, 12))]

    def copy(k, most):
        w = list(base[k])
        for _ in range(rng.randrange(most + 1)):
            w[rng.randrange(len(w))] = rng.choice(WORDS) if rng.random() < 0.5 else f"new{rng.randrange(10**6)}"
        return " ".join(w[: len(w) - rng.randrange(3)])

    rows = [(i, copy(0, 2)) for i in range(160)] + [(200 + i, copy(k, 6) + "\n" + prose(rng, 9)) for i in range(30) for k in (0, 1, 2)]
    rows += [(500, rows[3][1]), (501, rows[3][1] + "\n" + rows[3][1]), (None, rows[5][1]), (502, prose(rng, 20)), (503, None)]
    rng.shuffle(rows)
    for t, few in ((0.8, line_dedup._few), (0.65, lambda *_: False)):
        monkeypatch.setattr(line_dedup, "_few", few)
        got = line_dedup.report(table(spark, rows), t, least=1).collect()
        want = links_by_brute_force(rows, t)
        assert collections.Counter((r.doc_id, r.class_id, r.n_links) for r in got) == want
        if t == 0.8:
            assert met[0] < 0.25 * sum(n for _, _, n in want.elements()) / 2
            early = [(-1 if i is None else i, x) for i, x in rows if x and (i is None or i < 200)]
            gone = {i: n for i, (n, _) in lines_by_brute_force(early, least=1).items() if i >= 0}
            assert {r.doc_id: r.n_removed for r in got if r.doc_id is not None and r.doc_id < 200} == gone


# -- 6


def test_near_dedup_is_all_pairs(spark):
    rng = random.Random(7)
    base = [prose(rng, rng.randrange(30, 200)) for _ in range(12)]

    def edited(text, n):
        w = text.split()
        for _ in range(n):
            w[rng.randrange(len(w))] = "new" + str(rng.randrange(10**6))
        return " ".join(w)

    rows = [(i, edited(rng.choice(base), rng.choice([0, 0, 1, 1, 2, 12]))) for i in range(150)] + [(200, "too short"), (201, "too short"), (202, "")]
    sets = {i: {tuple(w[k : k + min(5, len(w))]) for k in range(len(w) - min(5, len(w)) + 1)} for i, t in rows for w in [t.lower().split()]}
    idf = math.log(1 + len(rows) / (len(rows) + 1))
    assert idf > 0
    found = {r.doc_id: r.class_id for r in near_dedup.report(table(spark, rows)).collect()}
    for (i, a), (j, b) in itertools.combinations(sets.items(), 2):
        both = len(a & b) / len(a | b) if a | b else 1.0
        if both >= 0.83:
            assert found[i] == found[j], (i, j, both)
    for i, c in found.items():  # no class without a chain of similar texts
        others = [j for j in found if found[j] == c and j != i]
        assert not others or max(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in others) >= 0.75


def test_near_dedup_recall_from_the_threshold_on(spark):
    """Of all pairs of texts whose weighted similarity is 0.8 to 0.84 nearly all are found, and none below 0.8 links two texts."""
    rng = random.Random(18)
    rows = []
    for k in range(150):
        w = prose(rng, 120).split()
        rows.append((2 * k, " ".join(w)))
        for _ in range(3):
            w[rng.randrange(len(w))] = "new" + str(rng.randrange(10**6))
        rows.append((2 * k + 1, " ".join(w)))
    docs = table(spark, rows)
    idf = near_dedup.idf_table(docs)
    near = [k for k in range(150) if 0.8 <= near_dedup.similarity(near_dedup.shingles(rows[2 * k][1]), near_dedup.shingles(rows[2 * k + 1][1]), idf)]
    assert 30 < len(near) < 145
    found = {r.doc_id: r.class_id for r in near_dedup.report(docs).collect()}
    got = [k for k in range(150) if found[2 * k] == found[2 * k + 1]]
    assert set(got) <= set(near) and len(got) >= 0.98 * len(near)


def test_near_dedup_of_a_large_bucket_is_all_pairs(spark):
    """A family of more than HOT members around the threshold: the classes are those of all pairs."""
    rng = random.Random(19)
    base = prose(rng, 100).split()
    rows = []
    for i in range(140):
        w = list(base)
        for _ in range(rng.choice((1, 1, 2, 3))):
            w[rng.randrange(len(w))] = "new" + str(rng.randrange(10**6))
        rows.append((i, " ".join(w)))
    docs = table(spark, rows)
    idf = near_dedup.idf_table(docs)
    sets = [near_dedup.shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if near_dedup.similarity(sets[i], sets[j], idf) >= 0.8:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    want = {i: find(i) for i in range(len(rows))}
    assert 1 < len(set(want.values())) < 140
    assert {r.doc_id: r.class_id for r in near_dedup.report(docs).collect()} == want


def test_near_dedup_takes_ids_of_any_type(spark):
    text = " ".join(WORDS)
    out = near_dedup.report(spark.createDataFrame([("b", text), ("a", text), (None, "x")], "doc_id string, text string"))
    assert {r.doc_id: (r.class_id, r.class_size) for r in out.collect()} == {"a": ("a", 2), "b": ("a", 2), None: (None, 1)}


def test_shingles_of_texts_laid_end_to_end_are_those_of_each():
    """Words are those of str.lower and str.split; no run reaches into the next text, however texts are batched."""
    odd = "".join(chr(c) for c in range(0x3100))
    rows = ["", "  ", "a", "A b", "b A", " a\xa0b\x85c\x1cd\u3000e f G ", "x" * 8 + " " + "x" * 9 + " \0 \0\0 " + "x" * 16 + " " + "x" * 17, "\u0130b \u03a3\u0391\u03a3", odd, "a b c d e f a b c d e f", "f g"]
    s, tf, each = near_dedup.shingled(rows)
    named, at = {}, 0
    for text, n in zip(rows, each.tolist(), strict=True):
        w = text.lower().split()
        k = min(5, len(w))
        runs = collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else {}
        here, times = s[at : at + n].tolist(), tf[at : at + n].tolist()
        assert here == sorted(set(here)) and sorted(times) == sorted(runs.values())
        alone = near_dedup.shingles(text)
        assert (alone[0].tolist(), alone[1].tolist()) == (here, times)
        for run in runs:
            named.setdefault(run, near_dedup.shingles(" ".join(run))[0].tolist())
            assert named[run][0] in here
        at += n
    assert at == len(s) and len({v[0] for v in named.values()}) == len(named) == len(set(s.tolist()))
    idf = np.full(near_dedup.COUNTERS, 0.5, np.float32)
    assert near_dedup.signatures(rows * 40, idf) == [c * 40 for c in near_dedup.signatures(rows, idf)]


def test_icws_agrees_as_often_as_the_weighted_jaccard_says():
    rng = np.random.default_rng(8)
    s = rng.integers(0, 2**63, 400).astype(np.uint64)
    w = rng.choice([0.4, 0.7, 1.4], 400).astype(np.float32)
    a, b = np.arange(0, 300), np.arange(60, 400)
    draw = lambda at: near_dedup.samples(s[at], np.log(w[at]), np.array([0]), 2000)[:, 0] & np.uint64(0xFFFFFFFF)
    true = w[60:300].sum() / w.sum()
    assert np.mean(draw(a) == draw(b)) == pytest.approx(true, abs=0.04)


# -- 7


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(5, 64))
    x = centres[rng.integers(0, 5, 400)] + rng.normal(scale=0.6, size=(400, 64))
    x[100:160] = x[0]
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)] + [(500, None), (None, [1.0] * 64), (450, [1.0] * 3), (0, [float(v) for v in x[0]])]
    codes = topk.with_code(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    code = {r.id: r.code & (2**64 - 1) for r in codes.collect()}
    want = {q: sorted(((bin(code[q] ^ c).count("1"), i) for i, c in code.items()))[:7] for q in code if q % 50 == 0}
    for block in (10_000, 60):
        out = topk.top_k(codes, codes.where("id % 50 = 0"), 7, block_codes=block, block_queries=3).collect()
        got = collections.defaultdict(list)
        for r in sorted(out, key=lambda r: r["rank"]):
            got[r.query_id].append((r.distance, r.id))
        assert got == want


def test_top_k_reads_all_components_of_wider_vectors(spark):
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(4, 150))
    x = centres[rng.integers(0, 4, 200)] + rng.normal(scale=0.5, size=(200, 150))
    x[:, :64] = 1.0
    x[60:70] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(300, [1.0] * 64), (301, [1.0] * 70), (302, [])]
    bits = {i: np.array([v > 0 for v in r] + [False] * (150 - len(r))) for i, r in rows}
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = {q: sorted((int((bits[q] != b).sum()), i) for i, b in bits.items())[:10] for q in bits if q % 50 == 0}
    got = collections.defaultdict(list)
    for r in sorted(topk.report(vectors).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.distance, r.vec_id))
    assert got == want
    codes = topk.with_code(vectors)
    parts = topk.top_k(codes, codes.where("id % 50 = 0"), block_codes=40, block_queries=2).collect()
    assert sorted((r.query_id, r.distance, r.id) for r in parts) == sorted((q, *d) for q, ds in want.items() for d in ds)


# -- 8


def test_differencing():
    placed, sums = sharding.difference([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]])
    assert sorted(sums) == [14, 16]
    assert all(sorted(p) == [0, 1] for p in placed)
    rng = random.Random(10)
    weights = [rng.randrange(1, 10**6) for _ in range(2000)]
    placed, sums = sharding.difference([[w] + [0] * 23 for w in weights])
    again = [0] * 24
    for w, p in zip(weights, placed, strict=True):
        again[p[0]] += w
    assert again == sums and max(sums) - min(sums) <= 1000
    assert sharding.difference([]) == ([], [])


def test_shards_are_even_and_groups_whole(spark):
    rng = random.Random(11)
    rows = [(i, "é" * rng.randrange(1, 400) + str(rng.randrange(10**9))) for i in range(1500)] + [(2000 + i, "copy of one text") for i in range(300)]
    out = sharding.report(table(spark, rows)).collect()
    size, slots, text = collections.Counter(), collections.defaultdict(list), dict(rows)
    for r in out:
        assert r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.law == "bytes" and r.grown_shard is None
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(out) == len(rows) and sorted(size) == list(range(24)) and max(size.values()) - min(size.values()) <= 64
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in out if r.doc_id >= 2000}) == 1


def test_differencing_over_levels_is_as_even(spark, monkeypatch):
    rng = random.Random(15)
    weights = {f"g{k}": rng.randrange(1, 10**5) for k in range(3000)}
    groups = spark.createDataFrame(list(weights.items()), "group string, weight long")
    monkeypatch.setattr(sharding, "FAN", 4)
    size, got = collections.Counter(), sharding.assign(groups, 24, chunk_groups=60).collect()
    for r in got:
        size[r.shard] += weights[r.group]
    assert len(got) == 3000 and len(size) == 24 and max(size.values()) - min(size.values()) <= 5000


# -- 9


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(12)
    bad = ["fool" + x for x in ("", "s", "ish", "ery", "hardy")]

    def text(toxic):
        w = prose(rng, rng.randrange(40, 120)).split()
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        return " ".join(w)

    rows = [(i, text(i % 4 == 0)) for i in range(800)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(800)], "doc_id long, quality int, toxic int")
    out = toxicity.report(table(spark, rows), labels).collect()
    held = [r for r in out if r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert len(held) > 100 and np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.97


def test_toxicity_vocabulary_holds_known_words_once():
    known = {b"": 0, b"\0word": 1, b"wordy": 2}
    v = toxicity.Vocabulary(known)
    assert [v[w] for w in (b"wordy", b"words", b"other", b"words")] == [2, 1, 0, 1]
    assert len(v) == 5 and not any(isinstance(x, dict) for x in vars(v).values())
    again = pickle.loads(pickle.dumps(v))
    assert dict(again) == known == v.known and again[b"words"] == 1


def test_a_worker_forgets_other_operators_words():
    """The pipeline's stages share workers; what one of them remembers is no burden to the next."""
    model = toxicity.Model(toxicity.Vocabulary({b"": 0}), np.zeros((2, 1)), np.zeros(5), 0.0)
    path = packing.public_tokenizers.path(packing.RANKS)
    for other in (lambda: near_dedup.shingles("a b c d e f"), lambda: model.differences([b"a b"])):
        encoder = packing.encoder(path)
        assert encoder.ids("some words") and packing.encoder(path) is encoder
        held = weakref.ref(encoder)
        del encoder
        other()
        assert held() is None


def test_toxicity_models_are_brute_force_and_add_up_to_one():
    rng = random.Random(20)
    words = sorted({rng.choice(("abcde", "abcdx", "foo", "barbaz", "quux")) + rng.choice(("", "q", "rs", "tuv")) for _ in range(40)} - {""})
    words = [w.encode() for w in words]
    counts = [np.array([rng.choice((0, 0, 1, 1, 2, 3, 7)) for _ in words]) for _ in (0, 1)]
    counts[1][(counts[0] == 0) & (counts[1] == 0)] = 1
    model = toxicity.models(words, counts)
    nodes = {k for w in words for k in toxicity.path(w)[:-1]}
    for row in model.words:  # known words, unknown words of every beginning, and of none
        assert sum(math.exp(row[model.vocabulary.known[x]]) for x in {*words, *nodes, b""}) == pytest.approx(1)

    def level(key):
        return next(len(toxicity.path(w)[: toxicity.path(w).index(key) + 1]) for w in words if key in toxicity.path(w))

    keys = {k for w in words for k in toxicity.path(w)}
    below = collections.defaultdict(set)
    for w in words:
        for a, b in itertools.pairwise([b"", *toxicity.path(w)]):
            below[a].add(b)
    n = [collections.Counter() for _ in range(3)]
    for w, c0, c1 in zip(words, *counts, strict=True):
        for k in [b"", *toxicity.path(w)]:
            for c, x in enumerate((c0, c1, c0 + c1)):
                n[c][k] += int(x)
    d = [{deep: toxicity.discount(np.array([n[c][k] for k in keys if level(k) == deep])) for deep in range(1, 5)} for c in range(3)]

    def free(c, a):
        return sum(d[c][level(b)] for b in below[a] if n[c][b]) / n[c][a] if n[c][a] else 1.0

    def share(c, a, b):
        both = (max(n[2][b] - d[2][level(b)], 0) if b else 0) / max(n[2][a], 1) + free(2, a) / (sum(n[2][x] > 0 for x in below[a]) + 1)
        return (max(n[c][b] - d[c][level(b)], 0) if b else 0) / max(n[c][a], 1) + free(c, a) * both

    for word, chain in [(w, toxicity.path(w)) for w in words] + [(b"abcdzzz", [b"\0abcd", None]), (b"zz", [None])]:
        for c in (0, 1):
            p = math.prod(share(c, a, b) for a, b in itertools.pairwise([b"", *chain]))
            assert model.words[1 - c][model.vocabulary[word]] == pytest.approx(math.log(p)), word


# -- 10


def contamination_by_brute_force(rows, items, window=13):
    windows = collections.defaultdict(set)
    for name, t in items:
        w = fold_words((t or "").encode())
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(name))
    out = {}
    for i, t in rows:
        w, hit, names = fold_words((t or "").encode()), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    names |= got
        out[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_decontamination_is_brute_force(spark):
    rng = random.Random(13)
    small = WORDS[:6]
    items = [(k, " ".join(rng.choice(small) for _ in range(rng.randrange(8, 40)))) for k in range(30)] + [(30, "Amber, BIRCH!"), (31, ""), (32, None), (5, "ember é7 grove")]
    rows = []
    for i in range(80):
        parts = [" ".join(rng.choice(small) for _ in range(30)), rng.choice(items)[1] or "", prose(rng, 20)]
        rng.shuffle(parts)
        rows.append((i, " - ".join(parts)))
    rows += [(100, "amber birch " * 3000), (101, None), (102, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = contamination_by_brute_force(rows, items)
    for block in (1 << 20, 300):
        found = decontamination.find_contamination(table(spark, rows), bench, block_bytes=block)
        hits = {r.doc_id: sum(b - a for a, b in zip(r.contam_spans[::2], r.contam_spans[1::2], strict=True)) for r in found.collect()}
        assert hits == {i: w[1] for i, w in want.items()}
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.report(table(spark, rows), bench).collect()}
    assert got == want


def test_longest_matches(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    docs = table(spark, [(3, "x b c d y a b c"), (2, "c d e f"), (9, "z b c d e")])
    got = {r.item_word: (r.length, r.doc_id, r.doc_word) for r in decontamination.longest_matches(docs, bench, window=3).collect()}
    assert got == {0: (3, 3, 5), 1: (4, 9, 1), 2: (4, 2, 0), 3: (3, 2, 1)}
