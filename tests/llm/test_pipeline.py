import random

import corpus_pipeline
from vellum.llm.common import Scratch, prepare


def test_stages(spark, tmp_path):
    """A small corpus with planted cases: toxic texts, repeated passages, copies and benchmark passages."""
    rng = random.Random(21)
    words = [a + b for a in ("bal", "cor", "dim", "fen", "gul", "hab") for b in ("ta", "ro", "mi", "ne", "su", "po", "la", "ki")]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice("xyz") + str(rng.randrange(50)) for _ in range(n))
    item, passage = prose(30), prose(60)
    rows = {i: prose(80) + "\n" + prose(40) for i in range(300)}
    toxic = [i for i in rows if i % 4 == 0]
    for i in toxic:
        w = rows[i].split(" ")
        for _ in range(5):
            w.insert(rng.randrange(len(w)), "rotten" + rng.choice(["", "est", "ly"]))
        rows[i] = " ".join(w)
    rows[301] = prose(20) + "\n" + passage + "\n" + prose(20)
    rows[302] = prose(20) + "\n" + passage + "\n" + prose(20)
    rows[303] = " ".join(["changed", *rows[1].replace("\n", " ").split()[1:]])
    rows[305] = prose(40) + " " + item + " " + prose(40)
    labels = [(i, 1, int(i in toxic)) for i in range(300)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = Scratch(prepare(spark), "test").save(stage(spark, docs, str(tmp_path)))
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert name == "packing" or docs.columns == columns
    clean = {i for i in rows if i not in toxic}
    assert len(set(toxic) & set(kept["toxicity"])) <= 3 and len(clean - set(kept["toxicity"])) <= 3
    lines = kept["line dedup"]
    assert passage in lines[301].text and passage not in lines[302].text and len(lines) == len(kept["toxicity"])
    assert set(lines) - set(kept["near dedup"]) == {303} & set(lines)
    assert set(kept["near dedup"]) - set(kept["decontamination"]) == {305}
    assert set(kept["packing"]) == set(kept["decontamination"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_pipeline_takes_odd_rows_and_empty_tables(spark, tmp_path):
    """Null, empty and very long texts, ties, repeated rows, a column of a clashing name; and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, tox_score int"
    odd = [(1, None), (2, ""), (3, " \n "), (None, "one two three four five six"), (4, "word " * 20_000), (5, "same text of a few words here"), (5, "same text of a few words here"), (6, "x")]
    for name, rows in (("odd", odd), ("none", [])):
        top = tmp_path / name
        spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7) for i, t in rows], schema).write.parquet(str(top / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(top / "labels.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(top / "benchmark.parquet"))
        got = {r.doc_id for r in corpus_pipeline.run(spark, str(top)).collect()}
        assert got == ({None, 1, 3, 4, 5, 6} if rows else set()), got
