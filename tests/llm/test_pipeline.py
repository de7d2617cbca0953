"""The pipeline over a small table: copies, near-copies, shared passages, benchmark passages and junk."""

import functools
import random

from pyspark.sql import functions as F

import corpus_pipeline
from tidewheel.llm import decontam


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["an", "er", "th", "on", "ing", "re"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    item, item2, passage = prose(20), prose(20), prose(60)
    base = prose(120)
    near = base.split(" ")
    near[60] = "other"
    rows = [(i, prose(80), "en") for i in range(30)]
    rows += [(100, base, "en"), (101, base, "en"), (102, " ".join(near), "en"), (103, "12 34 !!", "en"), (104, None, "en"), (105, "", "en")]
    rows += [(110, f"{prose(50)} {item} {prose(50)} {item2} x", "en"), (111, f"{prose(40)} {item} {prose(40)}", "en")]
    rows += [(120 + i, f"{prose(70)} {passage} {prose(70)}", "en") for i in range(3)]
    docs = spark.createDataFrame([(i, t, x, "s", len(t or "")) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, item2)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r["doc_id"]: r["text"] if k < 4 else None for r in docs.collect()}
    assert set(range(30)) <= set(kept["pack"])  # clean documents stay
    assert not {103, 104, 105} & set(kept["language"])
    assert {100} == {100, 101, 102} & set(kept["near_duplicates"])
    assert all(passage not in kept["repeated_substrings"][i] for i in (120, 121, 122))
    assert 110 not in kept["decontaminate"] and item not in kept["decontaminate"][111]


def test_decontamination_takes_a_benchmark_of_several_blocks(spark, tmp_path, monkeypatch):
    items = [" ".join(f"w{k}x{i}" for i in range(10)) for k in range(6)]
    rows = [(1, f"a {items[0]} b", 1), (2, f"{items[1]} c {items[4]}", 2), (3, "clean", 3), (None, None, None), (5, f"{items[5]}, {items[5]} d", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    whole = sorted(map(repr, corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()))
    monkeypatch.setattr(decontam, "spans", functools.partial(decontam.spans, limit_bytes=60))
    got = corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()
    assert sorted(map(repr, got)) == whole
    assert {r["doc_id"]: r["text"] and " ".join(r["text"].split()) for r in got} == {1: "a b", 3: "clean", None: None, 5: "d"}  # touching spans are one


def test_language_without_a_model_keeps_texts_with_letters(spark):
    rows = [(1, "clean text", None), (2, "12 34 !!", None), (3, None, None), (4, "", None), (None, "é", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect()} == {1, None}


def test_stages_take_odd_rows_columns_and_empty_tables(spark, tmp_path):
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    same, other, long_ = prose(60), prose(60), prose(3000)
    rows = [(1, same, "en", "x", 1), (1, same, "en", "x", 1), (None, other, "en", None, None), (None, None, None, None, None), (4, "", "en", "y", 0), (5, long_, None, "z", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _text string, uses long").withColumn("text_key", F.lit("k")).withColumn("kept", F.lit(7))
    spark.createDataFrame([(1, prose(12))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.where("doc_id < 0"), str(tmp_path))
        assert none.count() == 0
        got = stage(spark, docs, str(tmp_path))
        if name == "pack":
            assert got.select("doc_id").distinct().count() == 4
            continue
        assert got.columns == docs.columns
        kept = [r["doc_id"] for r in got.collect() if r["text"]]
        want = {"language": [1, 1, 5, None], "near_duplicates": [1, 5, None], "repeated_substrings": [5, None], "decontaminate": [1, 1, 5, None]}[name]
        assert sorted(kept, key=str) == sorted(want, key=str), name
