import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(0)
    pool = [f"w{i}" for i in range(900)]
    prose = lambda n: " ".join(rng.choices(pool, k=n))
    item, shared = prose(40), prose(60)
    near = prose(200).split()
    docs = {i: prose(80) for i in range(60)}
    docs |= {100: docs[3], 101: " ".join(near), 102: " ".join(near[:100] + ["zz"] + near[101:]), 103: prose(30) + " " + item + " " + prose(30), 104: shared + "\n" + prose(50), 105: prose(50) + "\n" + shared, 106: "You idiot. Pathetic scum, worthless trash, stupid loser.", 107: ""}
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs.items()], columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, str(tmp_path))
        kept.append({r[0] for r in table.select("doc_id").distinct().collect()})
        if name == "line dedup":
            texts = {r.doc_id: r.text for r in table.collect()}
            assert shared in texts[104] and shared not in texts[105] and all(r.n_chars == len(r.text) for r in table.collect())
        if name != "packing":
            assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    every = set(docs)
    assert 102 not in kept[2]  # the line stage may find it first
    assert [k - {102} for k in kept] == [every - {106, 102}, *[every - {106, 100, 102}] * 2, *[every - {106, 100, 102, 103}] * 2]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()} == kept[-1]


def test_empty_and_null_rows(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, None, None, None, None), (None, "a b", None, None, 3)], columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == 2


def test_line_stage_finds_what_shares_no_run(spark):
    """Short lines, and lines of which every other word is mistyped, go in the pipeline's line stage too."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(40)]
    texts = ["acknowledgement", "acknowlegdement", " ".join(words), " ".join(w if k % 2 else w[:3] + "9" + w[4:] for k, w in enumerate(words)), "something else"]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], columns)
    assert {r.doc_id for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()} == {0, 2, 4}
