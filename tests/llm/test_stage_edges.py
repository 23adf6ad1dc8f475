"""Clashing column names, null ids, repeated rows and ids that several texts share, in every stage."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

MORE = ("score", "predicted", "held_out", "row", "rest", "all", "drops", "n_lines", "n_dropped", "component_id", "a.b", "stays", "number")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    top, rng = str(tmp_path_factory.mktemp("edges")), random.Random(3)
    pool = [f"w{i}" for i in range(900)]
    prose = lambda n: " ".join(rng.choices(pool, k=n))
    item, near, same = prose(40), prose(120), prose(50)
    rows = [(i, prose(60)) for i in range(8)]
    rows += [(None, prose(30) + " " + item), (None, prose(40)), (20, prose(30) + " " + item), (20, prose(50)), (30, near), (30, near + " more"), (40, same), (40, same), (50, None), (51, ""), (52, "You idiot. Pathetic scum, worthless trash, stupid loser.")]
    columns = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in MORE)
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or ""), *(f"{c}{i}" for c in MORE)) for i, (k, t) in enumerate(rows)], columns)
    docs.write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top, rows


#: Rows, by their place in the table, that each stage takes out of it.
GONE = {"toxicity": [{18}], "line dedup": [{11, 13, 15}, {11, 13, 14}, {11, 12, 15}, {11, 12, 14}, {13, 15}, {13, 14}, {12, 15}, {12, 14}], "n-gram Jaccard join": [{a, b} for a in (12, 13) for b in (14, 15)], "benchmark decontamination": [{8, 10}]}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, tables, name):
    top, rows = tables
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{top}/documents.parquet")
    out = stage(spark, docs, top)
    assert stage(spark, docs.limit(0), top).count() == 0
    if name == "packing":
        assert out.groupBy("doc_id").count().count() == len({k for k, _ in rows})
        return
    assert out.columns == docs.columns
    kept = [(int(r.score.removeprefix("score")), r) for r in out.collect()]
    assert len({i for i, _ in kept}) == len(kept)
    assert all(r.asDict()[c] == f"{c}{i}" for i, r in kept for c in MORE)
    assert set(range(len(rows))) - {i for i, _ in kept} in GONE[name]
