"""The pipeline's stages on a small table: columns, decisions, and what packing makes of the rest."""

import random

import corpus_pipeline


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    rng = random.Random(2)
    clean = [" ".join(f"wort{rng.randrange(3000)}" for _ in range(90)) for _ in range(60)]
    passage = " ".join(f"gemein{i}" for i in range(60))
    rows = [(i, t, "de", "s", len(t)) for i, t in enumerate(clean)]
    rows += [(100, clean[0], "de", "s", 1), (101, clean[1] + " " + passage, "de", "s", 1), (102, clean[2][::-1] + " " + passage, "de", "s", 1), (103, "x " * 90, "de", "s", 1), (104, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sizes = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sizes[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert not sizes["quality"] & {103, 104} and 100 not in sizes["near_dedup"] and set(range(60)) <= sizes["near_dedup"] | {1}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sum(passage in (t or "") for t in text.values()) == 1
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == sizes["substring_dedup"]


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
