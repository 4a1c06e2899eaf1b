"""The pipeline's stages, one after the other, on planted cases."""

import random

import corpus_pipeline
from archlens.llm import queries


def text(rng, n):
    return " ".join("".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_pipeline_keeps_clean_and_drops_planted(spark, tmp_path):
    rng = random.Random(5)
    clean = [(i, text(rng, 120), "en", "a", 1) for i in range(30)]
    item, passage = text(rng, 30), text(rng, 60)
    copies = [(100 + i, clean[i][1], "en", "b", 1) for i in range(3)]
    words = clean[4][1].split(" ")
    near = [(110, " ".join([*words[:60], "other", *words[61:]]), "en", "b", 1)]
    leaks = [(120, text(rng, 50) + " " + item + " " + text(rng, 50), "en", "b", 1)]
    shared = [(130 + i, text(rng, 70) + " " + passage + "\n" + text(rng, 70), "en", "b", 1) for i in range(3)]
    bad = [(140, None, "en", "a", None), (141, "", "en", "a", 0), (142, "1234 !!", None, None, 7)]
    spark.createDataFrame(clean + copies + near + leaks + shared + bad, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, text(rng, 25))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out/{name}")
        docs = spark.read.parquet(f"{tmp_path}/out/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
    ids = {name: set(rows) for name, rows in seen.items()}
    assert ids["language"] == set(range(30)) | {100, 101, 102, 110, 120, 130, 131, 132}
    assert ids["near_duplicates"] == set(range(30)) | {120, 130, 131, 132}
    assert ids["repeats"] == ids["near_duplicates"]
    assert all(passage not in r.text and len(r.text.split()) == 140 for i, r in seen["repeats"].items() if i >= 130)
    assert all(seen["repeats"][i].text == t for i, t, *_ in clean)
    assert ids["leaks"] == ids["packing"] == ids["repeats"] - {120}


def test_pipeline_keeps_rows_without_an_id(spark, tmp_path):
    rng = random.Random(9)
    alone, twin, item, other = text(rng, 120), text(rng, 120), text(rng, 30), text(rng, 120)
    words = twin.split(" ")
    near = " ".join([*words[:60], "other", *words[61:]])
    leak = text(rng, 50) + " " + item + " " + text(rng, 50)
    rows = [(None, alone), (None, alone), (None, twin), (4, twin), (2, near), (None, leak), (9, other)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    key = lambda df: sorted([(r.doc_id or 0, r.text) for r in df.collect()])
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).cache()
    assert key(kept) == sorted([(0, alone), (2, near), (0, leak), (9, other)])
    assert key(corpus_pipeline.drop_leaks(spark, kept, str(tmp_path))) == sorted([(0, alone), (2, near), (9, other)])


def test_near_duplicates_send_texts_once(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, text(rng, 30), "en", "a", 1) for i in (1, 2, 2, None)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
        behind_join = kept._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")
        assert len(behind_join) > 1 and "Window" in behind_join[0] and "Exchange" not in behind_join[0]
        assert kept.count() == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pipeline_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
