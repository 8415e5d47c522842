from __future__ import annotations

import random

import corpus_pipeline
from studylens.llm import queries


def test_every_operator_is_registered():
    assert {k.split("_")[0] for k in queries.QUERIES if k.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "substring_dedup", "packing"]


def _docs(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(f"v{rng.randrange(3000)}" for _ in range(n))
    passage, near = text(60), text(400)
    rows = [(0, "plain  text\nof one"), (1, "plain text of one"), (2, near), (3, near + " more"), (4, text(50) + " " + passage), (5, passage + " " + text(50)), (6, None), (7, ""), (8, text(5000))]
    return spark.createDataFrame([(i, t, "en", None, len(t or ""), "extra") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n string")


def test_stages(spark, tmp_path):
    docs = _docs(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        kept[name] = {r.doc_id: r for r in now.collect()}
    assert set(kept["toxicity"]) == set(range(9))
    assert set(kept["exact_dedup"]) == {0, 2, 3, 4, 5, 6, 8}
    assert set(kept["near_dedup"]) == {0, 2, 4, 5, 6, 8}
    last = kept["substring_dedup"]
    assert last[0].text == "plain  text\nof one" and last[0].n == "extra" and last[6].text == ""
    assert len(last[4].text.split()) == 50 and len(last[5].text.split()) == 50 and last[4].n_chars == len(last[4].text)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(last)


def test_stages_on_an_empty_table(spark, tmp_path):
    empty = _docs(spark).limit(0)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == []


def test_toxicity_stage_with_a_fitted_model(spark, tmp_path):
    from .test_text_operators import _labelled

    docs, labels, truth = _labelled(spark)
    long = "ordinary words that go on " * 30_000
    odd = spark.createDataFrame([(9000, long, "x"), (9001, long + " idiot worthless scumbag pathetic" * 50, "x"), (None, "solver andmi renka tomi", "x"), (None, "solver andmi renka tomi", "x")], docs.schema)
    labels.filter("doc_id < 1100").write.parquet(f"{tmp_path}/labels.parquet")
    docs = docs.unionByName(odd)
    kept = corpus_pipeline.toxicity(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    unseen = {i: y for i, y in truth.items() if i >= 1100}
    assert sum(i not in ids for i, y in unseen.items() if y) >= 0.9 * sum(unseen.values())
    assert sum(i in ids for i, y in unseen.items() if not y) >= 0.97 * sum(not y for y in unseen.values())
    assert ids.count(None) == 2 and ids.count(5001) == 2 and 9000 in ids and 9001 not in ids


def test_toxicity_drops_nothing_without_a_model(spark, tmp_path):
    docs = _docs(spark)
    spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.toxicity(spark, docs, str(tmp_path)).count() == 9


def test_stages_on_missing_ids_and_repeated_rows(spark, tmp_path):
    rows = [(None, "copy of one text", 1), (None, "copy of one text", 1), (1, "copy of one text", 1), (2, "a b c d e f g h", 2), (2, "a b c d e f g h", 2), (3, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in pieces) == [1, 2, 3]  # one row of each text


def _texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_no_unique_text_is_lost_with_a_shared_id(spark, tmp_path):
    schema = "doc_id long, text string, row int"
    rows = spark.createDataFrame([(1, "A", 0), (2, "A", 0), (2, "B", 0)], schema)
    assert _texts(corpus_pipeline.exact(spark, rows, "")) == [(1, "A"), (2, "B")]
    rng = random.Random(2)
    long, other = (" ".join(f"w{rng.randrange(900)}" for _ in range(200)) for _ in range(2))
    rows = spark.createDataFrame([(1, long, 0), (2, long + " x", 0), (2, other, 0), (3, "", 0), (4, None, 0)], schema)
    near = corpus_pipeline.near(spark, rows, "")
    assert near.columns == rows.columns
    assert _texts(near) == sorted([(1, long), (2, other), (3, ""), (4, None)], key=repr)


def test_copies_without_ids_leave_one_row(spark):
    schema = "doc_id long, text string"
    rows = spark.createDataFrame([(None, "A"), (None, "A"), (None, "B"), (5, "B"), (3, "B"), (None, None), (None, "")], schema)
    kept = corpus_pipeline.exact(spark, rows, "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, ""), (0, "A"), (3, "B")]
