from pyspark.sql import types as T

import corpus_pipeline


def test_stages_keep_their_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.storage.written(stage(spark, docs, sf_dir), name)
        assert docs.columns == names and docs.dtypes == spark.read.parquet(f"{sf_dir}/documents.parquet").dtypes
        after = docs.count()
        assert 0 < after <= before
        before = after
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    assert len(ids) == len(set(ids))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in pieces} == set(ids)


def test_stages_on_awkward_rows(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words here", None, None, 15), (3, "a b " * 4000, "en", "s", 1)]
    for frame in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = frame
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.storage.written(stage(spark, docs, sf_dir), name)
        docs.collect()


def test_stages_keep_clashing_columns_and_do_what_they_say(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    base = docs.where("doc_id >= 0").collect()
    own = " ".join(f"word{i}" for i in range(90))
    extra = [(9001, own), (9002, own), (9003, own.replace("word45 ", "changed ")), (9004, " ".join(f"first{i}" for i in range(40)) + "\n" + " ".join(f"other{i}" for i in range(60))), (9005, " ".join(f"second{i}" for i in range(40)) + "\n" + " ".join(f"other{i}" for i in range(60))), (9006, item)]
    names = ["row_id", "row_key", "repeats", "bands", "found", "key", "node"]
    rows = [(*r, "r", 1, "x", 2, "f", 3, 4) for r in base] + [(i, t, "en", "s", len(t), None, None, None, None, None, None, None) for i, t in extra]
    schema = T.StructType(docs.schema.fields)
    for n, kind in zip(names, ("string", "integer", "string", "integer", "string", "integer", "integer"), strict=True):
        schema.add(n, kind)
    frame = spark.createDataFrame(rows, schema)
    stages = dict(corpus_pipeline.STAGES)
    one = corpus_pipeline.storage.written(stages["near_duplicates"](spark, frame, sf_dir), "one")
    ids = {r.doc_id for r in one.collect()}
    assert {9001, 9004, 9006} <= ids and not {9002, 9003} & ids
    cut = corpus_pipeline.storage.written(stages["substrings"](spark, one, sf_dir), "cut")
    text = {r.doc_id: r.text for r in cut.collect()}
    assert "other30" in text[9004] and "other" not in text[9005] and text[9005].startswith("second0 ")
    clean = stages["decontamination"](spark, cut, sf_dir)
    assert 9006 not in {r.doc_id for r in clean.collect()} and clean.columns == frame.columns
    values = {r.doc_id: tuple(r[n] for n in names) for r in frame.collect()}
    for step in (one, cut, clean, stages["quality"](spark, frame, sf_dir)):
        assert step.dtypes == frame.dtypes
        assert all(tuple(r[n] for n in names) == values[r.doc_id] for r in step.collect())
    assert 9001 in {r.doc_id for r in stages["packing"](spark, clean, sf_dir).collect()}
    assert stages["quality"](spark, frame, sf_dir).columns == frame.columns
