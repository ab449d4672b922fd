import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.fixtures import SCHEMA, rows
from tests.llm.test_classifiers import small
from tests.llm.test_simhash import plain_similar

SF = "/root/testdata/sf0.001"


def test_stages_and_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        after = out.collect()
        ids = {r.doc_id for r in after}
        if name == "near_duplicates":
            order = sorted(before, key=lambda r: r.doc_id)
            label = plain_similar([r.text or "" for r in order])
            assert ids == {order[i].doc_id for i in label.values()} and len(after) == len(ids)
        else:
            column, bad = {"quality": ("quality", 0), "toxicity": ("toxic", 1)}[name]
            known = [r.doc_id for r in before if r.doc_id in labels]
            right = np.mean([(i in ids) == (labels[i][column] != bad) for i in known])
            assert right > 0.85, (name, right)
        assert set(map(tuple, after)) <= set(map(tuple, before))
        docs, before = spark.createDataFrame(after, docs.schema), after
    packed = corpus_pipeline.packing_stage(spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in before}


def test_run_is_its_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_odd_rows_pass_through(spark, tmp_path):
    _, labels = small(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows(), SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() <= docs.count()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.packing_stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.near_duplicate_stage(spark, docs.where(F.col("doc_id").isNull()), str(tmp_path)).count() <= 2


def test_clashing_names_pass_through(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 7, 8, 9), (2, "a b c d e f", 7, 8, 9)], "doc_id long, text string, __row long, component long, fps long")
    assert list(map(tuple, corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect())) == [(1, "a b c d e f", 7, 8, 9)]


def test_one_row_of_each_component_stays(spark):
    a, b, c, d = ("apple pie with cream", "seven grey ships at sea", "a cold wind blew over", "nobody knew the old song")
    table = [(1, a), (1, a), (None, a), (None, b), (None, b), (None, b), (5, c), (5, d), (9, d)]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()), key=str) == sorted([(1, a), (None, b), (5, c), (5, d)], key=str)
