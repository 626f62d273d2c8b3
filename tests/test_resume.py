"""Runs that stop and go on, the gate of the test split, and records."""

import pytest
from pyspark.sql import functions as F

from docgrain.operators import feedback
from docgrain.sources import resume


def test_a_run_that_stops_neither_repeats_nor_loses(spark, tmp_path):
    items = spark.range(200).select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("id"))
    seen = spark.sparkContext.accumulator(0)
    work = lambda df: df.withColumn("answer", F.upper("id"))
    run = resume.Run(spark, str(tmp_path / "run"), 7)
    assert run.results() is None and run.left(items).count() == 200
    assert run.carry_on(items, work, most=3) == [0, 1, 2]  # stopped between batches

    def dies(df):
        return df.withColumn("answer", F.when(F.pmod(F.xxhash64("id"), F.lit(5)) == 0, F.raise_error(F.lit("killed"))).otherwise(F.lit("half")))

    with pytest.raises(Exception, match="killed"):  # stopped inside a batch
        run.carry_on(items, dies)
    assert run.finished() == [0, 1, 2] and run.results().where("answer = 'half'").count() == 0
    (tmp_path / "run" / "batch=4").mkdir()
    (tmp_path / "run" / "batch=4" / "part-left-over.parquet").write_text("torn")
    again = resume.Run(spark, str(tmp_path / "run"), 7)
    before = {r["id"] for r in again.results().collect()}
    assert {r["id"] for r in again.left(items).collect()} == {r["id"] for r in items.collect()} - before
    asked = []
    assert again.carry_on(items, lambda df: (asked.extend(r["id"] for r in df.collect()), work(df))[1]) == [3, 4, 5, 6]
    assert not before & set(asked)
    rows = again.results().collect()
    assert sorted(r["id"] for r in rows) == sorted(r["id"] for r in items.collect()) and all(r["answer"] == r["id"].upper() for r in rows)
    assert again.carry_on(items, work) == [] and seen.value == 0


def test_the_gate(spark):
    finalists = spark.createDataFrame([("gpu_default",)], "value string")
    resume.admitted("gpu_default", "test", finalists)
    resume.admitted("anything", "dev", finalists)
    with pytest.raises(resume.FinalistGateError):
        resume.admitted("anything", "test", finalists)
    with pytest.raises(ValueError, match="dev or test"):
        resume.admitted("gpu_default", "train", finalists)


def test_boxes_of_one_page(spark):
    box = [{"x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0}]
    rows = spark.createDataFrame([(1, 1, 1, box), (2, 1, 2, box), (3, 4, None, box), (4, 1, 1, None)], "id int, page_no int, page_end int, boxes array<struct<x0:double,y0:double,x1:double,y1:double>>")
    got = {r["id"]: len(r["n"]) for r in rows.select("id", feedback.highlight_boxes(F.col("page_no"), F.col("page_end"), F.col("boxes")).alias("n")).collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: 0}
