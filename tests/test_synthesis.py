"""Families of frames and windows: one reading of each, tasks that grow in number with the rows."""

from pyspark.sql import functions as F

from tidemark.operators import ranks, synthesis
from tidemark.plans import synthesis as P


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_window_families_read_a_window_once(spark, sf):
    assert plan(P.syn_window_families(spark, sf)).count("Relation [") == 1


def test_frame_families_read_a_frame_once(spark, sf):
    for query in (P.syn_frame_families, P.syn_invariants):
        assert plan(query(spark, sf)).count("Relation [") == 1


def test_frames_are_gathered_by_more_tasks_as_rows_grow(spark, monkeypatch):
    rows = spark.range(1000).select((F.col("id") % 300).alias("frame"), F.lit("a").alias("cls"), F.lit(0.25).alias("cx"), F.lit(0.75).alias("cy"))
    monkeypatch.setattr(synthesis, "TASK_ROWS", 50)
    assert synthesis.facts(rows, "frame").rdd.getNumPartitions() == 20
    assert synthesis.facts(rows, "frame").agg(F.sum("n")).first()[0] == 1000


def test_first_places_alone(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), "id")
    order = F.md5(F.col("id").cast("string"))
    every = ranks.hashed_places(rows, ["g"], order, "k").where(F.col("k") <= 7 + F.col("g"))
    first = ranks.hashed_places(rows, ["g"], order, "k", 7 + F.col("g"))
    assert {tuple(r) for r in first.collect()} == {tuple(r) for r in every.collect()}
