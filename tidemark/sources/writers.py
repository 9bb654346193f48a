"""Sinks. Invariants are checked on the written rows' source before anything is published."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sorted_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """CSV files in order: parts follow each other, and rows in a part."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").csv(path, header=True)


def checked_parquet(df: DataFrame, path: str, unique: list[str], rules: dict[str, Column]) -> None:
    """Parquet, if the keys are unique and no row breaks a rule; all checks are one pass over the staged rows."""
    spark, own = df.sparkSession, f"{path}.staged-{uuid.uuid4().hex}"
    df.write.parquet(own)
    rows = spark.read.schema(df.schema).parquet(own)
    bad = {k: n for k, n in rows.agg(*[F.count_if(c).alias(k) for k, c in rules.items()] or [F.lit(0).alias("none")]).first().asDict().items() if n}
    if rows.groupBy(*unique).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        bad["unique"] = 1
    fs = spark._jvm.org.apache.hadoop.fs.Path(own)
    store = fs.getFileSystem(spark._jsc.hadoopConfiguration())
    if bad:
        store.delete(fs, True)
        raise ValueError(f"rows against the rules: {bad}")
    # the published folder is moved aside and goes only after the new one has its name
    name, aside = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.old-{uuid.uuid4().hex}"))
    had = store.exists(name) and store.rename(name, aside)
    if not store.rename(fs, name):
        if had:
            store.rename(aside, name)
        raise OSError(f"{own} could not be moved to {path}")
    if had:
        store.delete(aside, True)


def by_partition(df: DataFrame, path: str, keys: list[str]) -> None:
    """One folder per key; only the folders of keys in ``df`` are replaced, so a run can be repeated."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def answers_json(df: DataFrame, path: str) -> None:
    """Answers (qID, content, latency) as JSON lines."""
    df.select("qID", "content", "latency").write.mode("overwrite").json(path)
