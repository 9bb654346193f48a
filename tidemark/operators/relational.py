"""Filters, joins, ordering and set operations of annotation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import seeded

Keys = list[str]


def part(df: DataFrame, fold: int, which: str) -> DataFrame:
    """Rows of a fold to validate on (``val``), those of the others (``train``), or all."""
    return df.where(F.col("fold") == fold) if which == "val" else df.where(F.col("fold") != fold) if which == "train" else df


def spliced(part_: DataFrame, control: DataFrame, key: str) -> DataFrame:
    """The rows of ``part_``, and of ``control`` those whose key it lacks."""
    return part_.unionByName(control.join(part_.select(key), key, "left_anti"))


def overwritten(base: DataFrame, other: DataFrame, key: str, value: str, where: Column) -> DataFrame:
    """``base`` with ``value`` taken from ``other`` where the condition holds and it has one."""
    new = other.select(key, F.col(value).alias("_new"))
    return base.join(new, key, "left").withColumn(value, F.when(where & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col(value))).drop("_new")


def first_rows(df: DataFrame, keys: Keys, order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in ``order``."""
    return df.withColumn("_rk", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rk") <= n).drop("_rk")


def round_robin(df: DataFrame, stratum: str, order: list[Column], n: int) -> DataFrame:
    """``n`` rows, taken in turn from the strata: all first rows, then all second ones."""
    rows = df.withColumn("rk", F.row_number().over(W.partitionBy(stratum).orderBy(*order)))
    return rows.orderBy("rk", stratum).limit(n)


def strided_shard(df: DataFrame, order: list[Column], n: int, i: int, bucket: Column | None = None) -> DataFrame:
    """Every n-th row from the i-th in order. With ``bucket`` the order is within buckets only."""
    w = (W.partitionBy(bucket) if bucket is not None else W.partitionBy()).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w) - 1).where(F.pmod("_rn", F.lit(n)) == i).drop("_rn")


def unique_ids(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Numbers the rows that share a key from 0: adds dup."""
    return df.withColumn("dup", F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1)


def length_grouped(df: DataFrame, length: str, key: str, groups: int, seed: str) -> DataFrame:
    """Order for batches of like length: seeded groups, each by falling length: adds grp, pos."""
    rows = df.withColumn("grp", F.pmod(F.conv(F.substring(seeded(seed, F.col(key)), 1, 7), 16, 10).cast("long"), F.lit(groups)))
    return rows.withColumn("pos", F.row_number().over(W.partitionBy("grp").orderBy(F.col(length).desc(), F.col(key))))


def reconciled(wanted: DataFrame, given: DataFrame, key: str, content: str) -> DataFrame:
    """Counts of a full outer reconciliation: missing, extra, duplicate and empty answers."""
    g = given.groupBy(key).agg(F.count("*").alias("_n"), F.count_if(F.coalesce(F.trim(content), F.lit("")) == "").alias("_empty"))
    w = wanted.select(key).distinct().withColumn("_w", F.lit(1))
    both = w.join(g, key, "full_outer")
    return both.agg(
        F.count_if(F.col("_n").isNull()).alias("missing"), F.count_if(F.col("_w").isNull()).alias("extra"),
        F.count_if(F.col("_n") > 1).alias("duplicates"), F.coalesce(F.sum("_empty"), F.lit(0)).alias("empties"),
    )


def total_output(wanted: DataFrame, given: DataFrame, key: str, content: str) -> DataFrame:
    """One row per wanted key, with an empty answer where none was given."""
    return wanted.select(key).join(given.select(key, content), key, "left").withColumn(content, F.coalesce(content, F.lit("")))


def last_wins(df: DataFrame, key: str, priority: str) -> DataFrame:
    """The row of the highest priority for each key."""
    return first_rows(df, [key], [F.col(priority).desc()])


def fingerprints(df: DataFrame, name: str, digest: Column) -> DataFrame:
    """Names with equal digests share one copy: alias_of is the first of them, null for itself."""
    first = F.min(name).over(W.partitionBy("digest"))
    rows = df.select(name, digest.alias("digest"))
    return rows.withColumn("alias_of", F.when(first != F.col(name), first))
