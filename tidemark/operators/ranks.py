"""Places in a global order without one task that sorts all rows: ranges first, with the places in each, then their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.staging import Steps

#: Rows of one range of a global order, about.
RANGE_ROWS = 1 << 20


def hashed_places(df: DataFrame, groups: list[str], order: Column, name: str, most: Column | None = None) -> DataFrame:
    """Place of each row, from 1, in its group's order by a hash in hexadecimal.

    The hash's first three digits split a group of any size into 4,096 even parts; a part's first place is
    the sum of the counts before it. ``most``: only the rows up to that place, which is the same for all rows of a group; of
    few groups, as the parts that hold such rows go to every task, and no row of another part is moved.
    """
    rows = df.withColumn("_order", order).withColumn("_head", F.substring("_order", 1, 3))
    if most is not None:
        rows = rows.withColumn("_most", most)
    counts = rows.groupBy(*groups, "_head").agg(F.count("*").alias("_n"), *([F.max("_most").alias("_last")] if most is not None else []))
    before = F.sum("_n").over(W.partitionBy(*groups).orderBy("_head").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_head").alias("_h"), F.coalesce(before, F.lit(0)).alias("_before"), *(["_last"] if most is not None else []))
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)]
    if most is not None:
        rows = rows.join(F.broadcast(starts.where("_before < _last")), [*same, F.col("_head") == F.col("_h")])
        placed = rows.withColumn(name, F.col("_before") + F.row_number().over(W.partitionBy(*groups, "_head").orderBy("_order")))
        return placed.where(F.col(name) <= F.col("_most")).select(*df.columns, name)
    placed = rows.withColumn("_in", F.row_number().over(W.partitionBy(*groups, "_head").orderBy("_order")))
    out = placed.join(starts, [*same, F.col("_head") == F.col("_h")])
    return out.withColumn(name, F.col("_before") + F.col("_in")).select(*df.columns, name)


def _ordered(df: DataFrame, groups: list[str], order: list[Column], steps: Steps) -> DataFrame:
    """``df`` in ranges of (groups, order), written with _part (the range) and _in (the place in it, from 0).

    There are as many ranges as shuffle partitions, and more where rows are many. Ranges end anywhere in the order, so
    rows of one value, or one group, take as many as they need if the order tells them apart.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
    names = [f"_o{i}" for i in range(len(order))]
    rows = df.select("*", *[c.alias(n) for n, c in zip(names, order)])
    rows = rows.repartitionByRange(parts, *[F.col(g) for g in groups], *names).sortWithinPartitions(*groups, *names)
    low = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return steps(rows.select(*df.columns, F.spark_partition_id().alias("_part"), low.alias("_in")), "ranges")


def _bounds(rows: DataFrame, groups: list[str]) -> DataFrame:
    """One row per range and group: its rows, the first one's place in the range, the group's rows in ranges before and in all."""
    per = rows.groupBy(*groups, "_part").agg(F.count("*").alias("_n"), F.min("_in").alias("_first"))
    w = W.partitionBy(*groups)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return per.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_part").alias("_range"), "_n", "_first", before.alias("_before"), F.sum("_n").over(w).alias("_all"))


def _with_bounds(rows: DataFrame, bounds: DataFrame, groups: list[str]) -> DataFrame:
    return rows.join(bounds, [*[F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)], F.col("_part") == F.col("_range")])


def places(df: DataFrame, value: Column, tie: list[Column], name: str) -> DataFrame:
    """Place of each row, from 1, in the order of a number and then of ``tie``, which tells rows apart."""
    steps = Steps(df.sparkSession)
    rows = _ordered(df, [], [value, *tie], steps)
    return _with_bounds(rows, F.broadcast(_bounds(rows, [])), []).withColumn(name, F.col("_before") + F.col("_in") - F.col("_first") + 1).select(*df.columns, name)


def quantiles(df: DataFrame, groups: list[str], value: str, shares: list[float], name: str) -> DataFrame:
    """groups and ``name``: the exact quantiles of the group's values, linear between neighbours. Nulls are left out.

    Values lie in ranges of their order; only the ranges that hold a wanted place are looked at again. Equal values may
    be in several ranges: they are told apart by a number of the row.
    """
    steps = Steps(df.sparkSession)
    own = df.select(*groups, F.col(value).cast("double").alias("_v")).where("_v is not null")
    # equal values are interchangeable: any spread will do, and the row that gets a place has the same value
    rows = _ordered(own, groups, [F.col("_v"), F.xxhash64(F.monotonically_increasing_id())], steps)
    bounds = steps(_bounds(rows, groups), "range-bounds")
    spots = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(q)) * (F.col("_all") - 1)).alias("at")) for i, q in enumerate(shares)])
    wanted = bounds.withColumn("_s", F.explode(spots)).withColumn("_place", F.explode(F.array_distinct(F.array(F.floor("_s.at"), F.ceil("_s.at")))))
    inside = wanted.where("_place >= _before and _place < _before + _n").select(*[c for c in bounds.columns], "_place", "_s")
    at = F.col("_before") + F.col("_in") - F.col("_first")
    hits = _with_bounds(rows, inside, groups).where(at == F.col("_place"))
    ends = hits.groupBy(*groups, F.col("_s.i").alias("_i"), F.col("_s.at").alias("_at")).agg(F.min_by("_v", "_place").alias("_lo"), F.max_by("_v", "_place").alias("_hi"))
    each = ends.withColumn("_q", F.col("_lo") + (F.col("_at") - F.floor("_at")) * (F.col("_hi") - F.col("_lo")))
    return each.groupBy(*groups).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda x: x["_q"]).alias(name))
