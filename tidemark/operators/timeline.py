"""Timeline algebra over long rows (key columns, t, value): runs, smoothing, change points, edges, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.chains import greedy

Keys = list[str]


def runs(df: DataFrame, keys: Keys, t: str, step: int | float = 1) -> DataFrame:
    """Maximal runs of rows that are ``step`` apart: keys, start, end (exclusive), n."""
    w = W.partitionBy(*keys).orderBy(t)
    fresh = (F.col(t) - F.lag(t).over(w) != step) | F.lag(t).over(w).isNull()
    rows = df.select(*keys, t).distinct().withColumn("_run", F.sum(fresh.cast("int")).over(w))
    return rows.groupBy(*keys, "_run").agg(F.min(t).alias("start"), (F.max(t) + step).alias("end"), F.count("*").alias("n")).drop("_run")


def label_segments(df: DataFrame, keys: Keys, t: str, label: str) -> DataFrame:
    """Stretches of an unchanged label over all rows of a key: keys, start, end (inclusive), label, n."""
    w = W.partitionBy(*keys).orderBy(t)
    fresh = ~F.lag(label).over(w).eqNullSafe(F.col(label)) | (F.row_number().over(w) == 1)
    rows = df.withColumn("_seg", F.sum(fresh.cast("int")).over(w))
    return rows.groupBy(*keys, "_seg").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.first(label).alias(label), F.count("*").alias("n"))


def dense(df: DataFrame, keys: Keys, t: str, value: Column, name: str) -> DataFrame:
    """One row per key and integer t between the key's first and last: ``name`` is ``value``, or 0 where no row is."""
    span = df.groupBy(*keys).agg(F.min(t).alias("_a"), F.max(t).alias("_b")).select(*keys, F.explode(F.sequence("_a", "_b")).alias(t))
    marks = df.groupBy(*keys, t).agg(value.alias(name))
    return span.join(marks, [*keys, t], "left").withColumn(name, F.coalesce(name, F.lit(0)))


def eroded(df: DataFrame, keys: Keys, t: str, mask: str, k: int) -> DataFrame:
    """Rows whose window of ``k`` rows, k // 2 back and (k - 1) // 2 on, is all set."""
    w = W.partitionBy(*keys).orderBy(t).rowsBetween(-(k // 2), (k - 1) // 2)
    return df.withColumn("_kept", F.sum(F.col(mask)).over(w) >= k).where("_kept").drop("_kept")


def dilated(df: DataFrame, keys: Keys, t: str, mask: str, radius: int, name: str = "dilated") -> DataFrame:
    w = W.partitionBy(*keys).orderBy(t).rowsBetween(-radius, radius)
    return df.withColumn(name, F.max(mask).over(w))


def change_points(df: DataFrame, keys: Keys, t: str, value: str, k: int) -> DataFrame:
    """Rows where the floor of the centred mean over ``k`` rows differs from the row before: adds level, delta."""
    w = W.partitionBy(*keys).orderBy(t)
    level = F.floor(F.sum(value).over(w.rowsBetween(-(k // 2), (k - 1) // 2)) / F.lit(k))
    rows = df.withColumn("level", level).withColumn("delta", F.col("level") - F.lag("level").over(w))
    return rows.where("delta <> 0")


def edges(df: DataFrame, keys: Keys, t: str) -> DataFrame:
    """First and last t and number of rows of each key."""
    return df.groupBy(*keys).agg(F.min(t).alias("first_t"), F.max(t).alias("last_t"), F.count("*").alias("n"))


def nth_class(df: DataFrame, keys: Keys, t: str, cls: str, n: int) -> DataFrame:
    """The class that is the n-th to appear in each key; classes that start together go by name."""
    first = df.groupBy(*keys, cls).agg(F.min(t).alias("first_t"))
    return first.withColumn("_rk", F.row_number().over(W.partitionBy(*keys).orderBy("first_t", cls))).where(F.col("_rk") == n).drop("_rk")


def thinned(df: DataFrame, keys: Keys, t: str, gap: float) -> DataFrame:
    """Greedy thinning: a row stays if it lies ``gap`` or more behind the last row that stayed; keys and t, each once."""
    return greedy(df, keys, t, gap)


def forward_windows(df: DataFrame, keys: Keys, t: str, span: int, least_rows: int, least_span: int) -> DataFrame:
    """Windows that each row opens, ``span`` long: n rows, last t, if enough rows and long enough."""
    w = W.partitionBy(*keys).orderBy(t).rangeBetween(0, span)
    rows = df.withColumn("n", F.count("*").over(w)).withColumn("last_t", F.max(t).over(w))
    return rows.where((F.col("n") >= least_rows) & (F.col("last_t") - F.col(t) >= least_span))


def both_present(df: DataFrame, keys: Keys, cls: str, name: str = "n") -> DataFrame:
    """Pairs of classes (a < b) that share a key, and in how many keys they do."""
    marks = df.select(*keys, cls).distinct()
    other = marks.select(*keys, F.col(cls).alias("cls_b"))
    pairs = marks.withColumnRenamed(cls, "cls_a").join(other, keys).where("cls_a < cls_b")
    return pairs.groupBy("cls_a", "cls_b").agg(F.count("*").alias(name))


def peaks(df: DataFrame, keys: Keys, t: str, value: str, n: int, radius: int) -> DataFrame:
    """Up to ``n`` rows of the largest value in each key, none within ``radius`` of a larger one chosen before.

    Times are whole numbers, each once in a key. A chosen row rules out at most 2 * radius others, so the
    first n * (2 * radius + 1) rows of a key decide, and no more of it is gathered.
    """
    w = W.partitionBy(*keys).orderBy(F.col(value).desc(), F.col(t))
    top = df.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= n * (2 * radius + 1))
    arr = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("neg"), F.col(t).alias("t")))).alias("_p"))
    none = F.filter("_p", lambda x: F.lit(False))
    free = lambda a, x: ~F.exists(a, lambda y: F.abs(y["t"] - x["t"]) <= radius)
    kept = F.aggregate("_p", none, lambda a, x: F.when((F.size(a) < n) & free(a, x), F.concat(a, F.array(x))).otherwise(a))
    return arr.select(*keys, F.posexplode(kept).alias("rk", "_x")).select(*keys, (F.col("rk") + 1).alias("rk"), F.col("_x.t").alias(t), (-F.col("_x.neg")).alias(value))


def strided(df: DataFrame, keys: Keys, t: str, stride: int) -> DataFrame:
    """Every ``stride``-th row of each key, once for every offset: adds offset."""
    rows = df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(t)) - 1)
    return rows.withColumn("offset", F.pmod("_rn", F.lit(stride))).drop("_rn")


def thinned_evenly(df: DataFrame, keys: Keys, t: str, per: int) -> DataFrame:
    """At most ``per`` rows of each key at equal intervals of its order."""
    w = W.partitionBy(*keys)
    rows = df.withColumn("_rn", F.row_number().over(w.orderBy(t)) - 1).withColumn("_n", F.count("*").over(w))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / F.lit(per)))
    return rows.where((F.col("_rn") % step == 0) & (F.col("_rn") / step < per)).drop("_rn", "_n")


def cumulative_share(df: DataFrame, keys: Keys, t: str, weight: str) -> DataFrame:
    w = W.partitionBy(*keys)
    return df.withColumn("cdf", F.sum(weight).over(w.orderBy(t).rowsBetween(W.unboundedPreceding, 0)) / F.sum(weight).over(w))


def representatives(df: DataFrame, keys: Keys, bin_: Column, order: list[Column]) -> DataFrame:
    """One row per key and bin, the first in ``order``."""
    rows = df.withColumn("bin", bin_)
    return rows.withColumn("_rk", F.row_number().over(W.partitionBy(*keys, "bin").orderBy(*order))).where("_rk = 1").drop("_rk")


def grid_phase(df: DataFrame, keys: Keys, t: str, bin_: int) -> DataFrame:
    """The most common t % bin among rows without a direct neighbour, if it has 3 rows and half of them.
    Equal counts go to the smaller phase."""
    have = df.select(*keys, t).distinct()
    w = W.partitionBy(*keys).orderBy(t)
    alone = have.withColumn("_a", F.coalesce(F.col(t) - F.lag(t).over(w) > 1, F.lit(True)) & F.coalesce(F.lead(t).over(w) - F.col(t) > 1, F.lit(True))).where("_a")
    counts = alone.groupBy(*keys, F.pmod(F.col(t), F.lit(bin_)).alias("phase")).agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.max_by("phase", F.struct("n", -F.col("phase"))).alias("phase"), F.max("n").alias("n"), F.sum("n").alias("total"))
    return best.where("n >= 3 and 2 * n >= total")
