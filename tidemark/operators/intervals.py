"""Interval and as-of joins. All run as equi-joins on bins, so no join compares all rows with all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Keys = list[str]


def in_intervals(points: DataFrame, intervals: DataFrame, keys: Keys, t: str, start: str, end: str, pad: float, bin_: float) -> DataFrame:
    """Points that lie in some interval of their key, widened by ``pad`` on both sides, ends included.

    A point lies in one if the latest end among the intervals that start by then is not before it. That end is a
    running maximum within bins of ``bin_``, and over the bins before, one row each; so every row is sent once, however
    long its interval is.
    """
    names = points.columns
    at = points.select(F.struct(*[f"`{c}`" for c in names]).alias("_row"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(t).cast("double").alias("_t"), F.lit(None).cast("double").alias("_end"))
    starts = intervals.where(F.col(start) <= F.col(end)).select(F.lit(None).cast(at.schema["_row"].dataType).alias("_row"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.col(start) - pad).cast("double").alias("_t"), (F.col(end) + pad).cast("double").alias("_end"))
    both = at.unionByName(starts).withColumn("_bin", F.floor(F.col("_t") / F.lit(float(bin_))).cast("long"))
    own = [f"_k{i}" for i in range(len(keys))]
    here = F.max("_end").over(W.partitionBy(*own, "_bin").orderBy("_t", F.col("_end").isNull().cast("int")).rowsBetween(W.unboundedPreceding, 0))
    bins = both.groupBy(*own, "_bin").agg(F.max("_end").alias("_latest"))
    bins = bins.select(*[F.col(c).alias(f"b{c}") for c in own], F.col("_bin").alias("_b"), F.max("_latest").over(W.partitionBy(*own).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    both = both.withColumn("_here", here).where("_row is not null")
    found = both.join(bins, [*[F.col(c) == F.col(f"b{c}") for c in own], F.col("_bin") == F.col("_b")]).where(F.greatest("_here", "_before") >= F.col("_t"))
    return found.select("_row.*")


def _sized(df: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """Adds _level: the smallest for which the interval is no longer than ``least`` * 2 ** level."""
    return df.withColumn("_level", F.greatest(F.ceil(F.log2(F.greatest((F.col(b) - F.col(a)) / F.lit(float(least)), F.lit(1.0)))), F.lit(0)).cast("int"))


def _cell(x: Column, level: Column, least: float) -> Column:
    return F.floor(x / (F.lit(float(least)) * F.pow(F.lit(2.0), level))).cast("long")


def _placed(df: DataFrame, a: str, b: str, level: Column, least: float) -> DataFrame:
    """The cells of ``level`` that an interval meets: two or so where it is no longer than a cell."""
    return df.withColumn("_at", level).withColumn("_cell", F.explode(F.sequence(_cell(F.col(a), F.col("_at"), least), _cell(F.col(b), F.col("_at"), least))))


def _raised(df: DataFrame, levels: DataFrame, a: str, b: str, least: float, strict: bool) -> DataFrame:
    """Intervals in the cells of every level in use that is above their own, or not below it."""
    own = df.crossJoin(F.broadcast(levels))  # one row
    above = F.filter("_levels", lambda x: x > F.col("_level") if strict else x >= F.col("_level"))
    return _placed(own.withColumn("_up", F.explode(above)).drop("_levels"), a, b, F.col("_up"), least).drop("_up")


def clipped(intervals: DataFrame, windows: DataFrame, keys: Keys, bin_: float) -> DataFrame:
    """Parts of intervals (start, end) inside windows (lo, hi) of their key, of positive length.

    Lengths are put in classes, doubling from ``bin_`` on. Of two that overlap, the longer one lies in the cells of its
    own class, two or so, and the shorter one is sent to those it meets there, as many again; so rows grow with the
    number of classes in use, not with lengths.
    """
    left, right = _sized(intervals.where("start <= end"), "start", "end", bin_), _sized(windows.where("lo <= hi"), "lo", "hi", bin_)
    used = lambda df: df.agg(F.coalesce(F.collect_set("_level"), F.array().cast("array<int>")).alias("_levels"))

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.drop("_level").join(b.drop("_level"), [*keys, "_at", "_cell"]).where("start < hi and end > lo")
        # a pair that shares two cells counts where its common part begins
        return both.where(F.col("_cell") == _cell(F.greatest("start", "lo"), F.col("_at"), bin_)).drop("_at", "_cell")

    longer_windows = met(_raised(left, used(right), "start", "end", bin_, False), _placed(right, "lo", "hi", F.col("_level"), bin_))
    longer_intervals = met(_placed(left, "start", "end", F.col("_level"), bin_), _raised(right, used(left), "lo", "hi", bin_, True))
    both = longer_windows.unionByName(longer_intervals)
    return both.withColumn("clip_start", F.greatest("start", "lo")).withColumn("clip_end", F.least("end", "hi"))


def lowest_within(wanted: DataFrame, present: DataFrame, keys: Keys, t: str, back: int, ahead: int) -> DataFrame:
    """For each wanted t the lowest present one in [t - back, t + ahead]: adds hit (null if there is none)."""
    width = back + ahead + 1
    left = wanted.withColumn("_bin", F.explode(F.array(F.floor((F.col(t) - back) / F.lit(width)), F.floor((F.col(t) + ahead) / F.lit(width)))))
    right = present.select(*keys, F.col(t).alias("_t")).distinct().withColumn("_bin", F.floor(F.col("_t") / F.lit(width)))
    near = left.join(right, [*keys, "_bin"]).where((F.col("_t") >= F.col(t) - back) & (F.col("_t") <= F.col(t) + ahead))
    best = near.groupBy(*keys, t).agg(F.min("_t").alias("hit"))
    return wanted.join(best, [*keys, t], "left")


def nearest(wanted: DataFrame, present: DataFrame, keys: Keys, t: str) -> DataFrame:
    """For each wanted t the nearest present one of its key: adds near; of two as near, the lower.

    Both sides are put in one order per key; the last present t before and the first behind are carried along.
    """
    rows = wanted.select(*keys, t, F.lit(1).alias("_want")).unionByName(present.select(*keys, t, F.lit(0).alias("_want")))
    here = F.when(F.col("_want") == 0, F.col(t))
    w = W.partitionBy(*keys).orderBy(t, "_want")
    rows = rows.withColumn("_lo", F.last(here, True).over(w)).withColumn("_hi", F.first(here, True).over(w.rowsBetween(0, W.unboundedFollowing)))
    low = F.col("_hi").isNull() | (F.col(t) - F.col("_lo") <= F.col("_hi") - F.col(t))
    near = F.when(F.col("_lo").isNotNull() & low, F.col("_lo")).otherwise(F.col("_hi"))
    return rows.where("_want = 1").select(*keys, t, near.alias("near"))


def interpolated(wanted: DataFrame, known: DataFrame, keys: Keys, t: str, value: str) -> DataFrame:
    """Linear interpolation of (t, value) at wanted t, the ends held: adds value."""
    rows = wanted.select(*keys, t, F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_want"))
    rows = rows.unionByName(known.select(*keys, t, F.col(value).cast("double").alias("_v"), F.lit(0).alias("_want")))
    here = F.when(F.col("_want") == 0, F.struct(F.col(t).alias("t"), F.col("_v").alias("v")))
    w = W.partitionBy(*keys).orderBy(t, "_want")
    rows = rows.withColumn("_a", F.last(here, True).over(w)).withColumn("_b", F.first(here, True).over(w.rowsBetween(0, W.unboundedFollowing))).where("_want = 1")
    a, b = F.col("_a"), F.col("_b")
    mid = a["v"] + (b["v"] - a["v"]) * (F.col(t) - a["t"]) / (b["t"] - a["t"])
    out = F.when(a.isNull(), b["v"]).when(b.isNull() | (b["t"] == a["t"]) | (F.col(t) == a["t"]), a["v"]).otherwise(mid)
    return rows.select(*keys, t, out.alias(value))


def same_bin(points: DataFrame, seeds: DataFrame, keys: Keys, t: str, bin_: int) -> DataFrame:
    """Seeds in the half-open bin of each point: adds seed_t."""
    right = seeds.select(*keys, F.col(t).alias("seed_t"), F.floor(F.col(t) / F.lit(bin_)).alias("_bin"))
    return points.withColumn("_bin", F.floor(F.col(t) / F.lit(bin_))).join(right, [*keys, "_bin"]).drop("_bin")


def same_state(anchors: DataFrame, states: DataFrame, keys: Keys, t: str, state: str) -> DataFrame:
    """All t that share the state at the anchor's t."""
    at = anchors.join(states, [*keys, t]).select(*keys, F.col(t).alias("anchor_t"), state)
    return at.join(states, [*keys, state])
