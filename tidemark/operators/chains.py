"""Greedy choices along the times of a key as chains of successors.

A greedy rule that keeps the first time at least a gap behind the last one kept depends on every choice before it.
But the time that would follow any given one is known without them. So all times get a pointer to their successor, and
what the rule keeps is what pointers reach from the first time: by pointer doubling in as many rounds as the
logarithm of the chain's length, each a join on (key, time). Keys of few rows are folded as one array instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.staging import Steps

Keys = list[str]

#: A stretch of at most so many times may be folded as one array.
MANY = 10_000
#: Gaps in a bin; times are put in order by bins, so that no task sorts all of a key.
BIN = 256


def _same(left: DataFrame, right: DataFrame, keys: Keys, prefix: str = "_k") -> list[Column]:
    return [left[k].eqNullSafe(right[f"{prefix}{i}"]) for i, k in enumerate(keys)]


def _named(df: DataFrame, keys: Keys, *more: Column | str, prefix: str = "_k") -> DataFrame:
    return df.select(*[F.col(k).alias(f"{prefix}{i}") for i, k in enumerate(keys)], *more)


def neighbours(rows: DataFrame, keys: Keys, t: str, gap: float, strict: bool = False) -> DataFrame:
    """Of distinct (keys, t): prev (the time before) and next (the first time ``gap`` or more behind; more, if strict).

    Both are looked for in the bin, and beyond it among one row per bin.
    """
    width = float(gap) * BIN
    bin_ = lambda x: F.floor(x / F.lit(width)).cast("long")
    asks = rows.select(*keys, F.col(t).alias("_for"), (F.col(t) + F.lit(gap)).alias("_at")).withColumn("_bin", bin_(F.col("_at"))).withColumn("_have", F.lit(None).cast(rows.schema[t].dataType))
    have = rows.select(*keys, F.lit(None).cast(rows.schema[t].dataType).alias("_for"), F.col(t).alias("_at")).withColumn("_bin", bin_(F.col("_at"))).withColumn("_have", F.col("_at"))
    both = have.unionByName(asks.select(*have.columns))
    own = W.partitionBy(*keys, "_bin")
    # from the latest down, what lies at an asked time first unless it must lie behind
    down = own.orderBy(F.desc("_at"), (F.col("_have").isNull() if not strict else F.col("_have").isNotNull()).cast("int"))
    up = own.orderBy("_at", F.col("_have").isNull().cast("int"))
    both = both.withColumn("_next", F.last("_have", True).over(down.rowsBetween(W.unboundedPreceding, 0)))
    both = both.withColumn("_prev", F.last("_have", True).over(up.rowsBetween(W.unboundedPreceding, -1)))
    bins = both.groupBy(*keys, "_bin").agg(F.min("_have").alias("_first"), F.max("_have").alias("_last"))
    of_key = W.partitionBy(*keys)
    later = F.last("_first", True).over(of_key.orderBy(F.desc("_bin")).rowsBetween(W.unboundedPreceding, -1))
    before = F.last("_last", True).over(of_key.orderBy("_bin").rowsBetween(W.unboundedPreceding, -1))
    bins = _named(bins.withColumn("_later", later).withColumn("_before", before), keys, F.col("_bin").alias("_b"), "_later", "_before")
    both = both.join(bins, [*_same(both, bins, keys), both["_bin"] == bins["_b"]])
    found = both.select(
        *keys, F.coalesce("_have", "_for").alias(t), F.when(F.col("_have").isNotNull(), F.coalesce("_prev", "_before")).alias("prev"), F.when(F.col("_have").isNull(), F.coalesce("_next", "_later")).alias("next")
    )
    return found.groupBy(*keys, t).agg(F.max("prev").alias("prev"), F.max("next").alias("next"))


def _far(t: Column, prev: Column, gap: float, strict: bool) -> Column:
    return F.coalesce(t - prev > gap if strict else t - prev >= gap, F.lit(True))


def chained(rows: DataFrame, keys: Keys, t: str, gap: float, strict: bool = False) -> DataFrame:
    """The kept times of distinct (keys, t), by pointer doubling."""
    steps = Steps(rows.sparkSession)
    linked = steps(neighbours(rows, keys, t, gap, strict).withColumn("head", _far(F.col(t), F.col("prev"), gap, strict)), "chain-links")
    # a chain ends where another begins: a head is kept whatever comes before it
    heads = linked.where("head").select(*keys, t)
    stop = _named(heads, keys, F.col(t).alias("_t"))
    jumps = linked.where("next is not null").select(*keys, t, "next")
    jumps = steps(jumps.join(stop, [*_same(jumps, stop, keys), jumps["next"] == stop["_t"]], "left_anti"), "chain-jumps-0")
    kept, turn = heads, 0
    while jumps.limit(1).count():
        turn += 1
        ahead = _named(jumps, keys, F.col(t).alias("_t"), F.col("next").alias("_n"))
        reached = kept.join(ahead, [*_same(kept, ahead, keys), kept[t] == ahead["_t"]]).select(*keys, F.col("_n").alias(t))
        kept = kept.unionByName(steps(reached, f"chain-kept-{turn}"))
        jumps = steps(jumps.join(ahead, [*_same(jumps, ahead, keys), jumps["next"] == ahead["_t"]]).select(*keys, t, F.col("_n").alias("next")), f"chain-jumps-{turn}")
    out = steps(kept, "chain")
    steps.clear(keep=1)
    return out


def folded(rows: DataFrame, keys: Keys, t: str, gap: float, strict: bool = False) -> DataFrame:
    """The kept times of distinct (keys, t), each stretch between sure ones as one array."""
    w = W.partitionBy(*keys).orderBy(t)
    rows = rows.withColumn("_fresh", _far(F.col(t), F.lag(t).over(w), gap, strict).cast("int")).withColumn("_part", F.sum("_fresh").over(w))
    times = rows.groupBy(*keys, "_part").agg(F.array_sort(F.collect_list(t)).alias("_ts"))
    first = F.get("_ts", F.lit(0))
    start = F.struct(first.alias("last"), F.array(first).alias("out"))
    far = lambda x, last: x - last > gap if strict else x - last >= gap
    kept = F.aggregate("_ts", start, lambda a, x: F.when(far(x, a["last"]), F.struct(x.alias("last"), F.concat(a["out"], F.array(x)).alias("out"))).otherwise(a), lambda a: a["out"])
    return times.select(*keys, F.explode(kept).alias(t))


def greedy(df: DataFrame, keys: Keys, t: str, gap: float, strict: bool = False) -> DataFrame:
    """Times kept by the greedy rule: the first of each key, then each that lies ``gap`` or more (more, if strict)
    behind the last kept. ``gap`` is positive; equal times count once, null times are left out, null keys are one key.

    Keys of up to ``MANY`` times are folded, longer ones chained.
    """
    rows = df.select(*keys, t).where(F.col(t).isNotNull()).distinct()
    long = _named(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > MANY), keys)
    if not long.limit(1).count():
        return folded(rows, keys, t, gap, strict)
    steps = Steps(df.sparkSession)
    long = steps(long, "chain-long")
    few, many = rows.join(long, _same(rows, long, keys), "left_anti"), rows.join(long, _same(rows, long, keys), "left_semi")
    out = steps(folded(few, keys, t, gap, strict).unionByName(chained(many, keys, t, gap, strict)), "greedy")
    steps.clear(keep=1)
    return out


def run_starts(df: DataFrame, keys: Keys, t: str, apart: float) -> DataFrame:
    """Distinct (keys, t) with run, the first time of its run; the next run begins where a time lies more than
    ``apart`` behind the one before. One row per bin of times crosses tasks."""
    rows = df.select(*keys, t).where(F.col(t).isNotNull()).distinct().withColumn("_bin", F.floor(F.col(t) / F.lit(float(apart) * BIN)).cast("long"))
    own = W.partitionBy(*keys, "_bin").orderBy(t)
    rows = rows.withColumn("_prev", F.lag(t).over(own))
    bins = rows.groupBy(*keys, "_bin").agg(F.max(t).alias("_last"))
    bins = bins.withColumn("_before", F.lag("_last").over(W.partitionBy(*keys).orderBy("_bin")))
    bins = _named(bins, keys, F.col("_bin").alias("_b"), "_before")
    rows = rows.join(bins, [*_same(rows, bins, keys), rows["_bin"] == bins["_b"]])
    start = F.when(_far(F.col(t), F.coalesce("_prev", "_before"), apart, True), F.col(t))
    rows = rows.select(*keys, t, "_bin", start.alias("_start"))
    rows = rows.withColumn("_here", F.last("_start", True).over(own.rowsBetween(W.unboundedPreceding, 0)))
    starts = rows.groupBy(*keys, "_bin").agg(F.max("_start").alias("_last"))
    carried = F.last("_last", True).over(W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1))
    starts = _named(starts.withColumn("_carried", carried), keys, F.col("_bin").alias("_b"), "_carried")
    rows = rows.join(starts, [*_same(rows, starts, keys), rows["_bin"] == starts["_b"]])
    return rows.select(*keys, t, F.coalesce("_here", "_carried").alias("run"))


def last_mark(rows: DataFrame, marks: DataFrame, keys: Keys, t: str, name: str, apart: float) -> DataFrame:
    """Adds the last time of ``marks`` (keys, t) at or before each row's, by bins of ``apart`` times ``BIN``."""
    bin_ = F.floor(F.col(t) / F.lit(float(apart) * BIN)).cast("long")
    both = rows.withColumn("_mark", F.lit(None).cast(marks.schema[t].dataType)).withColumn("_row", F.lit(1))
    more = marks.select(*keys, t, F.col(t).alias("_mark"), F.lit(0).alias("_row"))
    both = both.unionByName(more, allowMissingColumns=True).withColumn("_bin", bin_)
    both = both.withColumn("_here", F.last("_mark", True).over(W.partitionBy(*keys, "_bin").orderBy(t, "_row").rowsBetween(W.unboundedPreceding, 0)))
    bins = both.groupBy(*keys, "_bin").agg(F.max("_mark").alias("_last"))
    carried = F.last("_last", True).over(W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1))
    bins = _named(bins.withColumn("_carried", carried), keys, F.col("_bin").alias("_b"), "_carried")
    out = both.where("_row = 1").join(bins, [*_same(both, bins, keys), F.col("_bin") == F.col("_b")])
    return out.select(*rows.columns, F.coalesce("_here", "_carried").alias(name))


def dense_groups(df: DataFrame, keys: Keys, t: str, apart: float, longest: float) -> DataFrame:
    """Greedy split into dense windows: distinct (keys, t) with grp, the first time of its window.

    A window takes the times that follow while each lies within ``apart`` of the one before and within ``longest`` of
    the window's first; the next one begins with the time that does not.
    """
    steps = Steps(df.sparkSession)
    runs = steps(run_starts(df, keys, t, apart), "dense-runs")
    firsts = greedy(runs, [*keys, "run"], t, longest, strict=True)
    out = steps(last_mark(runs, firsts, [*keys, "run"], t, "grp", longest).drop("run"), "dense")
    steps.clear(keep=1)
    return out
