"""Question families over windows of annotated frames, and their checks.

Input is long: keys, win, t (the frame's time in the window), cls, quad; one row per instance. A family is
one or two aggregations over it; nothing here gathers a window into one row but for an answer of its
distinct classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import seeded
from tidemark.operators.chains import dense_groups, greedy


def _draw(seed: str, key: Column) -> Column:
    """A number of 28 bits that is fixed for the key."""
    return F.conv(F.substring(seeded(seed, key), 1, 7), 16, 10).cast("long")


def frames(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per frame, with its place i in the window, the window's number of frames and the next time."""
    own = rows.select(*keys, "t").distinct()
    w = W.partitionBy(*keys)
    return own.select("*", (F.row_number().over(w.orderBy("t")) - 1).alias("i"), F.count("*").over(w).alias("m"), F.lead("t").over(w.orderBy("t")).alias("next_t"), F.lag("t").over(w.orderBy("t")).alias("prev_t"), F.min("t").over(w).alias("first_t"))


def per_class(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Instances of each class in each frame: n, and the quadrant if there is one instance."""
    return rows.groupBy(*keys, "t", "cls").agg(F.count("*").alias("n"), F.when(F.count("*") == 1, F.min("quad")).alias("quad"))


def classes_between(rows: DataFrame, keys: list[str], seed: str) -> DataFrame:
    """Two frame times of each window of three frames or more, drawn by seed, and the classes from one to the other."""
    own = frames(rows, keys).where("m >= 3")
    key = F.concat_ws("|", *keys)
    i = F.pmod(_draw(seed, key), F.col("m") - 2)
    j = i + 1 + F.pmod(_draw(seed + "j", key), F.col("m") - i - 1)
    ends = own.groupBy(*keys).agg(F.max(F.when(F.col("i") == i, F.col("t"))).alias("t0"), F.max(F.when(F.col("i") == j, F.col("t"))).alias("t1"))
    inside = rows.join(ends, keys).where("t >= t0 and t <= t1").groupBy(*keys, "t0", "t1").agg(F.array_join(F.sort_array(F.collect_set("cls")), ", ").alias("answer"))
    return ends.join(inside, [*keys, "t0", "t1"], "left").select(*keys, "t0", "t1", F.coalesce("answer", F.lit("none")).alias("answer"))


def edge_times(items: DataFrame, shown: DataFrame, keys: list[str], what: list[str], kind: str, tolerance: int) -> DataFrame:
    """First or last time of each item (a class, or a pair of classes in one frame) that is sure: the frame is
    the window's own edge, or its neighbour beyond, which lacks the item, lies within ``tolerance``."""
    edge = F.max("t") if kind == "last" else F.min("t")
    beyond = "next_t" if kind == "last" else "prev_t"
    at = items.groupBy(*keys, *what).agg(edge.alias("t"))
    sure = F.col(beyond).isNull() | (F.abs(F.col(beyond) - F.col("t")) <= tolerance)
    return at.join(shown.select(*keys, "t", beyond), [*keys, "t"]).where(sure).select(*keys, *what, "t")


def pairs_in_frames(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of classes (a before b) of each frame."""
    own = rows.groupBy(*keys, "t").agg(F.sort_array(F.collect_set("cls")).alias("c")).where(F.size("c") > 1)
    own = own.withColumn("a", F.explode("c")).withColumn("b", F.explode("c"))
    return own.where("a < b").select(*keys, "t", "a", "b")


def edge_quadrant(counts: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """The quadrant of each class at its first or last time, where it has one instance then."""
    pick = F.max if kind == "last" else F.min
    at = counts.groupBy(*keys, "cls").agg(pick(F.struct("t", "n", "quad")).alias("x"))
    return at.where("x.n = 1").select(*keys, "cls", F.col("x.t").alias("t"), F.col("x.quad").alias("answer"))


def also_appears(counts: DataFrame, shown: DataFrame, keys: list[str], seed: str) -> DataFrame:
    """For each class with one instance in a frame: is the class in another frame of the window, drawn by seed?"""
    key = F.concat_ws("|", *keys, "t", "cls")
    single = counts.where("n = 1").join(shown.where("m > 1").select(*keys, "t", "i", "m"), [*keys, "t"])
    other = F.pmod(F.col("i") + 1 + F.pmod(_draw(seed, key), F.col("m") - 1), F.col("m"))
    asked = single.withColumn("i", other).select(*keys, "cls", F.col("t").alias("t0"), "i")
    asked = asked.join(shown.select(*keys, "i", F.col("t").alias("t1")), [*keys, "i"])
    there = counts.select(*keys, "cls", F.col("t").alias("t1"), F.lit("yes").alias("answer"))
    return asked.join(there, [*keys, "cls", "t1"], "left").select(*keys, "cls", "t0", "t1", F.coalesce("answer", F.lit("no")).alias("answer"))


def sparse_check(rows: DataFrame, keys: list[str], t: str, apart: float, longest: float, step: float, least_rows: int, least_span: float, least_kept: int) -> DataFrame:
    """Rows of dense windows, each with grp (its window's first time) and sparse (its time is among those left when
    the window is thinned to ``step``).

    Windows are split greedily by ``apart`` and ``longest`` and count if they have enough times, are long enough and
    keep enough when thinned.
    """
    own = dense_groups(rows, keys, t, apart, longest)
    sized = own.groupBy(*keys, "grp").agg(F.count("*").alias("m"), F.max(t).alias("b")).where((F.col("m") >= least_rows) & (F.col("b") - F.col("grp") >= least_span)).select(*keys, "grp")
    own = own.join(sized, [*keys, "grp"])
    left = greedy(own, [*keys, "grp"], t, step)
    enough = left.groupBy(*keys, "grp").agg(F.count("*").alias("k")).where(F.col("k") >= least_kept).select(*keys, "grp")
    marks = own.join(enough, [*keys, "grp"]).join(left.withColumn("sparse", F.lit(True)), [*keys, "grp", t], "left")
    return rows.join(marks.select(*keys, t, "grp", F.coalesce("sparse", F.lit(False)).alias("sparse")), [*keys, t])


def capped_negatives(rows: DataFrame, positive: Column, share: float, order: Column) -> DataFrame:
    """All positive rows, and of the others the first by ``order`` (a hash in hexadecimal), ``share`` times as
    many at most. The cut is found in counts of the hash's leading digits, so that no task orders all rows."""
    cap = F.round(F.count_if(positive) * F.lit(share)).alias("cap")
    marked = rows.withColumn("_head", F.substring(order, 1, 3)).withColumn("_order", order)
    counts = marked.where(~positive).groupBy("_head").agg(F.count("*").alias("_n"))  # at most 4,096 rows
    before = F.coalesce(F.sum("_n").over(W.orderBy("_head").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edges = counts.select("_head", before.alias("_before")).crossJoin(rows.agg(cap)).where("_before < cap")
    kept = marked.where(~positive).join(F.broadcast(edges), "_head")
    kept = kept.withColumn("_rk", F.row_number().over(W.partitionBy("_head").orderBy("_order")) + F.col("_before")).where("_rk <= cap")
    return rows.where(positive).unionByName(kept.select(*rows.columns))


def repeated(rows: DataFrame, which: Column, times: int) -> DataFrame:
    """Rows of a kind ``times`` times, the others once; ``copy`` numbers them."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(which, times).otherwise(1))))
