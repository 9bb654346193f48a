"""Interval joins where lengths run from a second to thirty years in one table."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import intervals as I


def table(n, seed):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        length = int(10 ** rng.uniform(0, 9))
        a = int(rng.integers(-(10**6), 10**9))
        out.append((int(rng.integers(0, 2)), a, a + length))
    return [*out, (0, 5, 5), (1, 7, 3), (0, 0, 10**9), (1, 1024, 2048), (1, 0, 1024)]


def test_points(spark):
    ivs = [(k, a, a + (b - a) // 1000) for k, a, b in table(60, 1)]
    rng = np.random.default_rng(2)
    pts = [(int(rng.integers(0, 3)), int(x), "v") for x in rng.integers(-(10**6), 10**9, 3_000)] + [(k, x, "edge") for k, a, b in ivs for x in (a, b, b + 3, b + 2, a - 3)] * 2
    p = spark.createDataFrame(pts, "k long, t long, end string")
    q = spark.createDataFrame(ivs, "k long, a long, b long")
    got = sorted(map(tuple, I.in_intervals(p, q, ["k"], "t", "a", "b", 2.5, 100.0).collect()))
    assert got == sorted(x for x in pts if any(k == x[0] and a - 2.5 <= x[1] <= b + 2.5 for k, a, b in ivs if a <= b))


def test_clips(spark):
    ivs, wins = table(150, 3), table(120, 4)
    a = spark.createDataFrame(ivs, "k long, start long, end long")
    b = spark.createDataFrame(wins, "k long, lo long, hi long")
    got = sorted((r.k, r.start, r.end, r.lo, r.hi, r.clip_start, r.clip_end) for r in I.clipped(a, b, ["k"], 1.0).collect())
    want = sorted((k, s, e, lo, hi, max(s, lo), min(e, hi)) for k, s, e in ivs for j, lo, hi in wins if k == j and s <= e and lo <= hi and s < hi and e > lo)
    assert got == want


def test_sent_rows_do_not_grow_with_lengths(spark):
    df = spark.range(1_000).select(F.lit(1).alias("k"), F.col("id").alias("start"), (F.col("id") + F.pow(F.lit(10.0), F.col("id") % 10).cast("long")).alias("end"))
    sized = I._sized(df, "start", "end", 1.0)
    assert I._placed(sized, "start", "end", F.col("_level"), 1.0).count() <= 3 * 1_000
    levels = sized.agg(F.collect_set("_level").alias("_levels"))
    n = len(levels.first()[0])
    assert I._raised(sized, levels, "start", "end", 1.0, False).count() <= 3 * n * 1_000
