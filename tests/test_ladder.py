"""Runs over a ladder of thresholds beside a plain version."""

import random

from tidemark.operators import ladder as L
from tidemark.plans import sampling as P


def plain(scores, rungs, step):
    out = set()
    for i, (threshold, k) in enumerate(rungs):
        seen = [t for t in sorted(scores) if all((scores.get(t + j * step) or 0) >= threshold for j in range(-(k // 2), k - k // 2))]
        starts = [t for t in seen if t - step not in seen]
        for a in starts:
            b = a
            while b + step in seen:
                b += step
            out.add((i, a, b))
    return out


def test_rung_runs(spark):
    draw, rungs = random.Random(3), [(0.75, 3), (0.5, 2), (0.25, 4), (0.25, 1)]
    scores = {key: {t * 5: draw.choice([None, 0.25, 0.5, 0.75, 1.0]) for t in range(-40, 160) if draw.random() < 0.9} for key in (None, 1, 2)}
    rows = [(key, t, x) for key, own in scores.items() for t, x in own.items()]
    got = L.rung_runs(spark.createDataFrame(rows, "k int, t long, x double"), ["k"], "t", "x", rungs, 5)
    want = {(key, *r) for key, own in scores.items() for r in plain(own, rungs, 5)}
    assert {tuple(r) for r in got.select("k", "rung", "a", "b").collect()} == want
    first = {key: min(r[1] for r in want if r[0] == key) for key in scores}
    assert {tuple(r) for r in L.first_rung(got, ["k"]).collect()} == {r for r in want if r[1] == first[r[0]]}


def test_hours_without_views_get_no_rows(spark, sf):
    """Every hour of a user's time was a row, twice, once for each of two sizes; no step multiplies rows by time now."""
    for query in (P.smp_ladder_runs, P.smp_edge_ladder, P.smp_edge_several):
        plan = query(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.split("\n") if "Generate" in line and "sequence" in line]
