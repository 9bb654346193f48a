"""Greedy rules along long keys against the literal loops."""

import numpy as np
import pytest

from tidemark.operators import chains as C
from tidemark.operators import timeline as T


def loop(times, gap, strict=False):
    out = []
    for x in sorted(set(times)):
        if not out or (x - out[-1] > gap if strict else x - out[-1] >= gap):
            out.append(x)
    return out


def windows(times, apart, longest):
    ts, out, i = sorted(set(times)), {}, 0
    while i < len(ts):
        j = i
        while j + 1 < len(ts) and ts[j + 1] - ts[j] <= apart and ts[j + 1] - ts[i] <= longest:
            j += 1
        out.update({x: ts[i] for x in ts[i : j + 1]})
        i = j + 1
    return out


@pytest.fixture(scope="module")
def times():
    rng = np.random.default_rng(2)
    return {
        1: rng.integers(0, 3_000, 1_200).tolist(),
        2: np.cumsum(rng.choice([1, 1, 2, 3, 40], 900)).tolist(),
        3: [5], None: rng.integers(-500, 90_000, 400).tolist(), 4: [0, 10**9, 2 * 10**9], 5: list(range(2_000)),
    }


@pytest.mark.parametrize(("gap", "strict"), [(7, False), (7, True), (1, False), (100, True)])
@pytest.mark.parametrize("kind", ["long", "double"])
def test_chains_equal_the_loop(spark, times, gap, strict, kind, monkeypatch):
    monkeypatch.setattr(C, "MANY", 500)  # both ways
    monkeypatch.setattr(C, "BIN", 8)
    cast = float if kind == "double" else int
    rows = [(k, cast(x), "n") for k, xs in times.items() for x in xs] + [(1, None, "n"), (9, None, "n")]
    df = spark.createDataFrame(rows, f"key long, t {kind}, next string")
    got = {}
    for r in C.greedy(df, ["key"], "t", gap, strict).collect():
        got.setdefault(r.key, []).append(r.t)
    assert {k: sorted(v) for k, v in got.items()} == {k: loop(xs, gap, strict) for k, xs in times.items()}


@pytest.mark.parametrize("many", [10_000, 300])
def test_dense_windows_equal_the_loop(spark, times, many, monkeypatch):
    monkeypatch.setattr(C, "MANY", many)
    monkeypatch.setattr(C, "BIN", 16)
    df = spark.createDataFrame([(k, x) for k, xs in times.items() for x in xs], "key long, t long")
    got = {}
    for r in C.dense_groups(df, ["key"], "t", 3, 50).collect():
        got.setdefault(r.key, {})[r.t] = r.grp
    assert got == {k: windows(xs, 3, 50) for k, xs in times.items()}


def test_one_long_key_in_even_tasks(spark):
    """One key of 200,000 times, 2 apart: every third is kept; no exchange of the chains sends them to one task."""
    df = spark.range(200_000).selectExpr("7 as key", "id * 2 as t")
    kept = C.greedy(df, ["key"], "t", 6)
    assert kept.count() == 66_667
    assert kept.where("t % 6 <> 0").count() == 0
    largest = C.neighbours(df, ["key"], "t", 6).selectExpr("floor(t / 1536) as b").groupBy("b").count().agg({"count": "max"}).first()[0]
    assert largest <= 768


def test_thinned_uses_them(spark):
    df = spark.createDataFrame([(1, x) for x in (0, 3, 5, 6, 10, 16, 17)], "k long, t long")
    assert sorted(r.t for r in T.thinned(df, ["k"], "t", 5).collect()) == [0, 5, 10, 16]
    assert T.thinned(df.where("false"), ["k"], "t", 5).count() == 0
