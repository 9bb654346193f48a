"""Places and quantiles, where one value is on half of the rows and one group has most of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.operators import ranks as R


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    values = [7.0 if rng.random() < 0.5 else float(rng.integers(-50, 50)) for _ in range(3_000)]
    return [(i, ("big" if i % 10 else f"g{i % 7}") if i % 50 else None, v) for i, v in enumerate(values)] + [(5_000, "big", None), (5_001, "one", 3.0)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, grp string, v double").repartition(3)


def test_places(spark, rows, monkeypatch):
    monkeypatch.setattr(R, "RANGE_ROWS", 100)
    own = [r for r in rows if r[2] is not None]
    got = {r.id: r.rk for r in R.places(frame(spark, own), F.col("v"), [F.col("id")], "rk").collect()}
    assert got == {i: k + 1 for k, (v, i) in enumerate(sorted((v, i) for i, _, v in own))}


def test_a_common_value_fills_many_ranges(spark, rows, monkeypatch):
    from tidemark.staging import Steps

    monkeypatch.setattr(R, "RANGE_ROWS", 100)
    ordered = R._ordered(frame(spark, rows), [], [F.col("v"), F.col("id")], Steps(spark))
    sizes = [r["count"] for r in ordered.groupBy("_part").count().collect()]
    assert len(sizes) >= 25 and max(sizes) < 300


def test_quantiles(spark, rows, monkeypatch):
    monkeypatch.setattr(R, "RANGE_ROWS", 100)
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r.grp: r.q for r in R.quantiles(frame(spark, rows), ["grp"], "v", shares, "q").collect()}
    groups = {}
    for _, g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        assert got[g] == pytest.approx(np.quantile(vs, shares).tolist())
    assert R.quantiles(frame(spark, rows).where("false"), ["grp"], "v", shares, "q").count() == 0


def test_auc(spark):
    df = spark.createDataFrame([(i, 1.0 if i < 50 else 2.0, i % 3 == 0) for i in range(100)], "id long, s double, p boolean")
    got = A.rank_auc(df, "s", F.col("p"), "id").first()
    order = sorted(((1.0 if i < 50 else 2.0), i, i % 3 == 0) for i in range(100))
    r = sum(k + 1 for k, x in enumerate(order) if x[2])
    assert got.auc == pytest.approx((r - 34 * 35 / 2) / (34 * 66))
