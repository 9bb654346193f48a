"""Family quotas and the frame cap hold together."""

from collections import Counter

from pyspark.sql import functions as F

from tidemark.operators.synthesis import quota_sample


def test_no_family_is_short_while_a_row_is_left(spark):
    rows = [(f % 12, fam, str(s)) for f in range(40) for fam in "abc" for s in range(1 + f % 3)]
    rows = sorted(set(rows)) + [(99, "d", "only"), (0, "e", "x"), (1, "e", "y")]
    df = spark.createDataFrame(rows, "frame long, family string, subject string")
    quota = {"a": 10, "b": 14, "c": 5, "d": 30, "e": 2}
    got = quota_sample(df, "frame", "family", F.element_at(F.create_map(*[F.lit(x) for kv in quota.items() for x in kv]), F.col("family")), 2, "s").collect()
    frames, families = Counter(r.frame for r in got), Counter(r.family for r in got)
    assert max(frames.values()) <= 2 and all(families[k] <= q for k, q in quota.items())
    assert len({tuple(r) for r in got}) == len(got)
    have = {tuple(r) for r in got}
    for frame, family, subject in set(rows) - have:
        assert families[family] == quota[family] or frames[frame] == 2
    assert families["d"] == 1
    assert quota_sample(df.where("false"), "frame", "family", F.lit(3), 2, "s").count() == 0
