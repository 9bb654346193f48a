"""Rows that repeat an id, or have none: mixed as their own words ask, and thresholds that do not depend on their order."""

from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm import mixing, quality


def plain_mix(rows, spark):
    """Words that ``mix`` takes of each source."""
    got = Counter()
    for r in rows:
        got[r.source] += r.taken
    return got


def test_mixed_takes_what_the_mix_takes(spark):
    word = "w"
    rows = [(1, " ".join([word] * 40), s, i) for s in ("t", "u", None) for i in range(30)]  # one id in three sources
    rows += [(7, " ".join(["same"] * 25), "u", 5)] * 50  # 50 equal rows
    rows += [(None, " ".join([f"n{i}"] * (10 + i % 7)), "t", i) for i in range(60)]  # no id
    rows += [(100 + i, " ".join(["x"] * 20), ("t", "u", "v")[i % 3], i) for i in range(90)] + [(8, None, "t", 0), (8, "", "u", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, number int")
    want = plain_mix(mixing.mix(docs).collect(), spark)
    runs = []
    for parts in (1, 7):
        got = mixing.mixed(docs.repartition(parts)).select("*").collect()
        runs.append(Counter(map(tuple, got)))
        words = Counter()
        for r in got:
            words[r.source] += len((r.text or "").split())
        for s, n in want.items():
            assert abs(words[s] - n) <= 40 * 6  # rounded once for each group of equals
        assert max(Counter(r.doc_id for r in got if r.doc_id and r.doc_id >= 100).values()) <= 2
    assert runs[0] == runs[1]
    same = Counter(r for r in runs[0].elements() if r[0] == 7)
    assert sum(same.values()) <= 100


def test_equal_rows_share_a_shard_no_more(spark):
    docs = spark.range(20_000).selectExpr("5 as doc_id", "'a b c d e f g h' as text", "'s' as source")
    got = mixing.mix(docs, shard_words=1 << 12)
    shards = [r["count"] for r in got.groupBy("shard").count().collect()]
    assert len(shards) == 40 and max(shards) < 1.5 * min(shards)
    assert got.count() == 20_000
    assert abs(got.agg(F.sum("taken")).first()[0] - 20_000 * 8 * 1.5) <= 40 * 16  # a shard's last block may be short


def test_thresholds_do_not_depend_on_the_order_of_repeated_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    twice = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" # # # % % & & | <"))))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    runs = []
    for parts in (1, 6):
        figs = quality.figures(twice.repartition(parts, F.xxhash64("text", F.lit(parts))))
        runs.append(sorted(map(tuple, quality.thresholds(figs, labels, risk=0.5, delta=0.9).collect())))
    assert runs[0] == runs[1]
