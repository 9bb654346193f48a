from pyspark.sql import functions as F

from tidemark.streaming import thinning as Z


def fed(spark, tmp_path, batches, **options):
    """Each batch is a file; files are read one per micro-batch, in order."""
    src, name = str(tmp_path / "in"), f"fates{abs(hash(str(tmp_path)))}"
    schema = "k long, t double"
    q = None
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        if q is None:
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
            q = Z.thinned_stream(stream, "k", "t", **options).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
    q.stop()
    return sorted((r.k, r.t, r.fate) for r in spark.table(name).collect())


def test_out_of_order_and_late_rows_are_accounted_for(spark, tmp_path):
    batches = [[(1, 0.0), (1, 30.0), (2, 5.0)], [(1, 12.0), (1, 41.0), (1, 33.0)], [(1, 3.0), (1, 100.0), (2, 6.0)], [(1, 50.0), (2, 300.0)]]
    got = fed(spark, tmp_path, batches, gap=10, delay=20.0)
    # key 1: settled to 10, then 21, then 80; 12 comes in time, 3 and 50 late; 100 and 300 wait
    assert [x for x in got if x[0] == 1] == [(1, 0.0, "kept"), (1, 3.0, "late"), (1, 12.0, "kept"), (1, 30.0, "kept"), (1, 33.0, "thinned"), (1, 41.0, "kept"), (1, 50.0, "late")]
    assert [x for x in got if x[0] == 2] == [(2, 5.0, "kept"), (2, 6.0, "thinned")]


def test_idle_keys_are_settled_and_forgotten(spark, tmp_path):
    import time

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 0.0), (1, 4.0), (1, 20.0)], "k long, t double").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("k long, t double").parquet(src)
    q = Z.thinned_stream(stream, "k", "t", gap=10, delay=50.0, forget_ms=500).writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    begun, got = time.time(), []
    while time.time() - begun < 90 and len(got) < 3:  # the timer's batches come by themselves
        time.sleep(1)
        got = sorted((r.t, r.fate) for r in spark.table("idle").collect())
    q.stop()
    assert got == [(0.0, "kept"), (4.0, "thinned"), (20.0, "kept")]


def test_repeated_batches_replace_themselves(spark, tmp_path, sf):
    src = str(tmp_path / "ev")
    spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(src)
    stream = Z.event_stream(spark, src, spark.read.parquet(src).schema)
    counts = Z.hourly_counts(stream, "ts", "event_type")
    out = str(tmp_path / "out")
    q = Z.write_answers(counts, out, str(tmp_path / "cp2"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(out).agg(F.sum("n")).first()[0] > 0
