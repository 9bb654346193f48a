"""Scans and sinks as round trips: a table is written in a format and read back by the engine's reader."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.plans import timeline
from tidemark.plans.base import table
from tidemark.sources import readers, writers


def _path(spark, name):
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def src_csv_typed(s, d):
    p = _path(s, "csv")
    writers.sorted_csv(table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal"), p, ["c_custkey"])
    return readers.csv(s, p, "c_custkey bigint, c_name string, c_acctbal double")


def src_tsv(s, d):
    p = _path(s, "tsv")
    table(s, d, "nation").select("n_nationkey", "n_name").write.csv(p, sep="\t", header=True)
    return readers.csv(s, p, "n_nationkey int, n_name string", sep="\t")


def src_headerless(s, d):
    p = _path(s, "raw")
    table(s, d, "supplier").select(F.when(F.col("s_suppkey") % 4 == 0, F.col("s_suppkey").cast("string")).otherwise(F.concat_ws(",", F.col("s_suppkey").cast("string"), "s_name")).alias("value")).write.text(p)
    return readers.headerless(s, p, ["k", "name"], 2).select(F.col("k").cast("bigint").alias("s_suppkey"), F.col("name").alias("s_name"))


def src_json_lines(s, d):
    p = _path(s, "jsonl")
    table(s, d, "region").write.option("compression", "gzip").json(p)
    return readers.json_lines(s, p, "r_regionkey int, r_name string").select("r_regionkey", "r_name")


def src_requests(s, d):
    """One batch as an object under ``items``."""
    p = _path(s, "req")
    one = table(s, d, "part").select(F.struct(F.col("p_partkey").cast("string").alias("qID"), F.col("p_name").alias("question"), F.col("p_size").alias("unknown")).alias("x"))
    one.groupBy(F.pmod(F.col("x.qID").cast("bigint"), F.lit(8)).alias("b")).agg(F.collect_list("x").alias("items")).write.partitionBy("b").json(p)
    return readers.requests(s, p).select("qID", "question")


def src_parquet_union(s, d):
    a, b = _path(s, "a"), _path(s, "b")
    table(s, d, "supplier").select(F.col("s_name").alias("name"), "s_acctbal").write.parquet(a)
    table(s, d, "customer").select(F.col("c_name").alias("name"), "c_mktsegment").write.parquet(b)
    return readers.parquet_union(s, {a: 1.0, b: 0.5}).select("name", F.coalesce("s_acctbal", F.lit(0.0)).alias("bal"), F.coalesce("c_mktsegment", F.lit("")).alias("seg"), "source_weight")


def snk_checked_parquet(s, d):
    p = _path(s, "checked")
    writers.checked_parquet(table(s, d, "orders").select("o_orderkey", "o_totalprice"), p, ["o_orderkey"], {"negative": F.col("o_totalprice") < 0})
    return s.read.parquet(p)


def snk_by_partition(s, d):
    """The second write replaces the folders of its own keys alone."""
    p = _path(s, "parts")
    rows = table(s, d, "orders").select("o_orderkey", "o_orderstatus", F.lit(1).alias("version"))
    writers.by_partition(rows, p, ["o_orderstatus"])
    writers.by_partition(rows.where("o_orderstatus = 'F'").withColumn("version", F.lit(2)), p, ["o_orderstatus"])
    return s.read.parquet(p).groupBy("o_orderstatus", "version").agg(F.count("*").alias("n"))


def src_requests_list(s, d):
    """One batch as a bare list."""
    p = _path(s, "req-list")
    one = table(s, d, "part").select(F.struct(F.col("p_partkey").cast("string").alias("qID"), F.col("p_name").alias("question"), F.col("p_size").cast("double").alias("start_time")).alias("x"))
    one.groupBy(F.pmod(F.col("x.qID").cast("bigint"), F.lit(8)).alias("b")).agg(F.to_json(F.collect_list("x")).alias("value")).write.partitionBy("b").text(p)
    return readers.requests(s, p).select("qID", "question", "start_time")


def src_requests_wrapped(s, d):
    """One batch as an object under ``requests``."""
    p = _path(s, "req-requests")
    one = table(s, d, "supplier").select(F.struct(F.col("s_suppkey").cast("string").alias("qID"), F.col("s_name").alias("question")).alias("x"))
    one.groupBy(F.pmod(F.col("x.qID").cast("bigint"), F.lit(8)).alias("b")).agg(F.collect_list("x").alias("requests")).write.partitionBy("b").json(p)
    return readers.requests(s, p).select("qID", "question")


def _split(s, d):
    """Orders as rows of a question split, written as CSV."""
    p = _path(s, "split")
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    cols = {
        "uid": F.concat(F.lit("d:"), text(k)), "qID": text(k), "videoID": text(F.col("o_custkey")), "dataset": F.lit("d"), "fold": text(F.pmod("o_custkey", F.lit(5))), "track": F.when(k % 3 == 0, "FRAME").otherwise("SEGMENT"), "primary": F.col("o_orderpriority"), "answer_format": F.lit("number"),
        "start_time": F.lit("0.000"), "end_time": F.lit("1.500"), "duration": F.lit("1.500"), "ood": F.lit("0"), "clinical": F.lit("1"), "order": text(F.pmod(k * 7, F.lit(100003))),
    }
    table(s, d, "orders").select(*[c.alias(n) for n, c in cols.items()]).write.csv(p, header=True)
    return p


def src_qa_rows(s, d):
    return readers.qa_rows(s, _split(s, d), track="FRAME", fold=2, part="train").select("uid", "videoID", "fold", "end_time")


def src_qa_first(s, d):
    """The first rows of a part in their seeded order."""
    return readers.qa_rows(s, _split(s, d), track="SEGMENT", fold=1, part="val", limit=50).select("uid", F.col("order").cast("long").alias("place"))


def src_responses(s, d):
    p = _path(s, "responses")
    conf = F.when(F.col("o_orderkey") % 4 != 0, F.struct(F.lit(-1.5).alias("logp_sum"), (F.col("o_orderkey") % 10 / -10).alias("logp_mean"), F.lit(-0.5).alias("logp_min"), F.lit(3).alias("n_gen_tokens")))
    rows = table(s, d, "orders").select(F.pmod("o_orderkey", F.lit(8)).alias("b"), F.struct(F.col("o_orderkey").cast("string").alias("qID"), F.col("o_orderstatus").alias("content"), F.col("o_totalprice").alias("latency"), conf.alias("conf"), F.lit(1).alias("unknown")).alias("x"))
    rows.groupBy("b").agg(F.to_json(F.collect_list("x")).alias("value")).write.partitionBy("b").text(p)  # a list per file
    return readers.responses(s, p).select("qID", "content", "latency", F.round("conf.logp_mean", 6).alias("logp_mean"))


def src_shards_in_order(s, d):
    """Shards of a glob, put in order at the sink: a range of keys per part, sorted in each."""
    p = _path(s, "shards")
    table(s, d, "orders").select("o_orderkey", "o_custkey").repartition(6).write.parquet(p)
    rows = s.read.parquet(f"{p}/*.parquet")
    out = _path(s, "shards-sorted")
    writers.sorted_csv(rows, out, ["o_custkey", "o_orderkey"])
    back = readers.csv(s, out, "o_orderkey bigint, o_custkey bigint").withColumn("part", F.regexp_extract(F.input_file_name(), "part-([0-9]+)", 1).cast("int"))
    ends = back.groupBy("part").agg(F.min(F.struct("o_custkey", "o_orderkey")).alias("a"), F.max(F.struct("o_custkey", "o_orderkey")).alias("b"), F.count("*").alias("n"))
    later = ends.select((F.col("part") - 1).alias("part"), F.col("a").alias("next"))
    return ends.join(later, "part", "left").agg(F.sum("n").alias("n"), F.count_if(F.col("next") < F.col("b")).alias("out_of_order"))


def src_last_shard(s, d):
    """Three shards map keys to values; of a key in several the last shard's value stays."""
    p = _path(s, "map")
    rows = table(s, d, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal")
    for i in range(3):
        own = rows.where(F.col("k") % (i + 1) == 0).select("k", (F.col("k") * 10 + i).alias("v"))
        own.coalesce(1).write.json(f"{p}/s{i}")
    shards = s.read.schema("k bigint, v bigint").json(f"{p}/*").withColumn("shard", F.regexp_extract(F.input_file_name(), "/s([0-9]+)/", 1))
    return readers.last_wins(shards, "k", "shard")


def src_coco(s, d):
    """An annotation file per few customers: images are customers, annotations their orders."""
    p = _path(s, "coco")
    o = table(s, d, "orders").select("o_custkey", F.struct(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("image_id"), (F.col("o_orderkey") % 3).cast("int").alias("category_id"), F.array(F.lit(0.0), F.lit(0.0), F.col("o_totalprice"), F.lit(1.0)).alias("bbox"), F.col("o_totalprice").alias("area")).alias("a"))
    per = o.groupBy(F.pmod("o_custkey", F.lit(16)).alias("b")).agg(F.collect_list("a").alias("annotations"), F.collect_set(F.struct(F.col("o_custkey").alias("id"), F.concat(F.lit("v"), F.pmod("o_custkey", F.lit(7)).cast("string")).alias("video"), F.col("o_custkey").alias("frame_number"), F.lit(10).alias("width"), F.lit(20).alias("height"))).alias("images"))
    per.select("b", "images", "annotations", F.array(*[F.struct(F.lit(i).alias("id"), F.lit(n).alias("name")) for i, n in enumerate(("Clip", "Mesh", "Needle"))]).alias("categories")).write.partitionBy("b").json(p)
    images, notes, kinds = readers.coco(s, p)
    both = notes.join(images.select(F.col("id").alias("image_id"), "video"), "image_id").join(F.broadcast(kinds.distinct().select(F.col("id").alias("category_id"), "name")), "category_id")
    return both.groupBy("video", "name").agg(F.count("*").alias("n"))


def src_dumps(s, d):
    """Two dumps of odd and even parts whose ids overlap; their label maps must be equal."""
    paths = [_path(s, f"dump{i}") for i in range(2)]
    rows = table(s, d, "part").select(F.floor(F.col("p_partkey") / 2).alias("id"), F.col("p_size").alias("label"), (F.col("p_partkey") % 2).alias("odd"))
    for i, path in enumerate(paths):
        rows.where(F.col("odd") == i).select("id", "label").write.json(path)
    return readers.dumps(s, paths, "id bigint, label int", labels={"d0": {1: "Clip", 2: "Mesh"}, "d1": {2: "Mesh", 1: "Clip"}}).select("source_index", "id", "label")


def src_timeline(s, d):
    p = _path(s, "timeline")
    table(s, d, "events").select("user_id", F.col("event_type").alias("cls")).write.parquet(p)
    known = [r[0] for r in table(s, d, "events").select("event_type").distinct().collect()]  # the class list, a handful
    return readers.timeline(s, p, known).groupBy("cls").agg(F.count("*").alias("n"))


def _listing(s, d):
    o = table(s, d, "orders")
    return o.select(F.pmod("o_custkey", F.lit(100)).alias("vid"), (F.pmod("o_orderkey", F.lit(4)) * 256 + 256).alias("size")).distinct().withColumn("path", F.concat_ws("/", F.col("vid").cast("string"), F.col("size").cast("string")))


def src_with_fallback(s, d):
    want = table(s, d, "customer").select("c_custkey", F.pmod("c_custkey", F.lit(120)).alias("vid"), (F.pmod("c_custkey", F.lit(3)) * 256 + 300).alias("size"))
    return readers.with_fallback(want, _listing(s, d), ["vid"], "size", "path").select("c_custkey", "path")


def src_first_candidate(s, d):
    want = table(s, d, "customer").select("c_custkey", F.pmod("c_custkey", F.lit(120)).cast("string").alias("vid"))
    tries = [F.concat(F.col("vid"), F.lit(f"/{n}")) for n in (2048, 1024, 512)]
    return readers.first_candidate(want, _listing(s, d), "c_custkey", tries).select("c_custkey", "path")


def src_images_sharpness(s, d):
    """Small pictures made of the embeddings' values are written, scanned and scored; those known already are not."""
    root, known = _path(s, "images"), _path(s, "known")
    # eight values to a line, the last line filled with grey; a picture of less than three lines has no inner points
    e = table(s, d, "embeddings").where("size(embedding) > 16").select("vec_id", "embedding", F.ceil(F.size("embedding") / 8).cast("int").alias("h"))
    grey = F.transform("embedding", lambda x: F.least(F.greatest(F.floor(x * 100 + 128), F.lit(0)), F.lit(255)).cast("string"))
    full = F.concat(grey, F.array_repeat(F.lit("128"), F.col("h") * 8 - F.size("embedding")))
    lines = F.concat_ws("\n", F.lit("P2"), F.concat(F.lit("# "), F.col("vec_id").cast("string")), F.concat(F.lit("8 "), F.col("h").cast("string")), F.lit("255"), F.array_join(full, " "))
    # a file holds some hundred pictures, as a file for each takes longer to make than to score; tasks grow with them
    tasks = max(s.sparkContext.defaultParallelism, -(-e.count() // 4096))
    e.select(lines.alias("value")).repartition(tasks).write.option("maxRecordsPerFile", 256).text(root)
    s.createDataFrame([], "path string, sharp double").write.parquet(known)
    scored = readers.sharpness(s, root, s.read.parquet(known))
    return scored.select(F.col("note").cast("long").alias("vec_id"), F.round("sharp", 6).alias("sharp"))


def snk_answers(s, d):
    """Answers as JSON lines, replaced as a whole by a second write."""
    p = _path(s, "answers")
    rows = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("qID"), F.col("o_orderstatus").alias("content"), F.col("o_totalprice").alias("latency"))
    for n in (3, 2):
        writers.answers_json(rows.where(F.col("latency") > n), p)
    return s.read.schema("qID string, content string, latency double").json(p)


def str_answers(s, d):
    """A stream of event files into batches of their own; every row arrives once, and a second start adds none."""
    from tidemark.streaming import thinning

    src, out, mark = _path(s, "stream-in"), _path(s, "stream-out"), _path(s, "stream-mark")
    table(s, d, "events").select("event_id", "user_id").repartition(4).write.parquet(src)
    for _ in range(2):
        stream = thinning.event_stream(s, src, s.read.parquet(src).schema)
        thinning.write_answers(stream, out, mark, once=True).awaitTermination()
    return s.read.parquet(out).select("event_id", "user_id")


def str_thinned(s, d):
    """Greedy thinning of the timeline as a stream that has all files at once and then ends, and its state with it."""
    from tidemark.plans.base import events
    from tidemark.streaming import thinning

    src, out, mark = _path(s, "thin-in"), _path(s, "thin-out"), _path(s, "thin-mark")
    events(s, d).select("user_id", "sec").write.parquet(src)
    stream = thinning.event_stream(s, src, s.read.parquet(src).schema)
    fates = thinning.thinned_stream(stream, "user_id", "sec", 7200)
    thinning.write_answers(fates, out, mark, once=True).awaitTermination()
    rows = s.read.schema("user_id bigint, sec double, fate string").parquet(out)
    return rows.where("fate = 'kept'").select("user_id", F.col("sec").cast("long").alias("sec"))


QUERIES = {
    "src_csv_typed": (src_csv_typed, "select c_custkey, c_name, c_acctbal from customer"),
    "src_tsv": (src_tsv, "select n_nationkey, n_name from nation"),
    "src_headerless": (src_headerless, "select s_suppkey, s_name from supplier where s_suppkey % 4 <> 0"),
    "src_json_lines": (src_json_lines, "select r_regionkey, r_name from region"),
    "src_requests": (src_requests, 'select cast(p_partkey as varchar) as "qID", p_name as question from part'),
    "src_parquet_union": (src_parquet_union, "select s_name as name, s_acctbal as bal, '' as seg, 1.0::double as source_weight from supplier union all select c_name, 0.0, c_mktsegment, 0.5::double from customer"),
    "snk_checked_parquet": (snk_checked_parquet, "select o_orderkey, o_totalprice from orders"),
    "snk_by_partition": (snk_by_partition, "select o_orderstatus, case when o_orderstatus = 'F' then 2 else 1 end as version, count(*) as n from orders group by 1, 2"),
    "src_requests_list": (src_requests_list, 'select cast(p_partkey as varchar) as "qID", p_name as question, cast(p_size as double) as start_time from part'),
    "src_requests_wrapped": (src_requests_wrapped, 'select cast(s_suppkey as varchar) as "qID", s_name as question from supplier'),
    "src_qa_rows": (src_qa_rows, "select 'd:' || o_orderkey as uid, cast(o_custkey as varchar) as \"videoID\", cast(o_custkey % 5 as integer) as fold, 1.5::double as end_time from orders where o_orderkey % 3 = 0 and o_custkey % 5 <> 2"),
    "src_qa_first": (src_qa_first, "select 'd:' || o_orderkey as uid, (o_orderkey * 7) % 100003 as place from orders where o_orderkey % 3 <> 0 and o_custkey % 5 = 1 order by place limit 50"),
    "src_responses": (src_responses, 'select cast(o_orderkey as varchar) as "qID", o_orderstatus as content, o_totalprice as latency, case when o_orderkey % 4 <> 0 then round(o_orderkey % 10 / -10.0::double, 6) end as logp_mean from orders'),
    "src_shards_in_order": (src_shards_in_order, "select count(*) as n, 0 as out_of_order from orders"),
    "src_last_shard": (src_last_shard, "select c_custkey as k, c_custkey * 10 + case when c_custkey % 3 = 0 then 2 when c_custkey % 2 = 0 then 1 else 0 end as v from customer"),
    "src_coco": (src_coco, "select 'v' || (o_custkey % 7) as video, ['Clip', 'Mesh', 'Needle'][o_orderkey % 3 + 1] as name, count(*) as n from orders group by 1, 2"),
    "src_dumps": (src_dumps, "select cast(p_partkey % 2 as integer) as source_index, p_partkey // 2 as id, p_size as label from part"),
    "src_timeline": (src_timeline, "select event_type as cls, count(*) as n from events group by 1"),
    "src_with_fallback": (
        src_with_fallback,
        "with l as (select distinct o_custkey % 100 as vid, (o_orderkey % 4) * 256 + 256 as size from orders), w as (select c_custkey, c_custkey % 120 as vid, (c_custkey % 3) * 256 + 300 as size from customer) select c_custkey, (select w.vid || '/' || min(l.size) from l where l.vid = w.vid and l.size >= w.size having count(*) > 0) as path from w",
    ),
    "src_first_candidate": (
        src_first_candidate,
        "with l as (select distinct (o_custkey % 100) || '/' || ((o_orderkey % 4) * 256 + 256) as path from orders), w as (select c_custkey, c_custkey % 120 as vid, unnest([2048, 1024, 512]) as n, unnest([0, 1, 2]) as i from customer), h as (select c_custkey, arg_min(vid || '/' || n, i) as path from w where vid || '/' || n in (select path from l) group by 1) select c_custkey, path from customer left join h using (c_custkey)",
    ),
    "src_images_sharpness": (
        src_images_sharpness,
        "with g as (select vec_id, cast(ceil(len(embedding) / 8.0) as bigint) as h, list_concat([least(greatest(floor(x::double * 100 + 128), 0), 255) for x in embedding], [128.0::double for i in range(cast(ceil(len(embedding) / 8.0) as bigint) * 8 - len(embedding))]) as p from embeddings where len(embedding) > 16), "
        "l as (select vec_id, [4 * p[k + 1] - p[k] - p[k + 2] - p[k - 7] - p[k + 9] for k in [(i // 6 + 1) * 8 + i % 6 + 1 for i in range(6 * (h - 2))]] as z from g) "
        "select vec_id, round(list_var_pop(z), 6) as sharp from l",
    ),
    "snk_answers": (snk_answers, 'select cast(o_orderkey as varchar) as "qID", o_orderstatus as content, o_totalprice as latency from orders where o_totalprice > 2'),
    "str_answers": (str_answers, "select event_id, user_id from events"),
    "str_thinned": (str_thinned, timeline.QUERIES["tl_greedy_thin"][1]),
}
