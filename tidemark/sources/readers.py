"""Scans of annotation data with explicit schemas; empty texts become nulls where they mean none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDS = "videoID string, dataset string, fold int"
QA_SPLIT = "uid string, qID string, videoID string, dataset string, fold int, track string, primary string, answer_format string, start_time double, end_time double, duration double, ood int, clinical int, order int"
REQUEST = "qID string, videoID string, start_time double, end_time double, procedure_type string, question string"
RESPONSES = "uid string, qID string, dataset string, videoID string, content string, raw string, fmt string, primary string, group string, answer string, question string, latency double, start_time double, end_time double, n_input_tokens int, n_frames int, conf struct<logp_sum double, logp_mean double, logp_min double, n_gen_tokens int>"


def _clean(df: DataFrame) -> DataFrame:
    """Texts without carriage returns and outer blanks; an empty one is null."""
    strip = lambda c: F.nullif(F.trim(F.replace(F.col(c), F.lit("\r"), F.lit(""))), F.lit(""))
    return df.select(*[strip(c).alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes])


def csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """A CSV with a header that must fit the schema. Fields are read as text and then cast."""
    names = T.StructType.fromDDL(schema).fieldNames()
    text = ", ".join(f"`{n}` string" for n in names)
    rows = _clean(spark.read.csv(path, schema=text, header=True, sep=sep, enforceSchema=False))
    return rows.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)])


def headerless(spark: SparkSession, path: str, names: list[str], needed: int) -> DataFrame:
    """A CSV without header; rows with fewer than ``needed`` fields are left out."""
    rows = _clean(spark.read.csv(path, schema=", ".join(f"`{n}` string" for n in names), header=False, mode="PERMISSIVE"))
    return rows.where(F.col(names[needed - 1]).isNotNull())


def qa_rows(spark: SparkSession, path: str, track: str | None = None, fold: int | None = None, part: str = "all", limit: int | None = None) -> DataFrame:
    """Split rows of a track and fold part; a limit takes the first by seeded rank, rows of one rank by uid, so that subsets nest."""
    rows = csv(spark, path, QA_SPLIT)
    if track:
        rows = rows.where(F.col("track") == track)
    if fold is not None and part != "all":
        rows = rows.where(F.col("fold") == fold if part == "val" else F.col("fold") != fold)
    rest = [c for c in rows.columns if c not in ("track", "order")]  # from uid on, so that no tie is left to chance
    return rows.orderBy("track", "order", *rest).limit(limit) if limit else rows


def responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESPONSES).json(path, multiLine=True)


def requests(spark: SparkSession, path: str) -> DataFrame:
    """A batch of requests: a list, or an object that holds one under ``items`` or ``requests``."""
    item = T.StructType.fromDDL(REQUEST)
    wrapped = T.StructType([T.StructField("items", T.ArrayType(item)), T.StructField("requests", T.ArrayType(item)), *item.fields])
    rows = spark.read.schema(wrapped).json(path, multiLine=True)
    own = F.struct(*[F.col(f.name) for f in item.fields])
    several = F.coalesce("items", "requests", F.array(own))
    return rows.select(F.explode(several).alias("x")).select("x.*").where("qID is not null")


def parquet_union(spark: SparkSession, paths: dict[str, float]) -> DataFrame:
    """Files whose columns may differ, each row with its source's weight."""
    parts = [spark.read.parquet(p).withColumn("source_weight", F.lit(w)) for p, w in paths.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def last_wins(rows: DataFrame, key: str, shard: str) -> DataFrame:
    """Of rows with one key that of the last shard stays; counts are merged before rows are dealt out."""
    others = [c for c in rows.columns if c not in (key, shard)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), shard).alias("_row")).select(key, "_row.*")


def last_shard_wins(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON shards of (key, ...): of rows with one key that of the last file stays."""
    return last_wins(spark.read.schema(schema).json(path).withColumn("_file", F.input_file_name()), key, "_file")


def coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, annotations and categories of an annotation file."""
    schema = (
        "images array<struct<id: bigint, video: string, frame_number: bigint, width: int, height: int>>, "
        "annotations array<struct<id: bigint, image_id: bigint, category_id: int, bbox: array<double>, area: double>>, categories array<struct<id: int, name: string>>"
    )
    one = spark.read.schema(schema).json(path, multiLine=True)
    return tuple(one.select(F.explode(c).alias("x")).select("x.*") for c in ("images", "annotations", "categories"))


def dumps(spark: SparkSession, paths: list[str], schema: str, labels: dict[str, dict[int, str]] | None = None) -> DataFrame:
    """Several JSON-lines dumps in one; ids are unique by (source_index, id). ``labels`` are the dumps' label
    maps, which must be equal."""
    maps = list((labels or {}).values())
    if any(m != maps[0] for m in maps):
        raise ValueError(f"dumps of different labels: {sorted(labels)}")
    return reduce(DataFrame.unionByName, [spark.read.schema(schema).json(p).withColumn("source_index", F.lit(i)) for i, p in enumerate(paths)])


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, compressed or not, with the file's stem as video."""
    video = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.jsonl?)?(\.gz)?$", 1)
    return spark.read.schema(schema).json(path).withColumn("video", video)


def timeline(spark: SparkSession, path: str, classes: list[str]) -> DataFrame:
    """A timeline whose classes are data. Unknown ones raise when the row is read."""
    rows = spark.read.parquet(path)
    known = F.array(*map(F.lit, classes))
    return rows.withColumn("cls", F.when(F.array_contains(known, F.col("cls")), F.col("cls")).otherwise(F.raise_error(F.concat(F.lit("unknown class: "), F.coalesce("cls", F.lit("null"))))))


def with_fallback(rows: DataFrame, listing: DataFrame, keys: list[str], size: str, path: str) -> DataFrame:
    """The listed path of exactly the wanted size, else that of the next larger one."""
    cached = listing.select(*keys, F.col(size).alias("_size"), path)
    near = rows.join(cached, keys, "left").where(F.col("_size").isNull() | (F.col("_size") >= F.col(size)))
    best = near.groupBy(*keys, size).agg(F.min_by(path, "_size").alias(path))
    return rows.join(best, [*keys, size], "left")


def first_candidate(rows: DataFrame, listing: DataFrame, key: str, patterns: list[Column]) -> DataFrame:
    """The first of several candidate paths that the listing has."""
    tries = rows.withColumn("_c", F.explode(F.transform(F.array(*patterns), lambda p, i: F.struct(i.alias("i"), p.alias("path")))))
    hit = tries.join(listing.select("path"), tries["_c.path"] == listing["path"], "left_semi")
    return rows.join(hit.groupBy(key).agg(F.min_by("_c.path", "_c.i").alias("path")), key, "left")


def images(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """Paths and lengths of image files, without those that ``known`` (path) holds already."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files if known is None else files.join(known.select("path"), "path", "left_anti")


def sharpness(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """path, sharp and note of plain grey pictures (PGM, P2) that ``known`` (path) does not hold: the variance of the
    Laplacian over inner pixels, and the first comment, null without one. Files are read where they lie, one at a
    time; a file may hold several pictures, each begun by a line of its own, or none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "content")
    files = files if known is None else files.join(known.select("path"), "path", "left_anti")

    def score(parts):
        import re

        import numpy as np
        import pandas as pd

        comment, begin = re.compile(rb"#([^\r\n]*)"), re.compile(rb"(?m)^(?=P2\s)")
        for pdf in parts:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                for raw in filter(bytes.strip, begin.split(content)):
                    said = comment.search(raw)
                    head = comment.sub(b"", raw).split()
                    w, h = int(head[1]), int(head[2])
                    x = np.array(head[4 : 4 + w * h], dtype=np.float64).reshape(h, w)
                    z = 4 * x[1:-1, 1:-1] - x[1:-1, :-2] - x[1:-1, 2:] - x[:-2, 1:-1] - x[2:, 1:-1]
                    out.append((path, float(z.var()) if z.size else None, said[1].decode("utf-8", "replace").strip() if said else None))
            yield pd.DataFrame(out, columns=["path", "sharp", "note"])

    return files.mapInPandas(score, "path string, sharp double, note string")
