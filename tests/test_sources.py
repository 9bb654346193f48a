"""Readers and writers on small files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import readers as R
from tidemark.sources import writers as K


def test_csv_trims_and_casts(spark, tmp_path):
    (tmp_path / "f.csv").write_text("videoID,dataset,fold\r\n v1 ,d,3\r\nv2,,x\r\n")
    assert [tuple(r) for r in R.csv(spark, str(tmp_path / "f.csv"), R.FOLDS).orderBy("videoID").collect()] == [("v1", "d", 3), ("v2", None, None)]


def test_qa_rows(spark, tmp_path):
    head = "uid,qID,videoID,dataset,fold,track,primary,answer_format,start_time,end_time,duration,ood,clinical,order"
    rows = [f"d:q{i},q{i},v{i},d,{i % 2},{'FRAME' if i < 6 else 'SEGMENT'},p,number,0.000,1.500,1.500,0,1,{9 - i}" for i in range(8)]
    (tmp_path / "qa.csv").write_text("\n".join([head, *rows]))
    got = R.qa_rows(spark, str(tmp_path / "qa.csv"), track="FRAME", fold=0, part="train", limit=2).collect()
    assert [r.qID for r in got] == ["q5", "q3"]


def test_rows_of_one_rank_nest_whatever_their_files(spark, tmp_path):
    head = "uid,qID,videoID,dataset,fold,track,primary,answer_format,start_time,end_time,duration,ood,clinical,order"
    rows = [f"d:q{i},q{i},v{i},d,0,FRAME,p,number,0.000,1.500,1.500,0,1,{i // 6}" for i in range(9)]
    rows.append(rows[0].replace(",v0,", ",v00,"))  # an id that comes twice
    for name, files in (("up", [rows]), ("down", [rows[::-1]]), ("dealt", [rows[i::3] for i in (2, 0, 1)])):
        (tmp_path / name).mkdir()
        for i, own in enumerate(files):
            (tmp_path / name / f"{i}.csv").write_text("\n".join([head, *own]))
        for n in range(1, 11):
            got = R.qa_rows(spark, str(tmp_path / name), track="FRAME", limit=n).collect()
            assert [r.videoID for r in got] == ["v0", "v00", *[f"v{i}" for i in range(1, 9)]][:n]


def test_requests_in_every_wrapping(spark, tmp_path):
    one = {"qID": "1", "question": "?", "extra": 1, "start_time": 0.5}
    for name, body in (("list", [one, {**one, "qID": "2"}]), ("items", {"items": [one]}), ("requests", {"requests": [one]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    counts = {n: R.requests(spark, str(tmp_path / f"{n}.json")).count() for n in ("list", "items", "requests")}
    assert counts == {"list": 2, "items": 1, "requests": 1}


def test_last_shard_wins(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"s{i}.json").write_text(json.dumps({"k": "a", "v": i}) + "\n" + json.dumps({"k": f"b{i}", "v": i}))
    got = {r.k: r.v for r in R.last_shard_wins(spark, str(tmp_path), "k string, v int", "k").collect()}
    assert got == {"a": 2, "b0": 0, "b1": 1, "b2": 2}


def test_annotation_file(spark, tmp_path):
    body = {"images": [{"id": 1, "video": "v", "frame_number": 7, "width": 2, "height": 3}], "annotations": [{"id": 5, "image_id": 1, "category_id": 2, "bbox": [0, 0, 1, 1], "area": 1.0}], "categories": [{"id": 2, "name": "Clip"}]}
    (tmp_path / "a.json").write_text(json.dumps(body))
    im, an, ca = R.coco(spark, str(tmp_path / "a.json"))
    both = im.join(an, im.id == an.image_id).join(ca, an.category_id == ca.id)
    assert [(r.video, r.frame_number, r.name) for r in both.collect()] == [("v", 7, "Clip")]


def test_compressed_lines_carry_the_video(spark, tmp_path):
    with gzip.open(tmp_path / "vid7.jsonl.gz", "wt") as f:
        f.write('{"t": 1}\n{"t": 2}\n')
    assert {(r.video, r.t) for r in R.json_lines(spark, str(tmp_path), "t int").collect()} == {("vid7", 1), ("vid7", 2)}


def test_dumps_keep_ids_apart(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"d{i}.json").write_text('{"id": 1}')
    assert {(r.source_index, r.id) for r in R.dumps(spark, [str(tmp_path / f"d{i}.json") for i in range(2)], "id int").collect()} == {(0, 1), (1, 1)}


def test_unknown_class_raises(spark, tmp_path):
    spark.createDataFrame([("v", 0, "Clip"), ("v", 1, "Hat")], "video string, t int, cls string").write.parquet(str(tmp_path / "t"))
    assert R.timeline(spark, str(tmp_path / "t"), ["Clip", "Hat"]).count() == 2
    with pytest.raises(Exception, match="unknown class"):
        R.timeline(spark, str(tmp_path / "t"), ["Clip"]).collect()


def test_fallbacks(spark):
    want = spark.createDataFrame([("a", 560), ("b", 560), ("c", 560)], "k string, size int")
    have = spark.createDataFrame([("a", 560, "a560"), ("a", 768, "a768"), ("b", 768, "b768"), ("c", 448, "c448")], "k string, size int, path string")
    assert {r.k: r.path for r in R.with_fallback(want, have, ["k"], "size", "path").collect()} == {"a": "a560", "b": "b768", "c": None}
    files = spark.createDataFrame([("x/a.mp4",), ("y/b.avi",)], "path string")
    tries = [F.concat(F.lit("x/"), "k", F.lit(".mp4")), F.concat(F.lit("y/"), "k", F.lit(".avi"))]
    assert {r.k: r.path for r in R.first_candidate(want, files, "k", tries).collect()} == {"a": "x/a.mp4", "b": "y/b.avi", "c": None}


def test_images_not_known_yet(spark, tmp_path):
    for n in ("a.png", "b.png"):
        (tmp_path / n).write_bytes(b"123")
    every = R.images(spark, str(tmp_path))
    assert every.count() == 2
    assert R.images(spark, str(tmp_path), every.limit(1)).count() == 1


def test_checked_parquet_refuses_bad_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(ValueError, match="unique"):
        K.checked_parquet(rows, str(tmp_path / "o"), ["k"], {})
    with pytest.raises(ValueError, match="low"):
        K.checked_parquet(rows, str(tmp_path / "o"), ["v"], {"low": F.col("v") < 3})
    K.checked_parquet(rows, str(tmp_path / "o"), ["v"], {"low": F.col("v") < 2})
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2


def test_pictures_with_comments(spark, tmp_path):
    pixels = " ".join(str(i * i % 50) for i in range(12))
    (tmp_path / "a.pgm").write_text(f"P2\n# 17\n3 4\n255\n{pixels}\n")
    (tmp_path / "b.pgm").write_text(f"P2 3 4 255 {pixels}")
    (tmp_path / "c.pgm").write_text("")
    (tmp_path / "d.pgm").write_text(f"P2\n# x\n3 4\n255\n{pixels}\nP2\n# P2 y\n3 4\n255\n{pixels}\n")
    rows = R.sharpness(spark, str(tmp_path)).collect()
    assert {r.note for r in rows} == {"17", None, "x", "P2 y"} and len(rows) == 4 and len({r.sharp for r in rows}) == 1 and rows[0].sharp > 0
