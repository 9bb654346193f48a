"""The pipeline against plain versions of its deciding stages, and its shape."""

from collections import Counter

from test_documents import plain_components, plain_figures, secret_base

import corpus_pipeline as P


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, [(r.doc_id, r.text) for r in docs.collect()]
    kept = []
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert docs.columns == columns
        kept.append(docs.collect())
    good = [(i, t) for i, t in rows if (f := plain_figures(t))[0] >= 20 and 100 * f[4] <= 30 * f[0]]
    # the holdout of the smallest scale is too small to certify a cutoff
    assert sorted(r.doc_id for r in kept[0]) == sorted(i for i, _ in good)
    alone = {i for i, (_, c) in plain_components(good, 5).items() if i == c}
    assert {r.doc_id for r in kept[1]} == alone
    assert {r.doc_id for r in kept[2]} == alone
    assert all(not secret_base(r.text or "") for r in kept[2])
    copies = Counter(r.doc_id for r in kept[3])
    assert set(copies) <= alone
    assert max(copies.values()) <= 2
    pieces = Counter()
    for r in kept[4]:
        pieces[r.doc_id] += r.length
    assert set(pieces) == set(copies)


def _run(spark, folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return P.run(spark, str(folder))


def test_edge_rows(spark, edge, sf, tmp_path):
    """Nulls, empty and very long texts, repeated rows and ids, and columns of clashing names pass through."""
    out = _run(spark, tmp_path, edge, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    ids = {r.doc_id for r in edge.select("doc_id").collect()}
    assert out and {r.doc_id for r in out} <= ids
    pieces = Counter()
    for r in out:
        pieces[r.sequence_id] += r.length
    assert all(n == 1024 for w, n in pieces.items() if w != max(pieces))


def test_empty_tables(spark, empty, sf, tmp_path):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert _run(spark, tmp_path, empty, labels.where("false")).count() == 0
