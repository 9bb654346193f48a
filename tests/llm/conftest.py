import pytest
from pyspark.sql import functions as F

LONG = "word " * 30_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, spans int, shard string, class int, words int, `n` int, base string, label int"


def edge_rows():
    """Nulls in every column, empty and very long texts, repeated rows, other white space, other scripts."""
    x = ("x", 1, "s", 2, 3, 4, "b", 5)
    some = "Alpha beta gamma delta epsilon zeta eta theta iota kappa. " * 3
    return [
        (10**9 + 1, some, "en", "src1", 9, *x), (10**9 + 1, some, "en", "src1", 9, *x), (10**9 + 2, some, "en", "src2", 9, *x), (10**9 + 3, None, "en", "src1", None, *x), (10**9 + 4, "", "de", None, 0, *x),
        (10**9 + 5, " \t\n ", None, "src1", 4, *x), (None, "no id here at all", "en", "src1", 1, *x), (None, None, None, None, None, *([None] * 8)), (10**9 + 6, LONG, "en", "src3", 9, *x),
        (10**9 + 7, "a" * 60_000 + "1", "en", "src1", 9, *x), (10**9 + 8, "a  b\n\n c \n", "en", "src1", 9, *x), (10**9 + 9, "日本語 テキスト é 😀 <|endoftext|> ▁x", "ja", "", 9, *x), (10**9 + 10, "one", "en", "src1", 9, *x),
        (10**9 + 11, "ONE", "en", "src1", 9, *x), (10**9 + 12, "line one here\nline one here\n" * 20, "en", "src1", 9, *x),
    ]


@pytest.fixture(scope="session")
def edge(spark, sf, tmp_path_factory):
    """The edge rows beside the documents of the smallest scale."""
    path = str(tmp_path_factory.mktemp("edge") / "documents")
    own = spark.createDataFrame(edge_rows(), SCHEMA)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rest = [F.lit(None).cast(kind).alias(c) for c, kind in own.dtypes if c not in docs.columns]
    own.unionByName(docs.select("*", *rest)).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def rows(edge):
    return [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
