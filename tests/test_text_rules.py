"""Text queries on rows that the given tables lack."""

import oracle
import pytest

from tidemark.plans import text as P


def test_distinct_list_of_null_and_of_many_words(spark, tmp_path):
    words = " ".join("x" + "".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(3000))
    rows = [(1, None), (2, ""), (3, "The b, the B a THE"), (4, words + " " + words.upper())]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(path)
    got = P.txt_distinct_list(spark, str(tmp_path))
    # the list is made once, not once more for each of its words
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    con = oracle.duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{path}/*.parquet')")
    assert oracle.differences(spark, con, str(tmp_path), *P.QUERIES["txt_distinct_list"]) == ""


ODD = ("In\u00f6einung, im", "in time", "\u00e9is the", "wei\u00df first", "\u00fcfirst", "\u00f1both", "both\u00e9", "\u017felect one", "how many \u212a", "5\u00e9 7", "7 \u00fc8", "the\u00e4 the The\u00df", "\u0131n", "fo\u00f1 x", "yes or no\u00e9")


@pytest.mark.parametrize("name", ["txt_question_family", "txt_mask_mode", "txt_topic", "txt_template_fold", "txt_word_replace"])
def test_words_end_at_letters_beyond_ascii(spark, tmp_path, name):
    spark.createDataFrame([(i, k, t) for i in range(11) for k, t in enumerate(ODD)], "conv_id bigint, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame(list(enumerate(ODD)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = oracle.duckdb.connect()
    for t in ("conversations", "documents"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert oracle.differences(spark, con, str(tmp_path), *P.QUERIES[name]) == ""
