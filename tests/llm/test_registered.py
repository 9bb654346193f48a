"""The registered queries themselves, over edge rows and over empty tables."""

import oracle
import pytest

from tidemark.llm import queries

COLUMNS = {
    "op1_mixing": "doc_id size source_size target taken",
    "op2_vector_dedup": "vec_id n_links component_id kept",
    "op3_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op4_token_files": "doc_id start n_tokens ids_crc32",
    "op5_resharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op6_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op7_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op8_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op9_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op10_minhash": "doc_id n_shingles component_id kept",
    "op11_lexical_search": "item_id rank doc_id score",
    "op12_collocations": "lang rank phrase a l r n score",
    "op13_html_text": "page_id url text n_chars",
}


@pytest.fixture(scope="module")
def folders(spark, edge, empty, sf, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    labels, vectors = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "embeddings"))
    for name, docs, some in (("edge", edge, True), ("empty", empty, False)):
        docs.write.parquet(f"{root}/{name}/documents.parquet")
        for t in ("pages", "benchmark"):
            spark.read.parquet(f"{sf}/{t}.parquet").where("true" if some else "false").write.parquet(f"{root}/{name}/{t}.parquet")
        labels.where("true" if some else "false").write.parquet(f"{root}/{name}/labels.parquet")
        vectors.where("true" if some else "false").write.parquet(f"{root}/{name}/embeddings.parquet")
    return root


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, folders, edge, name):
    query = queries.queries()[name]
    out = query(spark, f"{folders}/edge")
    assert set(COLUMNS[name].split()) <= set(out.columns)
    rows = out.count()
    assert rows == edge.count() if name not in ("op2_vector_dedup", "op6_packing", "op11_lexical_search", "op12_collocations", "op13_html_text") else rows > 0
    assert query(spark, f"{folders}/empty").count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, folders, sf, name):
    """The given tables, the edge rows beside them, and empty tables, as DuckDB has them."""
    query, sql = queries.queries()[name], queries.oracle_sql()[name]
    assert oracle.differences(spark, oracle.connect(sf), sf, query, sql) == ""
    for kind in ("edge", "empty"):
        con = oracle.connect(sf)
        for t in ("documents", "benchmark"):
            con.execute(f"create or replace view {t} as select * from read_parquet('{folders}/{kind}/{t}.parquet/*.parquet')")
        assert oracle.differences(spark, con, f"{folders}/{kind}", query, sql) == ""
