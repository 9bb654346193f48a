"""The queries ``opN_<name>``: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import collocations, html_text, lexical, minhash, mixing, packing, pii, quality, reshard, secrets, token_counts, token_files, vectors


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.93)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_documents(spark, sf_dir))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, manifest = token_files.write_files(_documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json"), end_id=2)
    return token_files.digests(token_files.read_files(path, manifest))


def op5_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = reshard.reshard(_documents(spark, sf_dir), reshard.by_source(8), shards=8)
    return reshard.report(rows)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(_documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json"), end_id=0, window=1024))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(token_counts.prefix_table(_documents(spark, sf_dir), _vocabulary("piece_bpe_32k.model")), limit=4096)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(_documents(spark, sf_dir), shingle=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11_SQL = f"""
with d as (select doc_id, row_number() over () as u, {_TERMS} as ts from documents),
s as (select count(*) as docs, cast(sum(len(ts)) as bigint) as terms from d where len(ts) > 0),
i as (select q, item_id, unnest(list_distinct(ts)) as term from (select row_number() over () as q, item_id, {_TERMS} as ts from benchmark)),
o as (select u, doc_id, n, term, count(*) as tf from (select u, doc_id, len(ts) as n, unnest(ts) as term from d) where term in (select term from i) group by all),
w as (select term, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as w from o, s group by term, docs),
x as (select q, item_id, u, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) as bigint) as score
  from o join w using (term) join i using (term), s group by q, item_id, u, doc_id)
select item_id, cast(row_number() over (partition by q order by score desc, doc_id asc nulls last) as integer) as rank, doc_id, score
from x where score > 0 qualify rank <= 10"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir), least=10, share=50, top=2_000)


OP12_SQL = """
with t as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
p as (select lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) as piece from t),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as ws from p),
k as (select unnest([1, 2, 3]) as k),
g as (select lang, k, ws, unnest(range(1, len(ws) - k + 2)) as i from w, k where len(ws) >= k),
f as (select lang, k, array_to_string(ws[i:i + k - 1], ' ') as phrase, count(*) as f from g group by all),
n as (select lang, cast(sum(f) as bigint) as n from f where k = 1 group by lang),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as ws from f where k > 1 and f >= 10),
inner_ as (select lang, array_to_string(ws[i:i + 1], ' ') as phrase, max(a) as longer from (select lang, ws, a, unnest([1, 2]) as i from c where k = 3) group by all),
x as (select lang, phrase, a, ws, unnest(range(1, len(ws))) as cut from c left join inner_ using (lang, phrase) where k = 3 or longer is null or 100 * longer < 50 * a),
y as (select x.*, l.f as l, r.f as r from x join f l on l.lang = x.lang and l.phrase = array_to_string(ws[1:cut], ' ') join f r on r.lang = x.lang and r.phrase = array_to_string(ws[cut + 1:], ' ')),
z as (select lang, phrase, a, l, r, cast((cast(1000000 as hugeint) * a * a) // (cast(l as hugeint) * r) as bigint) as score, cut from y),
best as (select * from z qualify row_number() over (partition by lang, phrase order by score, cut) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from best join n using (lang) qualify rank <= 2000"""


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html_text.extract(pages)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_vector_dedup, op3_pii, op4_token_files, op5_resharding, op6_packing, op7_secrets, op8_token_counts, op9_quality_rules, op10_minhash, op11_lexical_search, op12_collocations, op13_html_text, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op11_lexical_search": OP11_SQL, "op12_collocations": OP12_SQL}
