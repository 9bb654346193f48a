"""Ranked lexical search in buckets of impact vectors ordered by length.

A document is a sparse vector: at each term its impact, an integer of tf and the document's length. A query is the
vector of its terms' weights, so a score is an inner product. Documents are dealt into ranges of vector length and
read longest first, in buckets. A bucket is left out for a query where length times length (Cauchy-Schwarz) stays
below the query's threshold, its k-th best score so far; within a bucket, a document is a candidate only if it
holds one of the focus terms, without which the bounds of the other coordinates cannot reach the threshold. What
then may still reach it is scored anew in exact integers. Thresholds start from the longest vectors of all.

Bounds are compared with a slack far above their rounding, and only what lies strictly below a threshold goes, so ties
are never lost: the result is exact.

Edge cases: a null or termless text, of a document or a query, is in no result and does not count in N; each row of
the queries is a query of its own, each row of the documents a document, so rows of one id may both be ranked;
equal scores go by ascending id, null ids last; columns of any other name are not looked at; empty tables give none.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, fresh_path

#: Bytes that belong to terms: digits, letters, and all of a code point beyond ASCII; A-Z become a-z.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Queries are worked off in blocks of at most about so many rows and bytes, so that a block's vocabulary is bounded.
BLOCK_ROWS, BLOCK_BYTES = 2_000, 16 << 20
#: A bucket ends after so many vectors, or when lengths fall below so much of its first, if it has enough by then.
BUCKET, BUCKET_LEAST, BUCKET_RATIO = 4_096, 512, 0.9
#: This share of all vectors, the longest, gives the first thresholds.
HEAD = 0.02
SLACK = 1 + 1e-9


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TERM_BYTES).split() if text else []


def postings(docs: DataFrame, doc: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """Of every document with a term: doc, n (all its terms), terms (places in the vocabulary) and tfs."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = vocabulary.get
        for part in parts:
            at, sizes, found, tfs, ends = [], [], [], [], [0]
            for i, text in enumerate(part.column(1)):
                all_terms = terms(text.as_py())
                if all_terms:
                    own = Counter(map(look, all_terms))
                    own.pop(None, None)
                    at.append(i)
                    sizes.append(len(all_terms))
                    found.extend(own)
                    tfs.extend(own.values())
                    ends.append(len(found))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (found, tfs)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(sizes, pa.int64()), *lists], names=["doc", "n", "terms", "tfs"])

    return docs.select(F.col(doc).cast("long").alias("doc"), "text").mapInArrow(read, "doc long, n long, terms array<int>, tfs array<int>")


def vectors(rows: DataFrame, documents: int, length: int) -> DataFrame:
    """doc, terms, impacts (long) and norm of the documents that hold any term of the vocabulary."""
    # 90 * n * documents may pass 64 bits on very large tables
    share = F.expr(f"cast(90 as decimal(2,0)) * cast(n as decimal(17,0)) * cast({documents} as decimal(19,0)) div cast({max(length, 1)} as decimal(19,0))")
    m = F.lit(10).cast("long") + share
    impacts = F.expr("transform(tfs, tf -> (1000000000L * tf) div (1000L * tf + 8L * m))")
    norm = F.sqrt(F.aggregate("impacts", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return rows.where(F.size("terms") > 0).withColumn("m", m).withColumn("impacts", impacts).select("doc", "terms", "impacts", norm.alias("norm"))


class _Bucket:
    """Vectors of like length, by term."""

    def __init__(self, docs: np.ndarray, null: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray, longest: float):
        self.docs, self.null, self.longest = docs, null, longest
        order = np.argsort(terms, kind="stable")
        self.rows, self.impacts = np.repeat(np.arange(len(docs)), sizes)[order], impacts[order]
        self.terms, self.starts = np.unique(terms[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(order))
        self.most = np.maximum.reduceat(self.impacts, self.starts)


class _Query:
    """A query's terms and weights, its k best so far and its threshold."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, threshold: int, k: int):
        self.terms, self.weights, self.k, self.threshold = terms, weights, k, max(threshold, 1)
        self.norm = float(np.sqrt((weights.astype(float) ** 2).sum()))
        self.best = [np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)]  # score, id is null, id

    def search(self, bucket: _Bucket) -> None:
        at = np.searchsorted(bucket.terms, self.terms)
        held = (at < len(bucket.terms)) & (bucket.terms[np.minimum(at, len(bucket.terms) - 1)] == self.terms)
        at, weights = at[held], self.weights[held]
        if not len(at):
            return
        # coordinate bounds: the terms that may add most are the focus, until the rest cannot reach the threshold
        bounds = weights.astype(float) * bucket.most[at]
        order = np.argsort(-bounds, kind="stable")
        at, weights, bounds = at[order], weights[order], bounds[order]
        behind = np.append(np.cumsum(bounds[::-1])[::-1], 0.0)
        lengths = np.append(np.sqrt(np.cumsum(weights[::-1].astype(float) ** 2)[::-1]), 0.0) * bucket.longest
        rest = np.minimum(behind, lengths) * SLACK
        focus = int(np.argmax(rest < self.threshold))
        if not focus:
            return
        rows = np.concatenate([bucket.rows[bucket.starts[t] : bucket.ends[t]] for t in at[:focus]])
        parts = np.concatenate([w * bucket.impacts[bucket.starts[t] : bucket.ends[t]].astype(float) for t, w in zip(at[:focus], weights[:focus])])
        some = np.bincount(rows, parts, len(bucket.docs))
        alive = (some > 0) & ((some + rest[focus]) * SLACK >= self.threshold)
        if not alive.any():
            return
        # the survivors, in exact integers
        scores = np.zeros(len(bucket.docs), np.int64)
        for t, w in zip(at, weights):
            own = slice(bucket.starts[t], bucket.ends[t])
            scores[bucket.rows[own]] += w * bucket.impacts[own]
        keep = np.flatnonzero(alive & (scores >= self.threshold))
        if len(keep):
            score, null, doc = (np.concatenate([a, b[keep]]) for a, b in zip(self.best, (scores, bucket.null, bucket.docs)))
            top = np.lexsort((doc, null, -score))[: self.k]
            self.best = [score[top], null[top], doc[top]]
            if len(top) == self.k:
                self.threshold = max(self.threshold, int(self.best[0][-1]))


def search(found: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], thresholds: list[int], k: int) -> DataFrame:
    """(query, doc, score): of each task the at most k best for each query that reach its threshold.

    ``found`` comes longest first within its partitions. Memory: one Arrow batch and one bucket.
    """

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [_Query(t, w, low, k) for (t, w), low in zip(queries, thresholds)]
        active = own
        for part in parts:
            norm = part.column(3).to_numpy(zero_copy_only=False)
            null = part.column(0).is_null().to_numpy(zero_copy_only=False)
            docs = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            lists = part.column(1)
            ends = lists.offsets.to_numpy()
            terms, impacts = lists.values.to_numpy(zero_copy_only=False), part.column(2).values.to_numpy(zero_copy_only=False)
            shift = part.column(2).offsets.to_numpy()
            begin = 0
            while begin < len(norm) and active:
                end = begin + int(np.searchsorted(-norm[begin:], -BUCKET_RATIO * norm[begin], side="right"))
                end = min(max(end, begin + BUCKET_LEAST), begin + BUCKET, len(norm))
                active = [q for q in active if q.norm * norm[begin] * SLACK >= q.threshold]  # all that follows is no longer
                bucket = _Bucket(docs[begin:end], null[begin:end], np.diff(ends[begin : end + 1]), terms[ends[begin] : ends[end]], impacts[shift[begin] : shift[end]], float(norm[begin]))
                for q in active:
                    q.search(bucket)
                begin = end
        for i, q in enumerate(own):
            score, null, doc = q.best
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), i), pa.int32()), pa.array(doc, mask=null), pa.array(score)], names=["query", "doc", "score"])

    return found.mapInArrow(read, "query int, doc long, score long")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _longest_first(found: DataFrame, tasks: int) -> DataFrame:
    """Dealt by ranges of length; documents of one length are spread by a hash of their ids."""
    spread = F.xxhash64("doc", "terms")
    return found.withColumn("spread", spread).repartitionByRange(tasks, F.desc("norm"), "spread").sortWithinPartitions(F.desc("norm")).drop("spread")


def rank(docs: DataFrame, queries: DataFrame, k: int = 10, doc: str = "doc_id", query: str = "item_id") -> DataFrame:
    """For each query, its k documents of the highest score above 0: query, rank, doc, score.

    N counts the documents with a term, L all their terms, n one document's, df the documents with a term, tf its times
    in one. Its weight is floor(1000 ln((2N + 2) / (2 df + 1))), a document's m is 10 + 90 n N div L, and a score sums
    weight * (10^9 tf div (1000 tf + 8 m)) over the query's distinct terms.
    """
    spark = docs.sparkSession
    size = queries.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, -(-size["rows"] // BLOCK_ROWS), -(-(size["bytes"] or 0) // BLOCK_BYTES))
    path = fresh_path(spark, "lexical-found")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for block in range(blocks):
        scratch = Scratch(spark)
        own = queries.where(F.pmod(F.xxhash64(query, "text"), F.lit(blocks)) == block).select(query, "text").collect()
        lists = [sorted(set(terms(r["text"]))) for r in own]
        vocabulary = {t: i for i, t in enumerate(sorted({t for ts in lists for t in ts}))}
        rows = scratch(postings(docs, doc, vocabulary), "lexical-postings")
        whole = rows.agg(F.count("*").alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
        df = {r.t: r.df for r in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}
        weights = {t: math.floor(1000 * math.log((2 * whole.N + 2) / (2 * n + 1))) for t, n in df.items()}
        asked = []
        for ts in lists:
            ids = np.array(sorted(i for i in map(vocabulary.get, ts) if weights.get(i, 0) > 0), np.int64)
            asked.append((ids, np.array([weights[i] for i in ids.tolist()], np.int64)))
        found = vectors(rows, whole.N, whole.L)
        cut = found.agg(F.percentile_approx("norm", F.lit(1 - HEAD), F.lit(1000)).alias("cut")).first().cut
        first = _ranked(search(_longest_first(found.where(F.col("norm") >= F.lit(cut)), tasks), asked, [0] * len(asked), k), k)
        low = {r["query"]: r.score for r in first.where(F.col("rank") == k).collect()}
        hits = search(_longest_first(found, tasks), asked, [low.get(i, 0) for i in range(len(asked))], k)
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(own)], f"query int, id {queries.schema[query].dataType.simpleString()}")
        out = _ranked(hits, k).join(F.broadcast(names), "query")  # one block's names
        out.select(F.col("id").alias(query), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(doc), "score").write.mode("append").parquet(path)
        scratch.clear()
    return spark.read.schema(f"`{query}` {queries.schema[query].dataType.simpleString()}, rank int, `{doc}` long, score long").parquet(path)
