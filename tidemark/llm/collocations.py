"""Phrase collocations from a weighted de Bruijn graph of words.

A node is a pair of words, an edge a run of three: it leads from its first two words to its last two. Only edges are
counted over the texts, first in every task, then by node. The rest follows from the graph: a pair occurs as often as
its node has outflow and pieces end at it, a word as often as the nodes that begin with it, and pieces that end with it.
Edges of at least ``least`` occurrences are then compacted: where a node has one edge in and one out, of equal weight,
both become one path, found by pointer doubling, so that a passage of many copies is one row.

Edge cases: a null or empty text has no words; a null lang is ``und``; rows that repeat all count; a text may be of any
length, as words are counted by slices that overlap by two; columns of any other name are not looked at; empty tables
give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, fresh_path

#: Piece ends become full stops, tabs spaces, A-Z a-z; all else stays.
PIECES = bytes(46 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
END = b"."

#: Bytes of text of one language that are counted at once: below 2**21 distinct words, so three fit 63 bits.
SLICE = 8_000_000
#: Bytes that a task holds back for all languages.
HELD = 24_000_000
ROWS = 200_000
#: Edges of a path are gathered by so many.
STRETCH = 1_024


class _Counter:
    """Counts the windows of three tokens of one language's stream of words and piece ends."""

    def __init__(self, lang: str):
        self.lang, self.held, self.size, self.tail = lang, [], 0, [END, END]

    def add(self, text: bytes) -> Iterator[pa.RecordBatch]:
        data, begin = text.translate(PIECES), 0
        while begin < len(data):
            end = min(begin + SLICE // 2, len(data))
            if end < len(data):  # not within a word
                cuts = [c for c in (data.find(b" ", end), data.find(END, end)) if c >= 0]
                end = min(cuts, default=len(data))
            if self.size + end - begin > SLICE:
                yield from self.flush()
            self.held.append(data[begin:end])
            self.size += end - begin
            begin = end
        self.held.append(END)

    def flush(self) -> Iterator[pa.RecordBatch]:
        """The edges so far; two tokens stay for the windows that begin there."""
        tokens = [*self.tail, *b"".join(self.held).replace(END, b" . ").split()]
        self.held, self.size, self.tail = [], 0, tokens[-2:]
        coded = pa.array(tokens, pa.binary()).dictionary_encode()
        del tokens
        words, ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        stop = pc.index(words, pa.scalar(END, pa.binary())).as_py()
        a, b, c = ids[:-2], ids[1:-1], ids[2:]
        edges = (b != stop) & ((a != stop) | (c == stop))
        bits = max(1, int(len(words)).bit_length())
        keys, counts = np.unique((a << 2 * bits | b << bits | c)[edges], return_counts=True)
        low = (1 << bits) - 1
        for at in range(0, len(keys), ROWS):
            k = keys[at : at + ROWS]
            a, b, c = k >> 2 * bits, k >> bits & low, k & low
            alone = pa.array(a == stop)  # a piece of one word
            first, second, third = (words.take(pa.array(x)) for x in (a, b, c))
            nothing = pa.scalar(b"", pa.binary())
            node = pc.binary_join_element_wise(pc.if_else(alone, second, first), pc.if_else(alone, nothing, second), pa.scalar(b" ", pa.binary()))
            word = pc.if_else(pa.array(c == stop), nothing, third)
            yield pa.RecordBatch.from_arrays([pa.array([self.lang] * len(k), pa.string()), node.cast(pa.string()), word.cast(pa.string()), pa.array(counts[at : at + ROWS])], names=["lang", "node", "word", "n"])


def edges(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, node (two words), word, n: each task's windows of three words and their counts.

    The word is empty where a piece ends; a piece of one word has a node whose second word is empty.
    """

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, _Counter] = {}
        for part in parts:
            texts = part.column(1).cast(pa.large_binary())
            for lang, data in zip(part.column(0), texts):
                if (own := data.as_py()) is not None:
                    name = lang.as_py()
                    if name not in counters:
                        counters[name] = _Counter(name)
                    yield from counters[name].add(own)
            if sum(c.size for c in counters.values()) + len(counters) * 1_000 > HELD:
                for c in counters.values():
                    if c.held:
                        yield from c.flush()
                counters.clear()
        for c in counters.values():
            if c.held:
                yield from c.flush()

    source = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    return source.mapInArrow(read, "lang string, node string, word string, n long")


def graph(docs: DataFrame, least: int, **columns: str) -> DataFrame:
    """Rows (kind, lang, phrase, n): edges of at least ``least`` occurrences, nodes and words of as many, and each
    language's number of words (phrase null).

    Edges go over the network once, dealt by node; all four kinds read what arrives. Conditions on the keys are
    therefore aggregated: as filters they would go below the exchange and make it another one for each kind; so would a column left out.
    """
    dealt = edges(docs, **columns).repartition("lang", "node")
    pair = ~F.col("node").endswith(" ")
    ends = F.when((F.col("word") == "") & pair, F.col("n")).otherwise(0)
    solid = dealt.groupBy("lang", "node", "word").agg(F.sum("n").alias("n"), F.max((F.col("word") != "") & pair).alias("real")).where(F.col("real") & (F.col("n") >= least))
    flows = dealt.groupBy("lang", "node").agg(F.sum("n").alias("n"), F.sum(ends).alias("ends"), F.max(pair).alias("real"))
    word = lambda at, n: F.struct(F.substring_index("node", " ", at).alias("word"), F.col(n).alias("n"))
    words = flows.select("lang", F.explode(F.array(word(1, "n"), word(-1, "ends"))).alias("w")).select("lang", "w.*").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    row = lambda df, kind, phrase: df.select(F.lit(kind).alias("kind"), "lang", phrase.alias("phrase"), "n")
    return (
        row(solid, "edge", F.concat_ws(" ", "node", "word"))
        .unionByName(row(flows.where(F.col("real") & (F.col("n") >= least) & (F.col("ends") <= F.col("n"))), "node", F.col("node")))
        .unionByName(row(words.where(F.col("n") >= least), "word", F.col("word")))
        .unionByName(row(dealt.groupBy("lang").agg(F.sum(F.col("n") + ends).alias("n")), "all", F.lit(None).cast("string")))
    )


def compacted(solid: DataFrame, scratch: Scratch) -> DataFrame:
    """Unary paths of the edges (lang, phrase, n): lang, phrase (all its words), n, edges (their number).

    A path longer than ``STRETCH`` edges is given in stretches that overlap by two words, a cycle is cut at its
    least edge.
    """
    two = lambda c, at: F.substring_index(c, " ", at)
    ends = solid.select("lang", two("phrase", 2).alias("node"), F.lit(0).alias("into"), "phrase", "n").unionByName(solid.select("lang", two("phrase", -2).alias("node"), F.lit(1).alias("into"), "phrase", "n"))
    unary = ends.groupBy("lang", "node").agg(
        F.sum("into").alias("i"), F.count("*").alias("k"), F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.when(F.col("into") == 1, F.col("phrase"))).alias("before"), F.max(F.when(F.col("into") == 0, F.col("phrase"))).alias("after")
    )
    unary = unary.where("i = 1 and k = 2 and low = high and before <> after")
    # each edge knows an edge some steps before it, and the least edge on the way; steps double, until all know their first
    least = F.least(F.struct(F.col("after").alias("edge"), F.lit(0).alias("back")), F.struct(F.col("before").alias("edge"), F.lit(1).alias("back")))
    known = scratch(unary.select("lang", F.col("after").alias("edge"), F.col("before").alias("up"), F.lit(1).alias("far"), least.alias("low"), F.lit(False).alias("done")), "paths-0")
    turn, left = 0, known.count()
    some = left > 0
    while left:
        turn += 1
        up = known.select(F.col("lang").alias("l"), F.col("edge").alias("e"), F.col("up").alias("up2"), F.col("far").alias("far2"), F.col("low").alias("low2"), F.col("done").alias("done2"))
        met = known.where("not done").join(up, (F.col("lang") == F.col("l")) & (F.col("up") == F.col("e")), "left")
        lower = F.coalesce(F.col("low2.edge") < F.col("low.edge"), F.lit(False))
        met = met.select(
            "lang", "edge", F.coalesce("up2", "up").alias("up"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"),
            F.when(lower, F.struct(F.col("low2.edge").alias("edge"), (F.col("low2.back") + F.col("far")).alias("back"))).otherwise(F.col("low")).alias("low"),
            (F.col("e").isNull() | F.col("done2")).alias("done"), lower.alias("moved"),
        )
        known = scratch(met.unionByName(known.where("done").withColumn("moved", F.lit(False))), f"paths-{turn}")
        now = known.where("not done").agg(F.count("*").alias("left"), F.coalesce(F.max("moved"), F.lit(False)).alias("moved")).first()
        known = known.drop("moved")
        if now.left == left and not now.moved:  # cycles alone, each seen whole
            break
        left = now.left
    placed = known.select("lang", F.col("edge").alias("phrase"), F.when(F.col("done"), F.col("up")).otherwise(F.col("low.edge")).alias("head"), F.when(F.col("done"), F.col("far")).otherwise(F.col("low.back")).alias("at"))
    rows = solid.select("lang", "phrase", "n")
    if not some:
        return rows.withColumn("edges", F.lit(1).cast("long"))
    rows = rows.join(placed, ["lang", "phrase"], "left").withColumn("head", F.coalesce("head", "phrase")).withColumn("at", F.coalesce("at", F.lit(0)))
    whole = rows.groupBy("lang", "head", F.expr(f"at div {STRETCH}").alias("part")).agg(F.sort_array(F.collect_list(F.struct("at", "phrase"))).alias("es"), F.first("n").alias("n"))
    more = F.transform(F.slice("es", F.lit(2), F.size("es")), lambda e: F.substring_index(e["phrase"], " ", -1))
    return whole.select("lang", F.concat_ws(" ", F.get("es", F.lit(0))["phrase"], F.concat_ws(" ", more)).alias("phrase"), "n", F.size("es").cast("long").alias("edges")).withColumn("phrase", F.rtrim("phrase"))


def triples(paths: DataFrame) -> DataFrame:
    """The edges of compacted paths again: lang, phrase of three words, n."""
    at = paths.withColumn("w", F.split("phrase", " ")).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - 2)))
    return at.select("lang", F.concat_ws(" ", F.slice("w", F.col("at"), 3)).alias("phrase"), "n")


def collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2_000, **columns: str) -> DataFrame:
    """Each language's first ``top`` phrases of two or three words that occur ``least`` times: lang, rank, phrase, a, l, r, n, score.

    a, l and r count the phrase and the two parts of its lowest-scoring cut, n all words; the score is
    floor(10^6 a^2 / (l r)). A pair within a triple of at least ``share`` percent of its occurrences is dropped.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    counted = scratch(graph(docs, least, **columns), "collocations-graph")
    paths = scratch(compacted(counted.where("kind = 'edge'").drop("kind"), scratch), "collocations-paths")
    three = triples(paths)
    two = counted.where("kind = 'node'").select("lang", "phrase", "n")
    inner = three.select("lang", F.explode(F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))).alias("phrase"), F.col("n").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    own = two.join(inner, ["lang", "phrase"], "left").where(F.expr(f"longer is null or 100 * longer < {share} * n")).select("lang", "phrase", "n").unionByName(three)
    own = own.withColumnRenamed("n", "a").withColumn("cut", F.explode(F.sequence(F.lit(1), F.size(F.split("phrase", " ")) - 1)))
    parts = counted.where("kind in ('node', 'word')")
    left, right = (parts.select(F.col("lang").alias(f"lang_{x}"), F.col("phrase").alias(f"part_{x}"), F.col("n").alias(x)) for x in "lr")
    cuts = own.withColumn("left", F.expr("substring_index(phrase, ' ', cut)")).withColumn("right", F.expr("substring_index(phrase, ' ', -(size(split(phrase, ' ')) - cut))"))
    cuts = cuts.join(left, (F.col("lang") == F.col("lang_l")) & (F.col("left") == F.col("part_l"))).join(right, (F.col("lang") == F.col("lang_r")) & (F.col("right") == F.col("part_r")))
    exact = lambda c: f"cast({c} as decimal(16,0))"
    cuts = cuts.withColumn("score", F.expr(f"cast(1000000 as decimal(7,0)) * ({exact('a')} * {exact('a')}) div ({exact('l')} * {exact('r')})"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    total = counted.where("kind = 'all'").select(F.col("lang").alias("lang_n"), F.col("n"))
    out = ranked.join(total, F.col("lang") == F.col("lang_n")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    path = fresh_path(spark, "collocations-found")
    out.write.parquet(path)
    scratch.clear()
    return spark.read.schema(out.schema).parquet(path)
