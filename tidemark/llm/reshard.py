"""Operator 5, resharding by minimum-cost flow.

1. Sizes (UTF-8 bytes of the text plus 1) are summed per old shard. New capacities are given, or equal.
2. Bytes flow from old shards to new ones at no cost where they stay and at a cost per byte where they
   move. The least cost moves the fewest bytes; the network has one node per shard, and is solved on the
   driver by successive cheapest paths.
3. An old shard's documents stand in an order: large ones first, so what stays is cut off behind them
   and the cuts between transfers fall between small documents. They are dealt into chunks of about
   ``chunk_bytes`` (size class, hash of the id); chunk totals give every chunk's place in its shard, so no
   task ever orders a whole shard. A document goes where the middle of its bytes lies.
4. Affected shards (those that give or take bytes) are rewritten, one folder each; others keep their files.
   Slots number the rows of a new shard from 0 without gaps, by counts per chunk.

Nulls and the like: a null text has size 1 and crc32 0; a null doc_id or old shard is a value like others;
equal texts are rows of their own and may part, since a group of copies may be larger than a shard; rows
that agree in everything are interchangeable; an empty table gives no row; other columns stay in the
rewritten files, whatever their names: what is added bears the prefix ``PREFIX``, and a table that has such a
column already is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_path, join_small, staged

PREFIX = "reshard_"


def cheapest_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Bytes from each old shard to each new one at the least total cost; all supply must fit.

    Each round sends as much as it can along a cheapest path from a shard with bytes left to one with
    room, where sending back what was sent earlier earns its cost again.
    """
    n, m = len(supply), len(capacity)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    if sum(left) > sum(room):
        raise ValueError("the capacities are too small")
    while any(left):
        far = [0 if x else None for x in left] + [None] * m  # distances; old shards, then new ones
        via: list[int | None] = [None] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    if far[i] is not None and (far[n + j] is None or far[i] + cost[i][j] < far[n + j]):
                        far[n + j], via[n + j], changed = far[i] + cost[i][j], i, True
                    if flow[i][j] and far[n + j] is not None and (far[i] is None or far[n + j] - cost[i][j] < far[i]):
                        far[i], via[i], changed = far[n + j] - cost[i][j], n + j, True
        end = min((j for j in range(m) if room[j] and far[n + j] is not None), key=lambda j: far[n + j])
        path, at = [], n + end
        while via[at] is not None:
            path.append((via[at], at))
            at = via[at]
        most = min([left[at], room[end], *(flow[b][a - n] for a, b in path if a >= n)])
        for a, b in path:
            if a < n:
                flow[a][b - n] += most
            else:
                flow[b][a - n] -= most
        left[at] -= most
        room[end] -= most
    return flow


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def _size() -> Column:
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")


def plan(sizes: dict[int, int], capacities: list[int], cost: list[list[int]] | None = None) -> list[tuple[int, int, int, int]]:
    """Transfers (old shard, from byte, to byte, new shard): an old shard's own bytes first, then by shard."""
    old = sorted(sizes)
    cost = cost or [[int(i != j) for j in range(len(capacities))] for i in old]
    out = []
    for i, row in zip(old, cheapest_flow([sizes[i] for i in old], capacities, cost)):
        at = 0
        for j in sorted(range(len(row)), key=lambda j: (j != i, j)):
            if row[j]:
                out.append((i, at, at + row[j], j))
                at += row[j]
    return out


def reshard(docs: DataFrame, old_shard: Column, shards: int = 8, capacities: list[int] | None = None, chunk_bytes: int = 4 << 20, path: str | None = None) -> tuple[DataFrame, list[tuple[int, int, int, int]]]:
    """Rewrites the affected shards under ``path`` and returns all rows with shard and slot, and the transfers.

    ``old_shard`` is an int expression over ``docs``. The table has one row per document: its columns, and
    reshard_size, reshard_text_crc32, reshard_shard, reshard_slot.
    """
    if any(c.lower().startswith(PREFIX) for c in docs.columns):
        raise ValueError(f"columns that begin with {PREFIX} are added here")
    spark = docs.sparkSession
    c = lambda name: F.col(PREFIX + name)
    named = lambda *names: [PREFIX + n for n in names]
    size_class = F.floor(F.log2(c("size"))).cast("int")
    # rows of one id and size lie in as many chunks as their texts need
    spread = F.xxhash64(F.lit(3), "doc_id", c("text_crc32"), c("size"))
    added = [_size().alias(PREFIX + "size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias(PREFIX + "text_crc32"), old_shard.cast("int").alias(PREFIX + "old_shard")]
    slim = staged(docs.select("doc_id", *added), "reshard-sizes").withColumn(PREFIX + "class", size_class)
    classes = staged(slim.groupBy(*named("old_shard", "class")).agg(F.sum(c("size")).alias("bytes")), "reshard-classes")
    sizes = {r[0]: r[1] for r in classes.groupBy(c("old_shard")).agg(F.sum("bytes")).collect()}  # one row per shard
    sizes = {-1 if k is None else k: v for k, v in sizes.items()}
    moves = plan(sizes, capacities or equal_capacities(sum(sizes.values()), shards))

    classes = classes.select(*named("old_shard", "class"), F.ceil(F.col("bytes") / F.lit(chunk_bytes)).alias(PREFIX + "n_chunks"))
    chunk = F.pmod(spread, c("n_chunks"))
    part = named("old_shard", "class", "bucket")
    totals = join_small(slim, classes, named("old_shard", "class")).groupBy(*named("old_shard", "class"), chunk.alias(PREFIX + "bucket")).agg(F.sum(c("size")).alias("bytes"))
    before = F.sum("bytes").over(W.partitionBy(c("old_shard")).orderBy(c("class").desc(), c("bucket")).rowsBetween(W.unboundedPreceding, -1))
    starts = staged(totals.select(*part, F.coalesce(before, F.lit(0)).alias(PREFIX + "chunk_start")), "reshard-chunks")

    rows = docs.select(*[docs[f"`{n}`"] for n in docs.columns], *added).withColumn(PREFIX + "class", size_class)
    rows = join_small(rows, classes, named("old_shard", "class"))
    rows = join_small(rows.withColumn(PREFIX + "bucket", chunk), starts, part)
    order = [c("size").desc(), F.col("doc_id"), c("text_crc32")]
    end = F.sum(c("size")).over(W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    middle = c("chunk_start") + c("end") - c("size") / 2
    target = F.lit(None).cast("int")
    for i, _, to, j in reversed(moves):
        target = F.when((F.coalesce(c("old_shard"), F.lit(-1)) == i) & (middle < to), j).otherwise(target)
    rows = rows.withColumn(PREFIX + "end", end).withColumn(PREFIX + "shard", target)
    rows = rows.withColumn(PREFIX + "rank", F.row_number().over(W.partitionBy(*part, c("shard")).orderBy(*order)))
    path = path or fresh_path(spark, "shards")
    touched = {k for i, _, _, j in moves if i != j for k in (i, j)}
    wrote = rows.drop(*named("n_chunks", "chunk_start", "end"))
    moved = c("shard").isin(*touched) if touched else F.lit(False)
    if touched >= set(range(shards)):
        wrote.write.partitionBy(PREFIX + "shard").parquet(path)
        new = spark.read.schema(wrote.schema).parquet(path)
    else:  # untouched shards keep the files they have
        wrote.where(moved).write.partitionBy(PREFIX + "shard").parquet(path)
        new = spark.read.schema(wrote.schema).parquet(path).unionByName(wrote.where(~moved))

    parts = [PREFIX + "shard", *part]
    counts = new.groupBy(*parts).agg(F.count("*").alias("n"))
    first = F.sum("n").over(W.partitionBy(c("shard")).orderBy(c("old_shard"), c("class").desc(), c("bucket")).rowsBetween(W.unboundedPreceding, -1))
    firsts = staged(counts.select(*parts, F.coalesce(first, F.lit(0)).alias(PREFIX + "first")), "reshard-slots")
    out = join_small(new, firsts, parts).withColumn(PREFIX + "slot", (c("first") + c("rank") - 1).cast("long"))
    return out.select(*[f"`{n}`" for n in docs.columns], *named("size", "text_crc32", "shard", "slot")), moves


def by_source(shards: int = 8) -> Column:
    """An old layout: documents lie where the hash of their source points, so shards are uneven."""
    return F.pmod(F.xxhash64("source"), F.lit(shards)).cast("int")


def report(rows: DataFrame) -> DataFrame:
    own = [F.col(PREFIX + n).alias(n) for n in ("size", "text_crc32", "shard", "slot")]
    size, crc, shard, slot = own
    return rows.select("doc_id", size, crc, F.lit("bytes").alias("law"), shard, slot, F.lit(None).cast("int").alias("grown_shard"))
