"""Operator 6, mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of tokens: its documents, each with the end id, in the order of the staged
parts. Every window of ``window`` tokens credits each queue with its quantum, window * share, serves the
whole tokens of the credit and carries the fraction as the queue's deficit, across windows and partitions.
Every document is packed once.

Shares by size (no ``weights``): all queues run dry together. With Q(s) the tokens of sources 0..s and N all
tokens, the tokens served from sources 0..s before window w are C(s, w) = floor(w * window * Q(s) / N). Queue
s has then given C(s, w) - C(s - 1, w) tokens, which is its credit up to a deficit below one token, and the
tokens of a window add up to ``window`` exactly. So the round-robin needs no pass over windows one after
another: any task knows the deficits at any window from the totals alone. Only the last window is short.

C(s, w) - C(s - 1, w) never falls where a queue's quantum is one token or more, nor for the last queue.
Sources of a smaller quantum therefore share one queue, the last. A Huffman tree of their sizes orders
its tokens: of the first m tokens of a node, floor(m * L / T) come from its left child, which has L of the
node's T tokens, and the rest from the right one. Both grow with m by at most one at a time, so each token
has one place, found by going up the tree. An error at a node weighs as the source's share of the child,
and nodes' sizes grow at least as Fibonacci's numbers, so in any window such a source is within four tokens
of its share.

Target shares (``weights``): each named source is a queue, and all others together are one, mixed among
themselves by size as above. In a phase the live queues keep their shares: after b of its T tokens a queue
of D tokens has given floor(b * D / T), and the largest queue what is left of b. A phase ends with the last
whole window before a queue runs dry; in the next window that queue gives its rest and the others fill up by
their shares, which from then on are those of the queues left, scaled to one. Phases are few, two at most
for each weight, so they are settled beforehand from the queues' sizes alone.

Documents are encoded once, by parts of the input, and staged with their running token counts per source
in the part. The totals of (part, source), a slim table, give each part's place in each queue; it is
joined to the staged rows, and each row is cut into pieces where it lies. Ids are never shuffled.

Nulls and the like: a null text is empty (its document is the end id alone); a null source is a queue
of its own, after the others; repeated rows are documents of their own; an empty table gives no piece; a
weight of 0 has its queue wait until the others are dry; other columns are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import join_small, staged
from tidemark.llm.tokenize import batches, encoder

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, source string"


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, source, part, before (tokens of the source earlier in the part), n, ids (u32)."""

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, lib, seen = TaskContext.get().partitionId(), encoder(tokenizer), {}
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in rows:
            keys, texts, sources = (batch.column(i).to_pylist() for i in range(3))
            for a, b in batches(texts):
                ids = [x + end for x in lib.encode(texts[a:b])]
                before = []
                for s, x in zip(sources[a:b], ids):
                    before.append(seen.get(s, 0))
                    seen[s] = before[-1] + len(x) // 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[a:b], pa.int64()), pa.array(sources[a:b], pa.string()), pa.array([part] * len(ids), pa.int32()), pa.array(before, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "source", "part", "before", "n", "ids"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("source").cast("string").alias("source"))
    return rows.mapInArrow(encode, "doc_id long, source string, part int, before long, n long, ids binary")


def boundaries(w: np.ndarray, q: int, total: int, window: int) -> np.ndarray:
    """C(s, w): tokens of the sources up to s, q tokens in all, that lie before window w."""
    if window * int(w.max(initial=0)) * max(q, 1) < 2**62:
        return w * window * q // total
    return np.array([x * window * q // total for x in w.tolist()], dtype=np.int64)


def cut(start: int, n: int, below: int, upto: int, total: int, window: int) -> tuple[np.ndarray, ...]:
    """Pieces of a document at [start, start + n) of the queue whose tokens are [below, upto) of all:
    (first token in the queue, length, window, offset in the window)."""
    size = upto - below
    end = -(-total // window)
    first = max(0, start * total // (size * window) - 2)
    last = min(end, (start + n) * total // (size * window) + 2)
    w = np.arange(first, last + 1)
    low, high = (np.minimum(boundaries(w, q, total, window), q) for q in (below, upto))
    given = high - low  # of this queue before window w
    a, b = np.maximum(given[:-1], start), np.minimum(given[1:], start + n)
    at = np.flatnonzero(b > a)
    return a[at], (b - a)[at], w[at], (low[1:] - low[:-1])[at] + (a - given[:-1])[at]


def cut_many(start: np.ndarray, n: np.ndarray, below: np.ndarray, upto: np.ndarray, total: int, window: int) -> tuple[np.ndarray, ...]:
    """``cut`` of many documents at once, for totals whose square fits 62 bits: the document's number before
    the four. Pieces come in the order of the documents and of their tokens."""
    share = total / ((upto - below) * float(window))
    first = np.maximum((start * share).astype(np.int64) - 2, 0)
    k = np.minimum(((start + n) * share).astype(np.int64) + 2, -(-total // window)) - first + 1
    doc = np.repeat(np.arange(len(n)), k)
    w = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k) + first[doc]
    low, high = (np.minimum(w * window * q[doc] // total, q[doc]) for q in (below, upto))
    given = high - low
    a, b = np.maximum(given[:-1], start[doc[:-1]]), np.minimum(given[1:], (start + n)[doc[:-1]])
    at = np.flatnonzero((doc[:-1] == doc[1:]) & (b > a))
    return doc[at], a[at], (b - a)[at], w[at], (low[1:] - low[:-1])[at] + (a - given[:-1])[at]


def tree_paths(sizes: list[int]) -> list[list[int]]:
    """For each size its way up a Huffman tree: the left child's size (negative if it comes from the right
    child) and the node's size, node after node."""
    heap = [(n, i) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    up: dict[int, tuple[int, int, int]] = {}
    node = len(sizes)
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        up[x], up[y] = (node, a, a + b), (node, -a, a + b)
        heapq.heappush(heap, (a + b, node))
        node += 1
    out = []
    for i in range(len(sizes)):
        path: list[int] = []
        while i in up:
            i, left, size = up[i]
            path += [left, size]
        out.append(path)
    return out


def raised(k: np.ndarray, left: int, size: int) -> np.ndarray:
    """Places in a node of the tokens at the places ``k`` of its left child, or of its right one (-left)."""
    if size >= 2**31:
        k = k.astype(object)
    m = -(-(k + 1) * size // left) - 1 if left > 0 else k * size // (size + left)
    return m.astype(np.int64)


def scatter(start: int, n: int, path: list[int], pool: int, total: int, window: int) -> tuple[np.ndarray, ...]:
    """As ``cut``, for a document of a source in the shared queue, which has ``pool`` tokens and is the last."""
    k = np.arange(start, start + n, dtype=np.int64)
    p = k
    for left, size in zip(path[::2], path[1::2]):
        p = raised(p, left, size)
    w = (p if pool == total else raised(p, pool - total, total)) // window
    low, high = (np.minimum(boundaries(x, total - pool, total, window), total - pool) for x in (w, w + 1))
    offset = high - low + p - (w * window - low)
    new = np.flatnonzero((np.diff(p, prepend=-2) != 1) | (np.diff(w, prepend=-1) != 0))
    return k[new], np.diff(new, append=n), w[new], offset[new]


def one_window(left: list[int], shares: list[Fraction], room: int) -> list[int]:
    """Tokens of each queue in a window in which one runs dry: by share, then by the shares of those left."""
    given = [0] * len(left)
    while room and any(left):
        live = [g for g, n in enumerate(left) if n and shares[g]] or [g for g, n in enumerate(left) if n]
        total = sum(shares[g] for g in live)
        want = {g: room * shares[g] / total if total else Fraction(room, len(live)) for g in live}
        take = {g: min(left[g], want[g].__floor__()) for g in live}
        if not any(take.values()):  # less than a token each: the largest claim first
            take = {max(live, key=lambda g: (want[g], -g)): 1}
        for g, n in take.items():
            given[g], left[g], room = given[g] + n, left[g] - n, room - n
    return given


def phases(sizes: list[int], weights: list[float], window: int) -> list[tuple[int, list[int]]]:
    """Phases of the queues: first token of all, and the tokens that each queue gives in the phase."""
    if len(sizes) * (len(sizes) - 1) > window:
        raise ValueError("too many weighted queues for the window")
    left, at, out = list(sizes), 0, []
    every = [Fraction(w) for w in weights]
    while any(left):
        live = [w if n else Fraction(0) for w, n in zip(every, left)]
        if not any(live):  # queues of no weight come last, by size
            live = [Fraction(n) for n in left]
        shares = [w / sum(live) for w in live]
        # whole windows until the first queue has less than its share; the largest takes up what rounding leaves
        whole = min((max(0, n - len(left)) / (window * x)).__floor__() for n, x in zip(left, shares) if x)
        if whole:
            given = [(whole * window * x).__floor__() for x in shares]
            given[given.index(max(given))] += whole * window - sum(given)
            left = [n - d for n, d in zip(left, given)]
        else:
            given = one_window(left, shares, window)
        out.append((at, given))
        at += sum(given)
    return out


def place(plan: list[tuple[int, list[int]]], g: int, start: int, n: int, window: int):
    """Pieces of the tokens [start, start + n) of queue g: (first token in the queue, length, window, offset)."""
    done = 0
    for at, given in plan:
        a, b = max(start, done), min(start + n, done + given[g])
        if a < b:
            total, filler = sum(given), given.index(max(given))
            k = np.arange(-(-total // window) + 1)
            if total > window:  # the windows that can hold the tokens
                k = k[max(0, (a - done) * total // (given[g] * window) - 2 - len(given)) : (b - done) * total // (given[g] * window) + 3 + len(given)]
            ends = np.minimum(k * window, total)
            before = [boundaries(k, d, total, window) if total > window else ends * d // total for d in given]
            before[filler] = ends - sum(x for s, x in enumerate(before) if s != filler)
            own = before[g] + done
            x, y = np.maximum(own[:-1], a), np.minimum(own[1:], b)
            skipped = sum(before[s][1:] - before[s][:-1] for s in range(g)) if g else np.zeros(len(x), dtype=np.int64)
            for i in np.flatnonzero(y > x).tolist():
                yield int(x[i]), int(y[i] - x[i]), at // window + int(k[i]), int(skipped[i] + x[i] - own[i])
        done += given[g]


def _shared(sources: DataFrame) -> DataFrame:
    """source, path, pool: the sources whose quantum is below one token."""

    def paths(own):
        own = own.sort_values(["size", "source"], na_position="last")
        return own.assign(path=tree_paths([int(n) for n in own["size"]]), pool=int(own["size"].sum()))[["source", "path", "pool"]]

    return sources.groupBy().applyInPandas(paths, "source string, path array<long>, pool long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = 1024, weights: dict[str | None, float] | None = None, other: float = 1.0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, u32), doc_tokens, sequence_id, offset, source.

    ``weights`` are the target shares of named sources, up to a factor, and ``other`` that of all others
    together; without ``weights`` every source has the share of its tokens.
    """
    rows = staged(encoded(docs, tokenizer, end_id), "pack-ids")
    held = staged(rows.groupBy("part", "source").agg(F.sum("n").alias("held")), "pack-parts")
    names = list(weights or {})
    group = F.lit(len(names))
    for g, name in enumerate(names):
        group = F.when(F.col("source").eqNullSafe(F.lit(name)), g).otherwise(group)
    sizes = held.groupBy("source").agg(F.sum("held").alias("size")).withColumn("grp", group)
    sizes = staged(sizes.withColumn("total", F.sum("size").over(W.partitionBy("grp"))), "pack-sizes")
    plan: list[tuple[int, list[int]]] = []
    if weights is not None:
        have = dict(sizes.groupBy("grp").agg(F.sum("size")).collect())  # one row per weight
        plan = phases([have.get(g, 0) for g in range(len(names) + 1)], [*weights.values(), other], window)
    small = (F.col("size") * F.lit(window) < F.col("total")) & (F.col("grp") == len(names))
    upto = F.sum("size").over(W.partitionBy("grp").orderBy(F.col("source").asc_nulls_last()))
    sources = sizes.where(~small).select("source", "grp", upto.alias("upto"), (upto - F.col("size")).alias("below"), "total", F.lit(None).cast("array<long>").alias("path"), F.lit(None).cast("long").alias("pool"))
    none = F.lit(None).cast("long")
    shared = join_small(sizes.where(small), staged(_shared(sizes.where(small)), "pack-shared"), ["source"])
    sources = sources.unionByName(shared.select("source", "grp", none.alias("upto"), none.alias("below"), "total", "path", "pool"))
    # places of the parts in a queue: a running sum over at most one row per part
    first = F.coalesce(F.sum("held").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = join_small(held.select("part", "source", first.alias("first")), staged(sources, "pack-sources"), ["source"])
    placed = join_small(rows, staged(places, "pack-places"), ["part", "source"])
    placed = placed.select("doc_id", "source", "grp", (F.col("first") + F.col("before")).alias("start"), "n", "ids", "below", "upto", "total", "path", "pool")

    def cuts(grp: int, start: int, n: int, below, upto_, total: int, path, pool) -> tuple[list, ...]:
        """First token in the source's queue, length, window and offset of the document's pieces."""
        if not plan:
            found = cut(start, n, below, upto_, total, window) if pool is None else scatter(start, n, path, pool, total, window)
            return tuple(x.tolist() for x in found)
        if grp < len(names):
            own = [(start, n, start)]
        else:  # the place among the other sources is the place in their common queue
            found = cut(start, n, below, upto_, total, window) if pool is None else scatter(start, n, path, pool, total, window)
            own = [(a, m, w * window + o) for a, m, w, o in zip(*(x.tolist() for x in found))]
        out = [(a + x - at, m, w, o) for a, k, at in own for x, m, w, o in place(plan, grp, at, k, window)]
        return tuple(map(list, zip(*out)))

    names_out = [x.split()[0] for x in PIECES.split(", ")]

    def at_once(part: pa.RecordBatch) -> pa.RecordBatch:
        """Pieces of a batch whose documents are all in queues of their own, by size."""
        start, n, below, upto_ = (part.column(part.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n", "below", "upto"))
        doc, at, length, w, offset = cut_many(start, n, below, upto_, part.column(part.schema.get_field_index("total"))[0].as_py(), window)
        of = pa.array(doc)
        # the pieces of a document follow each other, so their ids are the documents' ids, cut anew
        ids = b"".join(part.column(part.schema.get_field_index("ids")).to_pylist())
        ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32) * 4
        cut_ids = pa.BinaryArray.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(ids)])
        take = lambda c: part.column(part.schema.get_field_index(c)).take(of)
        return pa.RecordBatch.from_arrays([take("doc_id"), pa.array(at - start[doc]), pa.array(length), cut_ids, take("n"), pa.array(w), pa.array(offset), take("source")], names=names_out)

    def pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not plan and part.num_rows and part.column(part.schema.get_field_index("pool")).null_count == part.num_rows and part.column(part.schema.get_field_index("total"))[0].as_py() < 2**31:
                # slices of some million ids, so that no buffer grows with the longest texts of a batch
                size = np.cumsum(part.column(part.schema.get_field_index("n")).to_numpy(zero_copy_only=False)) >> 22
                at = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), part.num_rows]
                for a, b in zip(at, at[1:]):
                    yield at_once(part.slice(a, b - a))
                continue
            cols = part.to_pydict()
            for a in range(0, part.num_rows, 256):
                out: list[list] = [[] for _ in range(8)]
                for key, source, grp, start, n, ids, *rest in zip(*(cols[c][a : a + 256] for c in part.schema.names)):
                    at, length, w, offset = cuts(grp, start, n, *rest)
                    k = len(at)
                    out[0] += [key] * k
                    out[1] += [x - start for x in at]
                    out[2] += length
                    out[3] += [ids[4 * (x - start) : 4 * (x - start + m)] for x, m in zip(at, length)]
                    out[4] += [n] * k
                    out[5] += w
                    out[6] += offset
                    out[7] += [source] * k
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=names_out)

    return placed.mapInArrow(pieces, PIECES)


def sequences(pieces: DataFrame, pad_id: int = 0, window: int = 1024) -> DataFrame:
    """The sequences themselves: sequence_id, ids (array<long> of ``window`` ids), n_tokens without padding."""

    def assemble(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("offset")
        ids = np.frombuffer(b"".join(pdf["ids"]), dtype="<u4").astype(np.int64)
        return pd.DataFrame({"sequence_id": [key[0]], "ids": [np.pad(ids, (0, window - len(ids)), constant_values=pad_id)], "n_tokens": [len(ids)]})

    return pieces.groupBy("sequence_id").applyInPandas(assemble, "sequence_id long, ids array<long>, n_tokens long")


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")
