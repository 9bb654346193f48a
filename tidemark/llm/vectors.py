"""Operator 2, near-duplicate vectors by a robust-pruned flat graph.

1. Usable vectors (label and every component present, finite, not all zero) are collapsed to one row per
   (label, length, components); copies count as a weight. Vectors of different lengths never link.
2. Overlapping cluster shards: a group (at first a label and length) of more than ``shard_rows`` rows draws
   pivots by smallest hash, at most ``PIVOTS`` and no two that link, so that a tight cluster has one, and
   every row goes to the cells of its nearest ``overlap`` pivots that one of its links may be nearest to;
   cells that are still too large split again. Rows meet pivots in chunks of bounded size. A group with
   fewer than 2 * ``overlap`` such pivots (very many almost equal vectors), or a cell that does not shrink,
   is cut into tiles, and every pair of its tiles is searched: it costs more tasks but no larger ones.
3. In each tile a graph is built: candidates are the nearest ``CANDIDATES`` rows, and a candidate is pruned
   if a chosen neighbour is ``ALPHA`` times nearer to it than the row itself. A row's lists of all its
   tiles are united.
4. Search: every row walks the united graph of the tiles at hand, greedily with a beam, from the tiles'
   medoids and from its own place; then the range is expanded: neighbours of every row found above the
   threshold less ``SLACK`` are looked at until none is new. Similarities are double-precision cosines, so
   each link that is given is verified. A pair that meets in several shards counts in their first alone.
5. Across shards: a row found near that lies in a shard the query does not lie in opens the way there, as its
   united list names neighbours of that shard. Rows reached so, without a common shard, are verified too, and
   those that link are walked on from, until nothing new is found.
6. Tasks give counts and local components, and only the few links across shards as pairs; components are
   joined over all shards.
7. Audit: ``AUDIT`` rows drawn by hash are compared with all rows, block by block. Should recall, summed, or
   as the mean over rows or the least label's, fall below ``least_recall``, the search runs again with more
   overlap; beyond half of ``PIVOTS`` no group is split. If recall is still too low then, an error is raised.
   The figure is logged.

Nulls and the like: unusable rows have no links and are their own component, a null vec_id too; repeated
vec_ids are vectors of their own; copies link with each other; an empty table gives an empty result; other
columns are left out.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, fresh_path, join_small
from tidemark.llm.components import components

PIVOTS, CHUNK_ROWS, LEVELS = 64, 8192, 4
CANDIDATES, DEGREE, ALPHA, BEAM, SLACK = 48, 16, 1.2, 24, 0.02
AUDIT = 256

log = logging.getLogger(__name__)


def matrix(rows) -> np.ndarray:
    """Vectors of one length as unit rows in double precision."""
    x = np.array([np.asarray(r, dtype=np.float64) for r in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _shaped(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vector (array<double>), and whether the row can link."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("vector", lambda c: c != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), x.alias("vector"))
    return rows.withColumn("fine", F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))


def _pivots(rows: DataFrame, sizes: DataFrame, overlap: int, shard_rows: int, level: int, least: float) -> DataFrame:
    """grp, size, p: pivots of large groups, no two of which link."""
    rows = join_small(rows, sizes, ["grp"])
    draw = F.xxhash64(F.lit(level), "grp", "key")
    # cells hold each row ``overlap`` times and should come out at half the bound
    wish = F.least(F.lit(PIVOTS), F.ceil(2 * overlap * F.col("size") / F.lit(shard_rows))).cast("int")
    # about four times as many rows as pivots, of which those of the least hash are taken
    drawn = rows.where((draw.cast("double") + 2.0**63) / 2.0**64 < 4.0 * wish / F.col("size")).withColumn("draw", draw)
    drawn = drawn.groupBy("grp", "size").agg(F.slice(F.sort_array(F.collect_list(F.struct("draw", "vector"))), 1, 4 * PIVOTS)["vector"].alias("p"))

    def thin(parts):
        for pdf in parts:
            kept = []
            for own, most in zip(pdf["p"], pdf["wish"]):
                s = matrix(own) @ matrix(own).T
                at: list[int] = []
                for i in range(len(own)):
                    if len(at) < most and (s[i, at] < least - SLACK).all():
                        at.append(i)
                kept.append([own[i] for i in at])
            yield pdf.assign(p=kept)[["grp", "size", "p"]]

    return drawn.select("grp", "size", "p", wish.alias("wish")).mapInPandas(thin, "grp long, size long, p array<array<double>>")


def _split(rows: DataFrame, pivots: DataFrame, overlap: int, level: int, least: float) -> DataFrame:
    """Rows of the pivots' groups (key, grp, vector) in the groups of their nearest pivots' cells."""
    rows = join_small(rows, pivots.select("grp", "size"), ["grp"])
    n_chunks = F.ceil(F.col("size") / CHUNK_ROWS)
    pivots = pivots.select("grp", "p", F.explode(F.sequence(F.lit(0), n_chunks - 1)).alias("chunk"))
    pivots = pivots.select(F.col("grp").alias("of"), F.col("chunk").alias("part"), F.posexplode("p").alias("at", "pivot"))
    chunked = rows.select("key", "grp", "vector", F.pmod(F.xxhash64(F.lit(-level), "key"), n_chunks).alias("chunk"))
    reach = 2 * np.arccos(least)  # a linked row's nearest pivot is at most so much farther than the own one

    def assign(key, own, piv):
        import pandas as pd
        from xxhash import xxh64_intdigest

        if not len(own):
            return pd.DataFrame({"key": [], "grp": [], "vector": []})
        piv = piv.sort_values("at")
        s = matrix(own["vector"]) @ matrix(piv["pivot"]).T
        near = np.argsort(-s, axis=1, kind="stable")[:, :overlap]
        far = np.arccos(np.clip(np.take_along_axis(s, near, axis=1), -1, 1))
        i, j = np.nonzero(far <= far[:, :1] + reach + 1e-6)
        name = np.array([xxh64_intdigest(f"{key[0]}/{level}/{a}") >> 1 for a in range(len(piv))], dtype=np.int64)
        vectors = own["vector"].tolist()
        return pd.DataFrame({"key": own["key"].to_numpy()[i], "grp": name[near[i, j]], "vector": [vectors[a] for a in i]})

    return chunked.groupBy("grp", "chunk").cogroup(pivots.groupBy("of", "part")).applyInPandas(assign, "key long, grp long, vector array<double>")


def shards(rows: DataFrame, overlap: int, shard_rows: int, least: float, staged: Scratch) -> DataFrame:
    """(key, grp, vector): every row in one or more groups; groups beyond ``shard_rows`` are left only
    where splitting does not help."""
    done, open_, level = None, rows, 0
    while True:
        sizes = staged(open_.groupBy("grp").agg(F.count("*").alias("size")), "vectors-sizes")
        large = sizes.where(F.col("size") > shard_rows)
        if level >= LEVELS or not large.limit(1).count():
            return open_ if done is None else done.unionByName(open_)
        level += 1
        own = overlap if level == 1 else max(2, -(-overlap // 2))
        pivots = staged(_pivots(open_, large, own, shard_rows, level, least), "vectors-pivots").where(F.size("p") >= 2 * own)
        if not pivots.limit(1).count():
            return open_ if done is None else done.unionByName(open_)
        whole = join_small(open_, pivots.select("grp"), ["grp"], "left_anti")
        done = whole if done is None else done.unionByName(whole)
        open_ = staged(_split(open_, pivots, own, level, least).dropDuplicates(["key", "grp"]), "vectors-split")


def robust_lists(x: np.ndarray) -> np.ndarray:
    """(rows, DEGREE) neighbours of each unit row by robust pruning, -1 where there are fewer."""
    n = len(x)
    k = min(CANDIDATES, n - 1)
    out = np.full((n, DEGREE), -1, dtype=np.int64)
    if k < 1:
        return out
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    cand = np.argpartition(-s, k - 1, axis=1)[:, :k]
    own = np.take_along_axis(s, cand, axis=1)
    order = np.argsort(-own, axis=1, kind="stable")
    cand, own = np.take_along_axis(cand, order, axis=1), np.take_along_axis(own, order, axis=1)
    far = np.sqrt(np.maximum(2 - 2 * own, 0))  # Euclidean distance of unit rows
    alive = np.ones((n, k), dtype=bool)
    every = np.arange(n)
    for d in range(min(DEGREE, k)):
        first = alive.argmax(axis=1)
        some = alive[every, first]
        pick = cand[every, first]
        out[some, d] = pick[some]
        alive[every, first] = False
        between = np.sqrt(np.maximum(2 - 2 * s[pick[:, None], cand], 0))
        alive &= ~(ALPHA * between <= far)
        if not alive.any():
            break
    return out


def search(x: np.ndarray, lists: list[np.ndarray], medoids: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, found), query != found, of cosine >= ``least``; every row of ``x`` is a query."""
    n = len(x)
    degree = max(1, max(map(len, lists)))
    near = np.full((n, degree), -1, dtype=np.int64)
    for i, own in enumerate(lists):
        near[i, : len(own)] = own
    seen = np.zeros((n, n), dtype=bool)
    every = np.arange(n)

    def similar(q: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.empty(len(q))
        for a in range(0, len(q), 200_000):
            out[a : a + 200_000] = np.einsum("ij,ij->i", x[q[a : a + 200_000]], x[y[a : a + 200_000]])
        return out

    found_q, found_y = [], []

    def keep(q, y, s):
        at = (s >= least - SLACK) & (q != y)
        found_q.append(q[at])
        found_y.append(y[at])

    # greedy: the beam of each query, nearest first
    starts = np.concatenate([np.repeat(medoids[None, :], n, axis=0), every[:, None]], axis=1)
    beam = np.full((n, BEAM), -1, dtype=np.int64)
    score = np.full((n, BEAM), -np.inf)
    beam[:, : min(BEAM, starts.shape[1])] = starts[:, -BEAM:]
    on = beam >= 0
    q, y = np.nonzero(on)[0], beam[on]
    score[on] = similar(q, y)
    seen[q, y] = True
    open_ = on.copy()
    keep(q, y, score[on])
    for _ in range(4 * BEAM):
        best = np.where(open_, score, -np.inf)
        at = best.argmax(axis=1)
        go = np.flatnonzero(np.isfinite(best[every, at]))
        if not len(go):
            break
        open_[go, at[go]] = False
        nb = near[beam[go, at[go]]]
        q = np.repeat(go, nb.shape[1])
        y = nb.ravel()
        new = y >= 0
        q, y = q[new], y[new]
        new = ~seen[q, y]
        q, y = q[new], y[new]
        flat = np.unique(q * n + y)
        q, y = flat // n, flat % n
        if not len(q):
            continue
        seen[q, y] = True
        s = similar(q, y)
        keep(q, y, s)
        # merge into the beams
        rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        width = int(rank.max()) + 1
        more = np.full((n, width), -1, dtype=np.int64)
        score_more = np.full((n, width), -np.inf)
        more[q, rank], score_more[q, rank] = y, s
        rows = np.unique(q)
        b = np.concatenate([beam[rows], more[rows]], axis=1)
        t = np.concatenate([score[rows], score_more[rows]], axis=1)
        o = np.concatenate([open_[rows], more[rows] >= 0], axis=1)
        top = np.argsort(-t, axis=1, kind="stable")[:, :BEAM]
        beam[rows], score[rows], open_[rows] = (np.take_along_axis(z, top, axis=1) for z in (b, t, o))
    # range expansion
    q, y = np.concatenate(found_q), np.concatenate(found_y)
    while len(q):
        next_q, next_y = [], []
        step = max(1, 2_000_000 // degree)
        for a in range(0, len(q), step):
            nb = near[y[a : a + step]]
            qq, yy = np.repeat(q[a : a + step], degree), nb.ravel()
            new = yy >= 0
            qq, yy = qq[new], yy[new]
            new = ~seen[qq, yy]
            flat = np.unique(qq[new] * n + yy[new])
            qq, yy = flat // n, flat % n
            seen[qq, yy] = True
            s = similar(qq, yy)
            at = (s >= least - SLACK) & (qq != yy)
            next_q.append(qq[at])
            next_y.append(yy[at])
        q, y = np.concatenate(next_q), np.concatenate(next_y)
        found_q.append(q)
        found_y.append(y)
    q, y = np.concatenate(found_q), np.concatenate(found_y)
    flat = np.unique(np.concatenate([q * n + y, y * n + q]))  # the relation is symmetric
    q, y = flat // n, flat % n
    at = similar(q, y) >= least
    return q[at], y[at]


def _lowest(keys: np.ndarray, q: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest key each row reaches by the pairs."""
    root = keys.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, q, root[y])
        if (before == root).all():
            return root


def _links(rows: DataFrame, least: float, overlap: int, shard_rows: int, staged: Scratch) -> tuple[DataFrame, DataFrame]:
    """key, links (weight of other rows linked), local root, and rows near by that lead to other shards: one row
    per row and tile pair; and the nodes: key, vector, united list, groups, weight."""
    placed = staged(shards(rows.select("key", F.shiftrightunsigned(F.xxhash64("label", F.size("vector")), 1).alias("grp"), "vector"), overlap, shard_rows, least, staged), "vectors-placed")
    sizes = placed.groupBy("grp").agg(F.count("*").alias("size"))
    tiled = join_small(placed, staged(sizes, "vectors-groups"), ["grp"])
    n_tiles = F.ceil(F.col("size") / F.lit(shard_rows))
    tiled = staged(tiled.select("key", "grp", "vector", n_tiles.alias("n_tiles"), F.pmod(F.xxhash64(F.lit(99), "key"), n_tiles).alias("tile")), "vectors-tiles")

    def build(key, own):
        import pandas as pd

        lists = robust_lists(matrix(own["vector"]))
        keys = own["key"].to_numpy()
        return pd.DataFrame({"key": keys, "near": [keys[z[z >= 0]] for z in lists]})

    lists = tiled.groupBy("grp", "tile").applyInPandas(build, "key long, near array<long>")
    # united lists, with the row's groups; both are bounded by the overlap
    lists = lists.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    groups = placed.groupBy("key").agg(F.sort_array(F.collect_set("grp")).alias("grps"))
    united = staged(lists.join(groups, "key").join(rows.select("key", "vector", "weight"), "key"), "vectors-nodes")
    nodes = tiled.join(united.drop("vector"), "key")
    pairs = nodes.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1)))
    pairs = pairs.select("grp", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "key", "vector", "near", "grps", "weight")

    def look(key, own):
        import pandas as pd

        own = own.sort_values("key", ignore_index=True)
        keys, tile, weight = own["key"].to_numpy(), own["tile"].to_numpy(), own["weight"].to_numpy()
        x = matrix(own["vector"])
        at = {k: i for i, k in enumerate(keys.tolist())}
        near = [{at[k] for k in z.tolist() if k in at} for z in own["near"]]
        listed = np.array([(i, k) for i, z in enumerate(near) for k in z], dtype=np.int64).reshape(-1, 2)
        for i, z in enumerate([set(z) for z in near]):  # edges go both ways
            for k in z:
                near[k].add(i)
        near = [np.fromiter(sorted(z), dtype=np.int64, count=len(z)) for z in near]
        medoids = np.array([np.flatnonzero(tile == t)[(x[tile == t] @ x[tile == t].mean(axis=0)).argmax()] for t in np.unique(tile)])
        q, y = search(x, near, medoids, least)
        if key[1] != key[2]:  # pairs in one tile belong to that tile's own task
            across = tile[q] != tile[y]
            q, y = q[across], y[across]
        width = max(map(len, own["grps"]))
        g = np.full((len(own), width), -1, dtype=np.int64)
        for i, z in enumerate(own["grps"]):
            g[i, : len(z)] = z
        links = np.zeros(len(own), dtype=np.int64)
        for a in range(0, len(q), 200_000):
            b, c = q[a : a + 200_000], y[a : a + 200_000]
            gb = np.where(g[b] < 0, np.iinfo(np.int64).max, g[b])
            both = (gb[:, :, None] == g[c][:, None, :]).any(axis=2)
            first = np.where(both, gb, np.iinfo(np.int64).max).min(axis=1) == key[0]
            np.add.at(links, b[first], weight[c[first]])
        ways: list[list[int]] = [[] for _ in range(len(own))]
        for a in range(0, len(listed), 200_000):
            b, c = listed[a : a + 200_000].T
            beyond = ((g[c][:, :, None] != g[b][:, None, :]).all(axis=2) & (g[c] >= 0)).any(axis=1)
            b, c = b[beyond], c[beyond]
            close = np.einsum("ij,ij->i", x[b], x[c]) >= least - SLACK
            for i, k in zip(b[close].tolist(), keys[c[close]].tolist()):
                ways[i].append(k)
        return pd.DataFrame({"key": keys, "links": links, "root": _lowest(keys, q, y), "ways": ways})

    return pairs.groupBy("grp", "i", "j").applyInPandas(look, "key long, links long, root long, ways array<long>"), united


def across(links: DataFrame, nodes: DataFrame, least: float, staged: Scratch) -> DataFrame:
    """(a, b), a < b: links of rows that share no shard, found by walking united lists from rows near by.

    A row has at most as many ways as its united list has entries, and each leads to as many rows.
    """

    def verified(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            pdf = part.to_pandas()
            hit = [bool((matrix([x]) @ matrix([y]).T)[0, 0] >= least) for x, y in zip(pdf["va"], pdf["vb"])]
            yield pa.RecordBatch.from_pandas(pdf.loc[hit, ["a", "b"]], preserve_index=False)

    front = links.select(F.col("key").alias("x"), F.explode("ways").alias("y")).distinct()
    lists = nodes.select(F.col("key").alias("y"), F.explode("near").alias("z"))
    tried = found = None
    while True:
        step = front.join(lists, "y").where("x <> z").select(F.least("x", "z").alias("a"), F.greatest("x", "z").alias("b")).distinct()
        if tried is not None:
            step = step.join(tried, ["a", "b"], "left_anti")
        for k in "ab":
            step = step.join(nodes.select(F.col("key").alias(k), F.col("vector").alias(f"v{k}"), F.col("grps").alias(f"g{k}")), k)
        step = staged(step.where((F.size("va") == F.size("vb")) & ~F.arrays_overlap("ga", "gb")).select("a", "b", "va", "vb"), "vectors-step")
        new = staged(step.mapInArrow(verified, "a long, b long"), "vectors-across")
        tried = step.select("a", "b") if tried is None else tried.unionByName(step.select("a", "b"))
        found = new if found is None else found.unionByName(new)
        if not new.limit(1).count():
            return found
        front = new.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(new.select(F.col("b").alias("x"), F.col("a").alias("y")))


def audit(rows: DataFrame, links: DataFrame, least: float) -> float:
    """Recall of the links of at most AUDIT rows drawn by hash, which are compared with all rows, in blocks:
    the summed one, the mean over rows or the least label's, whichever is less."""
    drawn = rows.select("key", "label", "vector").orderBy(F.xxhash64(F.lit(7), "key")).limit(AUDIT).collect()
    if not drawn:
        return 1.0
    by: dict[tuple[str, int], list] = {}
    for r in drawn:
        by.setdefault((r["label"], len(r["vector"])), []).append(r)
    queries = {k: (np.array([r["key"] for r in own]), matrix([r["vector"] for r in own])) for k, own in by.items()}

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        total: dict[int, int] = {}
        for part in parts:
            pdf = part.to_pandas()
            pdf["size"] = pdf["vector"].map(len)
            for k, own in pdf.groupby(["label", "size"]):
                if k in queries:
                    keys, x = queries[k]
                    hit = (matrix(own["vector"]) @ x.T >= least) & (own["key"].to_numpy()[:, None] != keys[None, :])
                    for i, n in zip(keys.tolist(), (hit * own["weight"].to_numpy()[:, None]).sum(axis=0).tolist()):
                        total[i] = total.get(i, 0) + n
        yield pa.RecordBatch.from_pandas(pd.DataFrame({"key": list(total), "n": list(total.values())}, dtype="int64"), preserve_index=False)

    true = dict(rows.select("key", "label", "vector", "weight").mapInArrow(compare, "key long, n long").groupBy("key").agg(F.sum("n")).where("sum(n) > 0").collect())
    ids = F.broadcast(rows.sparkSession.createDataFrame([(r["key"],) for r in drawn], "key long"))
    found = dict(links.join(ids, "key", "left_semi").groupBy("key").agg(F.sum("links")).collect())
    if not true:
        return 1.0
    each = {k: (min(found.get(k, 0), n), n) for k, n in true.items()}
    labels: dict[str, list[int]] = {}
    for r in drawn:
        if r["key"] in each:
            sums = labels.setdefault(r["label"], [0, 0])
            sums[0] += each[r["key"]][0]
            sums[1] += each[r["key"]][1]
    of = lambda pairs: sum(f for f, _ in pairs) / sum(n for _, n in pairs)
    return min(of(each.values()), float(np.mean([f / n for f, n in each.values()])), *(f / n for f, n in labels.values()))


def near_duplicates(vectors: DataFrame, least: float = 0.93, overlap: int = 3, shard_rows: int = 1024, least_recall: float = 0.99) -> DataFrame:
    """Returns vec_id, n_links, component_id, kept, class_id (the smallest vec_id of equal vectors)."""
    shaped = _shaped(vectors)
    staged = Scratch(vectors.sparkSession)
    fine, equal = shaped.where("fine"), ["label", "vector"]
    # the key of a class is its smallest vec_id
    rows = staged(fine.groupBy(*equal).agg(F.min("vec_id").alias("key"), F.count("*").alias("weight")), "vectors-classes")
    # a vec_id of several vectors is a key of the first alone
    if rows.groupBy("key").count().where("count > 1").limit(1).count():
        first = rows.groupBy("key").agg(F.min(F.struct(*equal)).alias("_first"))
        high = F.shiftrightunsigned(F.xxhash64("key", *equal), 2).bitwiseOR(F.lit(1 << 62))
        rows = rows.join(first, "key").withColumn("low", F.col("key")).withColumn("key", F.when(F.col("_first") == F.struct(*equal), F.col("key")).otherwise(high)).drop("_first")
        rows = staged(rows, "vectors-keys")
    else:
        rows = rows.withColumn("low", F.col("key"))
    while True:
        links, nodes = _links(rows.drop("low"), least, overlap, shard_rows, staged)
        links = staged(links, "vectors-links")
        far = staged(across(links, nodes, least, staged), "vectors-far")
        both = far.select(F.col("a").alias("key"), F.col("b").alias("root")).unionByName(far.select(F.col("b").alias("key"), F.col("a").alias("root")))
        more = both.join(nodes.select(F.col("key").alias("root"), "weight"), "root").select("key", F.col("weight").alias("links"), "root")
        links = staged(links.drop("ways").unionByName(more), "vectors-all")
        recall = audit(rows, links, least)
        log.info("recall of links %.4f with %d shards to a row", recall, overlap)
        if recall >= least_recall:
            break
        if 2 * overlap > PIVOTS:
            raise RuntimeError(f"recall of links is {recall:.4f} without splitting, below {least_recall}")
        overlap *= 2
    sums = links.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(links.where("root <> key"), staged, "key", "root").withColumnRenamed("node", "key")
    classes = rows.join(sums, "key", "left").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    lows = classes.groupBy("root").agg(F.min("low").alias("component"))
    classes = classes.join(lows, "root")
    classes = classes.select(*equal, F.col("low").alias("key"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component")
    ids = fine.join(staged(classes, "vectors-found"), equal).select("vec_id", "n_links", "component", "key")
    rest = shaped.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"), F.col("vec_id").alias("key"))
    out = ids.unionByName(rest)
    out = out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("component").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"), F.col("key").alias("class_id"))
    path = fresh_path(vectors.sparkSession, "vectors-out")
    out.write.parquet(path)
    staged.clear()
    return vectors.sparkSession.read.schema(out.schema).parquet(path)
